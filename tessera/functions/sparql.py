"""SPARQL expressions as Spark columns.

An expression is ``E(kind, col)``: ``term`` (canonical string), ``bool``, ``num`` (double; ``whole`` is a
boolean column telling integers, ``exact`` the value as a decimal where it is an integer or decimal) or ``str`` (plain text).  Errors are nulls, so SQL's three-valued logic is
SPARQL's error logic; a FILTER keeps rows that are true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..namespaces import XSD
from . import terms as t


@dataclass
class E:
    kind: str
    col: Column
    whole: Column | None = None
    exact: Column | None = None
    constant: str | None = None


def number_term(e: E) -> Column:
    """Literal of a number: integers and decimals exactly, others as doubles."""
    text = F.regexp_replace(F.regexp_replace(e.exact.cast("string"), "0+$", ""), "\\.$", ".0") if e.exact is not None else None
    out = t.typed(e.col.cast("string"), "double")
    if text is None:
        return out
    digits = e.exact.cast("decimal(38,0)").cast("string")
    known = t.typed(text, "decimal") if e.whole is None else F.when(e.whole, t.typed(digits, "integer")).otherwise(t.typed(text, "decimal"))
    return F.coalesce(known, out)


def as_term(e: E) -> Column:
    if e.kind == "term":
        return e.col
    if e.kind == "bool":
        return t.typed(e.col, "boolean")
    return number_term(e) if e.kind == "num" else t.to_literal(e.col)


def as_num(e: E) -> Column:
    return e.col if e.kind == "num" else t.num(as_term(e)) if e.kind == "term" else e.col.try_cast("double")


def as_exact(e: E) -> Column:
    """Exact number, null where the value is a double or none."""
    if e.kind == "num":
        return F.lit(None).cast(t.EXACT) if e.exact is None else e.exact
    return t.exact(as_term(e)) if e.kind == "term" else F.lit(None).cast(t.EXACT)


def as_str(e: E) -> Column:
    return e.col if e.kind == "str" else t.lex(as_term(e))


def as_bool(e: E) -> Column:
    """Effective boolean value."""
    if e.kind == "bool":
        return e.col
    if e.kind == "num":
        return e.col != 0
    if e.kind == "str":
        return F.length(e.col) > 0
    n = t.num(e.col)
    return F.when(n.isNotNull(), n != 0).when(e.col.endswith(f"^^<{XSD}boolean>"), t.lex(e.col).isin("true", "1")).when(t.is_literal(e.col), F.length(t.lex(e.col)) > 0)


def whole_of(e: E) -> Column:
    if e.kind == "num":
        return F.lit(False) if e.whole is None else e.whole
    return t.is_whole(as_term(e))


_TIME = re.compile(f'"[^"]*"\\^\\^<{XSD}date(Time)?>$')
_NUMBER = re.compile(f'"[^"]*"\\^\\^<{XSD}({"|".join(t.NUMERIC)})>$')


def compare(op: str, a: E, b: E) -> E:
    """Numbers by value, exactly where both are integers or decimals; times as points in time; other terms by text."""
    if a.kind == "bool" or b.kind == "bool":
        return E("bool", _apply(op, as_bool(a), as_bool(b)))
    numbers = lambda: F.coalesce(_apply(op, as_exact(a), as_exact(b)), _apply(op, as_num(a), as_num(b)))
    if a.kind == "num" or b.kind == "num":
        return E("bool", numbers())
    given = a.constant or b.constant or ""
    if a.kind == "str" or b.kind == "str":
        return E("bool", _apply(op, as_str(a), as_str(b)))
    same = op in ("=", "!=")
    text = _apply(op, as_term(a), as_term(b)) if same else _apply(op, as_str(a), as_str(b))
    if _NUMBER.match(given):  # what isn't a number differs from one, and has no order with it
        return E("bool", F.coalesce(numbers(), text) if same else numbers())
    times = lambda: _apply(op, t.instant(as_term(a)), t.instant(as_term(b)))
    if _TIME.match(given):
        return E("bool", F.coalesce(times(), text) if same else times())
    if given:  # an IRI or a text
        return E("bool", text)
    return E("bool", F.when(as_term(a) == as_term(b), _apply(op, F.lit(0), F.lit(0))).otherwise(F.coalesce(numbers(), times(), text)))


def _apply(op: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()


def math(op: str, a: E, b: E) -> E:
    x, y, m, n = as_num(a), as_num(b), as_exact(a), as_exact(b)
    whole = whole_of(a) & whole_of(b)
    # Spark cuts the scale of wide products and quotients, so narrower operands go first where they lose nothing
    short = lambda v: F.when(v.try_cast("decimal(18,6)") == v, v.try_cast("decimal(18,6)"))
    if op == "/":
        return E("num", F.try_divide(x, y), F.lit(False), F.coalesce(_fit(F.try_divide(short(m), short(n))), _fit(F.try_divide(m, n))))
    if op == "*":
        integers = F.when(whole, F.try_multiply(m.try_cast("decimal(19,0)"), n.try_cast("decimal(19,0)")))
        return E("num", x * y, whole, F.coalesce(_fit(integers), _fit(F.try_multiply(short(m), short(n))), _fit(F.try_multiply(m, n))))
    return E("num", x + y if op == "+" else x - y, whole, _fit((F.try_add if op == "+" else F.try_subtract)(m, n)))


def _fit(x: Column) -> Column:
    return x.try_cast(t.EXACT)


def _when(args: list[E]) -> E:
    return E("term", F.when(F.coalesce(as_bool(args[0]), F.lit(False)), as_term(args[1])).otherwise(as_term(args[2])))


def _regex(text: Column, pattern: E, flags: E | None) -> tuple[Column, Column]:
    p = as_str(pattern)
    if flags is not None:
        f = as_str(flags)
        p = F.when(F.length(f) > 0, F.concat(F.lit("(?"), f, F.lit(")"), p)).otherwise(p)
    return text, p


def _part(name: str):
    def get(a: list[E]) -> E:
        return _whole_num(F.regexp_extract(as_str(a[0]), name, 1).try_cast("int"))

    return get


def _keep_tag(a: E, text: Column) -> E:
    """String results keep the language tag of their argument."""
    if a.kind != "term":
        return E("str", text)
    tag = t.lang(a.col)
    return E("term", F.when(F.coalesce(tag, F.lit("")) != "", F.concat(t.to_literal(text), F.lit("@"), tag)).otherwise(t.to_literal(text)))


def _whole_num(col: Column) -> E:
    return E("num", col.cast("double"), F.lit(True), col.cast(t.EXACT))


def _same_number(f):
    return lambda a: E("num", f(as_num(a[0])).cast("double"), whole_of(a[0]), _fit(f(as_exact(a[0]))))


def _from_text(name: str):
    """Number of a literal's or text's characters, under a numeric type's name."""
    def get(a: list[E]) -> E:
        text = F.trim(as_str(a[0]))
        value = text.try_cast("double")
        if name == "integer":  # towards zero
            exact = F.coalesce(F.regexp_extract(text, "^([+-]?[0-9]+)(?:[.][0-9]*)?$", 1).try_cast(t.EXACT), value.try_cast("bigint").cast(t.EXACT))
            return E("num", exact.cast("double"), F.lit(True), exact)
        return E("num", value, F.lit(False), text.try_cast(t.EXACT) if name == "decimal" else None)

    return get


def _zone(a: list[E]) -> E:
    """Offset of a dateTime as a day-time duration."""
    zone = F.regexp_extract(as_str(a[0]), "T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    hours, minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    text = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), part(hours, "H"), part(minutes, "M"))
    nought = (zone == "Z") | ((hours == 0) & (minutes == 0))
    return E("term", F.when(zone != "", t.typed(F.when(nought, "PT0S").otherwise(text), "dayTimeDuration")))


FUNCTIONS = {
    "STR": lambda a: E("str", as_str(a[0])),
    "LANG": lambda a: E("str", t.lang(as_term(a[0]))),
    "DATATYPE": lambda a: E("term", t.to_iri(t.datatype(as_term(a[0])))),
    "IRI": lambda a: E("term", t.to_iri(as_str(a[0]))),
    "STRDT": lambda a: E("term", F.concat(t.to_literal(as_str(a[0])), F.lit("^^"), as_term(a[1]))),
    "STRLANG": lambda a: E("term", F.concat(t.to_literal(as_str(a[0])), F.lit("@"), F.lower(as_str(a[1])))),
    "BNODE": lambda a: E("term", F.concat(F.lit("_:b"), F.md5(as_str(a[0])))),
    "STRLEN": lambda a: _whole_num(F.length(as_str(a[0]))),
    "SUBSTR": lambda a: _keep_tag(a[0], F.substr(as_str(a[0]), as_num(a[1]).cast("int"), *([as_num(a[2]).cast("int")] if len(a) > 2 else []))),
    "UCASE": lambda a: _keep_tag(a[0], F.upper(as_str(a[0]))),
    "LCASE": lambda a: _keep_tag(a[0], F.lower(as_str(a[0]))),
    "CONTAINS": lambda a: E("bool", F.contains(as_str(a[0]), as_str(a[1]))),
    "STRSTARTS": lambda a: E("bool", F.startswith(as_str(a[0]), as_str(a[1]))),
    "STRENDS": lambda a: E("bool", F.endswith(as_str(a[0]), as_str(a[1]))),
    "STRBEFORE": lambda a: E("str", F.when(F.contains(as_str(a[0]), as_str(a[1])), F.substr(as_str(a[0]), F.lit(1), F.position(as_str(a[1]), as_str(a[0])) - 1)).otherwise("")),
    "STRAFTER": lambda a: E("str", F.when(F.contains(as_str(a[0]), as_str(a[1])), F.substr(as_str(a[0]), F.position(as_str(a[1]), as_str(a[0])) + F.length(as_str(a[1])), F.length(as_str(a[0])))).otherwise("")),
    "CONCAT": lambda a: E("str", F.concat(*[as_str(x) for x in a])),
    "ENCODE_FOR_URI": lambda a: E("str", F.replace(F.url_encode(as_str(a[0])), F.lit("+"), F.lit("%20"))),
    "REPLACE": lambda a: _keep_tag(a[0], F.regexp_replace(*_regex(as_str(a[0]), a[1], a[3] if len(a) > 3 else None), as_str(a[2]))),
    "REGEX": lambda a: E("bool", F.rlike(*_regex(as_str(a[0]), a[1], a[2] if len(a) > 2 else None))),
    "LANGMATCHES": lambda a: E("bool", F.when(as_str(a[1]) == "*", F.length(as_str(a[0])) > 0).otherwise((F.lower(as_str(a[0])) == F.lower(as_str(a[1]))) | F.startswith(F.lower(as_str(a[0])), F.concat(F.lower(as_str(a[1])), F.lit("-"))))),
    "ABS": _same_number(F.abs),
    "ROUND": _same_number(lambda x: F.floor(x + F.lit("0.5").cast("decimal(2,1)"))),
    "CEIL": _same_number(F.ceil),
    "FLOOR": _same_number(F.floor),
    "RAND": lambda a: E("num", F.rand(), F.lit(False)),
    "NOW": lambda a: E("term", t.typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")),
    "YEAR": _part("^(-?[0-9]{4})-"),
    "MONTH": _part("^-?[0-9]{4}-([0-9]{2})"),
    "DAY": _part("^-?[0-9]{4}-[0-9]{2}-([0-9]{2})"),
    "HOURS": _part("T([0-9]{2}):"),
    "MINUTES": _part("T[0-9]{2}:([0-9]{2})"),
    "SECONDS": lambda a: _from_text("decimal")([E("str", F.regexp_extract(as_str(a[0]), "T[0-9]{2}:[0-9]{2}:([0-9.]+)", 1))]),
    "TIMEZONE": _zone,
    "TZ": lambda a: E("str", F.regexp_extract(as_str(a[0]), "T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})?$", 1)),
    "MD5": lambda a: E("str", F.md5(as_str(a[0]))),
    "SHA1": lambda a: E("str", F.sha1(as_str(a[0]))),
    "SHA256": lambda a: E("str", F.sha2(as_str(a[0]), 256)),
    "SHA384": lambda a: E("str", F.sha2(as_str(a[0]), 384)),
    "SHA512": lambda a: E("str", F.sha2(as_str(a[0]), 512)),
    "COALESCE": lambda a: E("term", F.coalesce(*[as_term(x) for x in a])),
    "IF": _when,
    "ISIRI": lambda a: E("bool", t.is_iri(as_term(a[0]))),
    "ISBLANK": lambda a: E("bool", t.is_blank(as_term(a[0]))),
    "ISLITERAL": lambda a: E("bool", t.is_literal(as_term(a[0]))),
    "ISNUMERIC": lambda a: E("bool", t.num(as_term(a[0])).isNotNull()),
    "SAMETERM": lambda a: E("bool", as_term(a[0]) == as_term(a[1])),
    "BOUND": lambda a: E("bool", a[0].col.isNotNull()),
    "UUID": lambda a: E("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
    "STRUUID": lambda a: E("str", F.uuid()),
    **{f"<{XSD}{name}>": _from_text(name) for name in ("integer", "decimal", "double", "float")},
    f"<{XSD}boolean>": lambda a: E("bool", as_str(a[0]).isin("true", "1")),
    f"<{XSD}string>": lambda a: E("str", as_str(a[0])),
    f"<{XSD}dateTime>": lambda a: E("term", t.typed(as_str(a[0]), "dateTime")),
}
FUNCTIONS["URI"], FUNCTIONS["ISURI"] = FUNCTIONS["IRI"], FUNCTIONS["ISIRI"]


def variables(e) -> set[str]:
    """Names of the variables in an expression or path tuple, patterns of EXISTS excepted."""
    if isinstance(e, tuple):
        if e[:1] == ("var",):
            return {e[1]}
        if e[:1] == ("exists",):
            return set()
        return set().union(*[variables(x) for x in e]) if e else set()
    return set().union(*[variables(x) for x in e]) if isinstance(e, list) and e else set()


def compile_expr(e: tuple, at) -> E:
    """``at(name)`` gives the column of a variable or an exists/aggregate key."""
    kind = e[0]
    if kind == "var":
        return E("term", at(e[1]))
    if kind == "term":
        return E("term", F.lit(e[1]), constant=e[1])
    if kind in ("flag", "aggregate"):
        return e[1] if isinstance(e[1], E) else E("bool", at(e[1]))
    if kind in ("and", "or"):
        a, b = as_bool(compile_expr(e[1], at)), as_bool(compile_expr(e[2], at))
        return E("bool", a & b if kind == "and" else a | b)
    if kind == "not":
        return E("bool", ~as_bool(compile_expr(e[1], at)))
    if kind == "cmp":
        return compare(e[1], compile_expr(e[2], at), compile_expr(e[3], at))
    if kind == "in":
        left = compile_expr(e[1], at)
        out = F.lit(False)
        for x in e[2]:
            out = out | compare("=", left, compile_expr(x, at)).col
        return E("bool", out)
    if kind == "math":
        return math(e[1], compile_expr(e[2], at), compile_expr(e[3], at))
    if kind == "call":
        if e[1] not in FUNCTIONS:
            raise ValueError(f"unknown function: {e[1]}")
        return FUNCTIONS[e[1]]([compile_expr(x, at) for x in e[2]])
    raise ValueError(f"{kind} is not allowed here")
