"""RDF terms as canonical N-Triples strings: Python constructors and Spark column expressions."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..namespaces import XSD

TRIPLE = T.StructType([T.StructField(c, T.StringType(), False) for c in "spo"])
QUAD = T.StructType([T.StructField(c, T.StringType(), False) for c in "gspo"])
NUMERIC = ["integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte", "negativeInteger", "nonPositiveInteger"]
WHOLE = [t for t in NUMERIC if t not in ("decimal", "double", "float")]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def literal(value, lang: str | None = None, datatype: str | None = None) -> str:
    """Term of a Python value; ``datatype`` is an IRI without brackets."""
    if lang:
        return f'"{escape(str(value))}"@{lang.lower()}'
    if datatype is None:
        for kind, name in ((bool, "boolean"), (int, "integer"), (float, "double"), (Decimal, "decimal"), (datetime, "dateTime"), (date, "date")):
            if isinstance(value, kind):
                datatype = XSD + name
                break
    text = str(value).lower() if isinstance(value, bool) else value.isoformat() if isinstance(value, date) else str(value)
    return f'"{escape(text)}"' + (f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


def unescape(text: str) -> str:
    import re

    plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else plain.get(m[1], m[1]), text, flags=re.S)


def lexical(term: str) -> str:
    """Text of a Python term: IRI without brackets, literal without quotes."""
    if term[:1] == "<":
        return term[1:-1]
    if term[:1] == '"':
        return unescape(term[1 : term.rindex('"')])
    return term


# column expressions


def _quote_at(t: Column) -> Column:
    """Position of the closing quote; neither language tags nor datatype IRIs hold quotes."""
    return F.length(t) - F.locate('"', F.reverse(t)) + 1


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lex(t: Column) -> Column:
    """Text of a term."""
    inner = F.substr(t, F.lit(2), _quote_at(t) - 2)
    plain = inner
    for code, char in (("\\\\", "\u0001"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).when(is_literal(t), F.when(F.contains(inner, F.lit("\\")), plain).otherwise(inner)).otherwise(t)


def lang(t: Column) -> Column:
    """Language tag, empty for other literals, null for non-literals."""
    return F.when(is_literal(t), F.regexp_extract(t, '"@([A-Za-z0-9-]+)$', 1))


def datatype(t: Column) -> Column:
    """Datatype IRI (text) of a literal."""
    given = F.regexp_extract(t, '"\\^\\^<([^<>"]*)>$', 1)
    return F.when(is_literal(t), F.when(given != "", given).when(lang(t) != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(XSD + "string"))


def num(t: Column) -> Column:
    """Number of a numeric literal, else null."""
    return F.regexp_extract(t, f'^"([^"]*)"\\^\\^<{XSD}(?:{"|".join(NUMERIC)})>$', 1).try_cast("double")


#: Integers and decimals count in this type: 26 digits before and 12 after the point.
EXACT = "decimal(38,12)"


def exact(t: Column) -> Column:
    """Exact number of an integer or decimal literal, else null (also beyond ``EXACT``'s range)."""
    names = [n for n in NUMERIC if n not in ("double", "float")]
    return F.regexp_extract(t, f'^"([^"]*)"\\^\\^<{XSD}(?:{"|".join(names)})>$', 1).try_cast(EXACT)


def instant(t: Column) -> Column:
    """Point in time of a date or dateTime literal; without a zone it is taken as UTC."""
    text = F.regexp_extract(t, f'^"(-?[0-9]{{4,}}-[0-9]{{2}}-[0-9]{{2}}(?:T[0-9:.]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?)"\\^\\^<{XSD}date(?:Time)?>$', 1)
    day = F.rlike(text, F.lit("^[^T]*$"))
    full = F.when(day, F.concat(F.substr(text, F.lit(1), F.lit(10)), F.lit("T00:00:00"), F.substr(text, F.lit(11), F.length(text)))).otherwise(text)
    zoned = F.when(F.rlike(full, F.lit("(Z|[+-][0-9]{2}:[0-9]{2})$")), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(text != "", zoned.try_cast("timestamp"))


def is_whole(t: Column) -> Column:
    return F.rlike(t, F.lit(f'\\^\\^<{XSD}({"|".join(WHOLE)})>$'))


_RANGES = {"byte": (-128, 127), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "unsignedByte": (0, 255), "unsignedShort": (0, 2**16 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "integer": (None, None)}
_FORMS = {"decimal": "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)", "double": "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN", "boolean": "true|false|0|1", "dateTime": "-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?", "date": "-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?", "hexBinary": "([0-9A-Fa-f]{2})*", "language": "[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*"}


def well_formed(t: Column) -> Column:
    """Whether a literal's text is one of its XSD type; true for other types and terms."""
    text = lex(t)
    of = lambda name: t.endswith(f'"^^<{XSD}{name}>')
    out = None
    for name, form in [*_FORMS.items(), ("float", _FORMS["double"])]:
        good = F.rlike(text, F.lit(f"^({form})$"))
        if name in ("date", "dateTime"):  # the day exists
            good = good & instant(t).isNotNull()
        out = F.when(of(name), good) if out is None else out.when(of(name), good)
    for name, (low, high) in _RANGES.items():
        value = text.try_cast("decimal(38,0)")
        good = F.rlike(text, F.lit("^[+-]?[0-9]+$"))
        for bound, ok in ((low, value >= F.lit(str(low)).cast("decimal(38,0)")), (high, value <= F.lit(str(high)).cast("decimal(38,0)"))):
            if bound is not None:
                good = good & F.coalesce(ok, F.lit(False))
        out = out.when(of(name), good)
    return out.otherwise(True)


def same_value(a: Column, b: Column) -> Column:
    """Whether two literals denote one value: equal terms, numbers or points in time."""
    return (a == b) | F.coalesce(exact(a) == exact(b), num(a) == num(b), instant(a) == instant(b), F.lit(False))


def local_name(t: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:`` of an IRI."""
    return F.regexp_extract(lex(t), "([^#/:]*)$", 1)


def to_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def to_literal(text: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    """Literal terms of a column (null stays null); numbers and booleans get their datatype's IRI when given."""
    body = text.cast("string")
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(code))
    return F.concat(F.lit('"'), body, F.lit('"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")))


def typed(text: Column, name: str) -> Column:
    """Literal of an XSD type whose text needs no escapes."""
    return F.concat(F.lit('"'), text.cast("string"), F.lit(f'"^^<{XSD}{name}>'))


def skolem(t: Column, authority: str = "urn:tessera:skolem/") -> Column:
    """IRIs for blank nodes; other terms pass."""
    return F.when(is_blank(t), F.concat(F.lit("<" + authority), F.replace(F.substr(t, F.lit(3), F.length(t)), F.lit(" "), F.lit("_")), F.lit(">"))).otherwise(t)


def unskolem(t: Column, authority: str = "urn:tessera:skolem/") -> Column:
    return F.when(t.startswith("<" + authority), F.concat(F.lit("_:"), F.substr(t, F.lit(len(authority) + 2), F.length(t) - len(authority) - 2))).otherwise(t)
