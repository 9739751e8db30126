"""Tables and foreign graphs converted to triples by declarative operations.

A configuration holds ``namespace_prefixes``, ``operations`` (each with optional ``conditions`` and one of
``data``, ``query`` or ``template``), ``macros``, ``replace_dict`` and ``header_start``.  Operations aren't
run row by row: templates become column expressions, one ``explode`` makes the triples of all rows, and
conditions become filters.  Condition text is parsed, never evaluated.
"""

from __future__ import annotations

import ast
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.terms import TRIPLE
from ..namespaces import PREFIXES, SUBCLASS, TYPE
from ..plans.compile import Compiler, Solutions, template_triples
from ..plans.parser import Parser
from .closure import checkpoint, distinct, spread, transitive

ARGUMENT = re.compile(r"(?<!\{)\{([^{}]+)\}(?!\})")
MARK = re.compile(r"ZZ(\d+)ZZ")
#: Triples that an operation makes of a row, about.
ROW_TRIPLES = 16
TRUE, FALSE = ["TRUE", "true", "True", "on", "ON"], ["FALSE", "false", "False", "off", "OFF"]


def load_config(path: str) -> dict:
    """A JSON or YAML configuration; another kind of file gives an empty one with a warning."""
    import warnings

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    warnings.warn(f"unknown configuration format: {path}", stacklevel=2)
    return {}


def clean(c: Column, replace: dict[str, str] | None = None) -> Column:
    """A cell's text: numbers stay, whole ones without ``.0``; boolean words become True or False; in other texts
    patterns are replaced, then they are trimmed."""
    text = c
    for pattern, by in (replace or {}).items():
        text = F.regexp_replace(text, pattern, str(by))
    number = F.trim(c)
    whole = F.regexp_replace(number, r"^([+-]?[0-9]+)\.0+$", "$1")
    return F.when(F.rlike(number, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")), whole).when(c.isin(TRUE), "True").when(c.isin(FALSE), "False").otherwise(F.trim(text))


def clean_table(df: DataFrame, config: dict | None = None) -> DataFrame:
    """All cells cleaned; header names replaced and trimmed."""
    rules = (config or {}).get("replace_dict") or {}

    def head(name: str) -> str:
        for pattern, text in (rules.get("headers") or {}).items():
            name = re.sub(pattern, str(text), name)
        return name.strip()

    return df.select(*[clean(F.col(f"`{c}`").cast("string"), rules.get("values")).alias(head(c)) for c in df.columns])


# conditions


class Condition(ast.NodeVisitor):
    """Compiles a condition's syntax tree to a column; anything not listed here is an error."""

    def __init__(self, columns: list[Column]):
        self.columns = columns

    def text(self, s: str) -> Column:
        parts = MARK.split(s)
        if len(parts) == 1:
            return F.lit(s)
        return F.concat(*[self.columns[int(x)] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x or k % 2])

    def get(self, node: ast.AST):
        """A column, or a list of columns for tuples and lists."""
        if isinstance(node, ast.Expression):
            return self.get(node.body)
        if isinstance(node, ast.Constant):
            return self.text(node.value) if isinstance(node.value, str) else F.lit(node.value)
        if isinstance(node, ast.Name) and MARK.fullmatch(node.id):
            return self.columns[int(MARK.fullmatch(node.id)[1])]
        if isinstance(node, (ast.Tuple, ast.List, ast.Set)):
            return [self.get(x) for x in node.elts]
        if isinstance(node, ast.BoolOp):
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), [self.truth(x) for x in node.values])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.number(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
            a, b = self.number(node.left), self.number(node.right)
            return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}.get(type(node.op), F.try_divide(a, b))
        if isinstance(node, ast.Compare):
            out, left = F.lit(True), node.left
            for op, right in zip(node.ops, node.comparators):
                out = out & self.compare(op, left, right)
                left = right
            return out
        if isinstance(node, ast.Subscript):
            s = self.get(node.value)
            if isinstance(node.slice, ast.Slice) and node.slice.step is None:
                a, b = (self.index(x, s) for x in (node.slice.lower, node.slice.upper))
                start = F.lit(0) if a is None else a
                return F.substr(s, start + 1, F.greatest(F.lit(0), (F.length(s) if b is None else b) - start))
            at = self.index(node.slice, s)
            return F.substr(s, at + 1, F.lit(1))
        if isinstance(node, ast.Call) and not node.keywords:
            if isinstance(node.func, ast.Attribute):
                s, args = self.get(node.func.value), [self.get(x) for x in node.args]
                method = {"lower": F.lower, "upper": F.upper, "strip": F.trim, "startswith": F.startswith, "endswith": F.endswith}.get(node.func.attr)
                if method:
                    return method(s, *args)
            elif isinstance(node.func, ast.Name) and node.func.id in ("len", "int", "float", "str") and len(node.args) == 1:
                return {"len": lambda: F.length(self.get(node.args[0])), "str": lambda: self.get(node.args[0]).cast("string")}.get(node.func.id, lambda: self.number(node.args[0]))()
        raise ValueError(f"not allowed in a condition: {ast.dump(node)[:80]}")

    def index(self, node, s: Column) -> Column | None:
        if node is None:
            return None
        n = ast.literal_eval(node)
        return F.least(F.length(s), F.lit(n)) if n >= 0 else F.greatest(F.lit(0), F.length(s) + n)

    def number(self, node) -> Column:
        return self.get(node).try_cast("double")

    def numeric(self, node) -> bool:
        if isinstance(node, ast.Constant):
            return isinstance(node.value, (int, float)) and not isinstance(node.value, bool)
        return isinstance(node, (ast.BinOp, ast.UnaryOp)) or isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("len", "int", "float")

    def compare(self, op, left, right) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            a, b = self.get(left), self.get(right)
            hit = reduce(lambda x, y: x | y, [a.cast("string") == y.cast("string") for y in b], F.lit(False)) if isinstance(b, list) else F.contains(b, a)
            return ~hit if isinstance(op, ast.NotIn) else hit
        if self.numeric(left) or self.numeric(right):
            a, b = self.number(left), self.number(right)
        else:
            a, b = self.get(left).cast("string"), self.get(right).cast("string")
            x, y = a.try_cast("double"), b.try_cast("double")
            if isinstance(left, ast.Name) or isinstance(right, ast.Name):  # bare cells are numbers where both are
                both = x.isNotNull() & y.isNotNull()
                return F.when(both, self.apply(op, x, y)).otherwise(self.apply(op, a, b))
        return self.apply(op, a, b)

    def apply(self, op, a: Column, b: Column) -> Column:
        return {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}[type(op)]()

    def truth(self, node) -> Column:
        got = self.get(node)
        if isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) or isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("startswith", "endswith"):
            return got
        text = got.cast("string")
        return (F.length(text) > 0) & ~text.isin("False", "false", "0", "None")


def condition(text: str, row) -> Column:
    """Boolean column of a condition; false where a cell is missing or the comparison fails.

    A condition that is nothing but a cell or a string is true for true words, false for false words.
    """
    names: list[str] = []

    def mark(m) -> str:
        names.append(m[1].strip())
        return f"ZZ{len(names) - 1}ZZ"

    tree = ast.parse(ARGUMENT.sub(mark, text.strip()), mode="eval")
    columns = [row(n) for n in names]
    maker = Condition(columns)
    if isinstance(tree.body, (ast.Constant, ast.Name)):
        word = maker.get(tree.body).cast("string")
        got = F.when(word.isin(TRUE), True).when(word.isin(FALSE), False).otherwise((F.length(word) > 0) & ~word.isin("0", "None"))
    else:
        got = maker.truth(tree.body)
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns], F.lit(True))
    return present & F.coalesce(got, F.lit(False))


# templates


def _fill(term: str, columns: list[Column]) -> Column:
    """Term column of a term text with marks; spaces become underscores in IRIs."""
    parts = MARK.split(term)
    if len(parts) == 1:
        return F.lit(term)
    is_text = term.startswith('"')
    cells = [columns[int(x)] for x in parts[1::2]]
    if not is_text:
        cells = [F.regexp_replace(F.trim(c), r"[\s<>\"{}|\\^`]", "_") for c in cells]
    else:
        cells = [F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')) for c in cells]
    return F.concat(*[cells[k // 2] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x or k % 2])


def data_triples(df: DataFrame, text: str, prefixes: dict[str, str], row) -> DataFrame:
    """Triples of a ``data`` template over all rows that have every cell it names.

    ``row(name)`` gives a cell's column.
    """
    return distinct(_data(df, text, prefixes, row))


def _data(df: DataFrame, text: str, prefixes: dict[str, str], row) -> DataFrame:
    """The same with repeats."""
    names: list[str] = []

    def mark(m) -> str:
        names.append(m[1].strip())
        return f"ZZ{len(names) - 1}ZZ"

    quads = Parser("{" + ARGUMENT.sub(mark, text) + "}", prefixes).quads()
    columns = [row(n) for n in names]
    items = []
    for _, s, p, o in template_triples(quads):
        parts = []
        for x in (s, p, o):
            if x[0] == "var":  # a blank node of the template: one for each row
                parts.append(F.concat(F.lit("_:t"), F.md5(F.concat_ws("|", F.lit(x[1] + text), *columns))))
            else:
                parts.append(_fill(x[1], columns))
        items.append(F.struct(*[c.alias(n) for c, n in zip(parts, "spo")]))
    present = reduce(lambda a, b: a & b, [F.length(c) > 0 for c in columns], F.lit(True))
    out = df.where(present).select(F.explode(F.array(*items)).alias("t")).select("t.*")
    return out.where("s is not null and p is not null and o is not null")


def query_triples(df: DataFrame, text: str, prefixes: dict[str, str], row, triples: DataFrame) -> DataFrame:
    """``triples`` after a ``query`` operation (one or more updates) run for every row that has its cells.

    ``{name}`` stands for a cell, ``{{`` and ``}}`` for braces.  All rows see the same graph.
    """
    names: list[str] = []

    def mark(m) -> str:
        names.append(m[1].strip())
        return f"ZZ{len(names) - 1}ZZ"

    marked = ARGUMENT.sub(mark, text).replace("{{", "{").replace("}}", "}")
    updates = Parser(marked, prefixes).update()
    columns = [row(n) for n in names]
    made: dict[str, str] = {}

    def lift(x):
        """Terms with marks become variables that the rows bind."""
        if isinstance(x, list):
            return [lift(y) for y in x]
        if not isinstance(x, tuple):
            return x
        if len(x) == 2 and x[0] in ("term", "iri") and isinstance(x[1], str) and MARK.search(x[1]):
            return ("var", made.setdefault(x[1], f"row{len(made)}"))
        return tuple(lift(y) for y in x)

    for u in updates:
        u.where, u.delete, u.insert = lift(u.where), lift(u.delete), lift(u.insert)
    given = None
    if made:
        present = reduce(lambda a, b: a & b, [F.length(c) > 0 for c in columns], F.lit(True))
        rows = df.where(present).select(*[_fill(t, columns).alias("v_" + v) for t, v in made.items()]).distinct()
        given = Solutions(rows, set(made.values()), set())
    for u in updates:
        compiler = Compiler(triples.sparkSession, triples, None, given)
        solutions = compiler.group(compiler.unit(), u.where)
        if u.delete and u.insert:
            solutions.df = checkpoint(solutions.df)
        if u.delete:
            triples = triples.join(compiler.instantiate(solutions, [t[1:] for t in template_triples(u.delete)]), ["s", "p", "o"], "left_anti")
        if u.insert:
            triples = triples.union(compiler.instantiate(solutions, [t[1:] for t in template_triples(u.insert)])).distinct()
    return triples


MACRO = re.compile(r"\{%-?\s*macro\s+(\w+)\s*\(([^)]*)\)\s*-?%\}(.*?)\{%-?\s*endmacro\s*-?%\}", re.S)
CALL = re.compile(r"\{\{-?\s*(\w+)\((.*)\)\s*-?\}\}")
LOOP = re.compile(r"\{%-?\s*for\s+(\w+)\s+in\s+range\((.*?)\)\s*-?%\}(.*?)\{%-?\s*endfor\s*-?%\}", re.S)
WHEN = re.compile(r"\{%-?\s*if\s+(.*?)\s*-?%\}(.*?)(?:\{%-?\s*else\s*-?%\}(.*?))?\{%-?\s*endif\s*-?%\}", re.S)
CELL = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}")


def _arguments(text: str) -> list[str]:
    """Top-level arguments of a call."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        depth += (c in "([") - (c in ")]") if not quote else 0
        if c == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return out + [now.strip()] if now.strip() else out


def template_rows(df: DataFrame, text: str, macros: list[str], prefixes: dict[str, str], row) -> DataFrame:
    """Triples of a ``template``: macro calls, ``for`` over ``range``, ``if`` on a condition and ``{{ cell }}``."""
    return distinct(_template(df, text, macros, prefixes, row))


def _template(df: DataFrame, text: str, macros: list[str], prefixes: dict[str, str], row) -> DataFrame:
    """The same with repeats."""
    known = {m[1]: ([a.strip() for a in m[2].split(",") if a.strip()], m[3]) for x in macros for m in MACRO.finditer(x)}

    def call(m) -> str:
        if m[1] not in known:
            raise ValueError(f"unknown macro: {m[1]}")
        params, body = known[m[1]]
        values = dict(zip(params, _arguments(m[2])))
        swap = lambda s: re.sub(r"(?<![\w'\"])([A-Za-z_]\w*)(?![\w'\"])", lambda x: values.get(x[1], x[1]), s)
        return re.sub(r"\{\{.*?\}\}|\{%.*?%\}", lambda x: swap(x[0]), body, flags=re.S)

    text = CALL.sub(call, text)

    def plain(df: DataFrame, text: str, row) -> list[DataFrame]:
        """A stretch without loops."""
        hit = WHEN.search(text)
        if hit:
            test = condition(re.sub(r"value\[['\"](.*?)['\"]\]", r"{\1}", hit[1]), row)
            rest = text[: hit.start()] + "\n" + text[hit.end() :]
            return plain(df.where(test), hit[2], row) + (plain(df.where(~test), hit[3], row) if hit[3] else []) + plain(df, rest, row)
        fixed = CELL.sub(lambda m: m[1][1:-1] if m[1][:1] in "\"'" else "{" + re.sub(r"^value\[['\"](.*)['\"]\]$", r"\1", m[1]) + "}", text)
        return [_data(df, fixed, prefixes, row)] if fixed.strip() else []

    out, at = [], 0
    for m in LOOP.finditer(text):
        out += plain(df, text[at : m.start()], row)
        bounds = [F.lit(int(x)) if x.isdigit() else row(re.sub(r"^value\[['\"](.*)['\"]\]$", r"\1", x)).try_cast("int") for x in _arguments(m[2])]
        low, high = (F.lit(0), bounds[0]) if len(bounds) == 1 else bounds[:2]
        turns = df.where(high > low)
        n, total = turns.agg(F.count("*"), F.sum((high - low).cast("bigint"))).first()
        inner = spread(turns, -(-total // n) if n else 1).withColumn("loop_index", F.explode(F.sequence(low, high - 1))).withColumn("loop_index", F.col("loop_index").cast("string"))
        out += plain(inner, m[3], lambda n, v=m[1]: F.col("loop_index") if n == v else row(n))
        at = m.end()
    out += plain(df, text[at:], row)
    return reduce(DataFrame.union, out) if out else df.sparkSession.createDataFrame([], TRIPLE)


def rewrite_prefixes(config: dict, building: tuple[str, str] | None = None, site: tuple[str, str] | None = None) -> dict:
    """The configuration with ``bldg:`` and ``site:`` renamed to (prefix, namespace) of the caller."""
    text = json.dumps(config)
    prefixes = dict(config.get("namespace_prefixes") or {})
    for name, new in (("bldg", building), ("site", site)):
        if new:
            text = re.sub(rf"\b{name}:", f"{new[0]}:", text)
            prefixes[new[0]] = new[1]
    return json.loads(text) | {"namespace_prefixes": prefixes}


def convert_table(df: DataFrame, config: dict, triples: DataFrame | None = None) -> DataFrame:
    """Triples of a table under a configuration; operations run in order over all rows."""
    prefixes = {"bldg": "urn:tessera:site/"} | PREFIXES | (config.get("namespace_prefixes") or {})
    table = clean_table(spread(df, ROW_TRIPLES), config)
    names = {c.strip().lower(): c for c in table.columns}

    def row(name: str) -> Column:
        c = names.get(name.strip().lower())
        return F.col(f"`{c}`") if c else F.lit(None).cast("string")

    out = triples if triples is not None else df.sparkSession.createDataFrame([], TRIPLE)
    for op in config.get("operations") or []:
        rows = table
        for text in op.get("conditions") or []:
            rows = rows.where(condition(text, row))
        if op.get("data"):
            out = out.union(_data(rows, op["data"], prefixes, row))
        if op.get("template"):
            out = out.union(_template(rows, op["template"], config.get("macros") or [], prefixes, row))
        if op.get("query"):
            out = query_triples(rows, op["query"], prefixes, row, distinct(out))
    return distinct(out)


def convert_graph(triples: DataFrame, config: dict) -> tuple[DataFrame, list[str]]:
    """(triples after a configuration's queries, what failed): a failing operation is reported and skipped."""
    from .update import update_triples

    prefixes, failed = PREFIXES | (config.get("namespace_prefixes") or {}), []
    for op in config.get("operations") or []:
        text = op.get("query") or "INSERT DATA {" + op["data"] + "}"
        try:
            triples = checkpoint(update_triples(triples.sparkSession, text.replace("{{", "{").replace("}}", "}"), triples, prefixes))
        except ValueError as e:
            failed.append(f"{op.get('description', text[:60])}: {e}")
    return triples, failed


class Conversion:
    """Steps of a conversion; subclasses override what differs."""

    def __init__(self, spark, config: dict):
        self.spark, self.config, self.failed = spark, config, []

    def ingest(self, source) -> DataFrame:
        return source

    def translate(self, data: DataFrame) -> DataFrame:
        if set(data.columns) == {"s", "p", "o"}:
            out, self.failed = convert_graph(data, self.config)
            return out
        return convert_table(data, self.config)

    def infer(self, triples: DataFrame) -> DataFrame:
        return triples

    def clean_up(self, triples: DataFrame) -> DataFrame:
        return triples

    def run(self, source, building: tuple[str, str] | None = None, site: tuple[str, str] | None = None) -> DataFrame:
        self.config = rewrite_prefixes(self.config, building, site)
        return self.clean_up(self.infer(self.translate(self.ingest(source))))


def without_namespaces(triples: DataFrame, namespaces: list[str]) -> DataFrame:
    """Without triples that mention an IRI of the namespaces anywhere."""
    hit = reduce(lambda a, b: a | b, [F.startswith(F.col(c), F.lit("<" + n)) for c in "spo" for n in namespaces])
    return triples.where(~hit)


def minify(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Without types that a more specific asserted type implies; classes that reach each other stay."""
    edges = ontology.where(F.col("p") == SUBCLASS).select("s", "o")
    pairs = transitive(edges).where("s <> o")
    strict = pairs.join(pairs.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_anti")
    types = triples.where(F.col("p") == TYPE)
    low = types.select("s", F.col("o").alias("c")).join(strict.select(F.col("s").alias("c"), F.col("o").alias("up")), "c").select("s", F.lit(TYPE).alias("p"), F.col("up").alias("o"))
    return triples.join(low, ["s", "p", "o"], "left_anti").join(ontology, ["s", "p", "o"], "left_anti")


def translate_name(c: Column) -> Column:
    """Names of networked devices made safe for IRIs."""
    return F.translate(c, " -./", "____")


def device_triples(devices: DataFrame, namespace: str) -> DataFrame:
    """Triples of a device/point table (device, device_id, point, object_type, object_id, units)."""
    from ..namespaces import BLD, LABEL, iri

    device = F.concat(F.lit(f"<{namespace}"), translate_name(F.col("device")), F.lit(">"))
    point = F.concat(F.lit(f"<{namespace}"), translate_name(F.concat_ws("_", "device", "point")), F.lit(">"))
    items = [
        (device, TYPE, F.lit(iri(BLD + "NetworkDevice"))),
        (device, LABEL, terms.to_literal(F.col("device"))),
        (device, iri(BLD + "deviceInstance"), terms.typed(F.col("device_id"), "integer")),
        (point, iri(BLD + "objectOf"), device),
        (point, LABEL, terms.to_literal(F.col("point"))),
        (point, iri(BLD + "objectType"), terms.to_literal(F.col("object_type"))),
        (point, iri(BLD + "objectIdentifier"), terms.typed(F.col("object_id"), "integer")),
        (point, iri(BLD + "hasUnit"), terms.to_literal(F.col("units"))),
    ]
    structs = [F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in items]
    return devices.select(F.explode(F.array(*structs)).alias("t")).select("t.*").where("s is not null and o is not null").distinct()
