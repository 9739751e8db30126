"""SHACL: shapes compiled to set operations over the data, and rules run to a fixpoint.

Shapes are gathered to the driver behind a check of their size; the data stays distributed.  A shape is
compiled to the DataFrame of its violations over a DataFrame of focus nodes, so nested shapes (node, and,
or, xone, not, qualified) are anti and semi joins with the conforming set.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.sparql import E, compare
from ..namespaces import CLASS, FIRST, NIL, RDFS, REST, SH, SUBCLASS, TYPE, iri
from ..plans.compile import Compiler, run_query
from .closure import checkpoint, transitive

SHAPE_TRIPLES = 500_000
#: The report's text spells out so many results; its table holds all of them.
REPORT_LINES = 10_000
REPORT = ["focus_node", "result_path", "value", "component", "source_shape", "severity", "message"]
RDFS_CLASS = iri(RDFS + "Class")
SEVERITIES = {"Info": 0, "Warning": 1, "Violation": 2}


def sh(name: str) -> str:
    return iri(SH + name)


class Shapes:
    """Shapes on the driver: subject -> predicate -> objects."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.of: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in sorted(set(rows)):
            self.of[s][p].append(o)

    @classmethod
    def gather(cls, triples: DataFrame) -> "Shapes":
        """Everything but the plain instance data: what shapes can reach is small."""
        rows = triples.limit(SHAPE_TRIPLES + 1).collect()
        if len(rows) > SHAPE_TRIPLES:
            raise ValueError(f"the shapes graph has more than {SHAPE_TRIPLES} triples; pass the shapes apart from the data")
        return cls([tuple(r) for r in rows])

    def get(self, s: str, name: str) -> list[str]:
        return self.of[s][sh(name)] if s in self.of else []

    def one(self, s: str, name: str) -> str | None:
        got = self.get(s, name)
        return got[0] if got else None

    def items(self, head: str) -> list[str]:
        out, seen = [], set()
        while head != NIL and head in self.of:
            if head in seen:
                raise ValueError(f"a list runs in a circle: {head}")
            seen.add(head)
            out.append(self.of[head][FIRST][0])
            head = self.of[head][REST][0]
        return out

    def targets(self) -> list[str]:
        """Active shapes with a target."""
        kinds = [sh(n) for n in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")]
        out = []
        for s, props in list(self.of.items()):
            implicit = (sh("NodeShape") in props[TYPE] or sh("PropertyShape") in props[TYPE]) and (CLASS in props[TYPE] or RDFS_CLASS in props[TYPE])
            if any(props.get(k) for k in kinds) or implicit:
                if not any(terms.lexical(x) == "true" for x in props.get(sh("deactivated"), [])):
                    out.append(s)
        return sorted(out)

    def path(self, node: str) -> tuple:
        """Path tuple of a SHACL path node."""
        props = self.of.get(node, {})
        if props.get(FIRST):
            return ("seq", [self.path(x) for x in self.items(node)])
        for name, kind in (("inversePath", "inv"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "opt")):
            if props.get(sh(name)):
                return (kind, self.path(props[sh(name)][0]))
        if props.get(sh("alternativePath")):
            return ("alt", [self.path(x) for x in self.items(props[sh("alternativePath")][0])])
        return ("iri", node)

    def path_text(self, node: str) -> str:
        def show(p) -> str:
            if p[0] == "iri":
                return p[1]
            if p[0] in ("seq", "alt"):
                return "(" + ("/" if p[0] == "seq" else "|").join(show(x) for x in p[1]) + ")"
            return {"inv": "^", "star": "", "plus": "", "opt": ""}[p[0]] + show(p[1]) + {"inv": "", "star": "*", "plus": "+", "opt": "?"}[p[0]]

        return show(self.path(node))

    def prefixes(self, node: str) -> dict[str, str]:
        out = {}
        for owner in self.get(node, "prefixes"):
            for d in self.get(owner, "declare"):
                out[terms.lexical(self.one(d, "prefix"))] = terms.lexical(self.one(d, "namespace"))
        return out


class Validator:
    def __init__(self, triples: DataFrame, shapes: Shapes):
        self.triples, self.shapes, self.spark = triples, shapes, triples.sparkSession
        self.compiler = Compiler(self.spark, triples)
        types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("class"))
        up = transitive(triples.where(F.col("p") == SUBCLASS).select("s", "o")).select(F.col("s").alias("class"), F.col("o").alias("up"))
        self.instances = types.union(types.join(up, "class").select("node", F.col("up").alias("class"))).distinct()
        self.nested: list[str] = []

    def of_class(self, c: str) -> DataFrame:
        return self.instances.where(F.col("class") == c).select("node")

    def focus(self, shape: str) -> DataFrame:
        """Distinct focus nodes of a shape's targets."""
        S, props = self.shapes, self.shapes.of[shape]
        parts = [self.of_class(c) for c in S.get(shape, "targetClass")]
        if CLASS in props[TYPE] or RDFS_CLASS in props[TYPE]:
            parts.append(self.of_class(shape))
        parts += [self.triples.where(F.col("p") == p).select(F.col("s").alias("node")) for p in S.get(shape, "targetSubjectsOf")]
        parts += [self.triples.where(F.col("p") == p).select(F.col("o").alias("node")) for p in S.get(shape, "targetObjectsOf")]
        if S.get(shape, "targetNode"):
            parts.append(self.spark.createDataFrame([(n,) for n in S.get(shape, "targetNode")], "node string"))
        return reduce(DataFrame.union, parts).distinct()

    def values(self, focus: DataFrame, shape: str) -> DataFrame:
        """(node, value): distinct values of a shape's path, or the nodes themselves."""
        path = self.shapes.of[shape].get(sh("path"))
        if not path:
            return focus.select("node", F.col("node").alias("value"))
        pairs = self.compiler.pairs(self.shapes.path(path[0]), None).select(F.col("s").alias("node"), F.col("o").alias("value"))
        return focus.join(pairs, "node").distinct()

    def conforming(self, nodes: DataFrame, shape: str) -> DataFrame:
        """Those of the distinct nodes (column node) that a shape accepts."""
        if shape in self.nested:
            raise ValueError(f"recursive shape: {shape}")
        self.nested.append(shape)
        bad = self.violations(nodes, shape)
        self.nested.pop()
        return nodes if bad is None else nodes.join(bad.select(F.col("focus_node").alias("node")).distinct(), "node", "left_anti")

    def violations(self, focus: DataFrame, shape: str) -> DataFrame | None:
        """Report rows of a shape over focus nodes; None if it has no constraint."""
        S = self.shapes
        if any(terms.lexical(x) == "true" for x in S.get(shape, "deactivated")):
            return None
        props = S.of[shape]
        path = props.get(sh("path"))
        path_text = S.path_text(path[0]) if path else None
        severity = terms.lexical(S.one(shape, "severity") or sh("Violation")).removeprefix(SH)
        message = terms.lexical(S.one(shape, "message")) if S.one(shape, "message") else None
        values = self.values(focus, shape)
        out: list[DataFrame] = []

        def report(df: DataFrame, component: str, text: str, value=F.col("value")) -> None:
            out.append(df.select(F.col("node").alias("focus_node"), F.lit(path_text).cast("string").alias("result_path"), value.cast("string").alias("value"), F.lit(component).alias("component"), F.lit(shape).alias("source_shape"), F.lit(severity).alias("severity"), F.lit(message or text).alias("message")))

        none = F.lit(None)
        v = F.col("value")
        distinct_values = values.select(F.col("value").alias("node")).distinct()

        def failing(good: DataFrame) -> DataFrame:
            """Pairs whose value isn't among the good nodes."""
            return values.join(good.select(F.col("node").alias("value")), "value", "left_anti")

        for c in S.get(shape, "class"):
            report(failing(self.of_class(c)), "class", f"value must be an instance of {c}")
        for d in S.get(shape, "datatype"):
            ok = terms.datatype(v) == terms.lexical(d)
            name = terms.lexical(d).rpartition("#")[2]
            if name in terms.NUMERIC:
                ok = ok & terms.num(v).isNotNull() & ~(F.lit(name in terms.WHOLE) & ~F.rlike(terms.lex(v), F.lit("^[+-]?[0-9]+$")))
            elif name == "boolean":
                ok = ok & terms.lex(v).isin("true", "false", "0", "1")
            elif name == "date":
                ok = ok & F.rlike(terms.lex(v), F.lit("^-?[0-9]{4}-[0-9]{2}-[0-9]{2}"))
            report(values.where(~F.coalesce(ok, F.lit(False))), "datatype", f"value must have datatype {d}")
        for k in S.get(shape, "nodeKind"):
            name = terms.lexical(k).removeprefix(SH)
            ok = F.lit(False)
            for part, test in (("IRI", terms.is_iri(v)), ("BlankNode", terms.is_blank(v)), ("Literal", terms.is_literal(v))):
                if part in name:
                    ok = ok | test
            report(values.where(~ok), "nodeKind", f"value must be of kind {name}")
        if S.get(shape, "minCount") or S.get(shape, "maxCount"):
            counts = focus.join(values.groupBy("node").agg(F.count("*").alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
            for x in S.get(shape, "minCount"):
                report(counts.where(F.col("n") < int(terms.lexical(x))), "minCount", f"fewer than {terms.lexical(x)} values", none)
            for x in S.get(shape, "maxCount"):
                report(counts.where(F.col("n") > int(terms.lexical(x))), "maxCount", f"more than {terms.lexical(x)} values", none)
        for name, op in (("minInclusive", ">="), ("minExclusive", ">"), ("maxInclusive", "<="), ("maxExclusive", "<")):
            for x in S.get(shape, name):
                ok = compare(op, E("term", v), E("term", F.lit(x))).col & terms.is_literal(v)
                report(values.where(~F.coalesce(ok, F.lit(False))), name, f"value must be {op} {terms.lexical(x)}")
        for name, op in (("minLength", 1), ("maxLength", -1)):
            for x in S.get(shape, name):
                report(values.where(terms.is_blank(v) | ((F.length(terms.lex(v)) - int(terms.lexical(x))) * op < 0)), name, f"length must respect {name} {terms.lexical(x)}")
        for x in S.get(shape, "pattern"):
            flags = terms.lexical(S.one(shape, "flags") or '""')
            regex = (f"(?{flags})" if flags else "") + terms.lexical(x)
            report(values.where(terms.is_blank(v) | ~F.rlike(terms.lex(v), F.lit(regex))), "pattern", f"value must match {terms.lexical(x)}")
        for x in S.get(shape, "languageIn"):
            langs = [terms.lexical(y).lower() for y in S.items(x)]
            ok = reduce(lambda a, b: a | b, [(terms.lang(v) == y) | terms.lang(v).startswith(y + "-") for y in langs], F.lit(False))
            report(values.where(~F.coalesce(ok, F.lit(False))), "languageIn", f"language must be one of {', '.join(langs)}")
        if any(terms.lexical(x) == "true" for x in S.get(shape, "uniqueLang")):
            twice = values.withColumn("lang", terms.lang(v)).where("lang <> ''").groupBy("node", "lang").agg(F.count("*").alias("n")).where("n > 1")
            report(twice, "uniqueLang", "a language is used more than once", none)
        for x in S.get(shape, "hasValue"):
            report(focus.join(values.where(v == x).select("node"), "node", "left_anti"), "hasValue", f"must have value {x}", none)
        for x in S.get(shape, "in"):
            report(values.where(~v.isin(S.items(x))), "in", "value is not in the list")
        for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for p in S.get(shape, name):
                other = self.triples.where(F.col("p") == p).select(F.col("s").alias("node"), F.col("o").alias("value")).join(focus, "node", "left_semi")
                if name == "equals":
                    report(values.join(other, ["node", "value"], "left_anti").union(other.distinct().join(values, ["node", "value"], "left_anti")), name, f"values must equal those of {p}")
                elif name == "disjoint":
                    report(values.join(other, ["node", "value"], "left_semi"), name, f"values must differ from those of {p}")
                else:
                    op = "<" if name == "lessThan" else "<="
                    both = values.join(other.select("node", F.col("value").alias("other")), "node")
                    report(both.where(~F.coalesce(compare(op, E("term", v), E("term", F.col("other"))).col, F.lit(False))), name, f"value must be {op} that of {p}")
        for x in S.get(shape, "node"):
            report(failing(self.conforming(distinct_values, x)), "node", f"value must conform to {x}")
        for x in S.get(shape, "not"):
            report(values.join(self.conforming(distinct_values, x).select(F.col("node").alias("value")), "value"), "not", f"value must not conform to {x}")
        for name in ("and", "or", "xone"):
            for x in S.get(shape, name):
                parts = [self.conforming(distinct_values, y) for y in S.items(x)]
                counts = reduce(DataFrame.unionAll, parts).groupBy("node").agg(F.count("*").alias("n"))
                need = {"and": F.col("n") == len(parts), "or": F.col("n") > 0, "xone": F.col("n") == 1}[name]
                report(failing(counts.where(need)), name, f"value breaks sh:{name}")
        for x in S.get(shape, "property"):
            inner = self.violations(distinct_values, x)
            if inner is not None:
                if path:  # report against this shape's own focus nodes
                    report(values.join(inner.select(F.col("focus_node").alias("value")).distinct(), "value", "left_semi"), "property", f"value must conform to {x}")
                else:
                    out.append(inner)
        for x in S.get(shape, "qualifiedValueShape"):
            good = values.join(self.conforming(distinct_values, x).select(F.col("node").alias("value")), "value")
            if any(terms.lexical(y) == "true" for y in S.get(shape, "qualifiedValueShapesDisjoint")):
                siblings = {q for parent in S.of for y in S.get(parent, "property") if shape in S.get(parent, "property") and y != shape for q in S.get(y, "qualifiedValueShape")} - {x}
                for y in sorted(siblings):
                    good = good.join(self.conforming(distinct_values, y).select(F.col("node").alias("value")), "value", "left_anti")
            counts = focus.join(good.groupBy("node").agg(F.count("*").alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
            for y in S.get(shape, "qualifiedMinCount"):
                report(counts.where(F.col("n") < int(terms.lexical(y))), "qualifiedMinCount", f"fewer than {terms.lexical(y)} values conform to {x}", none)
            for y in S.get(shape, "qualifiedMaxCount"):
                report(counts.where(F.col("n") > int(terms.lexical(y))), "qualifiedMaxCount", f"more than {terms.lexical(y)} values conform to {x}", none)
        if any(terms.lexical(x) == "true" for x in S.get(shape, "closed")):
            allowed = [S.one(p, "path") for p in S.get(shape, "property") if S.one(p, "path")] + [y for x in S.get(shape, "ignoredProperties") for y in S.items(x)]
            extra = self.triples.join(distinct_values.select(F.col("node").alias("s")), "s", "left_semi").where(~F.col("p").isin(allowed))
            report(extra.select(F.col("s").alias("node"), F.col("o").alias("value")), "closed", "a property is not allowed")
        for x in S.get(shape, "sparql"):
            if any(terms.lexical(y) == "true" for y in S.get(x, "deactivated")):
                continue
            text = terms.lexical(S.one(x, "select"))
            if path:
                text = re.sub(r"\$PATH\b", S.path_text(path[0]), text)
            got = run_query(self.spark, text, self.triples, None, S.prefixes(x), focus.select(F.col("node").alias("this")))
            if "this" not in got.columns:
                continue
            words = F.lit(terms.lexical(S.one(x, "message") or S.one(shape, "message") or '"constraint is broken"'))
            for c in got.columns:
                for sign in "?$":
                    words = F.replace(words, F.lit("{" + sign + c + "}"), F.coalesce(terms.lex(F.col(c)), F.lit("")))
            level = terms.lexical(S.one(x, "severity") or S.one(shape, "severity") or sh("Violation")).removeprefix(SH)
            shown = F.col("path") if "path" in got.columns else F.lit(path_text).cast("string")
            value = F.col("value") if "value" in got.columns else F.col("this")
            out.append(got.distinct().select(F.col("this").alias("focus_node"), shown.alias("result_path"), value.alias("value"), F.lit("sparql").alias("component"), F.lit(shape).alias("source_shape"), F.lit(level).alias("severity"), words.alias("message")))
        return reduce(DataFrame.union, out) if out else None

    def report(self) -> DataFrame:
        parts = [x for s in self.shapes.targets() if (x := self.violations(self.focus(s), s)) is not None]
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT))
        return reduce(DataFrame.union, parts).distinct()


def violations(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Report rows of all shapes with targets."""
    return Validator(triples, Shapes.gather(shapes)).report()


def validate(graph, shapes=None, abort_on_first: bool = False, allow_warnings: bool = True, inference: str | None = None):
    """(conforms, report DataFrame, text) of a graph against shapes (a graph or a list of them; default: its own).

    Class shapes see subclass axioms of the shapes graph too.  The data graph is not changed.
    """
    parts = [graph] if shapes is None else list(shapes) if isinstance(shapes, (list, tuple)) else [shapes]
    shape_df = reduce(DataFrame.union, [g.df for g in parts]).distinct()
    data = graph.df if shapes is None else graph.df.union(shape_df.where(F.col("p") == SUBCLASS)).distinct()
    if inference:
        from ..graph import Graph
        from .reason import expand

        data = expand(Graph(data.union(shape_df)), inference).df
    report = checkpoint(violations(data, shape_df))
    fails = F.col("severity").isNotNull() if not allow_warnings else F.col("severity") == "Violation"
    ok = report.where(fails).isEmpty()
    if abort_on_first:  # the first result that fails, if one does
        report = report.orderBy(fails.desc(), "focus_node", "source_shape", "component", "value").limit(1)
    report = report.orderBy("focus_node", "source_shape", "component", "value")
    total = report.count()
    lines = [f"Conforms: {ok}", f"Results: {total}"]
    for r in report.limit(REPORT_LINES).collect():
        lines.append(f"- {r['severity']} {r['component']} at {r['focus_node']}" + (f" path {r['result_path']}" if r["result_path"] else "") + (f" value {r['value']}" if r["value"] else "") + f": {r['message']}")
    if total > REPORT_LINES:
        lines.append(f"- and {total - REPORT_LINES} more in the report table")
    return ok, report, "\n".join(lines)


def report_graph(report: DataFrame, conforms: bool) -> DataFrame:
    """Triples of a validation report."""
    spark = report.sparkSession
    head = "_:report"
    node = F.concat(F.lit("_:r"), F.md5(F.concat_ws("|", *REPORT)))
    parts = [report.select(F.lit(head).alias("s"), F.lit(sh("result")).alias("p"), node.alias("o")), report.select(node, F.lit(TYPE), F.lit(sh("ValidationResult")))]
    for name, c in (("focusNode", F.col("focus_node")), ("resultPath", F.col("result_path")), ("value", F.col("value")), ("sourceShape", F.col("source_shape"))):
        parts.append(report.where(c.isNotNull()).select(node, F.lit(sh(name)), c))
    parts.append(report.select(node, F.lit(sh("resultMessage")), terms.to_literal(F.col("message"))))
    parts.append(report.select(node, F.lit(sh("resultSeverity")), F.concat(F.lit("<" + SH), "severity", F.lit(">"))))
    top = spark.createDataFrame([(head, TYPE, sh("ValidationReport")), (head, sh("conforms"), terms.literal(bool(conforms)))], "s string, p string, o string")
    return reduce(DataFrame.union, parts, top)


# rules


def _rule_triples(v: Validator, S: Shapes, rule: str, focus: DataFrame) -> DataFrame:
    """What one rule derives over its focus nodes."""
    for condition in S.get(rule, "condition"):
        focus = v.conforming(focus, condition)
    text = S.one(rule, "construct")
    if text:
        return run_query(v.spark, terms.lexical(text), v.triples, None, S.prefixes(rule), focus.select(F.col("node").alias("this")))

    def expression(df: DataFrame, name: str, column: str) -> DataFrame:
        x = S.one(rule, name)
        if x == sh("this"):
            return df.withColumn(column, F.col("node"))
        if x in S.of and S.of[x].get(sh("path")):
            pairs = v.compiler.pairs(S.path(S.one(x, "path")), None).select(F.col("s").alias("node"), F.col("o").alias(column))
            return df.join(pairs, "node")
        return df.withColumn(column, F.lit(x))

    df = focus
    for name, column in (("subject", "s"), ("predicate", "p"), ("object", "o")):
        df = expression(df, name, column)
    return df.select("s", "p", "o").where(~terms.is_literal(F.col("s")) & terms.is_iri(F.col("p")))


def infer(graph, shapes=None, max_rounds: int = 100, keep_blank: bool = True, iterative: bool = True):
    """The graph with what the shapes' rules derive, run in ``sh:order`` until nothing is new.

    ``iterative``: False for one round only.  Rules that are still deriving after ``max_rounds`` (fresh blank nodes
    can go on for ever) raise.
    """
    from ..graph import Graph

    shapes = graph if shapes is None else shapes
    S = Shapes.gather(shapes.df)
    rules = []
    for s in S.targets():
        for r in S.get(s, "rule"):
            if not any(terms.lexical(x) == "true" for x in S.get(r, "deactivated")):
                rules.append((float(terms.lexical(S.one(r, "order") or '"0"')), s, r))
    rules.sort()
    axioms = shapes.df.where(F.col("p") == SUBCLASS)
    everything = checkpoint(graph.df.distinct())
    if not rules:
        return Graph(everything, graph.prefixes)
    for done in range(max_rounds + 1):
        if done == max_rounds:
            raise RuntimeError(f"the rules are still deriving after {max_rounds} rounds")
        grew = False
        for order in sorted({o for o, _, _ in rules}):
            v = Validator(everything.union(axioms).distinct(), S)
            found = [_rule_triples(v, S, r, v.focus(s)) for o, s, r in rules if o == order]
            new = reduce(DataFrame.union, found).distinct()
            if not keep_blank:
                new = new.where(~terms.is_blank(F.col("s")) & ~terms.is_blank(F.col("o")))
            new = checkpoint(new.join(everything, ["s", "p", "o"], "left_anti"))
            if not new.isEmpty():
                grew = True
                everything = checkpoint(everything.union(new))
        if not grew or not iterative:
            break
    return Graph(everything, graph.prefixes)
