"""SPARQL patterns and queries to DataFrames.

Solutions are a DataFrame with one nullable string column per variable.  ``certain`` holds the variables
that are never unbound: shared certain variables join by plain equality, so only variables that OPTIONAL,
UNION or VALUES may leave open need the wider compatible-mapping condition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.sparql import E, as_bool, as_exact, as_num, as_str, as_term, compile_expr, math, variables, whole_of
from ..namespaces import TYPE
from ..operators.closure import reachable, transitive
from .parser import Parser, Query


#: A path inside GRAPH with a variable is planned once a graph, for so many graphs at most.
PATH_GRAPHS = 256


def column_name(var: str) -> str:
    """Column of a variable; Spark ignores case in names, SPARQL doesn't."""
    mask = "".join("1" if c.isupper() else "0" for c in var)
    return "v_" + var.replace(".", "$") + ("_" + mask if "1" in mask else "")


def col(var: str):
    return F.col(f"`{column_name(var)}`")


@dataclass
class Solutions:
    """Solutions as a DataFrame; ``raw`` variables hold the bare integer key of an IRI, whose text before it is the value."""

    df: DataFrame
    certain: set[str]
    possible: set[str]
    raw: dict[str, str] = field(default_factory=dict)

    def at(self, name: str):
        if name not in self.certain | self.possible:
            return F.lit(None).cast("string")
        return spelled(col(name), self.raw.get(name))

    @property
    def all(self) -> set[str]:
        return self.certain | self.possible

    def only(self, names) -> "Solutions":
        names = [n for n in names if n in self.all]
        return Solutions(self.df.select(*[col(n) for n in names]), self.certain & set(names), self.possible & set(names), self.keys(names))

    def keys(self, names) -> dict[str, str]:
        return {n: self.raw[n] for n in names if n in self.raw}

    def plain(self, names=None) -> "Solutions":
        """With terms in place of bare keys (of ``names``, default all)."""
        names = set(self.raw) if names is None else set(names) & set(self.raw)
        if not names:
            return self
        df = self.df.withColumns({column_name(n): self.at(n) for n in names})
        return Solutions(df, self.certain, self.possible, {n: t for n, t in self.raw.items() if n not in names})


def spelled(c, before: str | None):
    """Term of a column: as it is, or an IRI around a bare key."""
    return c if before is None else F.concat(F.lit(before), c.cast("string"), F.lit(">"))


def _conjuncts(e: tuple) -> list[tuple]:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


class Compiler:
    """Compiles over ``triples`` (s, p, o), the default graph, and optionally ``quads`` (g, s, p, o)."""

    def __init__(self, spark: SparkSession, triples: DataFrame, quads: DataFrame | None = None, given: Solutions | None = None):
        self.spark, self.triples, self.quads, self.given = spark, triples, quads, given
        self.paths: dict = {}
        self.count = 0
        self.mapping = getattr(triples, "mapping", None)

    # patterns

    def unit(self) -> Solutions:
        if self.given is not None:
            return self.given
        return Solutions(self.spark.range(1).select(F.lit(None).cast("string").alias("unit")).select(), set(), set())

    def source(self, graph) -> DataFrame:
        """Triples of the active graph; a variable graph keeps its column g."""
        if graph is None:
            return self.triples
        if self.quads is None:
            raise ValueError("GRAPH needs a collection of named graphs")
        return self.quads if graph[0] == "var" else self.quads.where(F.col("g") == graph[1]).select("s", "p", "o")

    def scan(self, s: tuple, p: tuple, o: tuple, graph) -> Solutions:
        """One triple pattern whose predicate is a constant or a variable."""
        parts = [("s", s), ("p", p), ("o", o)] + ([("g", graph)] if graph and graph[0] == "var" else [])
        df, names = self.source(graph), {}
        for c, x in parts:
            if x[0] == "term":
                df = df.where(F.col(c) == x[1])
            elif x[1] in names:
                df = df.where(F.col(c) == F.col(names[x[1]]))
            else:
                names[x[1]] = c
        return Solutions(df.select(*[F.col(c).alias(column_name(v)) for v, c in names.items()]), set(names), set())

    def pairs(self, path: tuple, graph) -> DataFrame:
        """(s, o) of a path, bag semantics for sequences and alternatives."""
        kind = path[0]
        if kind == "iri":
            return self.source(graph).where(F.col("p") == path[1]).select("s", "o")
        if kind == "inv":
            return self.pairs(path[1], graph).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "seq":
            out = self.pairs(path[1][0], graph)
            for x in path[1][1:]:
                after = self.pairs(x, graph).select(F.col("s").alias("m"), F.col("o").alias("o2"))
                out = out.join(after, out["o"] == after["m"]).select("s", F.col("o2").alias("o"))
            return out
        if kind == "alt":
            if all(x[0] == "iri" for x in path[1]) and len({x[1] for x in path[1]}) == len(path[1]):
                return self.source(graph).where(F.col("p").isin([x[1] for x in path[1]])).select("s", "o")
            out = self.pairs(path[1][0], graph)
            for x in path[1][1:]:
                out = out.union(self.pairs(x, graph))
            return out
        if kind == "neg":
            ahead = self.source(graph).where(~F.col("p").isin(path[1])).select("s", "o")
            behind = self.source(graph).where(~F.col("p").isin(path[2])).select(F.col("o").alias("s"), F.col("s").alias("o"))
            return behind if path[2] and not path[1] else ahead.union(behind) if path[2] else ahead
        key = (repr(path), repr(graph))
        if key not in self.paths:
            inner = self.pairs(path[1], graph)
            closed = inner.distinct() if kind == "opt" else transitive(inner)
            if kind != "plus":
                triples = self.source(graph)
                nodes = triples.select("s").union(triples.select("o")).distinct()
                closed = closed.where("s <> o").union(nodes.select("s", F.col("s").alias("o")))
            self.paths[key] = closed
        return self.paths[key]

    def path_pattern(self, s: tuple, path: tuple, o: tuple, graph, starts: DataFrame | None = None) -> Solutions:
        """``starts`` (s): the subjects that are asked for, nodes of the graph; pairs of others may be left out."""
        if graph and graph[0] == "var":  # each graph has its own nodes and paths
            got, self.count = None, self.count + 1
            for r in self.quads.select("g").where("g <> ''").distinct().limit(PATH_GRAPHS + 1).collect():
                one = self.path_pattern(s, path, o, ("term", r[0]))
                here = F.lit(r[0])
                if graph[1] in one.all:
                    one = Solutions(one.df.where(col(graph[1]) == here), one.certain, one.possible)
                else:
                    one = Solutions(one.df.withColumn(column_name(graph[1]), here), one.certain | {graph[1]}, one.possible)
                got = [*(got or []), one]
            if got is None:
                names = variables((s, o, graph))
                return Solutions(self.quads.limit(0).select(*[F.col("s").alias(column_name(n)) for n in sorted(names)]), names, set())
            if len(got) > PATH_GRAPHS:
                raise ValueError(f"paths in every graph of more than {PATH_GRAPHS} graphs: name the graph")
            return self.union(got)
        pairs = None
        if path[0] in ("plus", "star") and (s[0] == "term" or o[0] == "term"):  # search from the constant end only
            back = s[0] != "term"
            inner = self.pairs(("inv", path[1]) if back else path[1], graph)
            seed = self.spark.createDataFrame([(o[1] if back else s[1],)], "s string")
            pairs = reachable(inner, seed)
            if path[0] == "star":
                pairs = pairs.union(seed.select("s", F.col("s").alias("o"))).distinct()
            if back:
                pairs = pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))
        if pairs is None and starts is not None and path[0] in ("plus", "star"):
            pairs = transitive(self.pairs(path[1], graph), starts=starts)
            if path[0] == "star":
                pairs = pairs.where("s <> o").union(starts.distinct().select("s", F.col("s").alias("o")))
        if pairs is None:
            pairs = self.pairs(path, graph)
        names = {}
        for c, x in (("s", s), ("o", o)):
            if x[0] == "term":
                pairs = pairs.where(F.col(c) == x[1])
            elif x[1] in names:
                pairs = pairs.where(F.col("s") == F.col("o"))
            else:
                names[x[1]] = c
        return Solutions(pairs.select(*[F.col(c).alias(column_name(v)) for v, c in names.items()]), set(names), set())

    def flatten(self, triples: list) -> list:
        """Sequences become chains of patterns, inverses swap ends, plain IRIs become terms."""
        out = []
        for s, p, o in triples:
            if p[0] == "iri":
                out.append((s, ("term", p[1]), o))
            elif p[0] == "inv":
                out += self.flatten([(o, p[1], s)])
            elif p[0] == "seq":
                self.count += 1
                nodes = [s, *[("var", f".p{self.count}_{k}") for k in range(len(p[1]) - 1)], o]
                out += self.flatten(list(zip(nodes[:-1], p[1], nodes[1:])))
            else:
                out.append((s, p, o))
        return out

    def star(self, s: tuple, pairs: list) -> Solutions | None:
        """Patterns of one subject over mapped tables: one scan a table.  None where that isn't the same as joining triples."""
        wanted = {p for p, _ in pairs}
        near = [m for m in self.mapping if wanted & set(m.properties)]
        if len(wanted) > 1 and not (all(m.unique for m in near) and len({m.kind for m in near}) == len(near)):
            return None
        parts = [x for m in near if wanted <= set(m.properties) and (x := self._rows(m, s, pairs)) is not None]
        if not parts:
            names = variables((s,)).union(*[variables((o,)) for _, o in pairs])
            return Solutions(self.triples.limit(0).select(*[F.col("s").alias(column_name(n)) for n in sorted(names)]), names, set())
        if len(parts) == 1:
            return parts[0]
        out = parts[0].plain()
        for x in parts[1:]:
            out = Solutions(out.df.union(x.plain().df.select(*out.df.columns)), out.certain, out.possible)
        return out

    def _rows(self, m, s: tuple, pairs: list) -> Solutions | None:
        """Rows of one mapped table that match; None if a constant rules all of them out."""
        df, found = m.df, {}
        for x, node in [(s, m.subject), *[(o, m.properties[p]) for p, o in pairs]]:
            if node.nullable:
                df = df.where(node.present())
            if x[0] == "term":
                test = node.equals(x[1])
                if test is None:
                    return None
                df = df.where(test)
            elif x[1] in found:
                other = found[x[1]]
                if node.before == other.before is not None:
                    df = df.where(node.bare() == other.bare())
                else:
                    df = df.where(node.term() == other.term())
            else:
                found[x[1]] = node
        raw = {v: node.before for v, node in found.items() if node.before is not None}
        return Solutions(df.select(*[(node.bare() if v in raw else node.term()).alias(column_name(v)) for v, node in found.items()]), set(found), set(), raw)

    def bgp(self, left: Solutions, triples: list, graph) -> Solutions:
        """Joins patterns, those of one subject first folded into one scan where tables are mapped: the most selective
        first, then those connected with what is bound."""
        todo: list[tuple[list, Solutions | None]] = []
        stars: dict = {}
        for t in self.flatten(triples):
            if self.mapping and graph is None and t[1][0] == "term":
                stars.setdefault(t[0], []).append(t)
            else:
                todo.append(([t], None))
        for s, members in stars.items():
            members = list(dict.fromkeys(members))
            whole = self.star(s, [(p[1], o) for _, p, o in members])
            if whole is not None:
                todo.append((members, whole))
            else:
                todo += [([t], self.star(s, [(t[1][1], t[2])])) for t in members]
        bound = set(left.all)

        def rank(item):
            names = set().union(*[variables(t) for t in item[0]])
            linked = bool(names & bound) or not bound
            constants = [(t[0][0] == "term") * 4 + (t[2][0] == "term") * 3 + (t[1][0] == "term") * (1 if t[1][1:] == (TYPE,) and t[2][0] != "term" else 2) for t in item[0]]
            return (linked, max(constants), sum(constants))

        out, nodes = left, set()  # nodes: variables bound to subjects or objects of the graph
        while todo:
            best = max(todo, key=rank)
            todo.remove(best)
            (first, *_), one = best
            if one is None and first[1][0] in ("term", "var"):
                one = self.scan(*first, graph)
            elif one is None:
                s = first[0]
                known = s[0] == "var" and first[2][0] == "var" and s[1] in nodes and s[1] not in out.raw and not (graph and graph[0] == "var")
                one = self.path_pattern(*first, graph, out.df.select(col(s[1]).alias("s")) if known else None)
            out = self.join(out, one)
            bound |= one.all
            nodes |= {x[1] for t in best[0] for x in (t[0], t[2]) if x[0] == "var"} & out.certain
        return out

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition=None) -> Solutions:
        """Compatible mappings of ``a`` and ``b``; ``how``: inner, left, semi, anti; ``condition`` sees both sides."""
        if not a.all and how == "inner" and not a.df.columns and self.given is None and condition is None and _is_unit(a):
            return b
        shared = sorted(a.all & b.all)
        mixed = {n for n in shared if a.raw.get(n) != b.raw.get(n)}
        a, b = a.plain(mixed), b.plain(mixed)
        plain = all(n in a.certain and n in b.certain for n in shared)
        if plain and condition is None and shared:
            kind = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how]
            df = a.df.join(b.df, [column_name(n) for n in shared], kind)
        else:
            right = b.df.select(*[col(n).alias("r_" + column_name(n)) for n in sorted(b.all)])
            on = F.lit(True)
            for n in shared:
                x, y = col(n), F.col(f"`r_{column_name(n)}`")
                same = x == y
                if n not in a.certain:
                    same = same | x.isNull()
                if n not in b.certain:
                    same = same | y.isNull()
                on = on & same

            def at(name):
                if name in b.all:
                    r = spelled(F.col(f"`r_{column_name(name)}`"), b.raw.get(name))
                    return F.coalesce(r, a.at(name)) if name in a.all else r
                return a.at(name)

            if condition is not None:
                on = on & F.coalesce(as_bool(compile_expr(condition, at)), F.lit(False))
            kind = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[how]
            df = a.df.join(right, on, kind)
            if how in ("inner", "left"):
                df = df.select(*[F.coalesce(col(n), F.col(f"`r_{column_name(n)}`")).alias(column_name(n)) if n in shared else col(n) for n in sorted(a.all)], *[F.col(f"`r_{column_name(n)}`").alias(column_name(n)) for n in sorted(b.all - a.all)])
        if how in ("semi", "anti"):
            return Solutions(df, a.certain, a.possible, a.raw)
        certain = a.certain | b.certain if how == "inner" else set(a.certain)
        return Solutions(df, certain, (a.all | b.all) - certain, b.raw | a.raw)

    def union(self, parts: list[Solutions]) -> Solutions:
        names = sorted(set().union(*[p.all for p in parts]))
        dfs = [p.df.select(*[p.at(n).alias(column_name(n)) for n in names]) if names else p.df for p in parts]
        out = dfs[0]
        for df in dfs[1:]:
            out = out.union(df)
        certain = set.intersection(*[p.certain for p in parts])
        return Solutions(out, certain, set(names) - certain)

    def split(self, group: list) -> tuple[list, list]:
        """Patterns and top-level filter conjuncts of a group."""
        filters = [c for e in group if e[0] == "filter" for c in _conjuncts(e[1])]
        return [e for e in group if e[0] != "filter"], filters

    def inner(self, group: list, outer: Solutions, graph) -> tuple[Solutions, tuple | None]:
        """A nested group's solutions, and the conjunction of those of its filters that need outer variables."""
        given, self.given = self.given, None
        patterns, filters = self.split(group)
        sol = self.patterns(self.unit(), patterns, graph)
        self.given = given
        needs = [f for f in filters if variables(f) - sol.all and variables(f) & outer.all]
        for f in filters:
            if f not in needs:
                sol = self.filter(sol, f, graph)
        condition = None
        for f in needs:
            condition = f if condition is None else ("and", condition, f)
        return sol, condition

    def filter(self, sol: Solutions, e: tuple, graph) -> Solutions:
        negated = e[0] == "not" and e[1][0] == "exists"
        if negated or e[0] == "exists":
            group = (e[1] if negated else e)[1]
            other, condition = self.inner(group, sol, graph)
            shared = sol.all & (other.all | set())
            keep = shared | (variables(condition) & other.all if condition else set())
            other = Solutions(other.df.select(*[col(n) for n in sorted(keep)]).distinct() if keep else other.df.limit(1), other.certain & keep, other.possible & keep, other.keys(keep))
            return self.join(sol, other, "anti" if negated else "semi", condition)
        sol, e = self.flags(sol, e, graph)
        df = sol.df.where(as_bool(compile_expr(e, sol.at)))
        sure = {x[1] for c in _conjuncts(e) if c[0] == "call" and c[1] == "BOUND" for x in c[2]} & sol.possible
        return Solutions(df, sol.certain | sure, sol.possible - sure, sol.raw)

    def flags(self, sol: Solutions, e, graph):
        """Replaces EXISTS inside an expression by a flag column joined to the solutions."""
        if not isinstance(e, tuple):
            return sol, e
        if e[0] == "exists":
            other, condition = self.inner(e[1], sol, graph)
            sol, other = sol.plain(), other.plain()
            if condition is not None or not (other.all & sol.all) <= (other.certain & sol.certain):
                raise ValueError("EXISTS inside an expression must share bound variables only")
            self.count += 1
            shared, flag = sorted(other.all & sol.all), f".e{self.count}"
            marks = (other.df.select(*[col(n) for n in shared]).distinct() if shared else other.df.limit(1).select()).withColumn("flag", F.lit(True))
            df = sol.df.join(marks, [column_name(n) for n in shared], "left") if shared else sol.df.join(marks, F.lit(True), "left")
            key = f"flag{self.count}"
            df = df.withColumnRenamed("flag", key)
            return Solutions(df, sol.certain, sol.possible), ("flag", E("bool", F.coalesce(F.col(key), F.lit(False))))
        out = []
        for x in e:
            if isinstance(x, list):
                items = []
                for y in x:
                    sol, y = self.flags(sol, y, graph)
                    items.append(y)
                x = items
            else:
                sol, x = self.flags(sol, x, graph)
            out.append(x)
        return sol, tuple(out)

    def group(self, left: Solutions, group: list, graph=None) -> Solutions:
        patterns, filters = self.split(group)
        sol = self.patterns(left, patterns, graph)
        for f in filters:
            sol = self.filter(sol, f, graph)
        return sol

    def patterns(self, sol: Solutions, group: list, graph) -> Solutions:
        for e in group:
            kind = e[0]
            if kind == "bgp":
                sol = self.bgp(sol, e[1], graph)
            elif kind == "optional":
                other, condition = self.inner(e[1], sol, graph)
                sol = self.join(sol, other, "left", condition)
            elif kind == "union":
                parts = [self.nested(g, graph) for g in e[1]]
                sol = self.join(sol, self.union(parts))
            elif kind == "group":
                sol = self.join(sol, self.nested(e[1], graph))
            elif kind == "minus":
                other = self.nested(e[1], graph)
                shared = sorted(sol.all & other.all)
                if shared:
                    other = other.only(shared)
                    other = Solutions(other.df.distinct(), other.certain, other.possible, other.raw)
                    if set(shared) & sol.certain & other.certain:
                        sol = self.join(sol, other, "anti")
                    else:  # some shared variable must be bound on both sides
                        bound, sol, other = None, sol.plain(shared), other.plain()
                        right = other.df.select(*[col(n).alias("r_" + column_name(n)) for n in shared])
                        on = F.lit(True)
                        for n in shared:
                            x, y = col(n), F.col(f"`r_{column_name(n)}`")
                            on = on & ((x == y) | x.isNull() | y.isNull())
                            one = x.isNotNull() & y.isNotNull()
                            bound = one if bound is None else bound | one
                        sol = Solutions(sol.df.join(right, on & bound, "left_anti"), sol.certain, sol.possible, sol.raw)
            elif kind == "bind":
                if e[2] in sol.all:
                    raise ValueError(f"?{e[2]} is bound already")
                sol, expr = self.flags(sol, e[1], graph)
                value = as_term(compile_expr(expr, sol.at))
                sol = Solutions(sol.df.withColumn(column_name(e[2]), value), sol.certain, sol.possible | {e[2]}, sol.raw)
            elif kind == "values":
                names = e[1]
                schema = ", ".join(f"`{column_name(n)}` string" for n in names)
                certain = {n for k, n in enumerate(names) if all(r[k] is not None for r in e[2])}
                sol = self.join(sol, Solutions(self.spark.createDataFrame(e[2], schema), certain, set(names) - certain))
            elif kind == "graph":
                sol = self.join(sol, self.nested(e[2], e[1]))
            elif kind == "select":
                given, self.given = self.given, None
                inner = self.select(e[1], graph)
                self.given = given
                sol = self.join(sol, inner)
        return sol

    def nested(self, group: list, graph) -> Solutions:
        given, self.given = self.given, None
        out = self.group(self.unit(), group, graph)
        self.given = given
        return out

    # aggregation and modifiers

    def aggregate(self, e: tuple, sol: Solutions) -> list:
        """Spark aggregates of one SPARQL aggregate and how to read them: [(column, ...)], reader."""
        _, name, distinct, inner, separator = e
        if inner is None:
            value = F.struct(*[col(n) for n in sorted(sol.all)]) if distinct else F.lit(1)
            got = F.count_distinct(value) if distinct else F.count(value)
            return [got], lambda c: E("num", c[0].cast("double"), F.lit(True), c[0].cast(terms.EXACT))
        x = compile_expr(inner, sol.at)
        if name == "COUNT":
            v = col(inner[1]) if inner[0] == "var" and inner[1] in sol.raw else as_term(x)
            return [F.count_distinct(v) if distinct else F.count(v)], lambda c: E("num", c[0].cast("double"), F.lit(True), c[0].cast(terms.EXACT))
        if name in ("SUM", "AVG"):
            n, m = as_num(x), as_exact(x)
            total, exact = (F.sum_distinct(n), F.sum_distinct(m)) if distinct else (F.sum(n), F.try_sum(m))
            many = F.count_distinct(n) if distinct else F.count(n)
            # one value that is no integer or decimal makes the result a double
            columns = [F.coalesce(total, F.lit(0.0)), F.coalesce(F.every(whole_of(x)), F.lit(True)), F.count(n) == F.count(m), F.coalesce(exact, F.lit(0)).try_cast(terms.EXACT), many]
            if name == "SUM":
                return columns, lambda c: E("num", c[0], c[1], F.when(c[2], c[3]))
            mean = lambda c: math("/", E("num", c[0], F.lit(True), c[3]), E("num", c[4].cast("double"), F.lit(True), c[4].cast(terms.EXACT)))
            return columns, lambda c: E("num", F.coalesce(mean(c).col, F.lit(0.0)), F.lit(False), F.when(c[2], F.coalesce(mean(c).exact, F.lit(0).cast(terms.EXACT))))
        if name in ("MIN", "MAX"):
            v = as_term(x)
            order = F.struct(*_order_key(v))
            return [(F.min_by if name == "MIN" else F.max_by)(v, order)], lambda c: E("term", c[0])
        if name == "SAMPLE":
            return [F.min(as_term(x))], lambda c: E("term", c[0])
        texts = F.collect_set(as_str(x)) if distinct else F.collect_list(as_str(x))
        return [F.array_join(F.array_sort(texts), separator)], lambda c: E("str", c[0])

    def select(self, q: Query, graph=None) -> Solutions:
        sol = self.group(self.unit(), q.where, graph)
        found: list[tuple] = []

        def lift(e):
            """Aggregates in an expression, replaced by references."""
            if isinstance(e, list):
                return [lift(x) for x in e]
            if not isinstance(e, tuple):
                return e
            if e[:1] == ("agg",):
                if e not in found:
                    found.append(e)
                return ("agg#", found.index(e))
            return tuple(lift(x) for x in e)

        picks = [(n, lift(e) if e is not None else None) for n, e in q.select]
        having = [lift(e) for e in q.having]
        order = [(lift(e), down) for e, down in q.order]
        if q.group is not None or found:
            keys = []
            for n, e in q.group or []:
                if e != ("var", n):
                    sol = Solutions(sol.df.withColumn(column_name(n), as_term(compile_expr(e, sol.at))), sol.certain, sol.possible | {n}, sol.keys(sol.all - {n}))
                keys.append(n)
            columns, readers = [], []
            for k, e in enumerate(found):
                cols, reader = self.aggregate(e, sol)
                columns += [c.alias(f"agg{k}_{j}") for j, c in enumerate(cols)]
                readers.append((len(cols), reader))
            grouped = sol.df.groupBy(*[col(n) for n in keys])
            df = grouped.agg(*columns) if columns else sol.df.select(*[col(n) for n in keys]).distinct()
            sol = Solutions(df, sol.certain & set(keys), set(keys) - sol.certain, sol.keys(keys))

            def put(e):
                if isinstance(e, list):
                    return [put(x) for x in e]
                if not isinstance(e, tuple):
                    return e
                if e[:1] == ("agg#",):
                    n, reader = readers[e[1]]
                    return ("aggregate", reader([F.col(f"agg{e[1]}_{j}") for j in range(n)]))
                return tuple(put(x) for x in e)

            picks, having, order = [(n, put(e) if e is not None else None) for n, e in picks], [put(e) for e in having], [(put(e), d) for e, d in order]
            for e in having:
                sol = Solutions(sol.df.where(as_bool(compile_expr(e, sol.at))), sol.certain, sol.possible, sol.raw)
        for n, e in picks:
            if e is not None:
                sol, e = self.flags(sol, e, graph)
                value = compile_expr(e, sol.at)
                counted = e[0] == "aggregate" and value.kind == "num"
                sol = Solutions(sol.df.withColumn(column_name(n), as_term(value)), sol.certain | ({n} if counted else set()), sol.possible | (set() if counted else {n}), sol.keys(sol.all - {n}))
        names = [n for n, _ in picks] or sorted(n for n in sol.all if not n.startswith("."))
        df = sol.df
        keys = []
        for k, (e, down) in enumerate(order):
            value = compile_expr(e, sol.at)
            for j, key in enumerate(_order_key(as_term(value))):
                df = df.withColumn(f"order{k}_{j}", key)
                keys.append(F.col(f"order{k}_{j}").desc() if down else F.col(f"order{k}_{j}").asc())
        shown = [col(n) if n in sol.all else sol.at(n).alias(column_name(n)) for n in names]
        if q.distinct:
            extra = [F.min(c).alias(c) for c in df.columns if c.startswith("order")]
            df = df.select(*shown, *[F.col(c) for c in df.columns if c.startswith("order")])
            df = df.groupBy(*[col(n) for n in names]).agg(*extra) if extra else df.distinct()
        else:
            df = df.select(*shown, *[F.col(c) for c in df.columns if c.startswith("order")])
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*[col(n) for n in names]), sol.certain & set(names), set(names) - sol.certain, sol.keys(names))

    # forms

    def instantiate(self, sol: Solutions, template: list, quads: bool = False) -> DataFrame:
        """Triples (or quads) of a template over solutions, distinct; incomplete ones are left out."""
        row = F.concat_ws("\u0001", *[F.coalesce(sol.at(n), F.lit("")) for n in sorted(sol.all)]) if sol.all else F.lit("")
        items = []
        for t in template:
            parts = []
            for x in t:
                if x is None:
                    parts.append(F.lit(""))
                elif x[0] == "var" and x[1].startswith(".") and x[1] not in sol.all:
                    parts.append(F.concat(F.lit("_:c"), F.md5(F.concat(F.lit(x[1] + "\u0001"), row))))
                else:
                    parts.append(F.lit(x[1]) if x[0] != "var" else sol.at(x[1]))
            items.append(F.struct(*[p.alias(c) for p, c in zip(parts, "gspo" if quads else "spo")]))
        df = sol.df.select(F.explode(F.array(*items)).alias("t")).select("t.*")
        ok = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~terms.is_literal(F.col("s")) & terms.is_iri(F.col("p"))
        return df.where(ok).distinct()


def _is_unit(a: Solutions) -> bool:
    return not a.df.columns


def _order_key(term) -> list:
    """SPARQL order: unbound, blank nodes, IRIs, literals; numbers by value (exactly where doubles are equal), times as points in time, others by text."""
    kind = F.when(term.isNull(), 0).when(terms.is_blank(term), 1).when(terms.is_iri(term), 2).otherwise(3)
    return [kind, F.coalesce(terms.num(term), F.lit(float("-inf"))), terms.exact(term), terms.instant(term), terms.lex(term)]


def template_triples(template: list) -> list:
    """Plain (s, p, o) of parsed template triples."""
    out = []
    for *g, s, p, o in template:
        out.append((*g, s, ("term", p[1]) if p[0] == "iri" else p, o))
    return out


def named(sol: Solutions, names: list[str]) -> DataFrame:
    return sol.df.select(*[sol.at(n).alias(n) for n in names])


def run_query(spark: SparkSession, text: str, triples: DataFrame, quads: DataFrame | None = None, prefixes: dict | None = None, bindings: DataFrame | None = None) -> DataFrame:
    """DataFrame of a query: its variables (SELECT), ``answer`` (ASK) or s, p, o (CONSTRUCT, DESCRIBE).

    ``bindings``: solutions to start from, one string column a variable (``this``, say).
    """
    q = Parser(text, prefixes).query()
    if q.named and quads is not None:
        quads = quads.where(F.col("g").isin(q.named))
    if q.default and quads is not None:
        triples = quads.where(F.col("g").isin(q.default)).select("s", "p", "o").distinct()
    given = None
    if bindings is not None:
        given = Solutions(bindings.select(*[F.col(c).alias(column_name(c)) for c in bindings.columns]), set(bindings.columns), set())
    c = Compiler(spark, triples, quads, given)
    if q.form == "SELECT":
        sol = c.select(q)
        names = [n for n, _ in q.select] or sorted(sol.all)
        return named(sol, names)
    if q.form == "ASK":
        sol = c.group(c.unit(), q.where)
        return sol.df.limit(1).agg((F.count("*") > 0).alias("answer"))
    if q.form == "CONSTRUCT":
        inner = c.select(Query("SELECT", where=q.where, group=q.group, having=q.having, order=q.order, limit=q.limit, offset=q.offset, select=[(n, None) for n in sorted(variables(template_triples(q.template))) if not n.startswith(".")])) if q.limit is not None or q.offset else c.group(c.unit(), q.where)
        return c.instantiate(inner, template_triples(q.template))
    named_nodes = [x[1] for x in q.template if x[0] == "term"]
    nodes = spark.createDataFrame([(x,) for x in named_nodes], "s string")
    if q.where:
        sol = c.group(c.unit(), q.where)
        for x in q.template:
            if x[0] == "var":
                nodes = nodes.union(sol.df.select(sol.at(x[1]).alias("s")))
    return triples.join(nodes.where("s is not null").distinct(), "s", "left_semi").select("s", "p", "o")
