"""SPARQL updates: operations run in order, each sees what those before it did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import QUAD
from ..plans.compile import Compiler, template_triples
from ..plans.parser import Parser, Update
from .closure import checkpoint

KEY = ["g", "s", "p", "o"]
#: After so many operations the plan is cut.
CUT_EVERY = 8


def _data(spark: SparkSession, template: list) -> DataFrame:
    def name(x):
        return "" if x is None else f"_:{x[1].strip('.')}" if x[0] == "var" else x[1]

    return spark.createDataFrame([tuple(map(name, t)) for t in template_triples(template)], QUAD)


def _apply(spark: SparkSession, u: Update, quads: DataFrame) -> DataFrame:
    if u.kind == "CLEAR":
        if u.target == "ALL":
            return quads.limit(0)
        if u.target in ("DEFAULT", "NAMED"):
            return quads.where(F.col("g") != "" if u.target == "DEFAULT" else F.col("g") == "")
        return quads.where(F.col("g") != u.target)
    if u.kind == "INSERT DATA":
        return quads.union(_data(spark, u.insert)).distinct()
    if u.kind == "DELETE DATA":
        return quads.join(_data(spark, u.delete), KEY, "left_anti")
    graph = quads.where(F.col("g") == u.graph[1]).select("s", "p", "o") if u.graph else quads.select("s", "p", "o").distinct()
    compiler = Compiler(spark, graph, quads)
    solutions = compiler.group(compiler.unit(), u.where)
    home = u.graph
    deleted = template_triples([(g or home, *t) for g, *t in u.delete])
    inserted = template_triples([(g or home, *t) for g, *t in u.insert])
    out = quads
    if deleted and inserted:  # both templates read one evaluation of the pattern
        solutions.df = checkpoint(solutions.df)
    if deleted:
        out = out.join(compiler.instantiate(solutions, deleted, quads=True), KEY, "left_anti")
    if inserted:
        out = out.union(compiler.instantiate(solutions, inserted, quads=True)).distinct()
    return out


def update_quads(spark: SparkSession, text: str, quads: DataFrame, prefixes: dict | None = None) -> DataFrame:
    for k, u in enumerate(Parser(text, prefixes).update()):
        quads = _apply(spark, u, quads)
        if k % CUT_EVERY == CUT_EVERY - 1:
            quads = checkpoint(quads)
    return quads


def update_triples(spark: SparkSession, text: str, triples: DataFrame, prefixes: dict | None = None) -> DataFrame:
    """Updates of one graph; it is the default graph."""
    quads = triples.select(F.lit("").alias("g"), "s", "p", "o")
    return update_quads(spark, text, quads, prefixes).where(F.col("g") == "").select("s", "p", "o")
