"""Graphs and collections of named graphs over triples DataFrames.

Both are immutable: every operation returns a new object over a lazy DataFrame (s, p, o) or (g, s, p, o) of
canonical term strings.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms
from .functions.terms import QUAD, TRIPLE
from .namespaces import PREFIXES, expand
from .operators.closure import checkpoint
from .plans.compile import run_query
from .sources import rdf

HERE = os.path.dirname(__file__)
NEWEST = "1.0"
#: Name under which a collection keeps the bundled vocabulary.
VOCABULARY = "<urn:tessera:building>"


def as_term(x) -> str:
    """Term of an argument: terms and IRIs pass, prefixed names expand, other values are literals."""
    if isinstance(x, str):
        if x[:1] in "<_\"" and x:
            return x
        head, colon, _ = x.partition(":")
        if colon and head in PREFIXES and " " not in x:
            return expand(x)
        if x.startswith(("http://", "https://", "urn:")):
            return f"<{x}>"
    return terms.literal(x)


def ground(triples) -> list[tuple[str, str, str]]:
    """Rows of triples; an object that is a list of (predicate, object) pairs becomes a blank node, at any depth.

    Blank nodes are named by their place, so equal calls give equal rows.
    """
    import hashlib

    out = []

    def put(s, p, o, place: str) -> None:
        if isinstance(o, list):
            node = "_:n" + hashlib.md5(f"{s}|{p}|{place}".encode()).hexdigest()[:12]
            out.append((s, p, node))
            for k, (p2, o2) in enumerate(o):
                put(node, as_term(p2), o2, f"{place}.{k}")
        else:
            out.append((s, p, as_term(o)))

    for k, (s, p, o) in enumerate(triples):
        put(as_term(s), as_term(p), o, str(k))
    return out


#: Formats that one process writes take so many triples; larger graphs go out as N-Triples or Parquet.
TEXT_TRIPLES = 2_000_000


def _bounded(df: DataFrame) -> list:
    rows = df.distinct().limit(TEXT_TRIPLES + 1).collect()
    if len(rows) > TEXT_TRIPLES:
        raise ValueError(f"more than {TEXT_TRIPLES} triples: write N-Triples to a path, or save as Parquet")
    return rows


class Graph:
    """A set of triples."""

    def __init__(self, df: DataFrame, prefixes: dict[str, str] | None = None):
        self.df = df.select("s", "p", "o")
        if getattr(df, "mapping", None):  # mapped tables stay known to the query compiler
            self.df.mapping = df.mapping
        self.spark: SparkSession = df.sparkSession
        self.prefixes = PREFIXES | (prefixes or {})

    def _new(self, df: DataFrame) -> "Graph":
        return Graph(df, self.prefixes)

    # sources

    @classmethod
    def empty(cls, spark: SparkSession) -> "Graph":
        return cls(spark.createDataFrame([], TRIPLE))

    @classmethod
    def from_triples(cls, spark: SparkSession, triples, prefixes: dict[str, str] | None = None) -> "Graph":
        return cls(spark.createDataFrame(ground(triples), TRIPLE).distinct(), prefixes)

    @classmethod
    def parse(cls, spark: SparkSession, text: str, format: str | None = None) -> "Graph":
        rows, prefixes = rdf.parse_any(text, format)
        return cls(spark.createDataFrame([r[1:] for r in rows], TRIPLE).distinct(), prefixes)

    @classmethod
    def load(cls, spark: SparkSession, path: str, format: str | None = None) -> "Graph":
        df, prefixes = rdf.read(spark, path, format)
        return cls(df.select("s", "p", "o").distinct(), prefixes)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Graph":
        """A graph stored by ``save``; patterns with a constant predicate read only its partition."""
        return cls(spark.read.parquet(path))

    def save(self, path: str, mode: str = "overwrite") -> None:
        self.df.distinct().repartition("p").sortWithinPartitions("p", "s").write.mode(mode).partitionBy("p").parquet(path)

    def load_file(self, path: str | None = None, source=None, format: str | None = None) -> "Graph":
        """This graph with the triples of a file or a file-like source."""
        if source is not None:
            text = source.read()
            other = Graph.parse(self.spark, text.decode() if isinstance(text, bytes) else text, format)
        else:
            other = Graph.load(self.spark, path, format)
        out = self + other
        out.prefixes = self.prefixes | other.prefixes
        return out

    @classmethod
    def building(cls, spark: SparkSession, version: str | None = None, source: str | None = None) -> "Graph":
        """The bundled example vocabulary (a class tree with tags, equivalents and inverses) in a version, or one from ``source``.

        ``source``: a path or URL that Spark's file systems read; the newest is what stands there.
        """
        if source is None and version not in (None, *Graph.versions()):
            raise ValueError(f"no version {version}: {', '.join(Graph.versions())}")
        tail = "" if version in (None, NEWEST) else f"-{version}"
        return cls.load(spark, source or os.path.join(HERE, "data", f"building{tail}.ttl"))

    @staticmethod
    def versions() -> list[str]:
        """Versions of the vocabulary that are bundled, the newest last."""
        old = glob.glob(os.path.join(HERE, "data", "building-*.ttl"))
        return sorted(os.path.basename(p)[len("building-") : -len(".ttl")] for p in old) + [NEWEST]

    @staticmethod
    def extensions(folder: str = os.path.join(HERE, "data", "extensions")) -> list[str]:
        return sorted(os.path.splitext(os.path.basename(p))[0] for p in glob.glob(os.path.join(folder, "*.ttl")))

    def load_extension(self, name: str, folder: str = os.path.join(HERE, "data", "extensions")) -> "Graph":
        return self.load_file(os.path.join(folder, name + ".ttl"))

    @staticmethod
    def alignments(folder: str = os.path.join(HERE, "data", "alignments")) -> list[str]:
        """Names of the alignments with other vocabularies that can be loaded."""
        return Graph.extensions(folder)

    def load_alignment(self, name: str, folder: str = os.path.join(HERE, "data", "alignments")) -> "Graph":
        return self.load_extension(name, folder)

    # algebra

    def add(self, *triples) -> "Graph":
        return self._new(self.df.union(self.spark.createDataFrame(ground(triples), TRIPLE)).distinct())

    def __add__(self, other: "Graph") -> "Graph":
        return self._new(self.df.union(other.df).distinct())

    def __sub__(self, other: "Graph") -> "Graph":
        return self._new(self.df.join(other.df, ["s", "p", "o"], "left_anti"))

    def __mul__(self, other: "Graph") -> "Graph":
        return self._new(self.df.intersect(other.df))

    def remove(self, s=None, p=None, o=None) -> "Graph":
        """Without the triples that match; None matches any."""
        hit = F.lit(True)
        for c, x in (("s", s), ("p", p), ("o", o)):
            if x is not None:
                hit = hit & (F.col(c) == as_term(x))
        return self._new(self.df.where(~hit))

    def match(self, s=None, p=None, o=None) -> DataFrame:
        df = self.df
        for c, x in (("s", s), ("p", p), ("o", o)):
            if x is not None:
                df = df.where(F.col(c) == as_term(x))
        return df

    def __contains__(self, triple) -> bool:
        return not self.match(*triple).isEmpty()

    def __len__(self) -> int:
        return self.df.distinct().count()

    def nodes(self) -> DataFrame:
        return self.df.select(F.col("s").alias("node")).union(self.df.select("o")).distinct()

    def subjects(self, p=None, o=None) -> DataFrame:
        return self.match(None, p, o).select("s").distinct()

    def objects(self, s=None, p=None) -> DataFrame:
        return self.match(s, p).select("o").distinct()

    def subject_objects(self, p=None) -> DataFrame:
        return self.match(None, p).select("s", "o").distinct()

    def predicate_objects(self, s=None) -> DataFrame:
        return self.match(s).select("p", "o").distinct()

    def subject_predicates(self, o=None) -> DataFrame:
        return self.match(None, None, o).select("s", "p").distinct()

    def skolemize(self) -> "Graph":
        return self._new(self.df.select(terms.skolem(F.col("s")).alias("s"), "p", terms.skolem(F.col("o")).alias("o")))

    def deskolemize(self) -> "Graph":
        return self._new(self.df.select(terms.unskolem(F.col("s")).alias("s"), "p", terms.unskolem(F.col("o")).alias("o")))

    def edges(self) -> DataFrame:
        """(src, dst, name): one edge a node pair, the greatest predicate names it."""
        return self.df.groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.max("p").alias("name"))

    def bind(self, prefix: str, namespace: str) -> "Graph":
        return Graph(self.df, self.prefixes | {prefix: namespace})

    def cut(self) -> "Graph":
        return self._new(checkpoint(self.df))

    # queries and reasoning

    def query(self, text: str, bindings: DataFrame | None = None) -> DataFrame:
        return run_query(self.spark, text, self.df, None, self.prefixes, bindings)

    def construct(self, text: str) -> "Graph":
        return self._new(self.query(text))

    def update(self, text: str) -> "Graph":
        from .operators.update import update_triples

        return self._new(update_triples(self.spark, text, self.df, self.prefixes))

    def expand(self, profile: str, **how) -> "Graph":
        from .operators.reason import expand as run

        return run(self, profile, **how)

    def simplify(self) -> "Graph":
        from .operators.reason import simplify

        return self._new(simplify(self.df))

    def most_specific(self, classes: list[str]) -> list[str]:
        from .operators.reason import most_specific

        return most_specific(self, classes)

    def validate(self, shapes=None, **how):
        from .operators.shacl import validate

        return validate(self, shapes, **how)

    def infer_haystack(self, model: dict, lookup, namespace: str) -> "Graph":
        from .operators.haystack import infer_model

        return self + Graph(infer_model(self.spark, model, lookup, namespace))

    # sinks

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.distinct().collect()]

    def serialize(self, format: str = "turtle", path: str | None = None) -> str | None:
        """Text of the graph on the driver, for ``TEXT_TRIPLES`` at most; with a path, N-Triples are written by Spark at any size."""
        if path and format in ("nt", "ntriples"):
            rdf.write_lines(self.df.distinct(), path)
            return None
        text = rdf.serialize([("", *r) for r in _bounded(self.df)], format, self.prefixes)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text


class GraphCollection:
    """Named graphs as quads; queries see the union of all graphs unless they name one."""

    def __init__(self, df: DataFrame, prefixes: dict[str, str] | None = None):
        self.df = df.select("g", "s", "p", "o")
        self.spark: SparkSession = df.sparkSession
        self.prefixes = PREFIXES | (prefixes or {})

    @classmethod
    def empty(cls, spark: SparkSession) -> "GraphCollection":
        return cls(spark.createDataFrame([], QUAD))

    @classmethod
    def building(cls, spark: SparkSession, version: str | None = None) -> "GraphCollection":
        """A collection that holds the vocabulary under its fixed name."""
        return cls.empty(spark).add_graph(VOCABULARY, Graph.building(spark, version))

    def load_alignment(self, name: str) -> "GraphCollection":
        """With an alignment as a graph of its own."""
        return self.add_graph(f"<urn:tessera:alignment/{name}>", Graph.empty(self.spark).load_alignment(name))

    def load_extension(self, name: str) -> "GraphCollection":
        return self.add_graph(f"<urn:tessera:extension/{name}>", Graph.empty(self.spark).load_extension(name))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "GraphCollection":
        return cls(spark.read.parquet(path))

    def save(self, path: str, mode: str = "overwrite") -> None:
        self.df.distinct().repartition("g").sortWithinPartitions("g", "p", "s").write.mode(mode).partitionBy("g").parquet(path)

    def load_graph(self, path: str | None = None, source=None, format: str | None = None, graph: Graph | None = None, name: str | None = None) -> "GraphCollection":
        """With a graph under ``name``, else under its ontology's name, else in the default graph (empty name)."""
        if graph is None:
            graph = Graph.empty(self.spark).load_file(path, source, format)
        if name is None:
            name = rdf.ontology_name(graph.df)
        return self.add_graph(as_term(name) if name else "", graph)

    def add_graph(self, name: str, graph: Graph) -> "GraphCollection":
        added = graph.df.select(F.lit(name).alias("g"), "s", "p", "o")
        return GraphCollection(self.df.union(added).distinct(), self.prefixes | graph.prefixes)

    def remove_graph(self, name: str) -> "GraphCollection":
        return GraphCollection(self.df.where(F.col("g") != as_term(name)), self.prefixes)

    def names(self) -> DataFrame:
        return self.df.select("g").where(F.col("g") != "").distinct()

    def graph(self, name: str) -> Graph:
        return Graph(self.df.where(F.col("g") == (as_term(name) if name else "")), self.prefixes)

    def subset(self, names: list[str]) -> "GraphCollection":
        """Only the named graphs are visible."""
        return GraphCollection(self.df.where(F.col("g").isin([as_term(n) for n in names])), self.prefixes)

    def contexts(self, s=None, p=None, o=None) -> DataFrame:
        """Names of the graphs that hold a matching triple."""
        df = self.df
        for c, x in (("s", s), ("p", p), ("o", o)):
            if x is not None:
                df = df.where(F.col(c) == as_term(x))
        return df.select("g").distinct()

    def union(self) -> Graph:
        return Graph(self.df.select("s", "p", "o").distinct(), self.prefixes)

    def triples(self) -> DataFrame:
        """Triples of all graphs with their repetitions."""
        return self.df.select("s", "p", "o")

    def query(self, text: str) -> DataFrame:
        return run_query(self.spark, text, self.union().df, self.df, self.prefixes)

    def update(self, text: str) -> "GraphCollection":
        from .operators.update import update_quads

        return GraphCollection(update_quads(self.spark, text, self.df, self.prefixes), self.prefixes)

    def serialize(self, format: str = "trig") -> str:
        return rdf.serialize([tuple(r) for r in _bounded(self.df)], format, self.prefixes)
