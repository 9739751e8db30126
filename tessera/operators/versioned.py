"""Versioned graph collections: an append-only log of changes, with undo, redo and time travel.

A log row is (id, timestamp, g, is_insertion, s, p, o).  ``state_at`` is a pure function of the log and so
works on logs of any size; ``VersionedGraphs`` keeps the log as Parquet, one file set per commit.
Changes are normalised when they are written: adding what is there, or removing what isn't, logs nothing.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.terms import QUAD
from ..graph import Graph, GraphCollection, as_term, ground
from ..sources import rdf

LOG = "id string, timestamp string, g string, is_insertion boolean, s string, p string, o string"
KEY = ["g", "s", "p", "o"]


def state_at(log: DataFrame, timestamp=None, base: DataFrame | None = None) -> DataFrame:
    """Quads at a time (inclusive; None: now): per quad the last change up to it decides.

    ``base``: quads that were there before the log began.
    """
    if timestamp is not None:
        log = log.where(F.col("timestamp") <= timestamp)
    last = log.groupBy(*KEY).agg(F.max_by("is_insertion", F.struct("timestamp", "is_insertion")).alias("there"))
    added = last.where("there").select(*KEY)
    if base is None:
        return added
    return base.select(*KEY).join(last, KEY, "left_anti").union(added)


def versions(log: DataFrame, graph: str | None = None) -> DataFrame:
    """Distinct (id, g, timestamp), newest first."""
    if graph is not None:
        log = log.where(F.col("g") == graph)
    return log.select("id", "g", "timestamp").distinct().orderBy(F.desc("timestamp"), "id")


def latest_version(log: DataFrame) -> DataFrame:
    return log.select("id", "g", "timestamp").orderBy(F.desc("timestamp"), "id").limit(1)


def version_before(log: DataFrame, timestamp) -> DataFrame:
    """The newest version strictly before a time; none before the first."""
    return log.where(F.col("timestamp") < timestamp).select("id", "g", "timestamp").orderBy(F.desc("timestamp"), "id").limit(1)


def versions_before(log: DataFrame, times: DataFrame) -> DataFrame:
    """As-of join: for each (key, ts) the newest log timestamp of the key strictly before ts."""
    both = log.select("key", F.col("timestamp").alias("t"), F.col("timestamp").alias("seen"), F.lit(1).alias("kind")).union(times.select("key", F.col("ts").alias("t"), F.lit(None).alias("seen"), F.lit(0).alias("kind")))
    before = F.max("seen").over(Window.partitionBy("key").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("before", before).where("kind = 0").select("key", F.col("t").alias("ts"), "before")


def point_in_time(ts) -> str:
    """A date and time (also as text) in UTC, without a zone, so that texts sort as times; what has no zone is UTC."""
    at = ts if isinstance(ts, datetime) else datetime.fromisoformat(str(ts))
    return (at if at.tzinfo is None else at.astimezone(timezone.utc).replace(tzinfo=None)).isoformat()


class Changeset:
    """Additions and removals being gathered for one commit."""

    def __init__(self, spark: SparkSession):
        self.spark, self.added, self.removed, self.prefixes = spark, [], [], {}

    def add(self, *triples) -> None:
        self.added += ground(triples)

    def remove(self, *triples) -> None:
        self.removed += ground(triples)

    def load_file(self, path: str, format: str | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            rows, prefixes = rdf.parse_any(f.read(), format)
        self.added += [r[1:] for r in rows]
        self.prefixes |= prefixes

    def graph(self) -> Graph:
        return Graph.from_triples(self.spark, self.added)


class VersionedGraphs:
    """A collection of graphs whose every state can be read again.

    Stored under ``path``: ``base`` (quads from outside any change), ``log`` and ``redo``.
    """

    def __init__(self, spark: SparkSession, path: str, base: DataFrame | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.before_commit, self.after_commit, self.prefixes = {}, {}, {}
        if base is not None:
            base.select(*KEY).write.mode("overwrite").parquet(f"{self.path}/base")

    def _read(self, name: str, schema: str) -> DataFrame:
        
        for place in (f"{self.path}/{name}", f"{self.path}/{name}.old"):  # the second only between two steps of a replacement
            where, fs = self._place(place)
            if fs.exists(where):
                return self.spark.read.schema(schema).parquet(place)
        return self.spark.createDataFrame([], schema)

    def _place(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _replace(self, name: str, df: DataFrame) -> None:
        """Writes the new table beside the old one, then swaps them by renaming; one of both is whole at any time."""
        new, old = f"{self.path}/{name}-{uuid.uuid4().hex}", f"{self.path}/{name}.old"
        df.write.parquet(new)
        target, fs = self._place(f"{self.path}/{name}")
        if fs.exists(target):
            fs.delete(self._place(old)[0], True)
            fs.rename(target, self._place(old)[0])
        fs.rename(self._place(new)[0], target)
        fs.delete(self._place(old)[0], True)

    @property
    def log(self) -> DataFrame:
        return self._read("log", LOG)

    @property
    def redone(self) -> DataFrame:
        return self._read("redo", LOG)

    def current(self, timestamp=None) -> DataFrame:
        return state_at(self.log, timestamp, self._read("base", "g string, s string, p string, o string"))

    def collection(self) -> GraphCollection:
        return GraphCollection(self.current(), self.prefixes)

    def __len__(self) -> int:
        return self.current().select("s", "p", "o").distinct().count()

    def latest(self, graph: str) -> Graph:
        return self.collection().graph(graph)

    def graph_at(self, timestamp=None, graph: str | None = None) -> Graph:
        df = self.current(None if timestamp is None else point_in_time(timestamp))
        if graph is not None:
            df = df.where(F.col("g") == as_term(graph))
        return Graph(df.select("s", "p", "o").distinct(), self.prefixes)

    def versions(self, graph: str | None = None) -> DataFrame:
        return versions(self.log, as_term(graph) if graph else None)

    def latest_version(self) -> DataFrame:
        return latest_version(self.log)

    def version_before(self, timestamp) -> DataFrame:
        return version_before(self.log, point_in_time(timestamp))

    def add_precommit_hook(self, hook) -> None:
        """``hook(collection)`` runs before a change is applied; a function of the same name replaces it."""
        self.before_commit[hook.__name__] = hook

    def add_postcommit_hook(self, hook) -> None:
        self.after_commit[hook.__name__] = hook

    @contextmanager
    def new_changeset(self, graph: str, ts: str | None = None):
        """Gathers changes of one graph and commits them at the end of the block; an error commits nothing."""
        name = as_term(graph)
        changes = Changeset(self.spark)
        yield changes
        self.prefixes |= changes.prefixes
        for hook in self.before_commit.values():
            hook(self.collection())
        stamp = point_in_time(ts or datetime.now(timezone.utc))
        now = self.current()
        rows = lambda xs: self.spark.createDataFrame([(name, *x) for x in xs], QUAD).distinct()
        added, removed = rows(changes.added), rows(changes.removed)
        gone = removed.join(now, KEY, "left_semi").join(added, KEY, "left_anti").withColumn("is_insertion", F.lit(False))
        new = added.join(now, KEY, "left_anti").withColumn("is_insertion", F.lit(True))
        entry = gone.union(new).select(F.lit(uuid.uuid4().hex).alias("id"), F.lit(stamp).alias("timestamp"), "g", "is_insertion", "s", "p", "o")
        entry.write.mode("append").parquet(f"{self.path}/log")
        for hook in self.after_commit.values():
            hook(self.collection())

    def undo(self) -> None:
        """Takes back the newest changeset; it can be redone."""
        top = self.latest_version().first()
        if top is None:
            raise ValueError("no changesets to undo")
        log = self.log
        self._replace("redo", self.redone.union(log.where(F.col("id") == top["id"])))
        self._replace("log", log.where(F.col("id") != top["id"]))

    def redo(self) -> None:
        """Applies the oldest undone changeset again."""
        redo = self.redone
        top = redo.orderBy("timestamp", "id").limit(1).select("id").first()
        if top is None:
            raise ValueError("no changesets to redo")
        redo.where(F.col("id") == top["id"]).write.mode("append").parquet(f"{self.path}/log")
        self._replace("redo", redo.where(F.col("id") != top["id"]))
