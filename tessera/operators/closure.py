"""Transitive closures and connected components of edge DataFrames.

Closures double path lengths each round, so chains of n edges take log n rounds.  Nodes that reach each other are
first made one node and spelled out at the end, so what they reach is found once for all of them.  Where a node has one
way on, steps of 1, 2, 4, ... edges are kept and each pair is made once.  Lineage is cut by reliable checkpoints.
Small inputs, checked by size, are closed on the driver instead, which saves the rounds' start-up.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_EDGES = 20_000
DRIVER_PAIRS = 400_000
MOST_PARTS = 24
#: A node that so many edges end in is kept out of the rounds if none leaves it.
HOT = 10_000
#: Members of a group that one task pairs with all members.
PAIRED = 1_000
#: Rows that one task makes of the rows of a table.
TASK_ROWS = 500_000


def shared(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine serves on a local master; a cluster raises.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage, in the shared folder."""
    shared(df.sparkSession)
    # strings are computed anew: otherwise constant columns carry constraints on attributes that are gone, which later unions trip over
    fresh = [F.concat(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*fresh).checkpoint(eager=True)


class Grown:
    """What a fixpoint has so far: one checkpoint a round, so a round writes only what is new."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, delta: DataFrame) -> None:
        self.parts.append(delta)
        if len(self.parts) > MOST_PARTS:  # long runs of small rounds are put together now and then
            self.parts = [checkpoint(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def reach(edges: list[tuple[str, str]], most: int = DRIVER_PAIRS, starts: list[str] | None = None) -> list[tuple[str, str]] | None:
    """All pairs joined by one edge or more (from ``starts`` only, if given); None beyond ``most`` pairs."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = []
    for a in list(after) if starts is None else starts:
        seen, todo = set(), list(after.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(after.get(x, ()))
        out.extend((a, b) for b in seen)
        if len(out) > most:
            return None
    return out


def transitive(edges: DataFrame, driver_edges: int = DRIVER_EDGES, starts: DataFrame | None = None) -> DataFrame:
    """Distinct (s, o) pairs joined by one edge or more; ``edges`` has the columns s and o, cycles are fine.

    ``starts`` (s): the nodes asked for; pairs from others may be left out.
    """
    spark = edges.sparkSession
    edges = edges.select("s", "o")
    few = edges.limit(driver_edges + 1).collect()
    if len(few) <= driver_edges:
        pairs = reach([tuple(r) for r in few])
        if pairs is not None:
            return spark.createDataFrame(pairs, "s string, o string")
    edges = checkpoint(distinct(edges))
    rest, groups = edges.where("s <> o"), None
    circles = checkpoint(rest.alias("a").join(rest.alias("b"), (F.col("a.s") == F.col("b.o")) & (F.col("a.o") == F.col("b.s")) & (F.col("a.s") < F.col("a.o"))).select("a.s", "a.o"))
    while True:
        if not circles.isEmpty():
            new = checkpoint(components(circles))
            groups = new if groups is None else checkpoint(regrouped(groups, new))
            rest = checkpoint(distinct(_moved(rest, new).where("s <> o")))
        pairs, circles = _paths(rest, starts if groups is None else None)
        if pairs is not None:
            break
    alone = edges.where("s = o")
    if groups is None:
        return pairs.union(alone)
    a, b = groups.select(F.col("root").alias("s"), F.col("node").alias("s2")), groups.select(F.col("root").alias("o"), F.col("node").alias("o2"))
    between = pairs.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), F.coalesce("o2", "o").alias("o"))
    return between.union(products(groups)).union(alone.join(groups.select(F.col("node").alias("s")), "s", "left_anti"))


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, for data with few repeats: rows move first, so no task holds all rows of a file in a hash table."""
    return df.repartition(*df.columns).distinct()


def spread(df: DataFrame, rows: int) -> DataFrame:
    """For rows that become ``rows`` rows each in the step that follows: so many partitions that none makes too many."""
    parts = -(-df.count() * rows // TASK_ROWS)
    return df.repartition(parts, *[F.col(f"`{c}`") for c in df.columns]) if parts > 1 else df


def regrouped(groups: DataFrame, new: DataFrame) -> DataFrame:
    """(node, root) after the roots of ``groups`` were grouped once more."""
    moved = groups.join(new.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left").select("node", F.coalesce("r2", "root").alias("root"))
    return moved.union(new.join(groups, "node", "left_anti").select("node", "root"))


def _moved(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between roots."""
    a, b = groups.select(F.col("node").alias("s"), F.col("root").alias("s2")), groups.select(F.col("node").alias("o"), F.col("root").alias("o2"))
    return edges.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), F.coalesce("o2", "o").alias("o"))


def products(groups: DataFrame, first: DataFrame | None = None, on=None) -> DataFrame:
    """(s, o): pairs of nodes of one root, of rows ``first`` (a, default: all) with all rows (b) where ``on`` holds.

    They are made as they are asked for; large groups are shared among tasks.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    large = checkpoint(sizes.where(F.col("n") > PAIRED).withColumn("parts", F.ceil(F.col("n") / PAIRED).cast("int")))
    tasks = int((large.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) / PAIRED**2)
    left = (groups if first is None else first).withColumnRenamed("node", "s")
    right = groups.withColumnRenamed("node", "o")
    if tasks == 0:
        pairs = left.alias("a").join(right.alias("b"), "root")
        return (pairs if on is None else pairs.where(on)).select("a.s", "b.o")
    parts = large.select("root", "parts")  # a row for thousands of nodes
    one = F.coalesce("parts", F.lit(1))
    left = left.join(F.broadcast(parts), "root", "left").withColumn("part", F.pmod(F.xxhash64("s"), one).cast("int")).drop("parts")
    right = right.join(F.broadcast(parts), "root", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    # by the pairs, which the bytes that are read don't tell
    tasks = max(tasks, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = left.repartition(tasks, "root", "part").alias("a").join(right.repartition(tasks, "root", "part").alias("b"), ["root", "part"])
    return (pairs if on is None else pairs.where(on)).select("a.s", "b.o")


def _paths(edges: DataFrame, starts: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(pairs, None), or (None, edges on circles) where there are any.  ``edges``: distinct, without loops.

    With ``starts``, pairs from other nodes may be left out.
    """
    ahead, back = (edges.groupBy(c).agg(F.count("*").alias("n")) for c in ("s", "o"))
    most = ahead.agg(F.max("n")).first()[0]
    if most is None:
        return edges, None
    hot = checkpoint(back.where(F.col("n") > HOT).select("o").join(edges.select(F.col("s").alias("o")), "o", "left_anti"))  # few, as each takes many edges
    last = None if hot.isEmpty() else checkpoint(edges.join(F.broadcast(hot), "o", "left_semi").select("s", "o"))
    body = edges if last is None else checkpoint(edges.join(F.broadcast(hot), "o", "left_anti").select("s", "o"))
    meets = body.groupBy("o").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if most == 1 and meets == 1:
        pairs, circles = _chains(body, starts)
    elif most == 1:
        pairs, circles = _steps(body, starts)
    elif last is None and meets == 1:
        turn = lambda df: df.select(F.col("o").alias("s"), F.col("s").alias("o"))
        pairs, circles = _steps(checkpoint(turn(body)), None)
        pairs, circles = (None, circles) if pairs is None else (turn(pairs), None)
    else:
        pairs, circles = _doubled(body)
    if pairs is None or last is None:
        return pairs, circles
    ends = _met(pairs, last).select("d.s", "e.o").union(last)
    return pairs.union(ends if most == 1 else distinct(ends)), None


def _met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` as d with ``b`` as e where d.o is e.s; sorted by a hash first, as IRIs of one kind begin alike."""
    return a.withColumn("h", F.xxhash64("o")).alias("d").join(b.withColumn("h", F.xxhash64("s")).alias("e"), (F.col("d.h") == F.col("e.h")) & (F.col("d.o") == F.col("e.s")), how)


def _chains(edges: DataFrame, starts: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """As _paths, where each node has one edge at most either way: each node's chain and distance to its end make the pairs."""
    open_, ended, n, span = edges.withColumn("far", F.lit(1).cast("bigint")), None, None, 1
    while True:
        everything = open_ if ended is None else open_.union(ended)
        step = checkpoint(_met(open_, everything, "left").select("d.s", F.coalesce("e.o", "d.o").alias("o"), (F.col("d.far") + F.coalesce("e.far", F.lit(0))).alias("far"), F.col("e.o").isNotNull().alias("on")))
        done = step.where("not on").drop("on")
        ended = done if ended is None else ended.union(done)
        open_ = step.where("on").drop("on")
        if open_.isEmpty():
            break
        span *= 2
        n = edges.count() if n is None else n
        if span > 2 * n:  # a round after the longest path could end: all these ends are on circles
            return None, edges.join(open_.select(F.col("o").alias("s")).distinct(), "s", "left_semi").select("s", "o")
    # rows (chain, node, far); a chain's end is its name and has no row yet
    rows = ended.select(F.col("o").alias("root"), F.col("s").alias("node"), "far").union(ended.select("o", "o", F.lit(0).cast("bigint")).distinct())
    rows = checkpoint(rows)
    before = rows.where("far > 0") if starts is None else rows.where("far > 0").join(starts.select(F.col("s").alias("node")), "node", "left_semi").select("root", "node", "far")
    return products(rows, before, F.col("a.far") > F.col("b.far")), None


def _steps(edges: DataFrame, starts: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """As _paths, where each node has one edge at most: pairs 1, 2, 4, ... edges apart are combined, so each pair comes up once."""
    powers, n = [edges], edges.count()
    while True:
        step = checkpoint(_met(powers[-1], powers[-1]).select("d.s", "e.o"))
        if step.isEmpty():
            break
        powers.append(step)
        if 2 ** (len(powers) - 1) > n:  # longer than any path: all these ends are on circles
            return None, edges.join(step.select(F.col("o").alias("s")).distinct(), "s", "left_semi").select("s", "o")
    wanted = None if starts is None else checkpoint(starts.select("s").distinct())
    parts: list[DataFrame] = []
    for power in reversed(powers):
        own = power if wanted is None else checkpoint(power.join(wanted, "s", "left_semi").select("s", "o"))
        if parts:
            far = reduce(DataFrame.union, parts)
            parts.append(checkpoint(_met(far, power).select("d.s", "e.o")))
        parts.append(own)
    return reduce(DataFrame.union, parts), None


def _doubled(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """As _paths, for any edges: all pairs so far are joined with those exactly 2^k edges apart."""
    power, known = edges, Grown(edges)
    while True:
        everything = known.all()
        far = everything.withColumn("exact", F.lit(False)).union(power.withColumn("exact", F.lit(True)))
        step = checkpoint(distinct(_met(far, power).select("d.s", "e.o", "d.exact")))
        if not step.where("s = o").isEmpty():
            every = everything.union(step.where("not exact").select("s", "o")).select(F.col("o").alias("s"), F.col("s").alias("o"))
            return None, checkpoint(edges.join(every, ["s", "o"], "left_semi"))
        delta = checkpoint(step.where("not exact").select("s", "o").join(everything, ["s", "o"], "left_anti"))
        power = step.where("exact").select("s", "o")
        if delta.isEmpty():  # paths of up to twice the length reach nothing more
            return everything, None
        known.add(delta)


def reachable(edges: DataFrame, seeds: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Distinct (s, o): nodes reached by one edge or more from the seeds (column s); one hop a round."""
    spark = edges.sparkSession
    edges = edges.select("s", "o")
    few = edges.limit(driver_edges + 1).collect()
    if len(few) <= driver_edges:
        starts = [r[0] for r in seeds.select("s").distinct().limit(driver_edges + 1).collect()]
        pairs = reach([tuple(r) for r in few], starts=starts) if len(starts) <= driver_edges else None
        if pairs is not None:
            return spark.createDataFrame(pairs, "s string, o string")
    edges = checkpoint(edges.distinct())
    delta = checkpoint(seeds.select("s").distinct().join(edges, "s").select("s", "o").distinct())
    known = Grown(delta)
    while True:
        seen = known.all()
        step = delta.alias("d").join(edges.alias("e"), F.col("d.o") == F.col("e.s")).select(F.col("d.s").alias("s"), F.col("e.o").alias("o")).distinct()
        delta = checkpoint(step.join(seen, ["s", "o"], "left_anti"))
        if delta.isEmpty():
            return seen
        known.add(delta)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes with an edge.

    Alternates hooking every larger neighbour to a node's least one with hooking the lesser ones.
    """
    at = checkpoint(edges.where("s <> o").select(F.greatest("s", "o").alias("u"), F.least("s", "o").alias("v")).distinct())
    while True:
        ends = at.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(at.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break  # every node hangs on a least one
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = checkpoint(low.select("u", F.col("m").alias("v")).union(rest).where("u <> v").distinct())
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
