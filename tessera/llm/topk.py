"""Exact top-k inner products over norm-sorted, rotated vectors.

The vectors are rotated by the singular vectors of the whole table (from one distributed Gram matrix), so
that leading coordinates carry most of every inner product, and sorted by falling length: a range partition each
task, sorted inside.  The query set goes to the table in batches of ``query_bytes``, each broadcast with a
first bar for every query, the k-th best score within the ``HEAD`` longest vectors.  A task streams its range
in blocks for all queries of the batch.  For a block it
takes partial sums over the leading coordinates; by Cauchy-Schwarz the rest adds at most the product of the
two residual lengths, which enters the same matrix product as one more coordinate.  Only pairs whose bound
reaches the query's k-th best score so far go on: to a longer partial sum of the whole block while many
remain, else to their full scores.  How far blocks of this table have to be summed is learnt from the block
before.  As lengths fall, a group of queries stops once none can gain from the next block's length.  The k best
of every range meet in one aggregate a query; each batch's result is written to the shared folder.

Partial sums are in single precision between vectors scaled to length 1 (queries) or to the block's longest
(table), with a slack beyond their rounding error; full scores are computed in double precision from the
unrotated vectors, scaled by one power of two for the whole table, so results are exact at any magnitude.

Results: the rows that ``queries`` picks (default: all) are queries, against all rows; a row is no neighbour of itself, told by identifier (repeated rows of one
identifier are one vector if equal; rows of one identifier but unequal vectors keep the first by value);
ties go to the smaller identifier; null identifiers, null or empty vectors, vectors with nulls, NaN or
infinite values, and vectors of another length than the commonest are left out as queries and neighbours;
tables with fewer than k + 1 vectors give what there is; scores beyond double precision are infinite, their order still exact;
identifiers that aren't integers keep their type; other columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, shared_path

OUT = "query_id bigint, rank int, neighbor_id bigint, score double"
#: So many of the longest vectors give the first bars.
HEAD = 2048


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, queries: Column | None = None) -> tuple[DataFrame, int]:
    """(id, vec, asks) of usable rows, and their common length (0: none)."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("vec"), asks.alias("asks"))
    rows = rows.where((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows, 0
    return rows.where(F.size("vec") == sizes["d"]).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")), sizes["d"]


def rotation(rows: DataFrame, d: int, scale: float) -> np.ndarray:
    """Right singular vectors of the table, by falling singular value."""

    def gram(batches):
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0)) * scale
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist())], ["i", "row"])

    parts = rows.select("vec").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    table = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((d, d))
    for r in table:
        g[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best of (query, score, id), in order."""
    order = np.lexsort((ids, -score, q))
    first = np.concatenate([[True], np.diff(q[order]) != 0]) if len(order) else np.zeros(0, bool)
    start = np.nonzero(first)[0]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


#: Above this share of surviving pairs a longer partial sum of the whole block is cheaper than single full scores.
MANY = 0.01


class Heads:
    """Partial vectors of a matrix: for each level the leading coordinates and the length of the rest."""

    def __init__(self, vecs: np.ndarray, turn: np.ndarray, levels: list[int]):
        self.rot = (vecs @ turn).astype(np.float32)
        self.levels, self.parts = levels, {}

    def at(self, level: int) -> np.ndarray:
        got = self.parts.get(level)
        if got is None:
            h = self.levels[level]
            got = self.rot
            if h < got.shape[1]:
                rest = np.sqrt((got[:, h:].astype(np.float64) ** 2).sum(1))
                got = np.column_stack([got[:, :h], rest.astype(np.float32)])
            self.parts[level] = got
        return got


class Queries:
    """A group of queries and their best neighbours so far, none below ``bar``."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, bar: np.ndarray, turn: np.ndarray, levels: list[int], k: int):
        self.ids, self.vecs, self.k, self.level, self.open = ids, vecs, k, 0, True
        self.norms = np.linalg.norm(vecs, axis=1)
        self.heads = Heads(vecs / np.maximum(self.norms, 1e-300)[:, None], turn, levels)
        self.first = self.bar = bar
        self.got = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def see(self, bid: np.ndarray, bvec: np.ndarray, longest: float, block: Heads) -> None:
        """``block`` holds ``bvec`` over ``longest``, the length of its first row."""
        size = self.norms * longest
        slack = 2e-7 * (bvec.shape[1] + 8)
        if (size * (1 + slack) < self.bar).all():
            self.open = False
            return
        last = len(self.heads.levels) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            floor = np.where(size > 0, self.bar / size, np.where(self.bar > 0, np.inf, -np.inf)) - slack
        floor = np.nextafter(np.clip(floor, -4, 4).astype(np.float32), np.float32(-np.inf))[:, None]  # bounds lie within 1
        level = max(0, self.level - 1)  # a level lower may do for shorter vectors
        if level < self.level and bid[0] % 8:
            level = self.level
        while True:
            bound = self.heads.at(level) @ block.at(level).T
            pairs = np.flatnonzero(bound >= floor)
            if level == last or len(pairs) <= MANY * bound.size:
                break
            level += 1
        self.level = level
        qi, xi = np.divmod(pairs, len(bid))
        other = self.ids[qi] != bid[xi]
        qi, xi = qi[other], xi[other]
        score = np.empty(len(qi))
        for a in range(0, len(qi), 1 << 17):
            part = slice(a, a + (1 << 17))
            score[part] = (self.vecs[qi[part]] * bvec[xi[part]]).sum(1)
        q, s, i = np.concatenate([self.got[0], qi]), np.concatenate([self.got[1], score]), np.concatenate([self.got[2], bid[xi]])
        keep = _best(q, s, i, self.k)
        self.got = (q[keep], s[keep], i[keep])
        ends = np.nonzero(np.append(np.diff(self.got[0]) != 0, len(self.got[0]) > 0))[0]
        filled = np.bincount(self.got[0], minlength=len(self.ids)) >= self.k
        mine = self.got[0][ends]
        own = np.full(len(self.ids), -np.inf)
        own[mine] = np.where(filled[mine], self.got[1][ends], -np.inf)
        self.bar = np.maximum(self.first, own)


def levels_of(d: int) -> list[int]:
    """Lengths of the partial sums: half, three quarters and all of the coordinates."""
    return sorted({max(1, d // 2), max(1, 3 * d // 4), d})


def top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None, block: int = 2048, batch: int = 2048, query_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank from 1, neighbor_id, score): the k largest inner products of every query with other rows.

    ``queries``: a boolean column over ``df``, the rows to ask for (default: all).
    """
    names = numbered(df, id_col)
    if names is not None:
        number = names.select(F.col("name").alias("__name"), F.col("number").alias("__id"))
        slim = df.select(F.col(f"`{id_col}`").alias("__name"), F.col(f"`{vec_col}`").alias("__vec"), (F.lit(True) if queries is None else queries).alias("__asks"))
        got = top_k(slim.join(number, "__name"), k, "__id", "__vec", F.col("__asks"), block, batch, query_bytes)
        for c in ("query_id", "neighbor_id"):
            got = got.join(names.select(F.col("number").alias(c), F.col("name").alias(f"{c}_")), c).drop(c)
        return got.select(F.col("query_id_").alias("query_id"), "rank", F.col("neighbor_id_").alias("neighbor_id"), "score")
    spark = df.sparkSession
    rows, d = clean_vectors(df, id_col, vec_col, queries)
    if not d:
        return spark.createDataFrame([], OUT)
    rows = cut(rows)
    most = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 0.0
    power = max(-1000, min(1000, -math.frexp(most)[1])) if most else 0
    scale = 2.0**power
    turn = rotation(rows, d, scale)
    levels = levels_of(d)

    def measure(batches):
        for b in batches:
            x = _matrix(b.column(1)) * scale if b.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.linalg.norm(x, axis=1)), b.column(2)], ["id", "vec", "norm", "asks"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = cut(rows.mapInArrow(measure, "id bigint, vec array<double>, norm double, asks boolean"))
    table = measured.select("id", "vec", "norm").repartitionByRange(n, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    asked = measured.where("asks").select("id", "vec")
    top = measured.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "vec").toArrow()
    top_ids, top_vecs = top.column("id").to_numpy(), _matrix(top.column("vec").combine_chunks())

    def first_bar(batches):
        for b in batches:
            if b.num_rows:
                score = _matrix(b.column(1)) @ top_vecs.T
                score[b.column(0).to_numpy()[:, None] == top_ids[None, :]] = -np.inf
                # a hair lower: full scores are summed in another order
                bar = np.partition(score, -k, axis=1)[:, -k] if len(top_ids) >= k else np.full(b.num_rows, -np.inf)
                size = np.linalg.norm(_matrix(b.column(1)), axis=1) * np.linalg.norm(top_vecs[0])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bar - 1e-12 * (d + 8) * size)], ["id", "vec", "bar"])

    parts = -(-asked.count() * d * 8 // query_bytes)
    barred = cut(asked.mapInArrow(first_bar, "id bigint, vec array<double>, bar double").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, parts)))))
    path = shared_path(spark, "neighbours")
    for part in range(max(1, parts)):
        held = barred.where(F.col("part") == part).select("id", "vec", "bar").toArrow()
        ask = spark.sparkContext.broadcast((held.column("id").to_numpy(), _matrix(held.column("vec").combine_chunks()) if held.num_rows else np.zeros((0, d)), held.column("bar").to_numpy()))

        def run(batches, ask=ask):
            ids, vecs, bars = ask.value
            groups = [Queries(ids[a : a + batch], vecs[a : a + batch], bars[a : a + batch], turn, levels, k) for a in range(0, len(ids), batch)]
            for whole in batches:
                for at in range(0, whole.num_rows, block):
                    b = whole.slice(at, block)
                    bid, bvec, longest = b.column(0).to_numpy(), _matrix(b.column(1)), float(b.column(2)[0].as_py())
                    heads = Heads(bvec / max(longest, 1e-300), turn, levels)
                    for g in groups:
                        if g.open:
                            g.see(bid, bvec, longest, heads)
            for g in groups:
                q, score, other = g.got
                yield pa.RecordBatch.from_arrays([pa.array(g.ids[q]), pa.array(other), pa.array(score)], ["query_id", "neighbor_id", "score"])

        near = table.mapInArrow(run, "query_id bigint, neighbor_id bigint, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id"))
        best = near.withColumn("rank", place).where(F.col("rank") <= k)
        best.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", (F.col("score") / scale / scale).alias("score")).write.mode("append").parquet(path)
        ask.destroy()
    return spark.read.schema(OUT).parquet(path)
