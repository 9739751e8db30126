"""SimHash near-dedup with random bit sampling.

A text's features are its distinct words (runs of letters and digits, lower case); its fingerprint has
``BITS`` bits, each the majority of that bit over the features' hashes.  Rows of equal fingerprints are
gathered first.  Each of ``tables`` hash tables then draws its own random coordinates of the fingerprint:
the first ``base_bits`` of them make a bucket.  Buckets are counted first, and one beyond ``HOLD`` rows is parted by
further bits before rows move, so no task holds more than some ``HOLD`` rows of a bucket.  Rows are partitioned and sorted by bucket, so a bucket is a
run of rows.  Within a bucket all pairs are
verified by their Hamming distance over all ``BITS`` bits, and the links of a spanning forest of the verified
pairs are emitted, which has the same connected components as all pairs; rows found linked are not compared
with one another.  A bucket beyond ``cap`` rows is split by further bits where it lies, in as many independent
ways as bring ``KEEP`` of its pairs at the full distance together in at least one, so what share of the near
copies is found doesn't depend on the number of rows.  Groups are the components over all tables, whatever their
diameter: rounds go on until nothing changes.

Results: null, empty and wordless texts have no fingerprint and always stay as groups of their own; of a
group the row of the smallest identifier stays (repeated rows of one identifier share a group, the row of
the least text stays; a null identifier stays and is not grouped); identifiers that aren't integers are numbered in
their order first; texts of any length count with all their words, in bounded memory; a bit of which half the words
vote each way is set; a distance of exactly ``DISTANCE`` links; other columns pass through whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, numbered

BITS = 256
DISTANCE = 38  # of 256 bits: about 15 % of differing words
TABLES = 36  # bring 93 % of the pairs at the full distance together, and more of the nearer ones
BASE_BITS = 16
CAP = 4096
#: Rows of one bucket that a task holds (40 bytes each).
HOLD = 1 << 20
KEEP = 0.99
WORD = re.compile(r"[^\W_]+")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Four 64-bit words of hash for each 64-bit hash."""
    out = np.empty((len(h), BITS // 64), np.uint64)
    for k in range(BITS // 64):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprints(texts: list[str | None], chunk: int = 1 << 15) -> list[bytes | None]:
    """Fingerprints of whole texts; None for those without words."""
    digest = xxhash.xxh3_64_intdigest
    out: list[bytes | None] = [None] * len(texts)
    rows, hashes, cuts = [], [], [0]

    def flush():
        if not rows:
            return
        h = np.array(hashes, np.uint64)
        totals = np.zeros((len(rows), BITS), np.int32)
        begin = np.array(cuts[:-1])
        for a in range(0, len(h), chunk):  # bounded memory for texts of any length
            b = min(len(h), a + chunk)
            bits = np.unpackbits(_mixed(h[a:b]).view(np.uint8), axis=1)
            first = int(np.searchsorted(begin, a, "right")) - 1
            last = int(np.searchsorted(begin, b, "left"))
            at = np.maximum(begin[first:last] - a, 0)
            totals[first:last] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        n = np.diff(cuts)[:, None]
        packed = np.packbits(2 * totals >= n, axis=1)
        for k, row in enumerate(rows):
            out[row] = packed[k].tobytes()
        rows.clear(), hashes.clear(), cuts.__setitem__(slice(None), [0])

    for i, text in enumerate(texts):
        words = set(WORD.findall(text.lower())) if text else ()
        if words:
            hashes.extend([digest(w) for w in words])
            rows.append(i)
            cuts.append(len(hashes))
            if len(hashes) > 1 << 18:
                flush()
    flush()
    return out


def with_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of the rows that have both; ``id`` bigint, ``fp`` binary."""
    slim = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()), pa.binary())], ["id", "fp"])

    return slim.mapInArrow(run, "id bigint, fp binary").where("fp is not null")


def sampled_coordinates(tables: int, seed: int = 7) -> np.ndarray:
    """64 random coordinates for each table."""
    return np.stack([np.random.default_rng([seed, t]).permutation(BITS)[:64] for t in range(tables)])


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether each row of ``a`` is within ``distance`` of each of ``b``."""
    far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for k in range(1, a.shape[1]):
        far += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return far <= distance


def _links(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs of rows within ``distance``.

    Each component is walked from its first row; a row that is reached leaves the rows still to be compared.
    """
    out = []
    while len(ids) > 1:
        step = max(1, min(len(ids), (1 << 16) // len(ids)))  # a block that stays in cache
        near = _near(fps[:step], fps, distance)
        live = np.ones(len(ids), bool)
        for k in np.nonzero(near.sum(1) > 1)[0]:
            if not live[k]:
                continue
            live[k] = False
            hit = np.nonzero(near[k] & live)[0]
            live[hit] = False
            out += [(int(ids[k]), x) for x in ids[hit].tolist()]
            queue = hit
            while len(queue):
                rest = np.nonzero(live)[0]
                if not len(rest):
                    break
                most = max(1, (1 << 20) // len(rest))
                some, queue = queue[:most], queue[most:]
                found = _near(fps[some], fps[rest], distance)
                hit = found.any(0)
                new = rest[hit]
                live[new] = False
                out += zip(ids[some[found.argmax(0)[hit]]].tolist(), ids[new].tolist())
                queue = np.concatenate([queue, new])
        ids, fps = ids[step:][live[step:]], fps[step:][live[step:]]
    return out


def _bucket_links(ids, fps, cap: int, distance: int):
    """Links in one bucket; beyond ``cap`` rows it is split by further bits, in several ways."""
    if len(ids) < 2:
        return
    if len(ids) <= cap:
        yield from _links(ids, fps, distance)
        return
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)
    open_ = np.nonzero(bits.any(0) & ~bits.all(0))[0]  # all differences are among these
    if len(open_) < distance + int(np.ceil(np.log2(len(ids) / cap))):
        yield from _links(ids, fps, distance)
        return
    further, ways = _ways(len(ids), cap, distance, len(open_))
    if ways >= 1 << further:  # comparing all is no dearer
        yield from _links(ids, fps, distance)
        return
    for way in range(ways):
        at = np.random.default_rng([11, len(ids), way]).permutation(open_)[:further]
        head = bits[:, at].astype(np.int64) @ (1 << np.arange(further, dtype=np.int64))
        order = np.argsort(head, kind="stable")
        edges = np.concatenate([[0], np.nonzero(np.diff(head[order]))[0] + 1, [len(ids)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                yield from _links(ids[order[a:b]], fps[order[a:b]], distance)


def _ways(rows: int, cap: int, distance: int, free: int) -> tuple[int, int]:
    """(further bits, independent draws of them) that part ``rows`` to about ``cap`` and keep ``KEEP`` of the pairs at the full distance."""
    further = int(np.ceil(np.log2(rows / cap)))
    agree = np.prod(1 - distance / (free - np.arange(further)))
    return further, int(np.ceil(np.log(1 - KEEP) / np.log(1 - agree)))


def _codes(fps: np.ndarray, coordinates: np.ndarray, base_bits: int) -> np.ndarray:
    """Bucket of each row (unpacked bits) in a table."""
    code = np.ascontiguousarray(np.packbits(fps[:, coordinates], axis=1)).view(">u8").reshape(len(fps)).astype(np.uint64)
    return (code >> np.uint64(64 - base_bits)).astype(np.int64)


def _unpacked(column) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8), axis=1)


def hot_buckets(fps: DataFrame, tables: int, base_bits: int, hold: int) -> dict[int, int]:
    """Rows (at least) of every bucket that may exceed ``hold``, by bucket.

    A task reports only buckets with a share of ``hold`` that matters: what it leaves out of all tasks together is
    below ``hold`` / 2, which is added.  At most 2 * tables * rows / hold buckets can be hot; a table of no more than ``hold`` rows has none.
    """
    if fps.count() <= hold:
        return {}
    coordinates = sampled_coordinates(tables)
    least = max(1, hold // (2 * max(1, fps.rdd.getNumPartitions())))

    def count(batches):
        total = np.zeros(tables << base_bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                bits = _unpacked(batch.column(1))
                for t in range(tables):
                    total += np.bincount(_codes(bits, coordinates[t], base_bits) + (t << base_bits), minlength=len(total))
        some = np.nonzero(total >= least)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = fps.select("id", "fp").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] + hold // 2 for r in found.where(F.col("n") > hold // 2).collect()}


def similar_links(fps: DataFrame, distance: int = DISTANCE, tables: int = TABLES, base_bits: int = BASE_BITS, cap: int = CAP, hold: int = HOLD) -> DataFrame:
    """(a, b) links between ``id``s of distinct fingerprints whose components are the near-duplicate groups."""
    coordinates = sampled_coordinates(tables)
    hot = {b: _ways(n, hold, distance, BITS - base_bits) for b, n in hot_buckets(fps, tables, base_bits, hold).items() if n > hold}

    def scatter(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bits = _unpacked(batch.column(1))
            for t in range(tables):
                bucket = _codes(bits, coordinates[t], base_bits) + (t << base_bits)
                part = np.zeros(n, np.int64)
                for b in np.unique(bucket) if hot else ():
                    if int(b) in hot:
                        rows = np.nonzero(bucket == b)[0]
                        further, ways = hot[int(b)]
                        free = np.setdiff1d(np.arange(BITS), coordinates[t][:base_bits])
                        for way in range(ways):
                            at = np.random.default_rng([13, int(b), way]).permutation(free)[:further]
                            code = bits[rows][:, at].astype(np.int64) @ (1 << np.arange(further, dtype=np.int64))
                            if way == 0:
                                part[rows] = code
                            else:
                                sub = (way << further) + code
                                yield pa.RecordBatch.from_arrays([pa.array(bucket[rows]), pa.array(sub), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], ["bucket", "part", "id", "fp"])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part), batch.column(0), batch.column(1)], ["bucket", "part", "id", "fp"])

    def sift(batches):
        held: list[tuple] = []
        now = None

        def settle():
            ids, fp = (np.concatenate(x) for x in zip(*held))
            got = list(_bucket_links(ids, fp, cap, distance))
            held.clear()
            return got

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(n, BITS // 64)
            edges = np.concatenate([[0], np.nonzero(np.diff(bucket) | np.diff(part))[0] + 1, [n]])
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and (bucket[a], part[a]) != now:
                    out += settle()
                now = (bucket[a], part[a])
                held.append((ids[a:b], fp[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if held:
            out = settle()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    rows = fps.select("id", "fp").mapInArrow(scatter, "bucket bigint, part bigint, id bigint, fp binary")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")
    return runs.mapInArrow(sift, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each linked id.

    Alternates joining every larger neighbour to a node's smallest one with joining the smaller ones, which
    halves path lengths each round; one aggregate tells when nothing changes.
    """
    at = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = cut(at)
    before = None
    while True:
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        least = both.withColumn("m", F.least(F.col("u"), F.min("v").over(w)))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(w))
        own = least.select("u", F.col("m").alias("v"))
        rest = least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = cut(own.union(rest).where("u <> v").distinct())
        now = at.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return at.select(F.col("u").alias("id"), F.col("v").alias("root"))


def groups_of(prints: DataFrame, **how) -> DataFrame:
    """(id, root) from (id, fp): rows that are near copies of a smaller identifier, ``root`` the group's smallest."""
    same = Window.partitionBy("fp")
    tied = prints.withColumn("head", F.min("id").over(same))
    heads = cut(prints.groupBy("fp").agg(F.min("id").alias("id")))
    return components(similar_links(heads, **how).union(tied.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, root) of the rows that are near copies of a smaller identifier, ``root`` the group's smallest."""
    return groups_of(cut(with_fingerprints(df, id_col, text_col)), **how)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``df`` less the near copies of rows with smaller identifiers."""
    names = numbered(df, id_col)
    if names is not None:
        own, = fresh(df.columns, "number")
        number = names.select(F.col("name").alias(f"{own}_name"), F.col("number").alias(own))
        return near_dedup(df.join(number, F.col(f"`{id_col}`") == F.col(f"{own}_name"), "left").drop(f"{own}_name"), own, text_col, **how).drop(own)
    key, place = fresh(df.columns, "key", "place")
    prints = cut(with_fingerprints(df, id_col, text_col))
    copies = groups_of(prints, **how).select(F.col("id").alias(key))
    worded = F.rlike(F.col(text_col), F.lit("[\\p{L}\\p{N}]"))
    marked = df.withColumn(key, F.when(worded, F.col(id_col).cast("bigint")))  # a null key joins nothing: such rows stay
    kept = marked.join(copies, key, "left_anti")
    repeated = prints.groupBy(F.col("id").alias(key)).agg(F.count("*").alias(place)).where(F.col(place) > 1).select(key)
    if not repeated.isEmpty():
        repeated = cut(repeated)
        first = Window.partitionBy(key).orderBy(text_col)
        again = kept.join(repeated, key, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
        kept = kept.join(repeated, key, "left_anti").unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
