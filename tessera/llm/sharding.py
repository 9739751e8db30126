"""Sharding by vector bin packing.

Rows are gathered into groups (a key, cut into sub-groups where it exceeds a share of one shard), each with a
vector of bytes, tokens and rows.  Shards are filled jointly: groups go, largest first, to the shard where
the dot product of the group's vector and the shard's residual capacity is highest among those it fits,
else where the overrun is least.  Vectors are in units of the totals, so the three resources count alike.

Packing goes in cells of at most ``cell_shards`` shards (32 GB of shards by default): each cell is packed by one
task in one pass over its groups, so neither the driver nor any task sees more than a cell's groups however
large the table; up to one cell the rule compares all shards.  Sub-groups are dealt to cells in snake order
of size, within classes of like size that are split by hash into decks of some ``DECK`` sub-groups, so no task
sorts more than a deck.

How many sub-groups a key has follows from its share of the totals and the number of shards, without a bound.

Results: rows of a null key form the group ``(null)``; null and empty texts weigh 0 bytes and tokens, 1
row; texts of any length are measured whole; rows with equal identifiers (also null) go to one sub-group; ties go to the lower shard; one text
larger than a shard has an overfull shard; an empty table gives an empty table; ``shard`` replaces an input column, others pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, token_count, without

RESOURCES = ["bytes", "tokens", "rows"]
#: Sub-groups that are dealt to cells together.
DECK = 250_000


def place(vectors: np.ndarray, shards: int, total: np.ndarray | None = None) -> np.ndarray:
    """Shard of each group (rows of ``vectors``), by falling size; the packing heuristic itself."""
    vectors = np.asarray(vectors, float)
    total = np.maximum(vectors.sum(0), 1e-12) if total is None else total
    load = vectors / total * shards  # a shard's capacity is 1 in each resource
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for g in np.lexsort((np.arange(len(load)), -load.sum(1), -load.max(1))):
        left = room - load[g]
        fits = (left >= -1e-9).all(1)
        if fits.any():
            score = np.where(fits, room @ load[g], -np.inf)
        else:
            score = left.min(1)
        out[g] = s = int(np.argmax(score))
        room[s] -= load[g]
    return out


def assign(df: DataFrame, group: Column, shards: int | None = None, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", groups_per_shard: int = 16, cell_shards: int = 2048) -> DataFrame:
    """``df`` with its ``shard`` (0 ..); ``shards`` defaults to total bytes / ``shard_bytes``, rounded up."""
    base = without(df, "shard")
    key, h = fresh(base.columns + ["shard"], "key", "h")
    marked = base.withColumn(key, F.coalesce(group.cast("string"), F.lit("(null)"))).withColumn(h, F.xxhash64(F.col(f"`{id_col}`")))
    text = F.col(f"`{text_col}`")
    # what packing needs of a row, some 40 bytes; texts are read once for it
    rows = cut(marked.select(F.col(key).alias("key"), F.col(h).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), token_count(text).alias("tokens")))
    sums = [F.sum("bytes").cast("double").alias("bytes"), F.sum("tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("rows")]
    keys = cut(rows.groupBy("key").agg(*sums))
    totals = keys.agg(*[F.sum(r).alias(r) for r in RESOURCES]).first()
    if not totals["rows"]:
        return base.withColumn("shard", F.lit(0).cast("bigint"))
    n = shards or max(1, -(-int(totals["bytes"]) // shard_bytes))
    piece = {r: max(totals[r] / (n * groups_per_shard), 1e-9) for r in RESOURCES}
    want = keys.select("key", F.greatest(F.lit(1), *[F.ceil(F.col(r) / piece[r]).cast("bigint") for r in RESOURCES]).alias("subs"))
    # a key's rows meet its one row of ``want``; adaptive execution broadcasts it or splits hot keys
    parts = cut(rows.join(want, "key").groupBy("key", F.pmod("h", "subs").alias("sub")).agg(*sums))
    cells = -(-n // cell_shards)
    if cells > 1:
        size = sum((F.col(r) / float(max(totals[r], 1e-12)) for r in RESOURCES), F.lit(0.0))
        decks = -(-parts.count() // DECK)
        deck = F.pmod(F.xxhash64("key", "sub"), F.lit(decks))
        band = F.floor(F.log2(size + F.lit(1e-18)))
        turn = F.row_number().over(Window.partitionBy(band, deck).orderBy(F.desc(size), "key", "sub")) - 1
        lap, at = F.floor(turn / cells), F.pmod(turn, F.lit(cells))
        snake = F.when(lap % 2 == 0, at).otherwise(cells - 1 - at)
        parts = parts.withColumn("cell", F.pmod(snake + deck * 7919, F.lit(cells)).cast("int"))  # decks begin at different cells
    else:
        parts = parts.withColumn("cell", F.lit(0))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        first = cell * n // cells
        own = (cell + 1) * n // cells - first
        pdf = pdf.sort_values(["key", "sub"]).reset_index(drop=True)
        pdf["shard"] = first + place(pdf[RESOURCES].to_numpy(), own)
        return pdf[["key", "sub", "shard"]]

    placed = cut(parts.groupBy("cell").applyInPandas(pack, "key string, sub bigint, shard bigint"))
    sub, subs = fresh(base.columns + ["shard", key, h], "sub", "subs")
    cut_keys = marked.join(want.select(F.col("key").alias(key), F.col("subs").alias(subs)), key).withColumn(sub, F.pmod(F.col(h), F.col(subs)))
    table = placed.select(F.col("key").alias(key), F.col("sub").alias(sub), "shard")
    return cut_keys.join(table, [key, sub]).select(*[F.col(f"`{c}`") for c in base.columns], "shard")
