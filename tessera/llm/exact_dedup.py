"""Exact dedup by content sort.

``repartitionByRange`` samples splitters of the normalised text and sends each range to one task.  What is
sampled, and so reaches the driver, is a short sort key: the text's first ``HEAD`` characters and a hash
that parts longer texts with one beginning.  The external sort of the task orders by that key and then by
the whole text, which puts equal texts side by side in order of identifier, and a window over the same
order compares each row's whole text with the neighbour before it; the first row of a run stays.  The window
needs no exchange of its own since a range partitioning on the key already keeps equal texts together.

Normalised: runs of ASCII white space become one space, outer spaces go.  The raw text travels beside it
only where the two differ.

Results: texts of any length are compared whole; rows of null text are no one's copies and all stay (they are spread by identifier, not put into
one range); all empty or blank texts are copies of each other; among equals the smallest identifier stays,
a null identifier only if there is no other, and of wholly repeated rows one; identifiers may be of any type that sorts; other columns pass through
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh


HEAD = 24


def normalised(text):
    return F.trim(F.regexp_replace(text, SPACE, " "))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Rows of ``df`` less those whose normalised text an earlier identifier has."""
    key, raw, head, spread, before = fresh(df.columns, "key", "raw", "head", "spread", "before")
    columns = df.columns
    norm = normalised(F.col(text_col))
    slim = df.select(
        *[F.col(f"`{c}`") for c in columns if c.lower() != text_col.lower()],
        norm.alias(key),
        F.when(norm != F.col(text_col), F.col(text_col)).alias(raw),
        F.substring(norm, 1, HEAD).alias(head),
        F.when(F.col(text_col).isNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(norm)).alias(spread),
    )
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [F.col(head), F.col(spread)]
    order = [F.col(id_col).asc_nulls_last(), F.col(raw).asc_nulls_first()]
    ranged = slim.repartitionByRange(n, *sides).sortWithinPartitions(*sides, key, *order)
    run = Window.partitionBy(*sides, key).orderBy(*order)
    first = ranged.withColumn(before, F.row_number().over(run)).where((F.col(before) == 1) | F.col(key).isNull())
    return first.select(*[F.coalesce(raw, key).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in columns])
