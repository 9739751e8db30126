"""The change log as a stream: new commits are read as they appear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versioned import LOG


def changes(spark: SparkSession, path: str) -> DataFrame:
    """Streaming rows of a log folder, with ``ts`` as event time; any source of the same columns serves as well."""
    return spark.readStream.schema(LOG).parquet(path).withColumn("ts", F.to_timestamp("timestamp"))


def activity(rows: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, g, insertions, removals) per tumbling window; rows later than ``late`` are left out."""
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "g").agg(F.count_if("is_insertion").alias("insertions"), F.count_if(~F.col("is_insertion")).alias("removals"))
    return counted.select(F.col("window.start").alias("start"), "g", "insertions", "removals")


def each_commit(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts ``act(micro-batch, number)`` for all that is there and stops; run again to continue."""
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def derive(rules: DataFrame, target: str) -> Callable[[DataFrame, int], None]:
    """An action for ``each_commit``: applies rules (p, what, q) that need one triple to each inserted triple.

    Results go to a folder per micro-batch, so a batch that is run again replaces what it wrote.
    """

    def act(batch: DataFrame, number: int) -> None:
        hit = batch.where("is_insertion").select("g", "s", "p", "o").join(rules, "p")
        swap = F.col("what") == "swap"
        out = hit.select("g", F.when(swap, F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"), F.when(swap, F.col("s")).otherwise(F.col("o")).alias("o"))
        out.distinct().write.mode("overwrite").parquet(f"{target}/batch={number}")

    return act
