"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, *stems: str) -> list[str]:
    """Column names that clash with none of ``taken`` (Spark resolves names without case)."""
    used = {c.lower() for c in taken}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to write."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def shared_dir(spark: SparkSession) -> str:
    """This application's folder that all executors see, below ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine is made, on a local master only; a cluster raises.
    """
    context = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not set_dir and not held.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    if not held.isDefined():
        context.setCheckpointDir(set_dir)
    return f"{(set_dir or held.get()).rstrip('/')}/tessera-{context.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table lasts until ``release``."""
    path = shared_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder; their results can't be read again."""
    remove(spark, shared_dir(spark))


def numbered(df: DataFrame, id_col: str) -> DataFrame | None:
    """(name, number): integers in the order of ``id_col``'s values, or None where these are integers themselves.

    Ranges of sorted values are numbered one by one, so nothing is gathered in one task; written out, so that
    numbers hold.
    """
    kind = df.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        return None
    names = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("name")).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(names.repartitionByRange(n, "name").sortWithinPartitions("name").withColumn("number", F.monotonically_increasing_id()))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def token_count(text) -> "F.Column":
    """Number of runs of other characters than white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("bigint")
