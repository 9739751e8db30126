"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the next stage's documents; a stage's input goes once its result is written.

All stages: texts of any length are read whole; repeated rows are each judged; columns that the operators don't know pass through
whatever their names; an empty table gives an empty table.  What becomes of nulls, empty texts and ties stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, mixing, simhash, sp_codec
from tessera.llm.common import remove, shared_path, small_batches
from tessera.llm.queries import PIECE_MODEL, SEED, TEXTS, WEIGHTS, levels

#: Share of the remaining tokens that the mixture keeps.
BUDGET = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors can tell.

    Null, empty and blank texts go, as do ties and narrow margins; null languages only give no dictionary, so their documents stay
    if their text can be told.
    """
    small_batches(spark, TEXTS)
    judged = langid.identify(docs, langid.fit(docs))
    return judged.where(F.col("pred_lang").isNotNull()).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the smallest identifier, a null one only if there is no other.

    Null texts all stay; empty and blank texts are copies of each other.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest identifier.

    Null, empty and wordless texts and null identifiers stay; of rows with one identifier one stays.
    """
    small_batches(spark, TEXTS)
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each domain's, language's and source's share of the token budget, at most once each document.

    Null languages and sources are nodes of their own; texts without tokens cost nothing and go with their place in the order; equal identifiers
    are taken together or not at all.
    """
    return mixing.mix(docs, levels(), WEIGHTS, F.col("all_tokens") * BUDGET, seed=SEED, max_epochs=1).drop("epoch")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with their count and the text they decode to; null texts give nulls, empty texts no ids."""
    small_batches(spark, TEXTS)
    return sp_codec.encode_decode(docs, PIECE_MODEL)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Compression, fingerprints and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
