"""Language ID by compression with per-language zstandard dictionaries.

A bounded sample of labelled rows gives each language a raw-content dictionary; a text is compressed with
every dictionary and gets the language of the smallest result.  It is rejected when the margin between the
two smallest sizes, over the second, is below ``min_margin``.  A text longer than half the compressors' window
is compressed in equal pieces that together cover it, each with the dictionary in reach, and the sizes of its
pieces are added, so the margin doesn't depend on length.

The sample bound is ``sample_rows`` rows and ``dict_bytes`` bytes a language (rows over 200 characters first,
each in order of a hash of their identifier, ``sample_chars`` characters of each); everything else sees whole texts of all rows.

Results: texts of any length are judged whole; null, empty and blank texts and ties are rejected (``pred_lang`` null, ``margin`` 0); labels that
are null, or whose rows are all blank, give no dictionary; with no labelled row at all everything is rejected, with one language
everything non-blank has that language with margin 1; repeated rows get equal results; input columns with the output's names are replaced, others pass through;
an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without


def squeezed(text: str) -> str:
    return " ".join(text.lower().split())


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", dict_bytes: int = 128 << 10, sample_rows: int = 96, sample_chars: int = 4000) -> dict[str, bytes]:
    """Dictionaries by language, from at most ``sample_rows`` labelled rows each.

    The rank by hash is pruned before its exchange (a limit per group), so only the sampled rows' heads move.
    """
    order, = fresh(df.columns, "order")
    head = F.substring(text_col, 1, sample_chars)
    rows = df.where(F.col(label_col).isNotNull() & F.rlike(head, F.lit("\\S"))).select(F.col(label_col).cast("string").alias("label"), (F.length(text_col) <= 200).alias("short"), F.xxhash64(id_col).alias("h"), head.alias("head"))
    best = Window.partitionBy("label").orderBy("short", "h", "head")
    got = rows.withColumn(order, F.row_number().over(best)).where(F.col(order) <= sample_rows).collect()
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["label"], r[order])):
        if plain := squeezed(r["head"]):
            out[r["label"]] = out.get(r["label"], "") + plain + "\n"
    return {k: v.encode()[:dict_bytes] for k, v in sorted(out.items())}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.langs = sorted(dictionaries)
        self.each = []
        fitted = lambda lang, **more: zs.ZstdCompressionParameters.from_level(level, dict_size=len(dictionaries[lang]), source_size=4096, write_content_size=False, write_dict_id=False, **more)
        window = max((fitted(lang).window_log for lang in self.langs), default=0)  # one for all, as they share the pieces
        self.piece = (1 << window) // 2
        for lang in self.langs:
            raw = zs.ZstdCompressionDict(dictionaries[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            self.each.append(zs.ZstdCompressor(dict_data=raw, compression_params=fitted(lang, window_log=window)))

    def __call__(self, text: str | None, min_margin: float) -> tuple[str | None, float]:
        plain = squeezed(text).encode() if text else b""
        if not plain or not self.langs:
            return None, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        n = -(-len(plain) // self.piece)
        pieces = [plain[i * len(plain) // n : (i + 1) * len(plain) // n] for i in range(n)]
        sizes = sorted((sum(len(c.compress(x)) for x in pieces), k) for k, c in enumerate(self.each))
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return (self.langs[sizes[0][1]] if sizes[0][0] < sizes[1][0] and margin >= min_margin else None), margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.005, level: int = 6) -> DataFrame:
    """``df`` with ``pred_lang`` (null: rejected) and ``margin``."""
    base = without(df, "pred_lang", "margin")
    at = [c.lower() for c in base.columns].index(text_col.lower())
    schema = T.StructType(base.schema.fields + [T.StructField("pred_lang", T.StringType()), T.StructField("margin", T.DoubleType())])

    def run(batches):
        judge = Compressors(dictionaries, level)
        for batch in batches:
            got = [judge(t, min_margin) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema.names)

    return base.mapInArrow(run, schema)
