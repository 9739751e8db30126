"""Query results in the W3C JSON format."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import terms


def bindings(df: DataFrame) -> DataFrame:
    """(binding): one JSON object a solution; unbound variables are left out."""

    def one(c: str):
        t = F.col(f"`{c}`")
        kind = F.when(terms.is_iri(t), "uri").when(terms.is_blank(t), "bnode").otherwise("literal")
        value = F.when(terms.is_blank(t), F.substr(t, F.lit(3), F.length(t))).otherwise(terms.lex(t))
        lang, given = terms.lang(t), F.regexp_extract(t, '"\\^\\^<([^<>"]*)>$', 1)
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), F.when(lang != "", lang).alias("xml:lang"), F.when(given != "", given).alias("datatype"))).alias(c)

    return df.select(F.to_json(F.struct(*[one(c) for c in df.columns])).alias("binding"))


def to_json(df: DataFrame) -> str:
    """A results document on the driver."""
    if df.columns == ["answer"]:
        return json.dumps({"head": {}, "boolean": bool(df.first()[0])})
    rows = [json.loads(r["binding"]) for r in bindings(df).collect()]
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}})
