"""The registered queries of this subpackage, their parameters and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, line_dedup, mixing, pii, sharding, simhash, sp_codec, topk, url_filter
from .common import small_batches, table

PIECE_MODEL = os.environ.get("TESSERA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Batches handed to Python hold at most so many texts.
TEXTS = 1000

#: Level 0: domain, level 1: language, level 2: source; nodes that aren't named weigh 1.
WEIGHTS = {(0, "web"): 0.5, (0, "books"): 0.3, (0, "forum"): 0.2, (1, "en"): 0.6, (1, "fr"): 0.15, (1, "de"): 0.15, (1, "es"): 0.1}
DOMAINS = {0: "web", 1: "books", 2: "forum"}
SEED = 11
EPOCHS = 2

RULES = [
    (1, "block", "*://*.cheap-pills.*"),
    (2, "block", "*://cheap-pills.*"),
    (3, "block", "*casino*"),
    (4, "block", "http://m.*"),
    (5, "block", "*/fr/?"),
    (6, "block", "*?page=*&ref=*"),
    (7, "block", "*.html"),
    (8, "allow", "https://www.*/en/*"),
    (9, "allow", "*://blog.*.example.org/*"),
    (10, "block", "*://*.example.net/de/1??*"),
]


def levels() -> list[F.Column]:
    """Domain (by source name), language and source of a document."""
    turn = F.pmod(F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(3))
    domain = F.when(turn == 0, "web").when(turn == 1, "books").when(turn == 2, "forum")
    return [domain, F.col("lang"), F.col("source")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, TEXTS)
    return table(spark, sf_dir, "documents")


def q_sentencepiece(spark, sf_dir):
    return sp_codec.encode_decode(documents(spark, sf_dir), PIECE_MODEL).select("doc_id", "n_tokens", "ids", "decoded")


def q_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def q_pii(spark, sf_dir):
    return pii.extract(documents(spark, sf_dir))


def q_topk(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, queries=F.col("vec_id") % 20 == 0).withColumn("score", F.round("score", 6))


def q_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "lang", "pred_lang", F.round("margin", 6).alias("margin"))


def q_simhash(spark, sf_dir):
    return simhash.near_dedup(documents(spark, sf_dir))


def q_line_dedup(spark, sf_dir):
    return line_dedup.page_lines_dedup(table(spark, sf_dir, "pages")).drop("html")


def q_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), levels(), WEIGHTS, F.col("all_tokens"), seed=SEED, max_epochs=EPOCHS)


def q_sharding(spark, sf_dir):
    return sharding.assign(documents(spark, sf_dir), F.col("source")).select("doc_id", "source", "n_chars", "shard")


def q_url_filter(spark, sf_dir):
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), RULES).select("page_id", "url", "canonical", "rule_ids", "verdict")


def q_pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sentencepiece": q_sentencepiece,
    "op2_exact_dedup": q_exact_dedup,
    "op3_pii": q_pii,
    "op4_topk": q_topk,
    "op5_langid": q_langid,
    "op6_simhash": q_simhash,
    "op7_line_dedup": q_line_dedup,
    "op8_mixing": q_mixing,
    "op9_sharding": q_sharding,
    "op10_url_filter": q_url_filter,
    "pipeline": q_pipeline,
}

EXACT_SQL = r"""
WITH n AS (
  SELECT *, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS norm FROM documents
)
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS place FROM n
) WHERE place = 1 OR norm IS NULL
"""

TOPK_SQL = """
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS place FROM s
)
SELECT query_id, place::INTEGER AS rank, neighbor_id, round(score, 6) AS score FROM r WHERE place <= 10
"""

def _cut_sql(x: str, begin: str, end: str, by: str) -> str:
    """``x`` with each stretch from ``begin`` to ``end`` replaced."""
    return f"array_to_string(list_transform(string_split({x}, '{begin}'), lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, '{end}') THEN {by} || substr(x, strpos(x, '{end}') + {len(end)}) ELSE {by} END), '')"


_BLOCKS = ", ".join(f"'{x}'" for x in "p br div li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer body html head title meta".split())
LINE_SQL = f"""
WITH q AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         {_cut_sql(_cut_sql(_cut_sql("html", "<!--", "-->", "''"), "<script", "</script>", "chr(10)"), "<style", "</style>", "chr(10)")} AS page FROM pages
), t AS (
  SELECT *, array_to_string(list_transform(string_split(page, '<'), lambda x, i: CASE WHEN i = 1 THEN x ELSE
      CASE WHEN starts_with(x, '!') THEN '' WHEN list_contains([{_BLOCKS}], lower(ltrim(split_part(split_part(x, '>', 1), ' ', 1), '/'))) THEN chr(10) ELSE ' ' END
      || CASE WHEN contains(x, '>') THEN substr(x, strpos(x, '>') + 1) ELSE '' END END), '') AS raw FROM q
), u AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain FROM t
), p AS (
  SELECT page_id, url, host, list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM u
), hosts AS (
  SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 4
), l AS (
  SELECT page_id, url, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM p
), boiler AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT page_id) AS n FROM l GROUP BY host, line) c JOIN hosts USING (host)
  WHERE n / pages > 0.5
), judged AS (
  SELECT l.*, boiler.line IS NOT NULL AS bad FROM l LEFT JOIN boiler ON l.host = boiler.host AND l.line = boiler.line
), done AS (
  SELECT page_id, string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT bad) AS text, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped
  FROM judged GROUP BY page_id
)
SELECT p.page_id, p.url, CASE WHEN p.lines IS NOT NULL THEN coalesce(d.text, '') END AS text,
       coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_dropped, 0) AS n_dropped
FROM p LEFT JOIN done d USING (page_id)
"""


def _case(level: int) -> str:
    return " ".join(f"WHEN '{name}' THEN {w}" for (at, name), w in sorted(WEIGHTS.items()) if at == level)


def _level_sql(k: int, keys: str, above: str) -> str:
    """Shares of the nodes of one level from those above: raise the siblings' water level until it fits."""
    part = f"PARTITION BY {above}" if above else ""
    parent = f"b{k - 1}" if k else "root"
    weight = f"CASE l{k} {_case(k)} ELSE 1.0 END" if _case(k) else "1.0"
    using = f"JOIN {parent} USING ({above})" if above else f"CROSS JOIN {parent}"
    return f"""
n{k} AS (SELECT {keys}, ({weight})::DOUBLE AS w, sum(tokens) * {EPOCHS}.0::DOUBLE AS cap FROM leaves GROUP BY {keys}),
f{k} AS (
  SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, l{k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(w) OVER ({part} ORDER BY cap / w, l{k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM n{k} {using}),
m{k} AS (
  SELECT *, min_by((budget - done) / rest, cap / w) FILTER (WHERE cap / w >= (budget - done) / rest) OVER ({part}) AS water
  FROM f{k}),
b{k} AS (SELECT {keys}, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS budget FROM m{k})"""


MIX_SQL = f"""
WITH d AS (
  SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS t,
         CASE try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE '(null)' END AS l0,
         coalesce(lang, '(null)') AS l1, coalesce(source, '(null)') AS l2
  FROM documents
), leaves AS (SELECT l0, l1, l2, sum(t) AS tokens FROM d GROUP BY l0, l1, l2),
root AS (SELECT sum(tokens)::DOUBLE AS budget FROM leaves),
{_level_sql(0, "l0", "")},
{_level_sql(1, "l0, l1", "l0")},
{_level_sql(2, "l0, l1, l2", "l0, l1")},
leaf AS (
  SELECT l0, l1, l2, tokens, floor(b2.budget + 1e-6)::BIGINT AS budget FROM leaves JOIN b2 USING (l0, l1, l2)
), whole AS (
  SELECT *, CASE WHEN tokens > 0 THEN least({EPOCHS}, budget // tokens) ELSE {EPOCHS} END AS epochs FROM leaf
), placed AS (
  SELECT d.*, w.epochs, w.budget - w.epochs * w.tokens AS rest,
         sum(t) OVER (PARTITION BY l0, l1, l2 ORDER BY md5('{SEED}:' || w.epochs || ':' || doc_id)) AS upto
  FROM d JOIN whole w USING (l0, l1, l2)
), counted AS (
  SELECT *, epochs + CASE WHEN epochs < {EPOCHS} AND upto <= rest THEN 1 ELSE 0 END AS times FROM placed
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(times::BIGINT))::INTEGER AS epoch FROM counted
"""

_CANON = r"""
WITH c0 AS (SELECT page_id, url, split_part(trim(replace(replace(replace(replace(url, chr(9), ''), chr(10), ''), chr(13), ''), chr(12), ''), ' '), '#', 1) AS bare FROM pages),
c1 AS (SELECT *, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', 0)) AS head FROM c0),
c2 AS (SELECT page_id, url, CASE WHEN starts_with(head, 'http://') AND ends_with(head, ':80') THEN head[:-4] WHEN starts_with(head, 'https://') AND ends_with(head, ':443') THEN head[:-5] ELSE head END AS head, substr(bare, length(head) + 1) AS tail FROM c1),
c3 AS (SELECT *, split_part(tail, '?', 1) AS path, regexp_replace('&' || substr(tail, length(split_part(tail, '?', 1)) + 2), '&(utm_[^&]*)?(&|$)', '&', 'g') AS q1 FROM c2),
c AS (SELECT page_id, url, head || path || CASE WHEN q3 = '' THEN '' ELSE '?' || q3 END AS canonical
      FROM (SELECT *, trim(regexp_replace(regexp_replace(q1, '&utm_[^&]*', '', 'g'), '&+', '&', 'g'), '&') AS q3 FROM c3))
"""


def _like(glob: str) -> str:
    for plain, escaped in (("!", "!!"), ("%", "!%"), ("_", "!_"), ("*", "%"), ("?", "_")):
        glob = glob.replace(plain, escaped)
    return glob.replace("'", "''")


URL_SQL = (
    _CANON
    + ", rules(id, kind, likeness) AS (VALUES "
    + ", ".join(f"({i}, '{kind}', '{_like(glob)}')" for i, kind, glob in RULES)
    + """),
hits AS (
  SELECT page_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, bool_or(kind = 'allow') AS allowed
  FROM c JOIN rules ON canonical LIKE likeness ESCAPE '!' GROUP BY page_id
)
SELECT c.page_id, c.url, c.canonical, coalesce(ids, '') AS rule_ids,
       CASE WHEN ids IS NULL OR allowed THEN 'keep' ELSE 'block' END AS verdict
FROM c LEFT JOIN hits USING (page_id)
"""
)

#: Tokenising, pattern bootstrapping, compression, fingerprints and greedy packing have no SQL; tests hold them against brute force.
SQL = {
    "op2_exact_dedup": EXACT_SQL,
    "op4_topk": TOPK_SQL,
    "op7_line_dedup": LINE_SQL,
    "op8_mixing": MIX_SQL,
    "op10_url_filter": URL_SQL,
}
