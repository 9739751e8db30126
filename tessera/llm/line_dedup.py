"""Line dedup by site-relative frequency.

Pages are split into lines, grouped by host; the share of a host's pages that contain a line decides: above
``ratio`` on a host of at least ``min_pages`` pages the line is boilerplate and goes from every page there.
(On fewer pages a share says nothing; such hosts keep all lines.)

Lines of HTML come from a tokeniser: comments, declarations, scripts and styles go, tags of block elements end a
line, other tags count as a space, attribute values may hold ``>``, entities are decoded.

Counting moves (host, line, pages) rows, already added up on the map side per batch, never page texts.  A
host's boilerplate is at most lines-per-page / ``ratio`` lines.  It is measured: up to ``BROADCAST_BYTES``
of it goes to the pages as a broadcast, which stay where they are; beyond that pages are
shuffled by host, which adaptive execution splits for hot hosts.  Both ways give the same rows.  Pages are split
twice, once for each pass, as keeping the lines in between would write all text.

Results: a null text gives null text and counts 0; empty text stays empty; blank lines are never
boilerplate and stay (HTML gives none); a line repeated in a page counts one page, and goes wherever it stands; a
share of exactly ``ratio`` stays; a page without host (null or malformed
URL) passes whole; repeated rows count as pages of their own; texts and lines of any length are compared whole; input columns with output names are
replaced, others pass through whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, without

BROADCAST_BYTES = 32 << 20
HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)")
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
MARKUP = re.compile(
    rf"""<!--(?:.*?-->|.*+)                                          # a comment, to the end if it isn't closed
    |<(script|style)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>?|\Z)   # raw text
    |<(/?[a-z][^\s/>]*+){ATTRIBUTES}>?                              # a tag, to the end if it isn't closed
    |<[!?/][^>]*+>?                                                 # a declaration or a stray end
    """,
    re.X | re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol optgroup option p pre script section select style summary table tbody td template tfoot th thead title tr ul".split()
)
SPACES = re.compile("[ \t\r\f\x0b\xa0]+")


def host_of(url: str | None) -> str | None:
    """Lower-case host of a URL, None where there is none."""
    got = HOST.match(url) if url else None
    return got[1].lower() if got else None


def _line_end(m: re.Match) -> str:
    if m[1]:
        return "\n"
    name = m[2]
    return "" if name is None else "\n" if name.lstrip("/").lower() in BLOCKS else " "


def html_lines(page: str) -> list[str]:
    """Text lines of an HTML page, white space squeezed, blank ones left out."""
    text = html.unescape(MARKUP.sub(_line_end, page)).replace(" ", "\n")
    return [x for line in text.split("\n") if (x := SPACES.sub(" ", line).strip(" "))]


def plain_lines(text: str) -> list[str]:
    return text.split("\n")


def drop_boilerplate(df: DataFrame, host_col: str, text_col: str, host: Callable = host_of, lines: Callable = html_lines, out_col: str = "text", ratio: float = 0.5, min_pages: int = 4) -> DataFrame:
    """``df`` with the kept lines in ``out_col`` and the counts ``n_lines`` and ``n_dropped``.

    ``host`` gives the site of a value of ``host_col``, ``lines`` the lines of a value of ``text_col``.
    """
    spark = df.sparkSession

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = host(h)
                if h is not None:
                    seen[h, None] += 1  # the page itself
                    if t is not None:
                        seen.update((h, x) for x in set(lines(t)) if x.strip())
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "line", "n"])

    slim = df.select(F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    counts = slim.mapInArrow(count, "host string, line string, n bigint").groupBy("host", "line").agg(F.sum("n").alias("n"))
    counts = cut(counts.where(F.col("n") > F.when(F.col("line").isNull(), min_pages - 1).otherwise(ratio * min_pages)))  # no other can matter
    hosts = counts.where(F.col("line").isNull()).select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("line").isNotNull())
    boiler = cut(often.join(hosts, "host").where(F.col("n") / F.col("pages") > ratio).groupBy("host").agg(F.collect_list("line").alias("bad")))
    size = boiler.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("bad", "")) + 64 * F.size("bad")).alias("n")).first()["n"] or 0
    base = without(df, *(c for c in (out_col, "n_lines", "n_dropped") if c.lower() not in (host_col.lower(), text_col.lower())))
    key, site, bad = fresh([*base.columns, out_col, "n_lines", "n_dropped"], "text", "site", "bad")
    keep = without(base, out_col, "n_lines", "n_dropped")
    rows = base.select(*[F.col(f"`{c}`") for c in keep.columns], F.col(f"`{text_col}`").cast("string").alias(key), F.col(f"`{host_col}`").cast("string").alias(site))
    held = None
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r["host"]: frozenset(r["bad"]) for r in boiler.collect()})
    else:
        name = F.lower(F.regexp_extract(site, "^" + HOST.pattern, 1)) if host is host_of else F.col(site)
        rows = rows.join(boiler.select(F.col("host").alias("__name"), F.col("bad").alias(bad)), name == F.col("__name"), "left").drop("__name")
    schema = T.StructType([*keep.schema.fields, T.StructField(out_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    width = len(keep.columns)

    def strip(batches):
        for batch in batches:
            sets: dict = held.value if held is not None else {}
            sites = [host(x) for x in batch.column(width + 1).to_pylist()]
            if held is None:
                for h, b in zip(sites, batch.column(width + 2)):
                    if h not in sets and b.is_valid:
                        sets[h] = frozenset(b.as_py())
            text, total, gone = [], [], []
            for t, h in zip(batch.column(width).to_pylist(), sites):
                own = lines(t) if t is not None else []
                out = sets.get(h)
                kept = [x for x in own if x not in out] if out else own
                text.append(None if t is None else "\n".join(kept))
                total.append(len(own))
                gone.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return rows.mapInArrow(strip, schema)


def page_lines_dedup(pages: DataFrame, ratio: float = 0.5, min_pages: int = 4) -> DataFrame:
    """Site-relative line dedup of a ``pages`` table (page_id, url, html)."""
    return drop_boilerplate(pages, "url", "html", ratio=ratio, min_pages=min_pages)
