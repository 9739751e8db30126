"""URL filters by a bit-parallel wildcard automaton.

Glob rules (``*`` any run, ``?`` one character, everything else literal, matched against the whole
canonical URL) are packed one after another into words of 64 bits.  One bit is one position of one rule;
reading a character (a code point, not a byte) moves all bits of all rules at once: shift by one (carrying
over word borders), mask with the positions that take the character, or stay where a ``*`` allows any run.
Characters that no rule names share one mask.  URLs of a batch step together, so the work is
one pass over array columns however many rules there are.

Canonical URL: outer spaces, tabs and line ends go, scheme and authority in lower case, default port and
fragment go; of the query (what follows the first ``?``), empty parameters and those whose name begins with
``utm_`` go, and the ``?`` too if none is left.  The path stays as it is.

Results: null URL -> null canonical URL, no rules, verdict ``keep``; an empty URL matches only rules that
match nothing (``*``); URLs of any length are read whole, in batches bounded by their total length; a rule
listed twice is reported under both of its ids; without rules all are
kept; where rules of both kinds match, ``allow`` wins; ties of ids keep the rules' order; repeated rows get
equal results; output columns replace input columns of their names, others pass through; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without


def canonical_url(url):
    """Canonical form of a URL column."""
    bare = F.substring_index(F.trim(F.regexp_replace(url, "[\\t\\n\\r\\f]", "")), "#", 1)
    head = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    tail = F.substr(bare, F.length(head) + 1)
    head = F.regexp_replace(F.regexp_replace(head, "^(http://[^/]*):80$", "$1"), "^(https://[^/]*):443$", "$1")
    at = F.instr(tail, "?")
    parts = F.filter(F.split(F.substr(tail, at + 1), "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("utm_")))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.concat(head, F.when(at > 0, F.concat(F.substr(tail, F.lit(1), at - 1), query)).otherwise(tail))


#: A batch of URLs steps together while it has at most so many cells (rows times longest URL).
CELLS = 1 << 22


class Automaton:
    """All of a list of globs at once."""

    def __init__(self, globs: list[str]):
        reads, stays, begins, ends = [], [], [], []
        for glob in globs:
            begins.append(len(reads))
            reads.append(None)
            stays.append(False)
            for char in glob:
                if char == "*":
                    stays[-1] = True
                else:
                    reads.append(char)
                    stays.append(False)
            ends.append(len(reads) - 1)
        words = max(1, -(-len(reads) // 64))

        def packed(flags) -> np.ndarray:
            bits = np.zeros(words * 64, np.uint8)
            bits[: len(flags)] = flags
            return np.packbits(bits, bitorder="little").view(np.uint64)

        named = sorted({r for r in reads if r not in (None, "?")})
        self.named = np.array([ord(c) for c in named], np.uint32)
        # mask 0: characters that no rule names
        self.masks = np.stack([packed([r == c or r == "?" for r in reads]) for c in ["", *named]])
        self.stays = packed(stays)
        self.start = packed([i in set(begins) for i in range(len(reads))])
        self.ends = np.array(ends, np.int64)

    def classes(self, url: str) -> np.ndarray:
        """Number of the mask of each character."""
        codes = np.frombuffer(url.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.named):
            return np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.named, codes), len(self.named) - 1)
        return np.where(self.named[at] == codes, at + 1, 0).astype(np.int32)

    def run(self, urls: list[str]) -> np.ndarray:
        """Boolean matrix: which URL (row) which glob (column) matches."""
        out = np.zeros((len(urls), len(self.ends)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        while order:  # the longest first, as many as the cells allow
            n = max(1, CELLS // max(1, len(urls[order[0]])))
            out[order[:n]] = self._step([urls[i] for i in order[:n]])
            order = order[n:]
        return out

    def _step(self, urls: list[str]) -> np.ndarray:
        """The same for URLs by falling length."""
        size = np.array([len(u) for u in urls], np.int64)
        chars = np.zeros((len(urls), int(size[0])), np.int32)
        flat = self.classes("".join(urls))
        chars[np.arange(chars.shape[1]) < size[:, None]] = flat
        state = np.repeat(self.start[None], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(chars.shape[1]):
            n = int(np.searchsorted(-size, -at, "left"))  # the URLs that have a character here
            s = state[:n]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= self.masks[chars[:n, at]]
            moved |= s & self.stays
            state[:n] = moved
        return ((state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one).astype(bool) if len(self.ends) else np.zeros((len(urls), 0), bool)


def apply_rules(df: DataFrame, rules: list[tuple[int, str, str]], url_col: str = "url", batch: int = 4096) -> DataFrame:
    """``df`` with ``canonical``, ``rule_ids`` (matching ids, ascending, joined by commas) and ``verdict``.

    ``rules``: (id, ``block`` or ``allow``, glob).
    """
    base = without(df, "canonical", "rule_ids", "verdict")
    slim = base.withColumn("canonical", canonical_url(F.col(url_col)))
    schema = T.StructType(slim.schema.fields + [T.StructField("rule_ids", T.StringType()), T.StructField("verdict", T.StringType())])
    ranked = sorted(rules)

    def run(batches):
        machine = Automaton([g for _, _, g in ranked])
        allow = np.array([k == "allow" for _, k, _ in ranked], bool)
        names = [str(i) for i, _, _ in ranked]
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                urls = part.column(part.num_columns - 1).to_pylist()
                hit = machine.run([u or "" for u in urls])
                hit[[u is None for u in urls]] = False
                ids = [",".join(names[j] for j in np.nonzero(row)[0]) for row in hit]
                verdict = ["keep" if not row.any() or row[allow].any() else "block" for row in hit]
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(ids, pa.string()), pa.array(verdict, pa.string())], schema.names)

    return slim.mapInArrow(run, schema)
