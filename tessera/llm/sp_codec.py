"""SentencePiece encoding and decoding with a streaming Viterbi lattice.

A piece model file is read (never trained).  Both kinds of models go through a lattice over character
positions in which pieces are committed as soon as all live backpointer paths run through one boundary, so what is kept
of a text is a window of as many positions as the longest piece and the backpointers since the last boundary, however long the text is.

* Scored models (``Scored``): each position keeps the best sum of piece scores that ends there.  Sums are rounded to single
  precision as the format's own encoder does, so ties and near ties fall alike.
* Merge-based models (``Codec``): scores are merge ranks, not weights, and the best sum is not what the model means.  The segmentation of
  every prefix is unique, and a sequence of pieces is the model's own exactly if each adjacent pair is what the merge procedure makes of
  the pair's concatenation; so each position carries the one backpointer that holds.  Two facts make this fast: no piece has a word-start mark after another character, so every such
  mark is a boundary where all paths meet, as is any border of letters and other characters that no piece spells; the ids of recurring
  stretches between boundaries are memoised, and so is the lattice over their first characters.

Texts are normalised as the model file says: character map, squeezed white space, leading mark.

Results (all columns but the new ones pass through):
null text -> null ids; empty text -> empty ids; texts of any length are encoded whole; characters outside the vocabulary -> their UTF-8 byte
pieces, or the unknown piece (one for a run of them) in models without byte pieces; equally scored paths keep the piece that begins first; a literal U+2581 decodes to a space, as in the library; repeated rows get equal results; an input
column with the name of an output column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO = 700_000  # stretches of text whose ids a worker remembers
HEAD, HEADS = 6, 200_000  # first characters of a stretch, and how many of them a worker remembers the lattice of


def _fields(buf: bytes):
    """(field number, value) of a protobuf message; nested messages stay bytes."""

    def varint(i):
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = buf[i : i + n], i + n
        else:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        yield tag >> 3, value


def _read(model_file: str) -> tuple[list[tuple[str, float, int]], dict]:
    """(text, score, kind) of each piece, and the settings of a model file."""
    pieces, settings = [], {}
    with open(model_file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                d = dict(_fields(value))
                score = struct.unpack("<f", d[2])[0] if 2 in d else 0.0
                pieces.append((d[1].decode(), score, d.get(3, NORMAL)))
            elif number == 3:
                settings |= {f"norm{k}": v for k, v in _fields(value)}
            elif number == 2:
                settings |= {f"train{k}": v for k, v in _fields(value)}
    if settings.get("train24", 0):
        raise ValueError("models with word marks at word ends are not supported")
    return pieces, settings


class Normaliser:
    """Text as a model's pieces spell it: mapped characters, squeezed white space, marks for spaces."""

    def __init__(self, settings: dict, symbols: list[str] = ()):
        self.prefix = bool(settings.get("norm3", 1))
        self.squeeze = bool(settings.get("norm4", 1))
        if not settings.get("norm5", 1):
            raise ValueError("models that keep spaces unmarked are not supported")
        blob = settings.get("norm2", b"")
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :]
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None

    def _mapped(self, raw: bytes) -> list[str]:
        """Replacements of the longest keys of the character map, and single characters where there is none."""
        trie, out, i, n = self.trie, [], 0, len(raw)
        while i < n:
            at, best = 0, None
            unit = trie[0]
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            for j in range(i, n):
                at ^= raw[j]
                unit = trie[at]
                if unit & 0x800000FF != raw[j]:
                    break
                at ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    best = (j + 1, trie[at] & 0x7FFFFFFF)
            if best:
                i, place = best
                out.append(self.texts[place : self.texts.index(0, place)].decode())
            else:
                size = 1 if raw[i] < 128 else 2 if raw[i] < 224 else 3 if raw[i] < 240 else 4
                out.append(raw[i : i + size].decode())
                i += size
        return out

    def __call__(self, text: str) -> str:
        if self.trie:
            parts, at = [], 0
            for m in self.symbols.finditer(text) if self.symbols else ():
                parts += [*self._mapped(text[at : m.start()].encode()), m[0]]
                at = m.end()
            text = "".join(parts + self._mapped(text[at:].encode()))
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)


class Codec:
    """One merge-based piece model: ``encode`` and ``decode`` of single texts and of Arrow batches."""

    def __init__(self, model_file: str):
        pieces, settings = _read(model_file)
        if any(k == USER for _, _, k in pieces):
            raise ValueError("merge-based models with user-defined pieces are not supported")
        self.normal = Normaliser(settings)
        self.plain = not self.normal.trie and not self.normal.squeeze
        self.prefix = MARK if self.normal.prefix else ""
        self.rank = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece runs over a word start")
        self._ids(pieces)
        self.memo: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.order = {p: k for k, p in enumerate(sorted(self.rank, key=lambda p: (-self.rank[p][0], self.rank[p][1])))}
        self.edges: tuple[dict, dict] = ({}, {})
        for p in [p for p in self.rank if len(p) > 1 and set(p) != {MARK} and self.merged(p) != [p]]:
            self.rank.pop(p)  # no merge ever makes it
        # between letters and other characters all paths meet too, but within the pairs that some piece spells
        self.stretch = _stretches({x for p in self.order for x in MIXED.findall(p)})
        # lengths, longest first, of the pieces that a text ends with, by its last four, three or two characters
        tails: dict[str, set[int]] = {}
        for p in self.rank:
            for size in (4, 3, 2):
                if len(p) == size or (size == 4 and len(p) > 4):
                    tails.setdefault(p[-size:], set()).add(len(p))
        self.tails = {k: tuple(sorted(v.union(*[tails.get(k[-n:], ()) for n in range(2, len(k))]), reverse=True)) for k, v in tails.items()}
        self._forget()

    def _forget(self) -> None:
        """An empty memo of pairs: for each piece, which pieces it may follow."""
        self.pair_ok: dict[str, dict[str, bool]] = {p: {} for p in self.rank if len(p) > 1}
        self.pairs = 0

    def _ids(self, pieces: list[tuple[str, float, int]]) -> None:
        """Tables of ids and of what ids decode to."""
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.longest = max(map(len, self.rank))
        self.packed_piece = {p: array("i", [i]).tobytes() for p, (_, i) in self.rank.items()}
        surface = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        surface[self.unknown] = " ⁇ ".encode()
        self.lengths = np.array([len(b) for b in surface], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself: best scored adjacent pair first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                got = self.rank.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got[0] > best[0]):
                    best = (got[0], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edges(self, piece: str, right: bool) -> list[tuple[int, str]]:
        """(merge time, piece) along one side of ``piece``'s merge tree, the whole piece first."""
        known = self.edges[right]
        got = known.get(piece)
        if got is None:
            got = [(self.order.get(piece, -1) if len(piece) > 1 else -1, piece)]
            if len(piece) > 1:
                halves = self._halves(piece)
                got += self._edges(halves[right], right)
            known[piece] = got
        return got

    def _halves(self, piece: str) -> list[str]:
        """The two parts whose merge makes ``piece``, or a third part's presence if it is never made."""
        last, parts = [], list(piece)
        while len(parts) > 1:
            got = [(-self.order[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.order]
            if not got:
                return [parts[0], parts[-1]]
            i = -max(got)[1]
            last = parts[i : i + 2]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def _fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: no merge over their border comes before either is whole.

        Goes back in time through the states of the two pieces' facing edges; while two edges coexist, a
        merge of them would have to come no earlier than the merge that ends that state.
        """
        ok = self.pair_ok.setdefault(right, {}).get(left)
        if ok is not None:
            return ok
        if left[-1] == MARK or right[:2] == MARK * 2:  # these pieces' scores tie
            ok = self.merged(left + right) == [left, right]
        else:
            ends, heads, order = self._edges(left, True), self._edges(right, False), self.order
            i = j = 0
            limit, ok = float("inf"), True
            while True:
                if order.get(ends[i][1] + heads[j][1], limit) < limit:
                    ok = False
                    break
                if i + 1 == len(ends) and j + 1 == len(heads):
                    break
                if j + 1 == len(heads) or (i + 1 < len(ends) and ends[i][0] > heads[j][0]):
                    limit = ends[i][0]
                    i += 1
                else:
                    limit = heads[j][0] + 0.5  # a merge further left goes first among equals
                    j += 1
        if self.pairs > MEMO:
            self._forget()
        self.pair_ok.setdefault(right, {})[left] = ok
        self.pairs += 1
        return ok

    def _whole(self, text: str) -> list[str]:
        """The lattice for a text no longer than the window, where nothing need be committed early."""
        tails, known, fits = self.tails, self.pair_ok, self._fits
        head = text[:HEAD] if len(text) > HEAD else ""
        sizes = self.heads.get(head, ONE) if head else ONE  # what prefixes end with depends on them alone
        last: list[str] = ["", *[text[end - size : end] for end, size in enumerate(sizes, 1)]]
        for end in range(len(last), len(text) + 1):
            for size in (end > 3 and tails.get(text[end - 4 : end])) or (end > 2 and tails.get(text[end - 3 : end])) or tails.get(text[end - 2 : end], ()):
                if size > end:
                    continue
                piece = text[end - size : end]
                before = known.get(piece)
                if before is None:
                    continue
                if size == end:
                    break
                left = last[end - size]
                ok = before.get(left)
                if fits(left, piece) if ok is None else ok:
                    break
            else:
                piece = text[end - 1]  # no longer piece holds, so this one does
            last.append(piece)
        if head and sizes is ONE and len(self.heads) < HEADS:
            self.heads[head] = bytes(map(len, last[1 : HEAD + 1]))
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def viterbi(self, text):
        """Pieces of ``text`` in order, yielded once every live path agrees on them."""
        longest, rank, fits = self.longest, self.rank, self._fits
        live: dict[int, tuple[int, str]] = {}  # end -> (start, piece); entries go once they are committed
        done, n, wait = 0, len(text), 4 * longest
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                if (piece in rank or end - start == 1) and (start == 0 or fits(live[start][1], piece)):
                    live[end] = (start, piece)
                    break
            if end - done < wait:
                continue
            # walk back from every end that a later piece can build on, until all paths share one boundary
            heads = set(range(end - longest + 1, end + 1))
            while len(heads) > 1:
                top = max(heads)
                heads.remove(top)
                heads.add(live[top][0])
            meet = heads.pop()
            if meet == done:
                wait += longest  # paths that differ so far must all be kept
                continue
            out, at = [], meet
            while at > done:
                start, piece = live[at]
                out.append(piece)
                at = start
            yield from reversed(out)
            live = {e: v for e, v in live.items() if e > meet}
            live[meet] = (meet, out[0])
            done, wait = meet, 4 * longest
        out, at = [], n
        while at > done:
            out.append(live[at][1])
            at = live[at][0]
        yield from reversed(out)

    def _stretch(self, text: str) -> bytes:
        known, out = self.packed_piece, []
        for piece in self._whole(text) if len(text) <= self.longest else self.viterbi(text):
            out.append(known.get(piece) or self._other(piece))
        packed = b"".join(out)
        if len(text) <= 64 and len(self.memo) < MEMO:
            self.memo[text] = packed
        return packed

    def _other(self, char: str) -> bytes:
        """Ids of a character outside the vocabulary."""
        ids = [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown]
        return array("i", ids).tobytes()

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        memo = self.memo
        text = self.prefix + text.replace(" ", MARK) if self.plain else self.normal(text)
        return self._runs(b"".join([memo.get(x) or self._stretch(x) for x in self.stretch.findall(text)]))

    def _runs(self, packed: bytes) -> bytes:
        """Without byte pieces, neighbouring unknown characters are one unknown piece."""
        if self.byte_id:
            return packed
        ids = np.frombuffer(packed, np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the rows whose ids lie between consecutive ``offsets``."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.surface[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        skip, firsts = 1 if self.prefix else 0, [*offsets[:-1].tolist()]
        out = []
        for a, b, first in zip(cuts, cuts[1:], firsts):
            row = raw[a:b]
            if row[:1] == b" " and ids[first] != self.unknown:
                row = row.lstrip(b" ") if self.normal.squeeze else row[skip:]
            out.append(row.decode("utf-8", "one-each"))
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_many(ids, np.array([0, len(ids)]))[0]


_SINGLE = struct.Struct("<f")


class Scored(Codec):
    """One scored (unigram) piece model."""

    def __init__(self, model_file: str):
        pieces, settings = _read(model_file)
        users = [p for p, _, k in pieces if k == USER]
        self.normal = Normaliser(settings, users)
        self.prefix = MARK if self.normal.prefix else ""
        self.rank = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self._ids(pieces)
        scores = [s for _, s, k in pieces if k == NORMAL]
        self.unknown_score = _SINGLE.unpack(_SINGLE.pack(min(scores) - 10.0))[0]
        self.trie: dict = {}
        for p, (score, _) in self.rank.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            # a user-defined piece outweighs any other path over the same characters
            node[""] = _SINGLE.unpack(_SINGLE.pack(len(p.encode()) * max(scores) - 0.1))[0] if p in users else score

    def viterbi(self, text):
        """Pieces of ``text`` in order, yielded once every live path agrees on them."""
        single, pack = _SINGLE.unpack, _SINGLE.pack
        best: dict[int, float] = {0: 0.0}  # the best sum that ends at a live position
        back: dict[int, int] = {}  # end -> start of its last piece, since the last boundary
        trie, longest, n = self.trie, self.longest, len(text)
        done, wait = 0, 4 * self.longest
        for start in range(n):
            here = best.pop(start)
            node, alone = trie, False
            for end in range(start, min(n, start + longest)):
                node = node.get(text[end])
                if node is None:
                    break
                score = node.get("")
                if score is not None:
                    alone = alone or end == start
                    total = single(pack(score + here))[0]
                    old = best.get(end + 1)
                    if old is None or total > old:
                        best[end + 1], back[end + 1] = total, start
            if not alone:
                total = single(pack(self.unknown_score + here))[0]
                old = best.get(start + 1)
                if old is None or total > old:
                    best[start + 1], back[start + 1] = total, start
            if start - done < wait:
                continue
            heads = set(best)  # every path goes on from one of these
            while len(heads) > 1:
                top = max(heads)
                heads.remove(top)
                heads.add(back[top])
            meet = heads.pop()
            if meet == done:
                wait += longest
                continue
            yield from self._walk(text, back, done, meet)
            back = {e: b for e, b in back.items() if e > meet}
            done, wait = meet, 4 * longest
        yield from self._walk(text, back, done, n)

    @staticmethod
    def _walk(text: str, back: dict[int, int], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def packed(self, text: str) -> bytes:
        text = self.normal(text)
        known = self.packed_piece
        return self._runs(b"".join([known.get(x) or self._other(x) for x in self.viterbi(text)]))


codecs.register_error("one-each", lambda e: ("�" * (e.end - e.start), e.end))
ONE = b"\1"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
OTHER = f"(?:[^\\w{MARK}]|_)"
MIXED = re.compile(f"(?=([^\\W_]{OTHER}|{OTHER}[^\\W_]))")
PAIRS = 16  # pairs that the expression below looks for; models with more are cut at marks alone


def _stretches(mixed: set[str]) -> re.Pattern:
    """Finds the stretches of a text over whose ends no piece runs, if ``mixed`` has all pairs of a letter and another character in pieces."""
    if len(mixed) > PAIRS:
        return WORDS
    run = f"(?:[^\\W_]+|{OTHER}+)"
    held = "|".join(f"(?<={re.escape(a)})(?={re.escape(b)})" for a, b in sorted(mixed))
    return re.compile(f"{MARK}*{run}" + (f"(?:(?:{held}){run})*" if held else "") + f"|{MARK}+")


@lru_cache(maxsize=4)
def codec(model_file: str) -> Codec:
    """The codec of a model file, by the kind it states."""
    kind = _read(model_file)[1].get("train3", 1)
    if kind not in (1, 2):
        raise ValueError("only scored and merge-based piece models are supported")
    return Scored(model_file) if kind == 1 else Codec(model_file)


def _lists(texts: pa.Array, model: Codec) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    rows = [None if t is None else model.packed(t) for t in texts.to_pylist()]
    flat = np.frombuffer(b"".join([r for r in rows if r]), np.int32)
    offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) // 4 for r in rows])]).astype(np.int32)
    nulls = np.array([r is None for r in rows] + [False])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=nulls) if nulls.any() else pa.array(offsets), pa.array(flat))
    return lists, flat, offsets


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the piece ids of ``text_col`` in ``ids_col``."""
    base = without(df, *([ids_col] if ids_col.lower() != text_col.lower() else []))
    at = [c.lower() for c in base.columns].index(text_col.lower())
    schema = T.StructType(base.schema.fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        model = codec(model_file)
        for batch in batches:
            lists, _, _ = _lists(batch.column(at), model)
            yield pa.RecordBatch.from_arrays(batch.columns + [lists], schema.names)

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``text_col``; null ids give null, ids out of range fail."""
    base = without(df, *([text_col] if ids_col.lower() != text_col.lower() else []))
    at = [c.lower() for c in base.columns].index(ids_col.lower())
    schema = T.StructType(base.schema.fields + [T.StructField(text_col, T.StringType())])

    def run(batches):
        model = codec(model_file)
        for batch in batches:
            lists = batch.column(at)
            empty = lists.is_null().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.where(empty, 0, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            texts = model.decode_many(flat, np.concatenate([[0], np.cumsum(sizes)]))
            got = pa.array([None if e else t for e, t in zip(empty, texts)], pa.string())
            yield pa.RecordBatch.from_arrays(batch.columns + [got], schema.names)

    return base.mapInArrow(run, schema)


def encode_decode(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """One pass: ``df`` with ``ids``, ``n_tokens`` and ``decoded``, the text that the ids give back."""
    base = without(df, "ids", "n_tokens", "decoded")
    at = [c.lower() for c in base.columns].index(text_col.lower())
    schema = T.StructType(base.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        model = codec(model_file)
        for batch in batches:
            texts = batch.column(at)
            lists, flat, offsets = _lists(texts, model)
            empty = texts.is_null().to_pylist()
            back = [None if e else t for e, t in zip(empty, model.decode_many(flat, offsets))]
            count = pa.array(np.diff(offsets), pa.int32(), mask=np.array(empty, bool))
            yield pa.RecordBatch.from_arrays(batch.columns + [lists, count, pa.array(back, pa.string())], schema.names)

    return base.mapInArrow(run, schema)
