"""Personal data by bootstrapped contextual extraction.

One pass over whole texts finds spans of a few classes and, for each, what
surrounds it.  Strict forms (an address with a domain, a number that passes its checksum, a quoted value
after an assignment, ...) are seeds; handles, plain numbers and codes (any run of tokens with digits that no class takes, four
digits at least: ``X1234567``, ``06 12 34 56 78``) have no strict form and are seeds right after a
word that says what they are (``LABELLED``).  Every instance is linked to lexical patterns (the word
before, the two words before, the word after) and, if its class has a form, to the pattern of
its shape.  Lexical patterns belong to a family of classes: all that consist of digits share them, so a slot learnt from numbers, cards
or labelled codes discovers identifiers of forms never seen.  Spark scores this bipartite graph in rounds: a pattern's confidence is the mean score of the distinct instances it extracts,
damped by ``prior`` unknown ones; an instance that is no seed gets the noisy-or of its patterns that have
``min_support`` instances.  At the end patterns of ``min_pattern`` confidence count, and instances whose
noisy-or over these reaches ``min_score`` are reported beside the seeds.

Rounds move only (pattern, instance) pairs of hashes (128 bits for instances, 64 for patterns), never texts, and aggregate on the map side.

Results: one row for each occurrence.  Null and empty texts give none; texts of any length are read whole, and contexts by whole words however long; an identifier keeps
its type and a null one is reported as null; repeated rows are each reported, though equal values are one instance; a score of exactly a threshold
counts; where classes could overlap the leftmost span wins, among equals the class listed first in ``SPAN``; scores do not depend on row
order; other columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SPAN = re.compile(
    r"""
    (?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)*)
   |(?P<handle>(?<![\w@])@\w{3,})
   |(?P<phone>(?<![\w+.])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)
     |(?<![\w.])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)
     |(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))
   |(?P<social>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
   |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
   |(?P<address>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
   |(?P<card>(?<![\w-])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![\w-])|(?<!\w)[0-9]{13,19}(?!\w))
   |(?P<number>(?<!\w)[0-9]{7,}+(?!\w))
   |(?P<key>(?<![\w-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{12,}+(?!\w))
    """,
    re.X,
)
#: What the classes leave over: neighbouring tokens with digits, letters only before or after them.
CODE = re.compile(r"(?<![\w@./-])[A-Za-z]{0,6}[0-9][A-Za-z0-9]*(?:[ ./-][A-Za-z]{0,6}[0-9][A-Za-z0-9]*)*(?![\w@])")
HINT = re.compile("[0-9@]")
GIVEN = re.compile(r"\w[\"']?\s*[=:]\s*[\"']?$")
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}")
#: What is written right before a handle or a plain number that is surely personal.
LABELLED = {
    "handle": re.compile(r"(?<!\w)(?:twitter|instagram|insta|telegram|tiktok|mastodon|snapchat|github|username|handle|follow|dm)(?: (?:is|me|at|on))*[ :=(]*$", re.I),
    "number": re.compile(
        r"""(?<!\w)(?:
        (?:tele)?phone|tel|mobile|cell|fax|telefon|handy|mobil|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil
       |(?:konto|kunden|telefon|handy|ausweis)(?:nummer|nr)
       |(?:account|acct|customer|client|member|patient|employee|passport|licen[cs]e|compte|cuenta|cliente)(?:[ ](?:number|no|nr|id)(?!\w)|(?=[ ]*[:=\#]))
       |(?:num[ée]ro|n[úu]mero)[ ](?:de[ ])?(?:t[ée]l[ée]phone|compte|client|tel[ée]fono|cuenta|cliente)
        )(?:[ ](?:number|no|nr))?(?:[ ]is)?[ .:=\#]*$""",
        re.X | re.I,
    ),
}
LABELLED["code"] = LABELLED["number"]
#: Classes whose lexical patterns are one family.
FAMILY = {k: "digits" for k in ("phone", "social", "iban", "card", "number", "key", "code")}
DIGITS = re.compile("[0-9]")
HEX = re.compile("[0-9a-f]+$")
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "\"'.,;:()[]{}<>|!?"
COLUMNS = [("kind", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()), ("instance", pa.binary()), ("patterns", pa.list_(pa.int64()))]
FIELDS = "kind string, start bigint, length int, value string, seed boolean, instance binary, patterns array<bigint>"


def checksum(digits: str) -> bool:
    """Luhn's check of a card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def whole_iban(text: str) -> str:
    """The longest beginning of ``text``, up to a space, that passes the check of account numbers; empty if none does."""
    while text:
        if int("".join(str(int(c, 36)) for c in (text[4:] + text[:4]).replace(" ", ""))) % 97 == 1 and len(text) > 12:
            return text
        text = text.rpartition(" ")[0]
    return ""


def is_seed(kind: str, value: str, before: str) -> bool:
    """Whether a span is sure by its form, or by the label right before it."""
    if kind in LABELLED:
        return bool(LABELLED[kind].search(before))
    if kind == "email":
        return "." in value.partition("@")[2]
    if kind == "phone":
        return value[0] == "+" or "(" in value
    if kind == "address":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "iban":
        return bool(whole_iban(value))
    if kind == "card":
        return checksum(re.sub("[ -]", "", value))
    if kind == "key":
        return bool(ISSUED.match(value)) or len(value) >= 16 and bool(GIVEN.search(before))
    return kind == "social"


def _word(token: str) -> str:
    return DIGITS.sub("9", token.lower().strip(EDGE)) or token[:3]


def pattern_names(kind: str, value: str, before: str, after: str) -> list[str]:
    """Lexical patterns and the shape of a span in its surroundings."""
    left, right, family = before.split()[-2:], after.split()[:1], FAMILY.get(kind, kind)
    # shapes keep the lengths of digit runs; a key's shape is its alphabet, its length and a prefix in capitals
    if kind == "key":
        shape = f"{'hex' if HEX.match(value) else 'any'} {len(value)} {value[:4] if value[:4].isalpha() and value[:4].isupper() else ''}"
    else:
        shape = LETTERS.sub("a", DIGITS.sub("9", value))
    if kind == "email":
        shape = "@" + re.sub("9+", "9", shape.partition("@")[2])
    out = [] if kind in LABELLED else [f"{kind}|shape|{shape}"]  # digits or a name alone tell nothing
    if left:
        out.append(f"{family}|left|{_word(left[-1])}")
    if len(left) == 2:
        out.append(f"{family}|left2|{_word(left[0])} {_word(left[1])}")
    if right:
        out.append(f"{family}|right|{_word(right[0])}")
    return out


def _before(text: str, at: int, words: int = 8, most: int = 80) -> str:
    """What stands before a place: at least ``words`` whole words, if there are as many."""
    while most < at and len(got := text[at - most : at].split(None, words)) <= words:
        most *= 2
    return text[max(0, at - most) : at] if most >= at else text[at - most : at][len(got[0]) :]


def _after(text: str, at: int, most: int = 40) -> str:
    """What stands after a place: at least one whole word, if there is one."""
    while at + most < len(text) and len(text[at : at + most].split(None, 1)) < 2:
        most *= 2
    return text[at : at + most]


def spans(text: str):
    """(kind, start, value, seed, pattern names) of every span of a whole text."""
    if not HINT.search(text):
        return
    at, look, hits = 0, 0, []
    while True:
        m = SPAN.search(text, look)
        kind, value = (m.lastgroup, m[0]) if m else (None, "")
        if kind == "iban":
            value = whole_iban(value)
            if not value:  # no such number: what it holds may be of another class
                look = m.start() + 4
                continue
        for c in CODE.finditer(text, at, m.start() if m else len(text)):  # codes are sought between the spans of the other classes
            if len(DIGITS.findall(c[0])) >= 4:
                hits.append(("code", c.start(), c[0]))
        if not m:
            break
        at = look = m.start() + len(value)
        hits.append((kind, m.start(), value))
    for kind, a, value in hits:
        before, after = _before(text, a), _after(text, a + len(value))
        yield kind, a, value, is_seed(kind, value, before), pattern_names(kind, value, before, after)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def found_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = df.where(F.length(f"`{text_col}`") > 0).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([slim.schema["id"], *T._parse_datatype_string(FIELDS).fields])

    def run(batches):
        for batch in batches:
            out, rows = [[] for _ in COLUMNS], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, a, value, seed, names in spans(text):
                    row = (kind, a, len(value), value, seed, xxhash.xxh3_128_digest(f"{kind}|{value.lower()}"), sorted({_hash(x) for x in names}))
                    rows.append(i)
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(out, COLUMNS)]], schema.names)

    return slim.mapInArrow(run, schema)


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, prior: float = 0.5, min_support: int = 3, min_pattern: float = 0.6, min_score: float = 0.9) -> DataFrame:
    """(``id_col``, kind, start, length, value, score, seed): every occurrence of a seed or a found identifier.

    ``start`` counts characters from 0.
    """
    found = cut(found_spans(df, id_col, text_col))
    edges = cut(found.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("sure")))
    known = edges.groupBy("instance").agg(F.max("sure").alias("sure")).withColumn("score", F.col("sure").cast("double"))
    for k in range(rounds):
        last = k == rounds - 1
        patterns = edges.join(known.select("instance", "score"), "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + prior)).alias("confidence"), F.count("*").alias("support"))
        good = patterns.where((F.col("support") >= min_support) & (F.col("confidence") >= (min_pattern if last else 0.0)))
        lift = edges.where(~F.col("sure")).join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("lift"))
        known = cut(known.join(lift, "instance", "left").select("instance", "sure", F.when(F.col("sure"), 1.0).otherwise(F.coalesce("lift", F.lit(0.0))).alias("score")))
    keep = known.where(F.col("sure") | (F.col("score") >= min_score)).select("instance", "score")
    return found.drop("patterns").join(keep, "instance").select(F.col("id").alias(id_col), "kind", "start", "length", "value", F.round("score", 6).alias("score"), "seed")
