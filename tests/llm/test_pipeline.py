"""Stages of the pipeline against brute force, on the small tables and on odd rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, simhash
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == steps[0].columns + ["ids", "n_tokens", "decoded"]


def test_language_stage(steps):
    judge = langid.Compressors(langid.fit(steps[0]))
    assert ids(steps[1]) == sorted(r["doc_id"] for r in steps[0].collect() if judge(r["text"], 0.005)[0] is not None)


def test_exact_stage(steps):
    first = {}
    for r in sorted(steps[1].collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[ \t\n\r\f\x0b]+", " ", r["text"]).strip(" "), r["doc_id"])
    assert ids(steps[2]) == sorted(first.values())


def test_near_stage(steps):
    from tests.llm.test_operators import brute_groups

    rows = steps[2].orderBy("doc_id").collect()
    prints = simhash.fingerprints([r["text"] for r in rows])
    keep = [(r["doc_id"], p) for r, p in zip(rows, prints) if p is not None]
    roots, _ = brute_groups([i for i, _ in keep], [p for _, p in keep])
    want = {r["doc_id"] for r, p in zip(rows, prints) if p is None or roots[r["doc_id"]] == r["doc_id"]}
    got = set(ids(steps[3]))
    assert want <= got and len(got - want) <= 0.1 * max(1, len(rows) - len(want))


def test_mixing_stage(steps):
    kept, given = set(ids(steps[4])), set(ids(steps[3]))
    assert kept <= given and len(ids(steps[4])) == len(kept)
    tokens = {r["doc_id"]: len(r["text"].split()) for r in steps[3].collect()}
    assert sum(tokens[i] for i in kept) <= corpus_pipeline.BUDGET * sum(tokens.values()) + 1


def test_piece_stage(steps):
    assert ids(steps[5]) == ids(steps[4])
    assert steps[5].where(F.col("decoded") != F.col("text")).count() == 0


def test_run_is_the_stages(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[5])


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, __key int, l0 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, clashing column names."""
    say = {"en": "the river was calm and people walked along the bank until the evening came over the town", "de": "der Fluss war ruhig und die Leute gingen am Ufer entlang bis der Abend über die Stadt kam"}
    texts = {k: " ".join(f"{w}{n % 7 or ''}" for n, w in enumerate(t.split() * 6)) for k, t in say.items()}
    rows = [(k, texts["en" if k % 2 else "de"] + f" {k} {k * 7}", "en" if k % 2 else "de", f"src{k % 3}") for k in range(10, 30)]
    rows += [(30, None, "en", "src0"), (31, "", "de", "src1"), (32, "  \n", None, None), (None, texts["en"] + " nobody", "en", None), (33, texts["de"] * 3000, None, "src2"), (10, rows[0][1], "de", "src1"), (10, rows[0][1], "de", "src1"), (34, rows[0][1], "de", "src0")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, "y") for r in rows], ODD)


def test_stages_on_odd_rows(spark, odd):
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language ID"](spark, odd, SF)
    assert told.columns == odd.columns and Counter(r["doc_id"] for r in told.collect()) == Counter([*range(10, 30), None, 33, 10, 10, 34])
    single = stage["exact dedup"](spark, odd, SF)
    # 34 copies 10, which is there three times; 32 copies 31; the null text stays
    assert single.columns == odd.columns and Counter(r["doc_id"] for r in single.collect()) == Counter([*range(10, 30), 30, 31, None, 33])
    near = Counter(r["doc_id"] for r in stage["SimHash near-dedup"](spark, odd, SF).collect())
    # each language is one group of near copies; what has no words or no identifier stays
    assert near == Counter([10, 11, 30, 31, 32, None])
    mixed = stage["mixing"](spark, odd, SF)
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == odd.columns and got <= Counter(r["doc_id"] for r in odd.collect()) and {r["ids"] for r in mixed.collect()} == {"x"}
    pieces = stage["SentencePiece"](spark, odd.drop("ids"), SF).collect()
    assert len(pieces) == odd.count()
    for r in pieces:
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None) and (r["ids"] == []) == (r["text"] == "")


def test_stages_on_empty_tables(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.drop("ids").limit(0), SF).count() == 0


def test_chained_stages_on_odd_rows(spark, odd):
    docs = odd.drop("ids")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept and kept <= {10, 11, 33, None} and 30 not in kept


def test_registration():
    names = list(QUERIES)
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"
    assert set(SQL) <= set(names) and corpus_pipeline.ORACLE_SQL is None
