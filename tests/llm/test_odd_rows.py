"""Nulls, empty tables, repeated rows, very long texts and clashing columns, with the values that each operator states."""

import hashlib
import random

import pytest

from lodestone.llm import bpe, exact_dedup, jaccard_join, line_dedup, suffix_dedup, topk, toxicity

LONG = "Long text " * 30_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report_of_exact_dedup(spark):
    rows = [(1, "A b"), (7, "a B"), (7, "a b"), (3, None), (2, ""), (None, "é"), (5, "É"), (8, LONG), (9, LONG.upper()), (None, LONG)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, keep_id int")
    got = sorted((tuple(r) for r in exact_dedup.report(docs).collect()), key=str)
    want = []
    for i, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        group = [j for j, u in rows if (u or "").translate({c: c + 32 for c in range(65, 91)}) == low]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, sha(low)))
    assert got == sorted(want, key=str)
    assert exact_dedup.report(docs.limit(0)).collect() == []


def test_line_dedup_of_odd_rows(spark):
    block = "a\nb\nc"
    docs = spark.createDataFrame([(2, block + "\nd", 1), (2, block + "\nd", 1), (None, block, 1), (1, None, 1), (3, block, 1)], "doc_id long, text string, w int")
    kept = sorted((str(r.doc_id), r.kept_text) for r in line_dedup.dedup_lines(docs).collect())
    assert len(kept) == 5 and ("1", "") in kept and ("3", "") in kept
    assert sum(t.startswith(block) for _, t in kept) == 1  # one row keeps the passage, whichever id is null or repeated
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_top_k_of_odd_rows(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (3, [5.0]), (None, [9.0, 9.0]), (40, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(df, df["vec_id"] % 20 == 0, k=20, scale=64.0).collect())
    score = 64 * 64 + 128 * 128
    # a query meets neither rows with its own id nor rows of another length; repeated rows are all found, and those that ask share a ranking
    assert got == [(20, n, 1, score) for n in (1, 2, 3, 4)]
    for large in (1e30, 1e12):
        huge = spark.createDataFrame([(20, [large, large]), (1, [large, large])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="(?i)bit|large|beyond|range"):
            topk.top_k(huge, huge["vec_id"] % 20 == 0, k=20, scale=64.0).collect()


def test_suffix_dedup_of_null_ids(spark):
    copy = "the same passage over and over " * 8
    docs = spark.createDataFrame([(None, copy), (None, None), (1, "x" + copy), (1, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.digests(docs).collect())
    assert got == [("1", 5, 0), ("1", len(copy) + 1, len(copy)), ("None", 0, 0), ("None", len(copy), len(copy))]


def test_join_of_an_empty_table(spark):
    assert jaccard_join.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bpe_of_repeated_and_long_rows(spark):
    from lodestone.llm.queries import tokenizer_path

    rows = [(1, "Same words", "k"), (1, "Same words", "k"), (2, LONG, "k"), (3, None, "k"), (None, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, tokenizer_path()).collect()
    same = [r for r in got if r.doc_id == 1]
    assert len(got) == 5 and same[0] == same[1] and all(r.n_tokens == len(r.ids) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, None)} == {0}
    assert next(r for r in got if r.doc_id == 2).n_tokens >= 60_000


def test_scores_depend_on_the_text_alone(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["fine", "good", "plain", "word"] if i % 3 else ["zonk", "vile", "grok"]) + str(rng.randrange(4)) for _ in range(12)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "v", "e", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, vote string, evidence string, tox_score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    moved = docs.selectExpr("doc_id + 10000 as doc_id", "text", "vote", "evidence", "tox_score")
    got = toxicity.score(docs.unionByName(moved), model, keep=["doc_id", "vote", "evidence"]).collect()
    scores = {r.doc_id: r.tox_score for r in got}
    assert len(got) == 480 and all(scores[i] == scores[i + 10000] for i in range(240)) and {(r.vote, r.evidence) for r in got} == {("v", "e")}


def test_pipeline_of_nulls_and_of_nothing(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", "a", 0), (2, None, "en", None, None), (3, "some plain words that stay", None, "a", 26), (None, "other words", "en", "b", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("rows", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {3, None} <= {r.doc_id for r in got} and len({r.doc_id for r in got}) <= 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
