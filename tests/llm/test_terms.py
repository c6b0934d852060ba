"""Distinctive terms and frequencies against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import distinctive, frequencies
from spindrift.plans import runtime

ROWS = [("tea", 1, 3), ("leaf", 1, 1), ("tea", 2, 1), ("cup", 2, 1), ("cup", 3, 2), ("tea", 3, 2), ("solo", 4, 7)]


def postings(spark, rows=ROWS):
    extra = [(None, 1, 1), ("tea", None, 1), ("tea", 9, None), ("tea", 9, 0)]
    return spark.createDataFrame(rows + (extra if rows is ROWS else []), "word string, page_id long, frequency long").withColumn("score", F.lit("clash")).withColumn("df", F.lit(1))


def brute(mu, min_df):
    total, cf, df, size = sum(r[2] for r in ROWS), Counter(), Counter(), Counter()
    for w, p, f in ROWS:
        cf[w] += f
        df[w] += 1
        size[p] += f
    out = {}
    for w, p, f in ROWS:
        pc = cf[w] / total
        pd = (f + mu * pc) / (size[p] + mu)
        if df[w] >= min_df:
            out[w, p] = pd * math.log(pd / pc)
    return out


@pytest.mark.parametrize(("mu", "min_df"), [(100.0, 1), (5.0, 2)])
def test_divergence(spark, mu, min_df):
    got = {(r["word"], r["page_id"]): r["score"] for r in distinctive.term_divergence(postings(spark), mu, min_df).collect()}
    assert got == pytest.approx(brute(mu, min_df))


def test_divergence_of_nothing_and_ties(spark):
    assert distinctive.term_divergence(postings(spark, [])).collect() == []
    scored = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "é", 0.0), (2, "z", 0.0)], "page_id long, word string, score double")
    assert sorted((r["page_id"], r["word"]) for r in distinctive.top_terms(scored).collect()) == [(1, "a"), (2, "z")]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_most_telling(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", broadcast_rows)
    t = "timestamp '2024-01-01'"
    index = spark.createDataFrame([("Tea", 1, 2), ("leaf", 1, 3), ("none", 1, 99), ("tea", 2, 1), (None, 2, 1), ("leaf", 8, 1)], "word string, page_id long, frequency int").withColumn("indexed_at", F.expr(t))
    pages = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    idf = spark.createDataFrame([("tea", 3.0), ("tea", 3.0), ("leaf", 2.0), ("none", None), (None, 1.0)], "word string, idf double")
    got = distinctive.most_telling(index, pages, idf)
    assert got.columns == ["page_id", "word"] and sorted(map(tuple, got.collect())) == [(1, "leaf"), (2, "tea")]


def test_stored_weights_take_the_place_of_the_log_ratio(spark):
    weights = spark.createDataFrame([("tea", 0.5), ("cup", -1.0), ("solo", 0.0)], "word string, idf double")
    got = {(r["word"], r["page_id"]): (r["score"], r["evidence"]) for r in distinctive.term_divergence(postings(spark), mu=0.0, weights=weights).collect()}
    size = {1: 4, 2: 2, 3: 4, 4: 7}
    idf = {"tea": 0.5, "cup": -1.0, "solo": 0.0}
    assert got == {(w, p): (pytest.approx(f * idf[w] / size[p]), f * idf[w]) for w, p, f in ROWS if w in idf}


def test_terms_equal_after_division_only_are_told_apart(spark):
    scored = spark.createDataFrame([(1, "a", 0.25, 1.0), (1, "b", 0.25, 1.5)], "page_id long, word string, score double, evidence double")
    assert [r["word"] for r in distinctive.top_terms(scored).collect()] == ["b"]


def ngrams(docs, n):
    total, records = Counter(), defaultdict(set)
    for d, words in docs.items():
        for i in range(len(words)):
            for k in range(1, n + 1):
                if i + k <= len(words):
                    total[tuple(words[i : i + k])] += 1
                    records[tuple(words[i : i + k])].add(d)
    return {g: (c, len(records[g])) for g, c in total.items()}


@pytest.mark.parametrize("rows_a_task", [500_000, 10])
def test_suffix_counts(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(frequencies, "ROWS_A_TASK", rows_a_task)
    rng = random.Random(5)
    docs = {d: [rng.choice("aaaabcde") + rng.choice(["", "", "é"]) for _ in range(rng.randrange(0, 30))] for d in range(40)}
    df = spark.createDataFrame([(d, w) for d, w in docs.items()] + [(99, None)], "doc long, words array<string>")
    got = frequencies.suffix_counts(frequencies.text_suffixes(df, "words", "doc", 3), partitions=3)
    assert {tuple(r["ngram"]): (r["total"], r["n_records"]) for r in got.collect()} == ngrams(docs, 3)


def test_hot_terms_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(frequencies, "ROWS_A_TASK", 3)
    docs = {d: list("aabac"[d % 3 :]) for d in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc long, words array<string>")
    got = frequencies.suffix_counts(frequencies.text_suffixes(df, "words", "doc", 2), broadcast_rows=0)
    assert {tuple(r["ngram"]): (r["total"], r["n_records"]) for r in got.collect()} == ngrams(docs, 2)


def test_text_ngrams(spark):
    texts = {1: "The cat. The CAT", 2: "the cat", 3: "the dog", 4: None, 5: "--", 6: "the"}
    df = spark.createDataFrame([*texts.items(), (None, "the cat"), (2, "the cat")], "doc long, text string").withColumn("ngram", F.lit("clash"))
    got = {r["ngram"]: (r["n"], r["total"], r["n_records"], r["mark"]) for r in frequencies.text_ngrams(df, "doc", "text", 2, least_records=2, most_share=0.5).collect()}
    assert got["the"] == (1, 6, 4, "common") and got["the cat"] == (2, 4, 2, None) and got["cat the"] == (2, 1, 1, "rare") and got["dog"] == (1, 1, 1, "rare")
    assert set(got) == {"the", "cat", "dog", "the cat", "cat the", "the dog"} and frequencies.text_ngrams(df.limit(0), "doc", "text").collect() == []


def test_suffix_counts_of_odd_rows(spark):
    rows = [(["a"], 1, 2), ([], 1, 5), (None, 1, 5), (["a"], None, 5), (["a", "b"], 2, 1), (["x" * 50_000], 3, 1)]
    got = frequencies.suffix_counts(spark.createDataFrame(rows, "suffix array<string>, record long, weight long"))
    assert sorted((r["ngram"][0][:2], len(r["ngram"]), r["total"], r["n_records"]) for r in got.collect()) == [("a", 1, 3, 2), ("a", 2, 1, 1), ("xx", 1, 1, 1)]
    assert frequencies.suffix_counts(spark.createDataFrame([], "suffix array<string>, record long, weight long")).collect() == []


def test_word_counts(spark):
    rows = [("page", k, 2) for k in range(1, 7)] + [("mid", k, 1) for k in range(1, 4)] + [("Few ", 1, 4), ("few", 2, 4), ("gone", 77, 1)]
    index = spark.createDataFrame(rows, "word string, page_id long, frequency int").withColumn("indexed_at", F.expr("timestamp '2024-01-01'"))
    pages = spark.createDataFrame([(k,) for k in range(1, 8)], "id long")
    idf = spark.createDataFrame([("page", 1.0), ("OLD", None), ("old", 2.0), (" ", 1.0), (None, 1.0)], "word string, idf double")
    got = {r["word"]: (r["total"], r["n_pages"], r["mark"]) for r in frequencies.word_counts(index, pages, idf).collect()}
    assert got == {"page": (12, 6, "common"), "mid": (3, 3, None), "few": (8, 2, "rare"), "old": (0, 0, "rare")}
