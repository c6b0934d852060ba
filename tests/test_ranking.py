"""Ranking on small corpora with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions.text import doc_length
from spindrift.operators import index, rank

GOLDEN = [
    (0, "https://en.wikipedia.org/wiki/Database", "Database", "A database is an organized collection of data. Database systems store data. It is useful!", "wikipedia", 1.0),
    (1, "https://www.example.com/db/", "Storage notes", "Notes on storage. A database index speeds up search.", "other", 0.4),
    (2, "https://example.com/db?ref=x", "Storage notes copy", "Notes on storage. A database index speeds up search.", "other", 0.2),
    (3, "https://en.wikipedia.org/wiki/Talk:Database", "Talk Database", "Talk page for the database article.", "wikipedia", 0.1),
    (4, "https://developer.mozilla.org/docs/IndexedDB", "IndexedDB", "IndexedDB is a low level API for storage in the browser.", "mdn", 0.0),
    (5, "https://stackoverflow.com/questions/1", "How to index", "How to index a table? Use an index on the search column.", "qa", 0.3),
    (6, "https://example.org/zoo", "Zoo", "Zebras graze on grass in the park.", "other", 0.0),
    (7, "https://example.org/tea", "Tea", "Green tea and black tea are drinks.", "other", 0.0),
]
FILLER = [(n, f"https://f.example.org/{n}", f"F{n}", f"filler{n} text{n} only{n}", "qa", 0.0) for n in range(10, 16)]


def corpus(spark, rows):
    p = spark.createDataFrame(rows, "id long, url string, title string, content string, source string, pagerank double").withColumn("length", doc_length(F.col("content")))
    postings = index.term_frequency(p)
    stats = index.corpus_stats(p)
    return postings, index.inverse_document_frequency(postings, stats), rank.prepare_pages(p), stats


def results(spark, rows, query):
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    tables = corpus(spark, rows)
    found = rank.with_snippets(rank.top_k(rank.search(q, *tables), 100), q, tables[2])
    return [(r["page_id"], r["score"], r["snippet"]) for r in found.orderBy("rank").collect()]


def check(got, expected):
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=1e-9)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("What is Database", [(0, 1.828017665397544), (1, 0.3461294727217295)]),
        ("database index", [(5, 1.076189202119929), (1, 1.0279089388479543), (0, 0.7812041305117708)]),
        ("how to index storage", [(1, 1.2895864664881669), (5, 1.076189202119929), (4, 0.596362034930408)]),
        ("storage storage", [(1, 1.5045175442361947), (4, 1.431268883832979)]),
        ("tea", [(7, 3.0584648229852833)]),
        ("who is", []), ("zzzzqq", []), ("  ", []),
    ],
)
def test_golden(spark, query, expected):
    got = results(spark, GOLDEN, query)
    check(got, expected)
    if query == "What is Database":
        assert got[0][2] == "A database is an organized collection of data."


def test_paging(spark):
    q = spark.createDataFrame([(1, "database index")], "query_id long, query string")
    found = rank.search(q, *corpus(spark, GOLDEN))
    assert [r["page_id"] for r in rank.page_of(found, 2, 2).collect()] == [0]
    assert rank.page_of(found, 9, 2).collect() == [] and found.count() == 3


AB = [(0, "https://e.org/b", "B", "alpha beta gamma delta", "qa", 0.0), (1, "https://e.org/a", "A", "beta alpha gamma delta", "qa", 0.0)]


@pytest.mark.parametrize(
    ("rows", "query", "expected"),
    [
        (AB + FILLER, "alpha", [(0, 1.1426120828868922), (1, 1.1426120828868922)]),
        (AB + FILLER, "beta alpha", [(1, 2.2852241657737844), (0, 1.9043534714781538)]),
        (AB + FILLER, "alpha zzz", [(0, 0.7934806131158975), (1, 0.7934806131158975)]),
        ([(0, "https://e.org/b", "B", "beta one two three", "qa", 0.0), (1, "https://e.org/a", "A", "alpha one two three", "qa", 0.0)] + FILLER, "alpha beta", [(1, 1.1214976472641678), (0, 1.1214976472641678)]),
        ([(0, "https://e.org/b", "B", "alpha beta", "wikipedia", 0.0), (1, "https://e.org/a", "A", "alpha gamma", "qa", 0.0)], "alpha beta", []),
        (
            [(0, "https://www.e.org/a", "Long", "kappa " + " ".join(f"pad{k}" for k in range(60)), "other", 0.0), (1, "https://e.org/a/", "Kappa", "kappa short page", "wikipedia", 0.5), (2, "https://e.org/c", "C", "kappa mid", "qa", 0.0)] + FILLER,
            "kappa", [(1, 2.7107166548853896), (2, 1.6131579415377484)],
        ),
    ],
)
def test_quirks(spark, rows, query, expected):
    check(results(spark, rows, query), expected)


@pytest.mark.parametrize("source", [*rank.SOURCE_WEIGHTS, "elsewhere", None])
def test_source_weights(spark, source):
    rows = [(0, "https://e.org/b", "B", "alpha one", source, 0.0)] + FILLER
    got = results(spark, rows, "alpha")
    plain = results(spark, [(0, "https://e.org/b", "B", "alpha one", "wikipedia", 0.0)] + FILLER, "alpha")
    named = source or "other"
    assert got[0][1] / plain[0][1] == pytest.approx((0.7 + 0.3 * rank.SOURCE_WEIGHTS.get(named, 0.5)) * (0.7 if named == "other" else 1))


def test_intents(spark):
    q = spark.createDataFrame([(1, "somewhat isolated"), (2, "what  is x"), (3, "show me"), (4, "What is how")], "query_id long, query string")
    got = {r["query_id"]: (r["what_is"], r["how"]) for r in rank.analyze_queries(q).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (True, False)}


def test_index_properties(spark):
    postings, idf, _, stats = corpus(spark, GOLDEN + [(9, "https://e.org/empty", "", "", "other", 0.0)])
    n = {r["word"]: (r["df"], r["idf"]) for r in idf.collect()}
    import math

    assert stats.first()["n_docs"] == 9 and n["database"][1] == pytest.approx(math.log(9 / 5))
    totals = index.index_totals(postings).first()
    assert totals["n_postings"] == sum(v[0] for v in n.values()) and totals["n_terms"] == len(n)
    empty = spark.createDataFrame([], "id long, content string, length int")
    assert index.corpus_stats(empty).first() == (0, 1.0)
    assert index.posting_lists(index.term_frequency(empty)).collect() == []
