import pytest
from pyspark.sql import functions as F

from spindrift.functions.html import page_records, parse_html
from spindrift.operators import crawl, graph


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def edges(spark, rows):
    return spark.createDataFrame(rows, "from_page long, to_page long")


@pytest.mark.parametrize("local", [True, False])
def test_golden_graph(spark, local):
    e = edges(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (2, 0), (9, 1), (1, None), (1, 77)])
    got = {r["page_id"]: r for r in graph.pagerank(nodes(spark, [0, 1, 2, 3, 3, None]), e, local_nodes=100 if local else 0).collect()}
    assert {k: v["raw"] for k, v in got.items()} == pytest.approx({0: 0.3693235333784587, 1: 0.20458155141613477, 2: 0.37847586758635865, 3: 0.047619047619047616}, abs=1e-12)
    top = 0.37847586758635865
    assert {k: v["pagerank"] for k, v in got.items()} == pytest.approx({0: 0.3693235333784587 / top, 1: 0.20458155141613477 / top, 2: 1.0, 3: 0.047619047619047616 / top}, abs=1e-12)
    assert {v["iterations"] for v in got.values()} == {35}
    assert sum(v["raw"] for v in got.values()) == pytest.approx(1)


@pytest.mark.parametrize("local", [True, False])
def test_graphs_without_edges_or_pages(spark, local):
    n = 100 if local else 0
    assert {r["pagerank"] for r in graph.pagerank(nodes(spark, [1, 2, 3]), edges(spark, []), local_nodes=n).collect()} == {1.0}
    assert graph.pagerank(nodes(spark, []), edges(spark, []), local_nodes=n).collect() == []


def test_self_links_count(spark):
    e = edges(spark, [(0, 0), (0, 1), (0, 0)])
    assert sorted(map(tuple, graph.known_edges(e, nodes(spark, [0, 1])).collect())) == [(0, 0), (0, 1)]
    step = {r[0]: r[1] for r in graph.pagerank_step(nodes(spark, [0, 1]), graph.known_edges(e, nodes(spark, [0, 1]))).collect()}
    assert step == pytest.approx({0: 0.075 + 0.85 * 0.25 + 0.85 * 0.25, 1: 0.075 + 0.85 * 0.25 + 0.85 * 0.25})


def test_link_resolution(spark):
    r = spark.createDataFrame([(0, "u0", ["u1", "u9"]), (1, "u1", ["u0", "u0", "u9", "u1"]), (2, "u0", [])], "page_id long, url string, links array<string>")
    assert sorted(map(tuple, graph.resolve_links(r).collect())) == [(0, 1), (1, 1), (1, 2)]


def test_html():
    page = """<html><head><title> A &amp; B </title><style>p{}</style></head><body><p>One &lt;1&gt;<!-- no --> <b>bold</b><p>Two
    <script>var x = '</p>';</script><div>outside</div><p>Three</p></body>"""
    title, text, hrefs, _ = parse_html(page + '<a href="../x">l</a><a>no</a>', "https://e.org/a/b/")
    assert title == "A & B" and text == "One <1> bold Two Three" and hrefs == ["../x"]
    assert parse_html(None) == ("", "", [], [])
    assert parse_html("<p>x" * 12)[1] == " ".join("x" * 10)


def test_page_records(spark):
    base = "https://en.wikipedia.org/wiki/"
    links = ["#x", "a#x", "mailto:m", "javascript:1", "//en.wikipedia.org/B", "../C", "D", "D", "/stage/x", "https://animenewsnetwork.com/y", "https://example.org/z", *[f"L{k}" for k in range(26)]]
    body = "".join(f'<a href="{x}">.</a>' for x in links)
    long = "y" * 99
    rows = [(base + "A", f"<title>T</title><p>{long}y</p>{body}"), (base + "S", f"<title>T</title><p>{long}</p>"), (base + "N", f"<title></title><p>{long}y</p>"), (base + "0", None)]
    got = page_records(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [r["url"] for r in got] == [base + "A"] and got[0]["source"] == "wikipedia"
    assert got[0]["links"][:3] == ["https://en.wikipedia.org/B", "https://en.wikipedia.org/C", base + "D"] and len(got[0]["links"]) == 25


def test_admission(spark):
    seen = spark.createDataFrame([("https://a.example/0", "a.example")], "url string, domain string")
    rows = [("https://a.example/0", 0), ("https://www.a.example/1?x", 1), ("https://a.example/1/", 2), ("https://a.example/2", 3), ("https://b.example/1", 4), ("nonsense", 5), ("https://c.example/1", 6)]
    c = spark.createDataFrame(rows, "url string, place long")
    got = [r["url"] for r in crawl.admit(c, seen, max_pages=3, domain_cap=2, check_domains=False).orderBy("place").collect()]
    assert got == ["https://a.example/1", "https://b.example/1"]
    assert crawl.admit(c, seen, max_pages=1, check_domains=False).collect() == []
    assert crawl.admit(c, seen).collect() == []


def test_crawl_rounds(spark):
    text = "<p>" + "word " * 30 + "</p>"
    site = {"https://en.wikipedia.org/A": ["B", "C"], "https://en.wikipedia.org/B": ["A", "D"], "https://en.wikipedia.org/C": ["D"], "https://en.wikipedia.org/D": []}
    web = spark.createDataFrame([(u, 200, "text/html; charset=utf-8", f"<title>{u}</title>{text}" + "".join(f'<a href="{x}">x</a>' for x in ls), None) for u, ls in site.items()], "url string, status int, content_type string, html string, error string")
    fetch = lambda f: f.join(web, "url", "left").withColumn("error", F.when(F.col("status").isNull(), "Timeout"))
    seeds = spark.createDataFrame([("https://en.wikipedia.org/A", 0), ("https://en.wikipedia.org/X", 1)], "url string, place long")
    records, failed = crawl.crawl(fetch, seeds)
    assert sorted(r["url"] for r in records.collect()) == sorted(site)
    assert [tuple(r) for r in failed.collect()] == [("https://en.wikipedia.org/X", "Timeout")]
    records, _ = crawl.crawl(fetch, seeds, max_pages=3)
    assert records.count() == 2


def test_deep_crawl_with_retries(spark):
    """Twelve rounds, one page each: places stay small; answers worth it are asked for again, twice at most."""
    text = "<p>" + "word " * 30 + "</p>"
    u = "https://en.wikipedia.org/{}".format
    rows = [(u(k), f"<title>{k}</title>{text}<a href='{u(k + 1)}'>x</a>") for k in range(12)] + [(u(12), f"<title>end</title>{text}")]
    web = spark.createDataFrame(rows, "url string, html string")
    asked, waited = [], []

    def fetch(frontier):
        asked.append([r["url"] for r in frontier.collect()])
        tries = {x: sum(x in a for a in asked) for x in asked[-1]}
        status = F.when(F.col("url") == u(3), F.lit(503 if tries.get(u(3), 0) < 3 else 200)).when(F.col("url") == u("never"), 429).otherwise(200)
        return frontier.join(web, "url", "left").select("url", status.alias("status"), F.lit("text/html").alias("content_type"), "html", F.lit(None).cast("string").alias("error"), F.lit("7" if u("never") in tries else None).alias("retry_after"))

    seeds = spark.createDataFrame([(u(0), 18), (u("never"), 19)], "url string, place long")
    records, failed = crawl.crawl(fetch, seeds, wait=waited.append)
    assert sorted(r["url"] for r in records.collect()) == sorted(x for x, _ in rows)
    assert [tuple(r) for r in failed.collect()] == [(u("never"), "status 429")]
    assert asked.count([u("never")]) == 2 and asked.count([u(3)]) == 3 and waited[:2] == [7.0, 7.0] and len(waited) == 4


def test_places_are_dense(spark):
    rows = [(f"u{k}", "d", (k * 7919) % 1000 * 2**40) for k in range(50)]
    got = crawl.dense_places(spark.createDataFrame(rows, "url string, domain string, place long")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(50)) and [r["url"] for r in got] == [r[0] for r in sorted(rows, key=lambda r: r[2])]


def test_retry_plan_and_server_metrics(spark):
    log = spark.createDataFrame([(1, "u", 503, 1), (1, "u", 503, 1), (2, "u", None, 2), (3, "u", 500, 3), (4, "v", 404, 1), (None, "v", 503, 1)], "fetch_id long, url string, status int, t long")
    log = log.select("fetch_id", "url", "status", F.timestamp_seconds("t").alias("fetched_at"), F.timestamp_seconds("t").alias("written_at"))
    assert sorted(map(tuple, crawl.retry_plan(log).collect())) == [(1, 0, True, 0.5), (2, 1, True, 1.0), (3, 2, False, None), (4, 0, False, None)]
    asked = spark.createDataFrame([("/search", 200, "hit", 1.0), ("/api/search", 200, "miss", 3.0), ("/search", 500, "n/a", 2.0), ("/", 200, "hit", None), (None, None, None, None)], "path string, status int, cache_status string, latency double")
    got = crawl.server_metrics(asked).first().asDict()
    assert got == {"total_requests": 5, "search_requests": 3, "cache_hits": 1, "cache_misses": 1, "cache_shared": 0, "error_requests": 1, "mean_latency": 2.0, "max_latency": 3.0}
    assert crawl.server_metrics(asked.limit(0)).first()["total_requests"] == 0


def test_retries():
    assert [crawl.should_retry(s, 0) for s in (200, 404, 429, 503)] == [False, False, True, True]
    assert not crawl.should_retry(503, 2) and crawl.should_retry(None, 1, error=True)
    assert crawl.retry_delay(2, jitter=0) == 2.0 and crawl.retry_delay(0, "7") == 7.0 and 0.5 <= crawl.retry_delay(0, "soon") <= 0.8


def test_crawl_stats_on_empty_log(spark):
    log = spark.createDataFrame([], "fetch_id long, url string, page_id long, status int, error string, n_bytes long, fetched_at timestamp, written_at timestamp")
    assert crawl.crawl_stats(log).first()["fetched"] == 0
    assert crawl.failed_log(log).collect() == []
