import json
import os

import pytest

from spindrift.operators import graph, index
from spindrift.plans import pipeline, store
from spindrift.plans.engine import ResultCache, SearchEngine
from spindrift.schema import validate, violations
from spindrift.sources import index_json, jsonl
from spindrift.streaming import ingest

LINES = [
    '{"url":"u0","text":"a b"}', "", "   ", "{bad", '{"url":"u1","links":["u0","u0","u9","u1"],"title":null}', "[1]", "7", '{"url":"ü2","title":"T","text":"tea","source":"qa","links":[]}',
]


@pytest.fixture
def lines(tmp_path):
    p = tmp_path / "pages.jsonl"
    p.write_text("\n".join(LINES), encoding="utf-8")
    return str(p)


def test_jsonl(spark, lines):
    got = sorted(map(tuple, jsonl.read_pages(spark, lines).collect()))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(0, "u0", "", "a b", "other"), (1, "u1", "", "", "other"), (2, "ü2", "T", "tea", "qa")]
    assert sorted(map(tuple, graph.resolve_links(jsonl.read_pages(spark, lines)).collect())) == [(1, 0), (1, 1)]
    assert sorted(map(tuple, jsonl.rejected_lines(spark, lines).collect())) == [("7", "other"), ("[1]", "other"), ("{bad", "malformed")]


def test_dense_ids_over_many_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps({"url": f"u{f}-{k}"}) for k in range(50 + f)))
    got = jsonl.read_pages(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == list(range(153))
    assert [r["url"] for r in got] == [f"u{f}-{k}" for f in range(3) for k in range(50 + f)]


def test_record_sinks(spark, tmp_path, lines):
    records = jsonl.read_pages(spark, lines).drop("page_id")
    jsonl.write_records(records, str(tmp_path / "out"), "overwrite")
    again = jsonl.read_pages(spark, str(tmp_path / "out")).drop("page_id")
    assert sorted(map(str, again.collect())) == sorted(map(str, records.collect()))
    (tmp_path / "old.json").write_text(json.dumps([{"url": "a", "links": []}, {"url": "b"}], indent=2))
    assert [r["url"] for r in jsonl.read_json_array(spark, str(tmp_path / "old.json")).collect()] == ["a", "b"]


def test_json_arrays(spark, tmp_path):
    df = spark.createDataFrame([(f"u{k}", 'a "b"\nç' if k else None, ["x"] * k) for k in range(5)], "url string, title string, links array<string>").repartition(3)
    jsonl.write_json_array(df, str(tmp_path / "arrays"))
    parts = [json.loads(p.read_text()) for p in sorted((tmp_path / "arrays").glob("part-*"))]
    assert sorted(r["url"] for p in parts for r in p) == [f"u{k}" for k in range(5)]
    back = jsonl.read_json_array(spark, str(tmp_path / "arrays")).select("url", "title", "links")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = next(p for p in (tmp_path / "arrays").glob("part-*") if "u0" in p.read_text()).read_text()
    assert one.startswith("[\n  {\n    \"url\"") and one.endswith("}\n]\n")


def test_lists_in_blocks_are_one_list_each(spark, tmp_path):
    postings = spark.createDataFrame([("tea", k, 1 + k % 3) for k in range(0, 50, 3)] + [("x", 40, 1)], "word string, page_id long, frequency int")
    lists = index.posting_lists(postings, block=10)
    assert lists.where("word = 'tea'").count() == 5 and lists.selectExpr("max(size(postings))").first()[0] <= 10
    index_json.write_postings(lists, str(tmp_path / "parts"))
    index_json.join_entries(str(tmp_path / "parts"), str(tmp_path / "index.json"))
    assert json.loads((tmp_path / "index.json").read_text()) == {"tea": [[k, 1 + k % 3] for k in range(0, 50, 3)], "x": [[40, 1]]}


def test_http_fetcher(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from spindrift.sources import http_fetch

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            status = {"/busy": 503, "/gone": 404}.get(self.path, 200)
            self.send_response(status)
            self.send_header("Content-Type", "image/png" if self.path == "/png" else "text/html; charset=utf-8")
            if status == 503:
                self.send_header("Retry-After", "3")
            self.end_headers()
            self.wfile.write("<title>é</title>".encode() + b"\xff")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        urls = [f"{at}/", f"{at}/png", f"{at}/busy", f"{at}/gone", "http://127.0.0.1:1/"]
        got = {r["url"].removeprefix(at): r for r in http_fetch.http_fetcher(host_delay=0.01)(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    finally:
        server.shutdown()
    assert (got["/"]["status"], got["/"]["html"]) == (200, "<title>é</title>") and (got["/png"]["status"], got["/png"]["html"]) == (200, None)
    assert (got["/busy"]["status"], got["/busy"]["retry_after"]) == (503, "3") and (got["/gone"]["status"], got["/gone"]["error"]) == (404, "status 404")
    assert got["http://127.0.0.1:1/"]["status"] is None and got["http://127.0.0.1:1/"]["error"] == "URLError"


def test_index_is_copied_where_none_is(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "there"), str(tmp_path / "here")
    monkeypatch.delenv("SEARCH_DB_URL", raising=False)
    with pytest.raises(FileNotFoundError, match="SEARCH_DB_URL"):
        store.ensure_index(spark, path)
    version = store.write_index(_pages(spark, [(0, "https://e.org/0", "T", "tea", "qa")]), spark.createDataFrame([], "from_page long, to_page long"), source, shards=2)
    monkeypatch.setenv("SEARCH_DB_URL", source)
    assert store.ensure_index(spark, path) == path and store.current_version(spark, path) == version
    assert store.open_index(spark, path).pages.count() == 1 and store.ensure_index(spark, path, "nowhere") == path


def test_index_exchange_files(spark, tmp_path):
    p = spark.createDataFrame([(0, "tea \"x tea", 3), (1, "tea über", 2), (2, "", 0)], "id long, content string, length int")
    postings = index.term_frequency(p)
    index_json.write_postings(index.posting_lists(postings), str(tmp_path / "parts"))
    index_json.join_entries(str(tmp_path / "parts"), str(tmp_path / "index.json"))
    assert json.loads((tmp_path / "index.json").read_text()) == {"tea": [[0, 2], [1, 1]], "x": [[0, 1]], "ber": [[1, 1]]}
    assert sorted(map(tuple, index_json.read_postings(spark, str(tmp_path / "index.json")).collect())) == [("ber", 1, 1), ("tea", 0, 2), ("tea", 1, 1), ("x", 0, 1)]
    index_json.write_weights(index.inverse_document_frequency(postings, index.corpus_stats(p)), str(tmp_path / "w"))
    index_json.join_entries(str(tmp_path / "w"), str(tmp_path / "idf.json"))
    assert {r[0] for r in index_json.read_weights(spark, str(tmp_path / "idf.json")).collect()} == {"tea", "x", "ber"}
    index_json.write_shards(postings, str(tmp_path / "shards"), 4)
    assert index_json.read_shards(spark, str(tmp_path / "shards")).select("word", "page_id", "frequency").exceptAll(postings).isEmpty()
    (tmp_path / "none").mkdir()
    index_json.join_entries(str(tmp_path / "none"), str(tmp_path / "empty.json"))
    assert (tmp_path / "empty.json").read_text() == "{}"
    assert index_json.read_postings(spark, str(tmp_path / "empty.json")).collect() == []
    (tmp_path / "cut.json").write_text('{"a": [[1,')
    with pytest.raises(Exception):  # noqa: B017
        index_json.read_postings(spark, str(tmp_path / "cut.json")).collect()


def _pages(spark, rows):
    from pyspark.sql import functions as F

    r = spark.createDataFrame(rows, "page_id long, url string, title string, text string, source string")
    return jsonl.pages_table(r.withColumn("links", F.array().cast("array<string>")))


def test_engine(spark, tmp_path):
    path, now = str(tmp_path / "ix"), [0.0]
    rows = [(k, f"https://e.org/{k}", f"Tea {k}", f"tea green{k} leaf", "qa") for k in range(12)] + [(20 + k, f"https://f.org/{k}", "F", f"pad{k} word{k}", "qa") for k in range(30)]
    with pytest.raises(FileNotFoundError):
        SearchEngine.open(spark, path)
    first = store.write_index(_pages(spark, rows), spark.createDataFrame([(0, 1), (1, 0), (5, 99)], "from_page long, to_page long"), path, shards=4)
    engine = SearchEngine(spark, path, clock=lambda: now[0])
    assert engine.health() == {"status": "ok", "db_exists": True}
    page1, page2, page3 = (engine.search_page("Tea", p, 10) for p in (1, 2, 3))
    assert (len(page1.results), len(page2.results), len(page3.results)) == (10, 2, 0) and page1.total == page2.total == page3.total == 12
    assert set(page1.results[0]) == {"title", "url", "score", "snippet"} and page1.results[0]["url"] == "https://e.org/0"
    assert engine.counters["miss"] == 1 and engine.counters["hit"] == 2
    assert engine.search_page("   ").envelope() == {"results": [], "total": 0}
    assert engine.search_page("the").total == 0 and engine.search("").count() == 0
    for bad in (("", 1, 10), ("tea", 0, 10), ("tea", 1, 0), ("tea", 1, 51)):
        with pytest.raises(ValueError):
            engine.search_page(*bad)
    batch = engine.search_batch(spark.createDataFrame([(1, "tea"), (2, "who is"), (3, "pad3")], "query_id long, query string"), 3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in batch) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    plan = store.postings_of(engine.tables(), ["tea"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard" in plan.split("PartitionFilters")[1][:60]
    assert "In(word" in plan or "EqualTo(word,tea)" in plan
    store.write_index(_pages(spark, rows[:5] + rows[12:]), spark.createDataFrame([], "from_page long, to_page long"), path, shards=4)
    assert engine.search_page("tea").total == 12
    now[0] = 31
    assert engine.search_page("tea").total == 5
    store.remove_old(spark, path)
    assert first not in os.listdir(path) and engine.search_page("green1").total == 1


def test_pages_beyond_the_kept_results(spark, tmp_path, monkeypatch):
    """The driver gets the number of results and the first few; a page beyond them is fetched alone."""
    from spindrift.plans import engine as module
    from spindrift.plans import http

    path = str(tmp_path / "ix")
    rows = [(k, f"https://e.org/{k:02}", f"Tea {k}", f"tea green{k} leaf", "qa") for k in range(23)] + [(50 + k, f"https://f.org/{k}", "F", f"pad{k} word{k}", "qa") for k in range(60)]
    store.write_index(_pages(spark, rows), spark.createDataFrame([], "from_page long, to_page long"), path, shards=4)
    monkeypatch.setattr(module, "HEAD", 6)
    engine = SearchEngine(spark, path)
    sizes, plain = [], engine._rows
    monkeypatch.setattr(engine, "_rows", lambda *a: sizes.append(len(out := plain(*a))) or out)
    pages = [engine.search_page("tea", p, 5) for p in (1, 2, 5, 6)]
    assert [len(p.results) for p in pages] == [5, 5, 3, 0] and {p.total for p in pages} == {23} and pages[0].pages(5) == 5
    assert sizes == [6, 5, 3]
    urls = [r["url"] for p in (engine.search_page("tea", n, 5) for n in range(1, 6)) for r in p.results]
    assert urls == [f"https://e.org/{k:02}" for k in range(23)]
    assert http.respond(engine, "/api/search?q=Tea&page=5&limit=5")[1]["total"] == 23 and http.respond(engine, "/search?q=")[0] == 422
    assert http.respond(engine, "/search?q=tea&page=0")[0] == 422 and http.respond(engine, "/search?q=tea&limit=x")[0] == 422 and http.respond(engine, "/x")[0] == 404
    server = http.serve(engine)
    try:
        import urllib.request

        at = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{at}/api/health")) == {"status": "ok", "db_exists": True}
        assert json.load(urllib.request.urlopen(f"{at}/")) == {"message": "API is running"}
        got = json.load(urllib.request.urlopen(f"{at}/api/search?q=tea&limit=2"))
        assert got["total"] == 23 and [r["url"] for r in got["results"]] == urls[:2]
    finally:
        server.shutdown()
    assert engine.counters["requests"] == engine.counters["hit"] + engine.counters["miss"] + engine.counters["errors"]


def test_failed_build_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "ix")
    good = [(0, "https://e.org/0", "T", "tea", "qa")]
    none = spark.createDataFrame([], "from_page long, to_page long")
    version = store.write_index(_pages(spark, good), none, path)
    with pytest.raises(ValueError, match="pages.url unique.*e.org/0"):
        store.write_index(_pages(spark, good + [(1, "https://e.org/0", "T", "x", "qa")]), none, path)
    with pytest.raises(Exception):  # noqa: B017
        store.write_index(_pages(spark, good), none.withColumnRenamed("to_page", "x"), path)
    assert store.current_version(spark, path) == version and len([x for x in os.listdir(path) if x.startswith("0")]) == 1


def test_constraints(spark):
    pages = _pages(spark, [(0, "a", "", "", "qa"), (0, "a", "", "", "qa"), (1, None, "", "", "qa")])
    postings = spark.createDataFrame([("w", 0, 0), ("w", 5, 1)], "word string, page_id long, frequency int")
    got = {r[0]: r[1] for r in violations(pages, postings=postings).collect()}
    assert got["pages.id unique"] == 1 and got["pages.url not null"] == 1 and got["postings.frequency > 0"] == 1 and got["postings.page_id in pages"] == 1
    with pytest.raises(ValueError):
        validate(pages)


def test_cache():
    now = [0.0]
    c = ResultCache(entries=2, seconds=10, clock=lambda: now[0])
    assert [c.get(k, lambda: k)[1] for k in ("a", "a", "b", "c", "a")] == ["miss", "hit", "miss", "miss", "miss"]
    now[0] = 11
    assert c.get("a", lambda: 1) == (1, "miss")
    with pytest.raises(ZeroDivisionError):
        c.get("x", lambda: 1 / 0)
    assert c.get("x", lambda: 2) == (2, "miss")
    import threading

    go, out = threading.Event(), []
    t = [threading.Thread(target=lambda: out.append(c.get("s", lambda: go.wait(5) and 3))) for _ in range(2)]
    t[0].start()
    while "s" not in c._working:
        pass
    t[1].start()
    go.set()
    [x.join() for x in t]
    assert sorted(out, key=lambda x: x[1])[0] == (3, "miss") and out[0][0] == out[1][0] == 3


def test_path_setting(monkeypatch):
    monkeypatch.setenv("SEARCH_DB_PATH", " ~/x ")
    assert store.index_path() == os.path.expanduser("~/x") and store.index_path("/y") == "/y"
    monkeypatch.delenv("SEARCH_DB_PATH")
    assert store.index_path() == "data/index"


def test_pipeline(spark, tmp_path):
    text = "<p>" + "tea " * 30 + "</p>"
    web = spark.createDataFrame([("https://en.wikipedia.org/A", 200, "text/html", f"<title>A</title>{text}<a href='B'>b</a>", None), ("https://en.wikipedia.org/B", 200, "text/html", f"<title>B</title>{text}", None)], "url string, status int, content_type string, html string, error string")
    said = []
    spent = pipeline.run(spark, str(tmp_path / "pages"), str(tmp_path / "ix"), lambda f: f.join(web, "url"), ["https://en.wikipedia.org/A"], shards=2, log=said.append)
    assert list(spent) == ["clean", "crawl", "index"] and said[-1].startswith("total")
    assert sorted(map(tuple, store.open_index(spark, str(tmp_path / "ix")).links.collect())) in ([(0, 1)], [(1, 0)])
    assert list(pipeline.run(spark, str(tmp_path / "pages"), str(tmp_path / "ix"), skip=("clean", "crawl"), log=said.append)) == ["index"]
    with pytest.raises(ValueError):
        pipeline.run(spark, "a", "b", skip=("all",))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(json.dumps({"url": f"u{k % 3}", "text": f"tea leaf{k}", "title": "T"}) for k in range(6)))
    stream = ingest.first_of_url(ingest.record_stream(spark, str(folder)))
    q = ingest.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out/pages")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/postings")).where("word = 'tea'").count() == 3
