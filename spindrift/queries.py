"""Registered queries over the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text, urls
from spindrift.functions.html import extract_html
from spindrift.functions.html import page_records as html_records
from spindrift.operators import crawl, graph, index, rank
from spindrift.plans import hot_words
from spindrift.plans.runtime import distinct_pages, materialize, scratch_path
from spindrift.schema import violations
from spindrift.sources import index_json, jsonl
from spindrift.streaming.ingest import windowed_requests

#: The queries that the ranked-retrieval entries run, as a batch.
SEARCHES = [
    (1, "page content"), (2, "What is a lock"), (3, "how search tree"), (4, "cache cache line"), (5, "who is"), (6, "zzzzqq"), (7, "socket zzzzqq"), (8, "  "),
    (9, "gene marker isotope"), (10, "somewhat isolated show enzyme"),
]


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without repeated rows; null texts empty, the length counted anew, the source in its compared form."""
    (raw,) = _t(spark, d, "pages")
    p = distinct_pages(raw, "url", "title", "content", "source", "views", "pagerank")
    content = F.coalesce("content", F.lit(""))
    return p.select("id", "url", F.coalesce("title", F.lit("")).alias("title"), content.alias("content"), text.doc_length(content).alias("length"), F.coalesce(text.fold_word(F.col("source")), F.lit("other")).alias("source"), "views", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = _t(spark, d, "documents")
    content = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), content.alias("content"), text.doc_length(content).alias("length"))


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, query string")


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All results of all searches, and the prepared pages."""
    pages = materialize(_pages(spark, d), "pages")
    postings = materialize(index.term_frequency(pages), "postings")
    stats = index.corpus_stats(pages)
    prepared = rank.prepare_pages(pages)
    return rank.search(_searches(spark), postings, index.inverse_document_frequency(postings, stats), prepared, stats), prepared


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_top10(spark, d)


def token_counts(spark, d):
    tokens = text.tokenize(F.col("content"))
    return _documents(spark, d).select(F.col("id").alias("doc_id"), F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_terms"))


def doc_lengths(spark, d):
    return _documents(spark, d).select(F.col("id").alias("doc_id"), F.col("length").cast("long").alias("length"))


def term_frequency(spark, d):
    return index.term_frequency(_pages(spark, d)).withColumn("frequency", F.col("frequency").cast("long"))


def posting_lists(spark, d):
    lists = index.posting_lists(index.term_frequency(_pages(spark, d)), block=256)
    return lists.select("word", "block", F.array_join(F.transform("postings", lambda p: F.concat(p["page_id"].cast("string"), F.lit(":"), p["frequency"].cast("string"))), ",").alias("postings"))


def idf_weights(spark, d):
    pages = materialize(_pages(spark, d).select("id", "content", "length"), "pages")
    out = index.inverse_document_frequency(index.term_frequency(pages), index.corpus_stats(pages))
    return out.select("word", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, d):
    return index.corpus_stats(_pages(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def index_totals(spark, d):
    return index.index_totals(index.term_frequency(_pages(spark, d)))


def posting_lookup(spark, d):
    return index.lookup(index.term_frequency(_pages(spark, d)), ["enzyme", "socket", "zzzzqq"]).withColumn("frequency", F.col("frequency").cast("long"))


def term_shards(spark, d):
    words = index.term_frequency(_pages(spark, d)).select("word").distinct()
    return words.groupBy(text.term_shard(F.col("word"), 256).alias("shard")).agg(F.count(F.lit(1)).alias("n_terms"))


def query_vocabulary(spark, d):
    pages = _pages(spark, d)
    return rank.query_vocabulary(_searches(spark), index.document_frequency(index.term_frequency(pages)).withColumn("idf", F.lit(0.0)))


def normalized_titles(spark, d):
    return _pages(spark, d).select("id", text.normalize_text(F.col("title")).alias("title_clean"), F.size(text.word_set(text.normalize_text(F.col("content")))).cast("long").alias("n_words"))


def snippets(spark, d):
    words = F.array(F.lit("page"), F.lit("enzyme"), F.lit("lock"))
    return _pages(spark, d).select("id", text.snippet(F.col("content"), words).alias("snippet"))


def query_intents(spark, d):
    return rank.analyze_queries(_searches(spark)).select("query_id", "clean", "what_is", "how", F.array_join("terms", " ").alias("terms"))


def bm25_batch(spark, d):
    pages = materialize(_pages(spark, d).select("id", "content", "length"), "pages")
    postings = materialize(index.term_frequency(pages), "postings")
    stats = index.corpus_stats(pages)
    terms = rank.query_terms(rank.analyze_queries(_searches(spark)))
    out = rank.bm25(terms, postings, index.inverse_document_frequency(postings, stats), pages.select(F.col("id").alias("page_id"), "length"), stats)
    return out.select("query_id", "page_id", F.round("base", 6).alias("base"), F.col("first_pos").cast("long").alias("first_pos"))


def rank_features(spark, d):
    pages = materialize(_pages(spark, d), "pages")
    analyzed = rank.analyze_queries(_searches(spark))
    every = pages.select(F.col("id").alias("page_id")).crossJoin(F.broadcast(analyzed.select("query_id"))).withColumn("base", F.lit(1.0)).withColumn("first_pos", F.lit(0))
    f = rank.rank_features(every, analyzed, rank.prepare_pages(pages))
    return f.select("query_id", "page_id", *[F.round(x, 6).alias(x) for x in rank.FACTORS])


def search_all(spark, d):
    return _results(spark, d)[0].select("query_id", "page_id", F.round("score", 6).alias("score"), "url")


def search_top10(spark, d):
    results, prepared = _results(spark, d)
    found = rank.with_snippets(rank.top_k(results, 10), _searches(spark), prepared)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "page_id", F.round("score", 6).alias("score"), "title", "url", "snippet")


def search_second_page(spark, d):
    found = _results(spark, d)[0].where("query_id = 9")
    return rank.page_of(found, page=2, limit=10).select("page_id", F.round("score", 6).alias("score"))


def search_totals(spark, d):
    totals = _results(spark, d)[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("n_pages", rank.page_count(F.col("total"), 10))


def canonical_urls(spark, d):
    (p,) = _t(spark, d, "pages")
    u = F.col("url")
    return p.select("id", urls.canonical_url(u).alias("canonical"), urls.crawl_url(u).alias("crawl"), urls.strip_fragment_query(u).alias("cut")).distinct()


def url_groups(spark, d):
    return _pages(spark, d).groupBy(urls.canonical_url(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("id").alias("first_page"))


def url_filters(spark, d):
    u = F.col("url")
    return _pages(spark, d).select(
        "id", urls.detect_source(u).alias("source"), urls.is_valid_url(u).alias("valid"), urls.is_allowed(u).alias("allowed"), urls.has_bad_pattern(u).alias("bad"), urls.has_banned_marker(u).alias("banned"), urls.is_too_deep(u).alias("deep")
    )


def source_counts(spark, d):
    return _pages(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))


def html_extract(spark, d):
    """Pages written as HTML, a paragraph a line, and read again."""
    out = extract_html(_html(_pages(spark, d)))
    return out.select(F.col("url").cast("long").alias("id"), "title", F.length("text").cast("long").alias("n_chars"))


def _html(pages: DataFrame) -> DataFrame:
    """url (the page's id) and html of pages: a paragraph a line."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(F.col("content"), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title></head><body><script>var p = '</p>';</script>"), body, F.lit("</body></html>"))
    return pages.select(F.col("id").cast("string").alias("url"), html.alias("html"))


def link_edges(spark, d):
    return graph.known_edges(*_t(spark, d, "links", "pages"))


def out_degrees(spark, d):
    return graph.out_degree(link_edges(spark, d))


def dangling_pages(spark, d):
    return graph.dangling_pages(_t(spark, d, "pages")[0], link_edges(spark, d))


def pagerank_step(spark, d):
    return graph.pagerank_step(_t(spark, d, "pages")[0], materialize(link_edges(spark, d), "edges")).select("page_id", F.round("rank", 10).alias("rank"))


def pagerank(spark, d):
    pages, links = _t(spark, d, "pages", "links")
    return graph.pagerank(pages, links).select("page_id", F.round("pagerank", 6).alias("pagerank"))


def domain_cap(spark, d):
    p = _pages(spark, d).select("url", F.col("id").alias("place"))
    return crawl.domain_capped(p, 5).select("url", "domain", "place")


def crawl_stats(spark, d):
    return crawl.crawl_stats(_t(spark, d, "fetch_log")[0])


def failed_fetches(spark, d):
    return crawl.failed_log(_t(spark, d, "fetch_log")[0])


def request_metrics(spark, d):
    return crawl.request_metrics(_t(spark, d, "events")[0], "event_type", "value")


def request_windows(spark, d):
    return windowed_requests(_t(spark, d, "events")[0])


def retry_plan(spark, d):
    return crawl.retry_plan(_t(spark, d, "fetch_log")[0])


def crawl_admission(spark, d):
    """What a crawl would schedule of all page URLs: three a host, at most 300 in all."""
    urls_ = _t(spark, d, "pages")[0].where("id is not null").select("url", F.col("id").alias("place"))
    return crawl.admit(urls_, spark.createDataFrame([], "url string, domain string"), max_pages=300, domain_cap=3, check_domains=False)


def page_records(spark, d):
    """Pages written as HTML, read as a crawl reads them: those with a title and enough text."""
    return html_records(_html(_pages(spark, d))).select(F.col("url").cast("long").alias("id"), "title", F.length("text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"))


def resolved_links(spark, d):
    """The link table resolved anew from page records that name their targets by URL."""
    pages, links = _t(spark, d, "pages", "links")
    known = distinct_pages(pages, "url")
    named = links.join(known.select(F.col("id").alias("to_page"), F.col("url").alias("target")), "to_page").groupBy(F.col("from_page").alias("id")).agg(F.collect_set("target").alias("links"))
    records = known.join(named, "id", "left").select(F.col("id").alias("page_id"), "url", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    return graph.resolve_links(records)


def jsonl_round_trip(spark, d):
    """Pages written as JSON lines and read again: ids are dense in the order of the file."""
    path = scratch_path(spark, "lines")
    rows = _pages(spark, d).where("url is not null")
    jsonl.write_records(rows.select("url", "title", F.col("content").alias("text"), "source", F.array().cast("array<string>").alias("links")), path)
    back = jsonl.pages_table(jsonl.read_pages(spark, path))
    span = back.agg(F.min("id").alias("first_id"), (F.max("id") - F.count(F.lit(1)) + 1).alias("gaps"), F.count_distinct("id").alias("n_ids"))
    return back.select("url", "title", "source", F.col("length").cast("long").alias("length")).crossJoin(F.broadcast(span))


def shard_round_trip(spark, d):
    """Postings written as shard files and read again, summed up by word."""
    path = scratch_path(spark, "shards")
    index_json.write_shards(index.term_frequency(_pages(spark, d)), path, 16)
    back = index_json.read_shards(spark, path)
    return back.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("frequency").alias("total"), F.sum(F.col("page_id") * F.col("frequency")).alias("mass"))


def pagerank_joined(spark, d):
    """Ten steps of PageRank by joins, as for graphs that are too large for one task."""
    pages, links = _t(spark, d, "pages", "links")
    return graph.pagerank(pages, links, max_iterations=10, local_nodes=0).select("page_id", F.round("pagerank", 6).alias("pagerank"))


def constraint_report(spark, d):
    pages, postings, idf, links = _t(spark, d, "pages", "inverted_index", "idf", "links")
    return violations(pages, postings=postings, idf=idf, links=links)


def p6_found(spark, d):
    return hot_words.leading_pages(*_t(spark, d, "inverted_index", "pages"))


def p6_totals(spark, d):
    return hot_words.weighted_totals(*_t(spark, d, "inverted_index", "pages", "idf"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        token_counts, doc_lengths, term_frequency, posting_lists, idf_weights, corpus_stats, index_totals, posting_lookup, term_shards, query_vocabulary,
        normalized_titles, snippets, query_intents, bm25_batch, rank_features, search_all, search_top10, search_second_page, search_totals,
        canonical_urls, url_groups, url_filters, source_counts, html_extract, link_edges, out_degrees, dangling_pages, pagerank_step, pagerank,
        page_records, resolved_links, jsonl_round_trip, shard_round_trip, pagerank_joined, constraint_report, crawl_admission, retry_plan, domain_cap, crawl_stats, failed_fetches, request_metrics, request_windows, p6_found, p6_totals,
    )
}


