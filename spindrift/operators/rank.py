"""Ranked retrieval: BM25 with re-ranking, for a batch of queries at once (one query is a batch of one)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import normalize_text, snippet, tokenize_query
from spindrift.functions.urls import canonical_url, has_banned_marker
from spindrift.plans.runtime import join_checked

# The ranking formula's constants.
K1, B = 1.5, 0.75
SOURCE_WEIGHTS = {
    "wikipedia": 1.0, "encyclopedia": 0.95, "science": 0.95, "health": 0.95, "mdn": 0.9, "docs": 0.9, "gfg": 0.85, "qa": 0.8,
    "finance": 0.75, "news": 0.65, "medium": 0.6, "other": 0.5,
}
UNKNOWN_WEIGHT = 0.5
HOW_SOURCES = ("gfg", "stackoverflow")
LEAST_SCORE = 0.3

#: The factors in the order in which a score is multiplied by them.
FACTORS = (
    "f_source", "f_what_wiki", "f_what_qa", "f_title_miss", "f_preferred", "f_other", "f_authority", "f_title_match", "f_phrase", "f_coverage", "f_url",
)


def prepare_pages(pages: DataFrame) -> DataFrame:
    """Features that don't depend on a query, worked out once when an index is built."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    return pages.select(
        F.col("id").alias("page_id"), "url", title.alias("title"), content.alias("content"), F.coalesce("source", F.lit("other")).alias("source"),
        F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "length", canonical_url(F.col("url")).alias("clean_url"),
        normalize_text(title).alias("title_clean"), normalize_text(content).alias("content_clean"),
    )


def analyze_queries(queries: DataFrame) -> DataFrame:
    """query_id, query, words (in order, repeats kept), terms (distinct, in order), clean, what_is, how."""
    low = F.lower("query")
    what = F.contains(low, F.lit("what is"))
    words = tokenize_query(F.col("query"))
    return (
        queries.where("query is not null").select("query_id", "query", words.alias("words"), normalize_text(F.col("query")).alias("clean"), what.alias("what_is"), (~what & F.contains(low, F.lit("how"))).alias("how"))
        .withColumn("terms", F.array_distinct("words"))
    )


def query_terms(analyzed: DataFrame) -> DataFrame:
    """query_id, word, pos (place of its first occurrence among the distinct words), n (how often the query has it)."""
    terms = analyzed.select("query_id", "words", F.posexplode("terms").alias("pos", "word"))
    return terms.select("query_id", "word", "pos", F.size(F.filter("words", lambda w: w == F.col("word"))).alias("n"))


def bm25(terms: DataFrame, postings: DataFrame, idf: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, page_id, base, first_pos of every page that has a term of a query.

    Terms that the index doesn't know drop out.  The terms are the counted, usually broadcast side, so postings are
    read with their words as a runtime filter and only matching rows move.  A page without a length counts as average.
    """
    known = join_checked(idf.select("word", "idf"), terms, ["word"], label="terms")
    hits = join_checked(postings.select("word", "page_id", "frequency"), known, ["word"], label="known")
    sized = hits.join(lengths.select("page_id", "length"), "page_id", "left").crossJoin(F.broadcast(stats.select("avgdl")))
    tf, avgdl = F.col("frequency"), F.col("avgdl")
    length = F.coalesce(F.col("length").cast("double"), avgdl)
    part = F.col("idf") * F.col("n") * (tf * (K1 + 1)) / (tf + K1 * (1 - B) + K1 * B / avgdl * length)
    return sized.groupBy("query_id", "page_id").agg(F.sum(part).alias("base"), F.min("pos").alias("first_pos"))


def _weight(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(UNKNOWN_WEIGHT))


def _has_word(clean: str, word: Column) -> Column:
    """Whether a normalised text has a word: both are runs of a-z and 0-9 between single spaces, so no word set is built."""
    space = F.lit(" ")
    return F.contains(F.concat(space, F.col(clean), space), F.concat(space, word, space))


def rank_features(scored: DataFrame, analyzed: DataFrame, prepared: DataFrame) -> DataFrame:
    """The candidates with their page and one column for each factor; pages that don't exist drop out.

    The candidates, ids and numbers, are the counted side: pages with their texts stay where they are read while that side is small.
    """
    found = join_checked(prepared, scored, ["page_id"], label="scored")
    found = join_checked(found, analyzed.select("query_id", "words", "terms", "clean", "what_is", "how"), ["query_id"], label="queries")
    found = found.where(~has_banned_marker(F.col("url")))
    source = F.col("source")
    in_title = F.size(F.filter("words", lambda w: _has_word("title_clean", w)))
    preferred = (F.col("what_is") & (source == "wikipedia")) | (F.col("how") & source.isin(*HOW_SOURCES))
    factors = {
        "f_source": 0.7 + 0.3 * _weight(source),
        "f_what_wiki": F.when(F.col("what_is") & (source == "wikipedia"), 1.5),
        "f_what_qa": F.when(F.col("what_is") & source.isin(*HOW_SOURCES), 0.8),
        "f_title_miss": F.when(in_title == 0, 0.95),
        "f_preferred": F.when(preferred, 1.3),
        "f_other": F.when(source == "other", 0.7),
        "f_authority": F.when(F.col("pagerank") > 0, 1 + 0.15 * F.least("pagerank", F.lit(1.0))),
        "f_title_match": F.when(in_title > 0, 1 + 0.2 * in_title),
        "f_phrase": F.when(F.contains(F.col("title_clean"), F.col("clean")), 1.5).when(F.contains(F.col("content_clean"), F.col("clean")), 1.2),
        "f_coverage": F.when(F.forall("terms", lambda w: _has_word("content_clean", w)), 1.2),
        "f_url": F.when(F.exists("terms", lambda w: F.contains(F.col("clean_url"), w)), 1.1),
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(1.0)).alias(k) for k, c in factors.items()])


def final_scores(features: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Base times all factors, in order; below ``least`` a candidate drops out."""
    return features.withColumn("score", reduce(lambda s, f: s * F.col(f), FACTORS, F.col("base"))).where(F.col("score") >= least)


def drop_duplicate_urls(scored: DataFrame) -> DataFrame:
    """Of the candidates with the same canonical URL, the first in candidate order stays, not the best."""
    first = Window.partitionBy("query_id", "clean_url").orderBy("first_pos", "page_id")
    return scored.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def search(queries: DataFrame, postings: DataFrame, idf: DataFrame, prepared: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, page_id, first_pos, score, url: all results of all queries, unordered.

    Texts are dropped as soon as the factors are known, so what is grouped and ordered from there on is a few numbers a row; ``with_snippets``
    looks the texts of chosen rows up again.  A query without tokens, with unknown words only or without pages gives no row.
    """
    analyzed = analyze_queries(queries)
    scored = bm25(query_terms(analyzed), postings, idf, prepared, stats)
    light = final_scores(rank_features(scored, analyzed, prepared)).select("query_id", "page_id", "first_pos", "score", "clean_url")
    return drop_duplicate_urls(light).withColumnRenamed("clean_url", "url")


def with_snippets(results: DataFrame, queries: DataFrame, prepared: DataFrame) -> DataFrame:
    """The given results (of ``search``, usually the first few of each query) with title and snippet."""
    texts = join_checked(prepared.select("page_id", "title", "content"), results, ["page_id"], label="results")
    words = analyze_queries(queries).select("query_id", "words")
    return join_checked(texts, words, ["query_id"], label="queries").withColumn("snippet", snippet(F.col("content"), F.col("words"))).drop("content", "words")


def top_k(results: DataFrame, k: int) -> DataFrame:
    """query_id, rank, ... of the first ``k`` results of each query; tasks keep only their own first ``k`` before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_pos", "page_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page_of(results: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
    """One page of a single query's results, in order."""
    return results.orderBy(F.desc("score"), "first_pos", "page_id").offset((page - 1) * limit).limit(limit)


def page_count(total: Column, limit: int = 10) -> Column:
    """Pages that so many results fill."""
    return F.ceil(total / limit).cast("long")


def query_vocabulary(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """query_id, word, known: whether the index has each distinct word of a query."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize_query(F.col("query")))).alias("word"))
    return terms.join(idf.select("word", F.lit(True).alias("_k")), "word", "left").select("query_id", "word", F.coalesce("_k", F.lit(False)).alias("known"))
