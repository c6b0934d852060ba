"""Inverted index: term frequencies, posting lists, weights and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import STOP_WORDS, raw_tokens


def term_frequency(pages: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """word, page_id, frequency of the tokens of ``content`` (stop words left out after the split, so no per-token list search)."""
    tokens = pages.select(F.col("id").alias("page_id"), F.explode(raw_tokens(F.col("content"))).alias("word"))
    return tokens.where(~F.col("word").isin(*stop)).groupBy("word", "page_id").agg(F.count(F.lit(1)).cast("int").alias("frequency"))


def posting_lists(postings: DataFrame, block: int = 65_536) -> DataFrame:
    """word, block, postings: each word's (page_id, frequency) pairs by page, in blocks of ``block`` page ids.

    An export format; the engine works on rows.  A block holds at most as many pairs as it has ids, so the list of a word that
    every page has is spread over as many rows and tasks as it needs.  A word's list is its blocks, one after the other.
    """
    keyed = postings.withColumn("block", F.floor(F.col("page_id") / block).cast("long"))
    return keyed.groupBy("word", "block").agg(F.sort_array(F.collect_list(F.struct("page_id", "frequency"))).alias("postings"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def inverse_document_frequency(postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """word, df, idf = ln(N / (1 + df)); may be 0 or negative.  ``n_docs`` has one row: n_docs, empty texts included."""
    return document_frequency(postings).crossJoin(F.broadcast(n_docs.select("n_docs"))).select("word", "df", F.log(F.col("n_docs") / (F.col("df") + 1)).alias("idf"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """n_docs, avgdl: pages (empty ones included) and their mean length; 1.0 if that is 0 or there are none."""
    mean = F.avg("length")
    return pages.agg(F.count(F.lit(1)).alias("n_docs"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avgdl"))


def index_totals(postings: DataFrame) -> DataFrame:
    """n_postings, n_terms, n_tokens of an index."""
    words = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("frequency").alias("f"))
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings"), F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_tokens"))


def lookup(postings: DataFrame, words: list[str]) -> DataFrame:
    """Rows of the given words; the list reaches the scan as a pushed filter."""
    return postings.where(F.col("word").isin(*words))
