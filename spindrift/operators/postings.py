"""Valid rows of an inverted index that was filled by several, partly late, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold_word
from spindrift.plans.runtime import distinct_pages


def clean_rows(index: DataFrame) -> DataFrame:
    """Rows with a word, a page and a positive frequency; the word in the form in which words are compared."""
    return (
        index.select(fold_word(F.col("word")).alias("word"), F.col("page_id").cast("long").alias("page_id"), "frequency", "indexed_at")
        .where("word <> '' and page_id is not null and frequency > 0")
    )


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of a word and page.  A null time is older than any; ties, which the data hold equal, go to the higher frequency."""
    newest = F.max(F.struct("indexed_at", "frequency"))
    return rows.groupBy("word", "page_id").agg(newest.alias("_r")).select("word", "page_id", F.col("_r.frequency").cast("long").alias("frequency"))


def valid_postings(index: DataFrame, pages: DataFrame) -> DataFrame:
    """word, page_id, frequency: one row for each word and page of ``pages``.

    Rows are reduced to the newest of a word and page before the join with the page ids, so what is shuffled is no
    larger than the result.  Null or blank words, null pages, pages that don't exist and frequencies that are null
    or below 1 give no row.
    """
    ids = distinct_pages(pages).select(F.col("id").alias("page_id"))
    return latest(clean_rows(index)).join(ids, "page_id", "left_semi")


def clean_weights(idf: DataFrame) -> DataFrame:
    """word, idf: one row a word; rows without a weight don't count; of several weights the highest does."""
    return idf.select(fold_word(F.col("word")).alias("word"), F.col("idf").cast("double").alias("idf")).where("word <> '' and idf is not null").groupBy("word").agg(F.max("idf").alias("idf"))
