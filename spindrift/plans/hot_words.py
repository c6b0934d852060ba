"""Per-word results of the index whose few hottest words hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.eager import eager_join_aggregate
from spindrift.operators.postings import clean_rows, clean_weights, latest, valid_postings
from spindrift.plans.runtime import materialize


def word_summary(index: DataFrame, pages: DataFrame) -> DataFrame:
    """word, n_pages, total, best (frequency, -page_id): each word's valid rows in one compact row."""
    ids = pages.where("id is not null").select(F.col("id").alias("page_id"))
    return eager_join_aggregate(
        latest(clean_rows(index)), ids, on="page_id", by=["word"], unique_right=True,
        sums={"total": F.col("frequency")}, best={"best": F.struct("frequency", (-F.col("page_id")).alias("neg_page"))},
    ).withColumnRenamed("n_rows", "n_pages")


def leading_pages(index: DataFrame, pages: DataFrame, share: float = 0.01) -> DataFrame:
    """word, page_id: of each word with at least ``share`` of all valid rows, the page where it is most frequent (tie: least id)."""
    words = word_summary(index, pages)
    words = materialize(words, "words")  # one row a word; read twice
    all_rows = words.agg(F.sum("n_pages").alias("_all"))
    return words.crossJoin(F.broadcast(all_rows)).where(F.col("n_pages") >= F.col("_all") * share).select("word", (-F.col("best.neg_page")).alias("page_id"))


def weighted_totals(index: DataFrame, pages: DataFrame, idf: DataFrame) -> DataFrame:
    """word, n_rows, total, weight: the join of valid rows and weights on the word, per word."""
    out = eager_join_aggregate(valid_postings(index, pages), clean_weights(idf), on="word", by=["word"], sums={"total": F.col("frequency")}, right_sums={"weight": F.col("idf")})
    return out.select("word", "n_rows", "total", F.round("weight", 4).alias("weight"))
