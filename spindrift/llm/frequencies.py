"""Frequencies of every term and n-gram: suffix sorting with a stack of prefix counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold_word, raw_tokens
from spindrift.operators.postings import valid_postings
from spindrift.plans.runtime import BROADCAST_ROWS, counted, join_split, materialize

#: A hot first term is spread so that a task gets about this many of its suffixes.
ROWS_A_TASK = 500_000


def text_suffixes(docs: DataFrame, tokens: str, record: str, longest: int) -> DataFrame:
    """suffix, record, weight: the suffixes of each record's tokens, cut to ``longest`` terms, equal ones of a record counted once with their number."""
    cut = F.expr(f"transform(sequence(1, size(`{tokens}`)), i -> slice(`{tokens}`, i, {int(longest)}))")
    rows = docs.where(F.size(tokens) > 0).select(F.explode(cut).alias("suffix"), F.col(record).alias("record"))
    return rows.groupBy("suffix", "record").agg(F.count(F.lit(1)).alias("weight"))


def _stack_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes arrive in reverse lexicographic order; a stack holds one (term, total, records) for each prefix that is open."""
    stack: list[list] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            term, total, records = stack[-1]
            out.append(([x[0] for x in stack], total, len(records)))
            stack.pop()
            if stack:
                stack[-1][1] += total
                if len(records) > len(stack[-1][2]):
                    stack[-1][2], records = records, stack[-1][2]
                stack[-1][2].update(records)

    def frame() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["ngram", "total", "n_records"])
        out.clear()
        return rows

    for pdf in parts:
        for suffix, record, weight in zip(pdf["suffix"], pdf["record"].tolist(), pdf["weight"].tolist()):
            same = 0
            for open_, term in zip(stack, suffix):
                if open_[0] != term:
                    break
                same += 1
            close(same)
            for term in suffix[same:]:
                stack.append([term, 0, set()])
            stack[-1][1] += weight
            stack[-1][2].add(record)
        if out:
            yield frame()
    close(0)
    if out:
        yield frame()


def suffix_counts(suffixes: DataFrame, partitions: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """ngram, total, n_records of every n-gram that is a prefix of a suffix.

    ``suffixes`` has suffix (array of terms), record and weight; a suffix of a record should stand once.  Rows are
    routed by the first term, so all prefixes of a suffix are counted where it is; a first term with more than
    ``ROWS_A_TASK`` rows is spread by the record's hash over as many tasks as its rows need.  Records of different
    tasks are then different ones, and their partial counts add up exactly.  Each task sorts its rows and streams
    them over the stack; it never holds more than the record sets of one open path.

    Rows with a null or empty suffix or a null record are left out; ties don't arise; no row gives no row.
    """
    rows = suffixes.where("suffix is not null and size(suffix) > 0 and record is not null").withColumn("_first", F.element_at("suffix", 1))
    # At most (rows / ROWS_A_TASK) first terms can be hot; the list is counted by its construction.
    heads = rows.groupBy("_first").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_A_TASK)
    hot, n_hot = counted(heads.select("_first", F.ceil(F.col("_n") / ROWS_A_TASK).cast("int").alias("_split")), "hot")
    if not n_hot:
        spread = rows.withColumn("_split", F.lit(None).cast("int"))
    elif n_hot <= broadcast_rows:
        spread = rows.join(F.broadcast(hot), "_first", "left")
    else:
        spread = join_split(rows, hot, ["_first"], "left")
    keyed = spread.withColumn("_salt", F.pmod(F.xxhash64("record"), F.coalesce("_split", F.lit(1)).cast("long")))
    routed = keyed.repartition(*([partitions] if partitions else []), "_first", "_salt").sortWithinPartitions(F.col("suffix").desc()).select("suffix", "record", "weight")
    partial = routed.mapInPandas(_stack_counts, "ngram array<string>, total long, n_records long")
    return partial.groupBy("ngram").agg(F.sum("total").alias("total"), F.sum("n_records").alias("n_records"))


def text_ngrams(docs: DataFrame, record: str, text: str, longest: int = 3, least_records: int = 3, most_share: float = 0.5) -> DataFrame:
    """ngram (terms joined by spaces), n, total, n_records, mark: every sequence of up to ``longest`` terms of the texts.

    Terms are runs of a-z and 0-9 in lower case.  ``mark`` is ``rare`` below ``least_records`` records, ``common`` above
    ``most_share`` of all records with a term, else null.  Null records and texts without terms don't count; rows of one record count as one.
    """
    terms = docs.where(F.col(record).isNotNull()).select(F.col(record).alias("_record"), raw_tokens(F.col(text)).alias("_terms")).where(F.size("_terms") > 0)
    counts = suffix_counts(text_suffixes(terms, "_terms", "_record", longest))
    n_records = terms.agg(F.count_distinct("_record").alias("_all"))
    mark = F.when(F.col("n_records") < least_records, "rare").when(F.col("n_records") > most_share * F.col("_all"), "common")
    return counts.crossJoin(F.broadcast(n_records)).select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").cast("long").alias("n"), "total", "n_records", mark.alias("mark"))


def word_counts(index: DataFrame, pages: DataFrame, idf: DataFrame) -> DataFrame:
    """word, total, n_pages, mark: every word of valid index rows or of ``idf`` (0 pages if only there).

    ``mark`` is ``rare`` below 3 pages, ``common`` above half of the pages with valid rows, else null.  Null and blank
    words are none; a weight may be null.
    """
    rows = materialize(valid_postings(index, pages), "postings")
    counts = suffix_counts(rows.select(F.array("word").alias("suffix"), F.col("page_id").alias("record"), F.col("frequency").alias("weight")))
    counts = counts.select(F.element_at("ngram", 1).alias("word"), "total", F.col("n_records").alias("n_pages"))
    listed = idf.select(fold_word(F.col("word")).alias("word")).where("word <> ''").distinct()
    n_pages = rows.select("page_id").distinct().agg(F.count(F.lit(1)).alias("_all"))
    every = counts.join(listed, "word", "full").na.fill(0, ["total", "n_pages"]).crossJoin(F.broadcast(n_pages))
    mark = F.when(F.col("n_pages") < 3, "rare").when(F.col("n_pages") * 2 > F.col("_all"), "common")
    return every.select("word", "total", "n_pages", mark.alias("mark"))
