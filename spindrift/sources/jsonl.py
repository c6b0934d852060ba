"""Page records, one JSON object a line, with dense ids in file order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import doc_length, strip_ws
from spindrift.plans.runtime import materialize
from spindrift.schema import PAGE_RECORD


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, place: the trimmed, non-blank lines of all files, with their place in the file order."""
    raw = spark.read.text(path).select(strip_ws(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return raw.where("line <> ''")


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``kind``: object, other (JSON, but no object) or malformed."""
    value = F.try_parse_json("line")
    kind = F.when(value.isNull(), "malformed").when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "object").otherwise("other")
    return lines.withColumn("kind", kind)


def _dense_ids(df: DataFrame) -> DataFrame:
    """page_id 0, 1, ... in file order: counts of each block of lines give its first id, so no task sees all rows."""
    rows = materialize(df, "lines")
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    # One row a file block; what a single task orders is the list of blocks, not of lines.
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("file", "block")) - F.col("_n")).select("file", "block", "_first")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    return rows.withColumn("_k", inside).join(first, ["file", "block"]).withColumn("page_id", F.col("_first") + F.col("_k") - 1).drop("_first", "_k")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, title, text, source, links of every JSON object; missing or null fields take their defaults.

    Blank lines, malformed lines and JSON that is no object take no id (``rejected_lines`` lists them).
    """
    objects = classify(read_lines(spark, path)).where("kind = 'object'").drop("kind")
    parsed = _dense_ids(objects).withColumn("_r", F.from_json("line", PAGE_RECORD))
    text = {c: F.coalesce(F.col(f"_r.{c}"), F.lit(d)).alias(c) for c, d in (("url", ""), ("title", ""), ("text", ""), ("source", "other"))}
    links = F.coalesce(F.col("_r.links"), F.array().cast("array<string>")).alias("links")
    return parsed.select("page_id", *text.values(), links)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, kind of the lines that gave no page."""
    return classify(read_lines(spark, path)).where("kind <> 'object'").select("line", "kind")


def pages_table(records: DataFrame) -> DataFrame:
    """Records as the ``pages`` table: length in white-space pieces; views, date and rank take their defaults (a reload resets the rank)."""
    return records.select(
        F.col("page_id").alias("id"), "url", "title", F.col("text").alias("content"), doc_length(F.col("text")).alias("length"), "source",
        F.lit(0).cast("long").alias("views"), F.lit(None).cast("string").alias("published_date"), F.lit(0.0).alias("pagerank"),
    )


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append (or overwrite) records as JSON lines; non-ASCII text stays as it is."""
    records.write.mode(mode).json(path, ignoreNullFields=False)


def write_json_array(records: DataFrame, path: str) -> None:
    """Records in the oldest format: each part file is one JSON array, two spaces deep; ``read_json_array`` reads them all.

    A record is a text of its own, so no array is put together in memory; a part without records is an empty array.
    """
    text = F.regexp_replace(F.to_json(F.struct(*records.columns), {"pretty": "true", "ignoreNullFields": "false"}), "(?m)^", "  ")

    def bracket(parts):
        held = ["["]
        for pdf in parts:
            for x in pdf["value"]:
                yield pd.DataFrame({"value": held})
                held = [x + ","]
        yield pd.DataFrame({"value": ["[]"] if held == ["["] else [held[0][:-1], "]"]})

    records.select(text.alias("value")).mapInPandas(bracket, "value string").write.mode("overwrite").text(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of the oldest format, one JSON array a file."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<{PAGE_RECORD.simpleString()}>")).alias("_r"))
    return rows.select("_r.*")
