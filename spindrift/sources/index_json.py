"""Exchange files of an index: one JSON object of posting lists, one of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _object(spark: SparkSession, path: str, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    parsed = F.from_json("value", f"map<string,{kind}>", {"mode": "FAILFAST"})
    return text.select(F.explode(parsed).alias("word", "value"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """word, page_id, frequency from ``{"word": [[page_id, frequency], ...]}``; an empty file gives no row, broken JSON fails."""
    pairs = _object(spark, path, "array<array<bigint>>").select("word", F.explode("value").alias("_p"))
    return pairs.select("word", F.col("_p")[0].alias("page_id"), F.col("_p")[1].cast("int").alias("frequency"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """word, idf from ``{"word": number}``."""
    return _object(spark, path, "double").select("word", F.col("value").alias("idf"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """word, page_id, frequency from tab-separated shard files."""
    return spark.read.csv(path, sep="\t", schema="word string, page_id long, frequency int", quote="")


def write_shards(postings: DataFrame, path: str, shards: int) -> None:
    """One folder a term shard, tab-separated, words in order inside."""
    from spindrift.functions.text import term_shard

    rows = postings.withColumn("shard", term_shard(F.col("word"), shards)).repartition("shard").sortWithinPartitions("shard", "word", "page_id")
    rows.select("shard", "word", "page_id", "frequency").write.partitionBy("shard").mode("overwrite").csv(path, sep="\t", quote="")


def _entries(df: DataFrame, value: str) -> DataFrame:
    """``"word":value`` entries, a text line each; joined by the caller's file concatenation into one object."""
    return df.select(F.concat(F.to_json(F.array("word")).substr(F.lit(2), F.length(F.to_json(F.array("word"))) - 2), F.lit(":"), F.col(value)).alias("value"))


def write_postings(lists: DataFrame, path: str) -> None:
    """Posting lists (word, block, postings) as entries of one JSON object, in parts; ``join_entries`` makes the object.

    A word's first block opens its list and its last one closes it; lines stand in the order of word and block over all parts.
    """
    pairs = F.to_json(F.transform("postings", lambda p: F.array(p["page_id"], p["frequency"].cast("long"))))
    bare = pairs.substr(F.lit(2), F.length(pairs) - 2)
    of_word = Window.partitionBy("word").orderBy("block")  # one row a block
    marked = lists.withColumn("_first", F.lag("block").over(of_word).isNull()).withColumn("_last", F.lead("block").over(of_word).isNull())
    name = F.to_json(F.array("word"))
    opened = F.concat(F.when(F.col("_first"), F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":["))).otherwise(""), bare, F.when(F.col("_last"), "]").otherwise(""))
    lines = marked.select("word", "block", opened.alias("value")).repartitionByRange("word", "block").sortWithinPartitions("word", "block")
    lines.select("value").write.mode("overwrite").text(path)


def write_weights(idf: DataFrame, path: str) -> None:
    _entries(idf.withColumn("_v", F.col("idf").cast("string")), "_v").write.mode("overwrite").text(path)


def join_entries(parts: str, target: str) -> None:
    """Stream the part files of a local folder into one JSON object file (``{}`` if there are none)."""
    from pathlib import Path

    with open(target, "w", encoding="utf-8") as out:
        out.write("{")
        first = True
        for part in sorted(Path(parts).glob("part-*")):
            with part.open(encoding="utf-8") as f:
                for line in f:
                    out.write(("" if first else ",") + line.rstrip("\n"))
                    first = False
        out.write("}")
