"""Persisted index: versions of Parquet tables, switched by a manifest."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import term_shard
from spindrift.operators import graph, index, rank
from spindrift.schema import validate

SHARDS = 64
PATH_VARIABLE, SOURCE_VARIABLE = "SEARCH_DB_PATH", "SEARCH_DB_URL"


def index_path(path: str | None = None) -> str:
    """The index folder: the argument, else the environment's path (trimmed, ``~`` expanded), else ``data/index``."""
    named = (path or os.environ.get(PATH_VARIABLE, "")).strip()
    return os.path.expanduser(named) if named else "data/index"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over, so that a reader sees the old or the new one."""
    fs, p = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context.rename(p, target, overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    text = _read_text(spark, f"{path}/manifest.json")
    return json.loads(text)["version"] if text else None


@dataclass(frozen=True)
class IndexTables:
    pages: DataFrame
    postings: DataFrame
    idf: DataFrame
    stats: DataFrame
    links: DataFrame
    version: str
    shards: int


def write_index(pages: DataFrame, links: DataFrame, path: str, shards: int = SHARDS, strict: bool = True) -> str:
    """Build all tables of a new version and make it the current one; on any error the old version stays current."""
    spark = pages.sparkSession
    version = f"{time.time_ns():020d}"
    root = f"{path}/{version}"
    try:
        pages.write.parquet(f"{root}/source_pages")
        stored = spark.read.parquet(f"{root}/source_pages")
        if strict:
            validate(stored)
        edges = graph.known_edges(links, stored)
        edges.write.parquet(f"{root}/links")
        postings = index.term_frequency(stored).withColumn("shard", term_shard(F.col("word"), shards))
        postings.repartition("shard").sortWithinPartitions("shard", "word", "page_id").write.partitionBy("shard").parquet(f"{root}/postings")
        index.corpus_stats(stored).write.parquet(f"{root}/stats")
        stats = spark.read.parquet(f"{root}/stats")
        index.inverse_document_frequency(spark.read.parquet(f"{root}/postings"), stats).write.parquet(f"{root}/idf")
        write_ranks(spark, root)
        _write_text(spark, f"{path}/manifest.json", json.dumps({"version": version, "shards": shards}))
    except Exception:
        fs, p = _fs(spark, root)
        fs.delete(p, True)
        raise
    return version


def write_ranks(spark: SparkSession, root: str) -> None:
    """PageRank of a version, joined to the prepared pages that ranking reads (tables aren't updated in place)."""
    pages, edges = spark.read.parquet(f"{root}/source_pages"), spark.read.parquet(f"{root}/links")
    rank.prepare_pages(graph.with_rank(pages, graph.pagerank(pages, edges))).write.mode("overwrite").parquet(f"{root}/pages")


def open_index(spark: SparkSession, path: str) -> IndexTables:
    text = _read_text(spark, f"{path}/manifest.json")
    if not text:
        raise FileNotFoundError(f"no index at {path}: build one with write_index")
    m = json.loads(text)
    root = f"{path}/{m['version']}"
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    return IndexTables(read("pages"), read("postings"), read("idf"), read("stats"), read("links"), m["version"], m["shards"])


def ensure_index(spark: SparkSession, path: str | None = None, source: str | None = None) -> str:
    """The path of an index: if there is none, it is copied from ``source`` or the folder that ``SEARCH_DB_URL`` names.

    The manifest is copied last, so a copy that breaks off is no index; what it left is removed.
    """
    path = index_path(path)
    if current_version(spark, path) is not None:
        return path
    source = (source or os.environ.get(SOURCE_VARIABLE, "")).strip().rstrip("/")
    version = current_version(spark, source) if source else None
    if version is None:
        raise FileNotFoundError(f"no index at {path}" + (f" nor at {source}" if source else f"; name one to copy in {SOURCE_VARIABLE}"))
    (here, root), (there, data) = _fs(spark, f"{path}/{version}"), _fs(spark, f"{source}/{version}")
    try:
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(there, data, here, root, False, spark._jsc.hadoopConfiguration())
        _write_text(spark, f"{path}/manifest.json", _read_text(spark, f"{source}/manifest.json"))
    except Exception:
        here.delete(root, True)
        raise
    return path


def postings_of(tables: IndexTables, words: list[str]) -> DataFrame:
    """Posting rows of some words: only their shards are listed, and the words reach the scan as a filter."""
    import zlib

    shards = sorted({zlib.crc32(w.encode()) % tables.shards for w in words})
    return tables.postings.where(F.col("shard").isin(*shards) & F.col("word").isin(*words)) if words else tables.postings.limit(0)


def remove_old(spark: SparkSession, path: str) -> None:
    """Delete all versions but the current one."""
    now = current_version(spark, path)
    fs, p = _fs(spark, path)
    if now and fs.exists(p):
        for s in fs.listStatus(p):
            if s.isDirectory() and s.getPath().getName() != now:
                fs.delete(s.getPath(), True)
