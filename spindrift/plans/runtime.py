"""Session, checkpointed tables and size-checked joins shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

_written: dict[str, SparkSession] = {}


def session(app: str = "spindrift", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/spindrift/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table read back.

    Cuts lineage like a reliable checkpoint does, but compressed and with column pruning; it outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete what was written under scratch paths (of one session, or all)."""
    for path, owner in list(_written.items()):
        if spark is None or owner is spark:
            _written.pop(path)
            try:
                jvm = owner._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(owner._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001 - the session may be gone
                pass


atexit.register(release)


def counted(df: DataFrame, label: str = "counted") -> tuple[DataFrame, int]:
    """Materialise a table and count it (from the Parquet footers)."""
    table = materialize(df, label)
    return table, table.count()


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, label: str = "small") -> DataFrame:
    """Join ``big`` with a side that is usually small: broadcast if its counted rows (at most ``rows``, or ``BROADCAST_ROWS``) allow it, else shuffled with hot keys split."""
    table, n = counted(small, label)
    if n <= (BROADCAST_ROWS if rows is None else rows):
        return big.join(F.broadcast(table), on, how)
    return join_split(big, table, on, how)


def hot_keys(df: DataFrame, on: list[str], share: float = 0.002) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: at most ``1/share`` of them, whatever the size of the input."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_total") * share).select(*on)


def join_split(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = 0.002, splits: int = 32) -> DataFrame:
    """Equi-join in which the rows of hot keys of ``left`` go to ``splits`` tasks each.

    ``right`` should have few rows a key: those of hot keys are copied ``splits`` times, which are at most
    ``splits / share`` keys.  Works for ``how`` inner, left, left_semi and left_anti.
    """
    # At most 1 / share keys, whatever the size of the input.
    mark = F.broadcast(materialize(hot_keys(left, on, share), "hot").withColumn("_hot", F.lit(True)))
    salted = left.join(mark, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(splits)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    copies = right.join(mark, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def distinct_pages(pages: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """One row a page id: rows are repeated whole, so any row of an id will do; the least by value is taken, for a defined result.

    Only ids are shuffled to find the repeated ones; texts stay where they are read, but for those of repeated ids.
    """
    keep = [c for c in columns if c != key]
    rows = pages.where(F.col(key).isNotNull())
    if not keep:
        return rows.select(key).distinct()
    repeated, n = counted(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), "repeated")
    rows = rows.select(key, *keep)
    if not n:
        return rows
    side = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    one = rows.join(side, key, "left_semi").groupBy(key).agg(F.min(F.struct(*keep)).alias("_row")).select(key, "_row.*")
    return rows.join(side, key, "left_anti").unionByName(one)


def source_name(c: Column) -> Column:
    """Lower case without surrounding white space; null means ``other``."""
    from spindrift.functions.text import fold_word

    return F.coalesce(fold_word(c), F.lit("other"))
