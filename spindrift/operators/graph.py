"""Link graph and PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import counted, materialize

# Damping, most iterations, and the L1 change at which the iteration stops.
DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 100, 1e-8
#: Graphs up to this size are solved by one task in arrays; larger ones by joins.
LOCAL_NODES, LOCAL_EDGES = 1_000_000, 4_000_000
#: Iterations that one Spark job runs before the change is looked at.
STEPS_A_JOB = 5


def resolve_links(records: DataFrame) -> DataFrame:
    """from_page, to_page: links whose target is exactly the URL of a page; of a URL with several pages the last one counts; self links stay."""
    targets = records.groupBy("url").agg(F.max("page_id").alias("to_page"))
    links = records.select(F.col("page_id").alias("from_page"), F.explode("links").alias("url")).distinct()
    return links.join(targets, "url").select("from_page", "to_page").distinct()


def known_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct edges between existing pages; self links stay."""
    ids = pages.where("id is not null").select("id").distinct()
    edges = links.select("from_page", "to_page").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_page"), "from_page", "left_semi").join(ids.withColumnRenamed("id", "to_page"), "to_page", "left_semi").select("from_page", "to_page")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_page").agg(F.count(F.lit(1)).alias("out_degree"))


def dangling_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    ids = pages.where("id is not null").select("id").distinct()
    return ids.join(edges.select(F.col("from_page").alias("id")), "id", "left_anti")


def _solve(damping: float, max_iterations: int, tolerance: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(parts)
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        nodes = np.sort(rows.loc[rows["to_page"].isna(), "from_page"].to_numpy())
        edges = rows[rows["to_page"].notna()]
        if not len(nodes):
            return
        src, dst = np.searchsorted(nodes, edges["from_page"].to_numpy()), np.searchsorted(nodes, edges["to_page"].to_numpy().astype(np.int64))
        n = len(nodes)
        degree = np.bincount(src, minlength=n)
        weight, dangling = 1.0 / degree[src] if len(src) else np.empty(0), degree == 0
        rank, used = np.full(n, 1.0 / n), 0
        for used in range(1, max_iterations + 1):
            new = (1 - damping) / n + damping * np.bincount(dst, rank[src] * weight, n) + damping * rank[dangling].sum() / n
            change = np.abs(new - rank).sum()
            rank = new
            if change <= tolerance:
                break
        yield pd.DataFrame({"page_id": nodes, "raw": rank, "iterations": used})

    return run


def _joined(nodes: DataFrame, edges: DataFrame, n: int, damping: float, max_iterations: int, tolerance: float) -> DataFrame:
    """Power iteration by joins: several steps a job, each one shuffle by the target page; the exact stopping step is kept."""
    weighted = materialize(edges.join(out_degree(edges), "from_page").select("from_page", "to_page", (1.0 / F.col("out_degree")).alias("w")), "edges")
    # A page without links out sends its rank to no page, but its mass is spread evenly.
    base = materialize(nodes.join(weighted.select(F.col("from_page").alias("page_id")).distinct().withColumn("_links", F.lit(True)), "page_id", "left").select("page_id", F.col("_links").isNull().alias("dangling")), "nodes")
    state = base.withColumn("r", F.lit(1.0 / n))
    done = 0
    while done < max_iterations:
        steps = min(STEPS_A_JOB, max_iterations - done)
        now, names = state.withColumnRenamed("r", "r0"), ["r0"]
        for k in range(1, steps + 1):
            old = f"r{k - 1}"
            mass = now.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col(old))), F.lit(0.0)).alias("_m"))
            sums = weighted.join(now.select(F.col("page_id").alias("from_page"), old), "from_page").groupBy(F.col("to_page").alias("page_id")).agg(F.sum(F.col(old) * F.col("w")).alias("_in"))
            new = (1 - damping) / n + damping * F.coalesce("_in", F.lit(0.0)) + damping * F.col("_m") / n
            now = now.join(sums, "page_id", "left").crossJoin(F.broadcast(mass)).withColumn(f"r{k}", new).drop("_in", "_m")
            names.append(f"r{k}")
        now = materialize(now, "ranks")
        changes = now.agg(*[F.sum(F.abs(F.col(b) - F.col(a))) for a, b in zip(names, names[1:])]).first()
        stop = next((k for k, x in enumerate(changes, 1) if x <= tolerance), None)
        last = stop or steps
        done += last
        state = now.select("page_id", "dangling", F.col(f"r{last}").alias("r"))
        if stop:
            break
    return state.select("page_id", F.col("r").alias("raw"), F.lit(done).alias("iterations"))


def pagerank(
    pages: DataFrame, links: DataFrame, damping: float = DAMPING, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
    local_nodes: int = LOCAL_NODES, local_edges: int = LOCAL_EDGES,
) -> DataFrame:
    """page_id, pagerank (greatest 1.0), raw (sums to 1), iterations.

    Links from or to unknown pages don't count, self links do; the mass of pages without links out is spread evenly.
    Without edges every page has 1.0; without pages there is no row.
    """
    nodes, n = counted(pages.where("id is not null").select(F.col("id").alias("page_id")).distinct(), "nodes")
    edges, m = counted(known_edges(links, pages), "edges")
    if n <= local_nodes and m <= local_edges:
        rows = nodes.select(F.col("page_id").alias("from_page"), F.lit(None).cast("long").alias("to_page")).unionByName(edges).coalesce(1)
        raw = materialize(rows.mapInPandas(_solve(damping, max_iterations, tolerance), "page_id long, raw double, iterations int"), "ranks")
    else:
        raw = _joined(nodes, edges, n, damping, max_iterations, tolerance)
    top = raw.agg(F.max("raw").alias("_top"))
    return raw.crossJoin(F.broadcast(top)).select("page_id", (F.col("raw") / F.col("_top")).alias("pagerank"), "raw", "iterations")


def pagerank_step(pages: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """page_id, rank after one step from the uniform vector."""
    nodes = pages.where("id is not null").select("id").distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    degree = out_degree(edges)
    sums = edges.join(degree, "from_page").groupBy(F.col("to_page").alias("id")).agg(F.sum(1.0 / F.col("out_degree")).alias("_in"))
    lost = dangling_pages(pages, edges).agg(F.count(F.lit(1)).alias("lost"))
    rows = nodes.join(sums, "id", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lost))
    return rows.select(F.col("id").alias("page_id"), ((1 - damping) / F.col("n") + damping * F.coalesce("_in", F.lit(0.0)) / F.col("n") + damping * F.col("lost") / F.col("n") / F.col("n")).alias("rank"))


def with_rank(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """Pages with their stored rank; a page without one has 0.0."""
    return pages.drop("pagerank").join(ranks.select(F.col("page_id").alias("id"), "pagerank"), "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
