"""One ranking from several scores on different scales: a random walk over ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.plans.runtime import BROADCAST_ROWS, join_checked, materialize, source_name

#: Groups up to this many items are solved whole in one task, many at once; larger ones by the distributed walk.
GROUP_ROWS = 20_000


def walk(values: np.ndarray, valid: np.ndarray, damping: float = 0.85, tol: float = 1e-10, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Positions and stationary masses for a batch of groups.

    ``values`` is (groups, items, scores), NaN where a score is null; ``valid`` (groups, items) marks real items.
    An item's position under a score is 1 + the number of its group's items with a higher value (null below all).
    The walk picks a score at random, then jumps to any of the items above, or stays if there are none; by sorted
    prefix sums an iteration costs one pass per score.
    """
    g, m, k = values.shape
    v = np.where(np.isnan(values), -np.inf, values)
    n = valid.sum(axis=1)
    pos = np.zeros((g, m, k), np.int64)
    order = np.empty((k, g, m), np.int64)
    below = np.empty((k, g, m), np.int64)  # how many items, in ascending order, are strictly lower
    for s in range(k):
        key = np.where(valid, v[:, :, s], np.inf)
        # padding sorts behind every item, real +inf values included
        o = np.lexsort((key, ~valid), axis=1)
        x = np.take_along_axis(key, o, axis=1)
        first = np.ones((g, m), bool)
        first[:, 1:] = x[:, 1:] != x[:, :-1]
        padded = np.flatnonzero(n < m)
        first[padded, n[padded]] = True  # padding is no tie of the last item
        start = np.maximum.accumulate(np.where(first, np.arange(m), 0), axis=1)
        last = np.ones((g, m), bool)
        last[:, :-1] = first[:, 1:]
        end = np.minimum.accumulate(np.where(last, np.arange(m), m)[:, ::-1], axis=1)[:, ::-1]
        higher = n[:, None] - 1 - end
        order[s] = o
        below[s] = start
        np.put_along_axis(pos[:, :, s], o, higher + 1, axis=1)
    pi = np.where(valid, 1.0 / np.maximum(n, 1)[:, None], 0.0)
    base = np.where(valid, (1 - damping) / np.maximum(n, 1)[:, None], 0.0)
    for _ in range(max_iter):
        new = np.zeros_like(pi)
        for s in range(k):
            h = pos[:, :, s] - 1
            out = np.where(h > 0, pi / np.maximum(h, 1), 0.0)
            sums = np.zeros((g, m + 1))
            np.cumsum(np.take_along_axis(out, order[s], axis=1), axis=1, out=sums[:, 1:])
            gained = np.empty_like(pi)
            np.put_along_axis(gained, order[s], np.take_along_axis(sums, below[s], axis=1), axis=1)
            new += gained + np.where(h == 0, pi, 0.0)
        new = np.where(valid, base + damping * new / k, 0.0)
        done = np.abs(new - pi).sum(axis=1).max(initial=0.0) <= tol
        pi = new
        if done:
            break
    return pos, pi


def _solve(pdf: pd.DataFrame, group: str, item: str, scores: list[str], damping: float) -> pd.DataFrame:
    codes, _ = pd.factorize(pdf[group])
    within = pdf.groupby(codes).cumcount().to_numpy()
    sizes = np.bincount(codes)
    out_pos = np.empty((len(pdf), len(scores)), np.int64)
    out_pi = np.empty(len(pdf))
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)  # groups of like size share a padded batch
    data = pdf[scores].to_numpy(float)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        step = max(1, 2_000_000 // (int(w) * max(1, len(scores))))
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            slot = np.full(len(sizes), -1)
            slot[part] = np.arange(len(part))
            rows = np.flatnonzero(slot[codes] >= 0)
            values = np.full((len(part), int(w), len(scores)), np.nan)
            valid = np.zeros((len(part), int(w)), bool)
            values[slot[codes[rows]], within[rows]] = data[rows]
            valid[slot[codes[rows]], within[rows]] = True
            pos, pi = walk(values, valid, damping)
            out_pos[rows] = pos[slot[codes[rows]], within[rows]]
            out_pi[rows] = pi[slot[codes[rows]], within[rows]]
    res = pd.DataFrame({group: pdf[group].to_numpy(), item: pdf[item].to_numpy()})
    for j, s in enumerate(scores):
        res[f"pos_{s}"] = out_pos[:, j]
    res["mass"] = out_pi
    return res


def _small_groups(rows: DataFrame, group: str, item: str, scores: list[str], damping: float) -> DataFrame:
    """Whole groups, streamed: rows arrive sorted by group, and the open group is carried over to the next batch."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            open_ = pdf[group] == pdf[group].iloc[-1]
            rest = pdf[open_]
            if not open_.all():
                yield _solve(pdf[~open_].reset_index(drop=True), group, item, scores, damping)
        if rest is not None and len(rest):
            yield _solve(rest.reset_index(drop=True), group, item, scores, damping)

    kinds = dict(rows.dtypes)
    schema = f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, " + "".join(f"pos_{s} long, " for s in scores) + "mass double"
    return rows.repartition(group).sortWithinPartitions(group).mapInPandas(solve, schema)


def _ahead(values: DataFrame, group: str, place: str, of: str, block: int) -> DataFrame:
    """Adds ``_ahead``: the sum of ``of`` over the rows of the group with a lower ``place`` (0, 1, ...), from sums over blocks of places."""
    rows = values.withColumn("_b", F.floor(F.col(place) / block))
    blocks = rows.groupBy(group, "_b").agg(F.sum(of).alias("_t"))
    blocks = blocks.select(group, "_b", (F.sum("_t").over(Window.partitionBy(group).orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy(group, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    met = join_checked(rows, blocks, [group, "_b"], label="blocks")
    return met.withColumn("_ahead", F.col("_before") + F.sum(of).over(inside) - F.col(of)).drop("_b", "_before")


def _distinct_values(base: DataFrame, group: str, score: str, block: int) -> DataFrame:
    """group, score, _v, pos: the distinct values of a score in each group in ascending order (_v = 0, 1, ...), and the position of the items that have it.

    Ties are one row, so a value that a third of the group has is no work for the task that orders it.
    """
    values = base.groupBy(group, score).agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialize(values.repartitionByRange(F.col(group), F.col(score)).withColumn("_p", F.spark_partition_id()), "range")
    per = ranged.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_k"))
    per = per.select(group, "_p", (F.sum("_k").over(Window.partitionBy(group).orderBy("_p")) - F.col("_k")).alias("_off"))  # one row a range
    placed = join_checked(ranged, per, [group, "_p"], label="ranges")
    placed = placed.withColumn("_v", F.col("_off") + F.row_number().over(Window.partitionBy(group, "_p").orderBy(score)) - 1)
    placed = materialize(placed.select(group, score, "_v", "_c"), "values")
    total = placed.groupBy(group).agg(F.sum("_c").alias("_n"))
    counts = join_checked(_ahead(placed, group, "_v", "_c", block), total, [group], label="totals")
    return counts.select(group, score, "_v", (F.col("_n") - F.col("_ahead") - F.col("_c") + 1).alias("pos"))


def _large_groups(
    rows: DataFrame, group: str, item: str, scores: list[str], damping: float, tol: float = 1e-10, max_iter: int = 200, block: int = 50_000, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The same walk for groups too large for a task: masses are summed by distinct value, and prefix sums run over the values in blocks.

    An item above is one with a higher value, so what an item gains from a score depends on its value only.
    """
    base = materialize(rows.select(group, item, *[F.coalesce(F.col(s), F.lit(float("-inf"))).alias(s) for s in scores]), "walk")
    total = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    state = join_checked(base, total, [group], label="totals").withColumn("mass", F.lit(1.0) / F.col("_n"))
    for s in scores:
        known = _distinct_values(base, group, s, block).select(group, s, F.col("_v").alias(f"_v_{s}"), F.col("pos").alias(f"pos_{s}"))
        state = join_checked(state, known, [group, s], rows=broadcast_rows, label="positions").drop(s)
    state = materialize(state, "walk")
    keep = [c for c in state.columns if c != "mass"]
    for _ in range(max_iter):
        new = state.withColumn("_g", F.lit(0.0))
        for s in scores:
            above = F.col(f"pos_{s}") - 1
            sums = state.groupBy(group, F.col(f"_v_{s}")).agg(F.sum(F.when(above > 0, F.col("mass") / above).otherwise(0.0)).alias("_o"))
            gained = _ahead(sums, group, f"_v_{s}", "_o", block).select(group, f"_v_{s}", "_ahead")
            new = join_checked(new, gained, [group, f"_v_{s}"], rows=broadcast_rows, label="gained")
            new = new.withColumn("_g", F.col("_g") + F.col("_ahead") + F.when(above == 0, F.col("mass")).otherwise(0.0)).drop("_ahead")
        new = materialize(new.withColumn("_old", F.col("mass")).withColumn("mass", (1 - damping) / F.col("_n") + damping * F.col("_g") / len(scores)).select(*keep, "_old", "mass"), "walk")
        delta = new.groupBy(group).agg(F.sum(F.abs(F.col("mass") - F.col("_old"))).alias("d")).agg(F.max("d")).first()[0]
        state = new.select(*keep, "mass")
        if delta is None or delta <= tol:
            break
    return state.select(group, item, *[f"pos_{s}" for s in scores], "mass")


def rank_walk(rows: DataFrame, group: str, item: str, scores: list[str], damping: float = 0.85, group_rows: int = GROUP_ROWS) -> DataFrame:
    """group, item, pos_<score>..., mass: positions under every score and the item's stationary mass.

    Only the order of each score matters, so no scale dominates.  ``rows`` has one row an item of a group.  Null and
    NaN scores stand below every number; ties share a position; a group of one item has mass 1; rows with a null
    group or item are left out; an empty table gives no row; other columns are ignored.
    """
    cast = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores]
    rows = materialize(rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, *cast), "scores")
    large = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows).select(group), "large")
    if large.isEmpty():
        return _small_groups(rows, group, item, scores, damping)
    small = join_checked(rows, large, [group], "left_anti", label="large")
    big = join_checked(rows, large, [group], "left_semi", label="large")
    return _small_groups(small, group, item, scores, damping).unionByName(_large_groups(big, group, item, scores, damping))


SCORES = ["bm25", "pagerank", "trust", "views"]


def candidate_scores(candidates: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, page_id and the four scores of each candidate that has a page; repeated rows count once."""
    offered = candidates.where("query_id is not null and page_id is not null").groupBy("query_id", "page_id").agg(F.max("bm25").alias("bm25"))
    trust = sources.select(source_name(F.col("source")).alias("source"), "trust").groupBy("source").agg(F.max("trust").alias("trust"))
    info = pages.where("id is not null").groupBy("id").agg(F.max(F.struct("pagerank", "views", source_name(F.col("source")).alias("source"))).alias("_p"))
    info = info.select(F.col("id").alias("page_id"), "_p.*")
    known = join_checked(info, trust, ["source"], "left", label="trust").select("page_id", "pagerank", "trust", "views")
    return offered.join(known, "page_id")


def fused_order(candidates: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, page_id, pos_*, mass of every candidate."""
    return rank_walk(candidate_scores(candidates, pages, sources), "query_id", "page_id", SCORES)


def first_by_mass(fused: DataFrame) -> DataFrame:
    """query_id, page_id: the page with the greatest stationary mass (to 9 digits; tie: least id)."""
    return fused.groupBy("query_id").agg(F.min(F.struct((-F.round("mass", 9)).alias("neg"), "page_id")).alias("_b")).select("query_id", "_b.page_id")


def first_by_positions(fused: DataFrame) -> DataFrame:
    """query_id, page_id: the page with the least sum of the operator's positions (tie: least id)."""
    total = sum((F.col(f"pos_{s}") for s in SCORES[1:]), F.col(f"pos_{SCORES[0]}"))
    return fused.groupBy("query_id").agg(F.min(F.struct(total.alias("sum"), "page_id")).alias("_b")).select("query_id", "_b.page_id")
