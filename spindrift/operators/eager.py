"""Per-key results over a join without the weight of hot keys: eager aggregation.

Both inputs are reduced to one compact state for each join key (and grouping key) before they meet; the join moves
states instead of rows; counts are then multiplied and sums scaled by the other side's count, and the states are
rolled up to the grouping keys with map-side combining.  No task ever sees the rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.plans.runtime import join_checked


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str],
    sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    best: dict[str, Column] | None = None,
    unique_right: bool = False,
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY by``, aggregated before the join.

    ``by`` are columns of ``left``.  Result: ``by``, ``n_rows`` (rows of the join), one column for each of ``sums``
    (an expression of left), of ``right_sums`` (of right) and of ``best`` (a struct of left columns, of which the
    greatest is kept).  With ``unique_right`` every key of right counts once however often it stands there.

    Nulls in ``on`` join nothing; null in ``by`` is a group of its own; null in a summed expression counts 0 rows
    towards the sum (a sum over nothing else is null); an empty side gives no row; other columns are ignored.
    """
    sums, right_sums, best = sums or {}, right_sums or {}, best or {}
    l_state = left.where(F.col(on).isNotNull()).groupBy(*dict.fromkeys([on, *by])).agg(
        F.count(F.lit(1)).alias("_nl"), *[F.sum(e).alias(f"_sl_{k}") for k, e in sums.items()], *[F.max(e).alias(f"_best_{k}") for k, e in best.items()]
    )
    r_state = right.where(F.col(on).isNotNull()).groupBy(on).agg(
        (F.lit(1).cast("long") if unique_right else F.count(F.lit(1))).alias("_nr"), *[F.sum(e).alias(f"_sr_{k}") for k, e in right_sums.items()]
    )
    met = join_checked(l_state, r_state, [on], label="eager")
    return met.groupBy(*by).agg(
        F.sum(F.col("_nl") * F.col("_nr")).alias("n_rows"),
        *[F.sum(F.col(f"_sl_{k}") * F.col("_nr")).alias(k) for k in sums],
        *[F.sum(F.col(f"_sr_{k}") * F.col("_nl")).alias(k) for k in right_sums],
        *[F.max(f"_best_{k}").alias(k) for k in best],
    )
