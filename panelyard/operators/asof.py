"""Leakage-safe aggregates: everything a target may use lies before it, by period and by time.

history has one row per entity and event, with a period number and an event time. targets have a period and, where
they need it, a deadline. Per-entity work shuffles by entity once; group-level priors aggregate history to
(group, period, time) first, so that the range join meets few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expressions import RECENCY_WEIGHTS, strict_sum


def agg_entity_period(history: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], appeared: Column, strict: bool = False) -> DataFrame:
    """Rows, appearances and sums per entity and period; strict sums are null where a value is."""
    add = strict_sum if strict else F.sum
    return history.groupBy(*entity, period).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(appeared).alias("appearances"), *[add(F.col(m)).alias(m) for m in measures]
    )


def feat_prior(periods: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], target: int) -> DataFrame:
    """Totals, and averages of period sums, over all periods before target."""
    return periods.where(F.col(period) < target).groupBy(*entity).agg(
        F.count(F.lit(1)).alias("periods"), F.sum("rows").alias("rows"), F.sum("appearances").alias("appearances"),
        *[F.sum(m).alias(f"prior_{m}") for m in measures], *[F.avg(m).alias(f"prior_avg_{m}") for m in measures], F.max(period).alias("max_period"),
    )


def feat_previous_period(periods: DataFrame, period: str, target: int) -> DataFrame:
    return periods.where(F.col(period) == target - 1)


def feat_windows(periods: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], target: int, spans: Sequence[int] = (3, 5)) -> DataFrame:
    """Prior, previous and calendar windows in one pass: sums, averages of period sums and sample counts.

    A window spans period numbers, so that missing periods shrink the sample; sums are null without a sample.
    """
    p = F.col(period)
    cols = [F.count(F.lit(1)).alias("prior_periods"), F.max(p).alias("max_period")]
    for m in measures:
        cols += [F.sum(m).alias(f"prior_{m}"), F.avg(m).alias(f"prior_avg_{m}"), F.sum(F.when(p == target - 1, F.col(m))).alias(f"previous_{m}")]
    for k in spans:
        inside = p >= target - k
        cols.append(F.count_if(inside).alias(f"last{k}_periods"))
        for m in measures:
            cols += [F.sum(F.when(inside, F.col(m))).alias(f"last{k}_{m}"), F.avg(F.when(inside, F.col(m))).alias(f"last{k}_avg_{m}")]
    return periods.where(p < target).groupBy(*entity).agg(*cols)


def feat_rolling_all(periods: DataFrame, entity: Sequence[str], period: str, measures: Sequence[str], k: int) -> DataFrame:
    """The same calendar window for every period as its own target: a range frame over period numbers, current one excluded."""
    w = Window.partitionBy(*entity).orderBy(period).rangeBetween(-k, -1)
    return periods.select(*entity, period, F.count(F.lit(1)).over(w).alias(f"last{k}_periods"), *[F.sum(m).over(w).alias(f"last{k}_{m}") for m in measures])


def join_asof_range(targets: DataFrame, history: DataFrame, keys: Sequence[str], period: str, time: str, target: str, deadline: str, back: int | None = None) -> DataFrame:
    """Each target's own history: the entity's rows of earlier periods, back periods at most, and before the deadline."""
    h = history.alias("h")
    on = [F.col(f"t.{k}") == F.col(f"h.{k}") for k in keys]
    on += [F.col(f"h.{period}") < F.col(f"t.{target}"), F.col(f"h.{time}") < F.col(f"t.{deadline}")]
    if back is not None:
        on.append(F.col(f"h.{period}") >= F.col(f"t.{target}") - back)
    rest = [F.col(f"h.{c}") for c in history.columns if c not in keys]
    return targets.alias("t").join(h, on).select(F.col("t.*"), *rest)


def join_group_history(targets: DataFrame, history: DataFrame, group: str, period: str, time: str, target: str, deadline: str, measures: Mapping[str, Column]) -> DataFrame:
    """Sums of the group's history before each target; history is summed to (group, period, time) before it is joined."""
    summed = history.groupBy(group, period, time).agg(*[c.alias(n) for n, c in measures.items()])
    joined = targets.alias("t").join(
        summed.alias("h"), (F.col(f"t.{group}") == F.col(f"h.{group}")) & (F.col(f"h.{period}") < F.col(f"t.{target}")) & (F.col(f"h.{time}") < F.col(f"t.{deadline}")), "left"
    )
    return joined.groupBy(*[F.col(f"t.{c}") for c in targets.columns]).agg(*[F.sum(f"h.{n}").alias(n) for n in measures])


def group_rate_sums(x: str, minutes: str) -> dict[str, Column]:
    """Numerator and minutes of a group rate, over rows where x is known."""
    return {f"{x}_sum": F.sum(x), f"{x}_minutes": F.sum(F.when(F.col(x).isNotNull(), F.col(minutes)))}


def weighted_recency_mean(lag: Column, x: Column, weights: Mapping[int, float] = RECENCY_WEIGHTS) -> Column:
    """Mean of x by lag weights, renormalised over the lags observed; an aggregate."""
    w = F.lit(None).cast("double")
    for k, v in weights.items():
        w = F.when(lag == k, F.lit(v)).otherwise(w)
    known = F.when(x.isNotNull(), w)
    return F.try_divide(F.sum(x * w), F.nullif(F.sum(known), F.lit(0.0)))


def last_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each partition in the given order, which should end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= k)
