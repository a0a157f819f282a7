"""Forecast metrics, correlations and calibration tables. All are aggregates; constant input gives null, never NaN."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.ranks import average_rank, spearman_by_group, top_n_lists, top_n_overlap  # noqa: F401

#: Lower edges of calibration bins; a forecast below the first is in none.
BIN_EDGES = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0)


def forecast_metrics(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, pairs, coverage, MAE, RMSE, bias, means and totals over the rows where both values are known."""
    pair = F.col(predicted).isNotNull() & F.col(actual).isNotNull()
    e = F.when(pair, F.col(predicted) - F.col(actual))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count(e).alias("pairs"),
        F.count_if(F.col(predicted).isNull()).alias("missing_predictions"),
        F.count_if(F.col(actual).isNull()).alias("missing_actuals"),
        F.try_divide(F.count(e) * 100.0, F.count(F.lit(1))).alias("coverage_pct"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.avg(F.when(pair, F.col(predicted))).alias("mean_predicted"),
        F.avg(F.when(pair, F.col(actual))).alias("mean_actual"),
        F.sum(F.when(pair, F.col(predicted))).alias("total_predicted"),
        F.sum(F.when(pair, F.col(actual))).alias("total_actual"),
    )


def scoped(df: DataFrame, scopes: Mapping[str, Column]) -> DataFrame:
    """A row per scope that applies: scope and group. One pass for all metric tables; null groups fall out."""
    rows = F.array(*[F.struct(F.lit(k).alias("scope"), v.cast("string").alias("group")) for k, v in scopes.items()])
    return df.withColumn("_s", F.explode(rows)).select("*", "_s.*").drop("_s").where("`group` is not null")


def metrics_by_scope(df: DataFrame, predicted: str, actual: str, scopes: Mapping[str, Column]) -> DataFrame:
    return forecast_metrics(scoped(df, scopes), predicted, actual, ["scope", "group"])


def pearson_by_group(df: DataFrame, x: str, y: str, by: Sequence[str], name: str = "pearson") -> DataFrame:
    """Pearson correlation of known pairs; null for fewer than two or where a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    value = F.when((F.count(F.lit(1)) > 1) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.try_divide(F.covar_pop(a, b), spread))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), value.alias(name))


def calibration_bins(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = (), edges: Sequence[float] = BIN_EDGES) -> DataFrame:
    """Fixed bins with counts, means and bias; empty bins stay, with a count of 0."""
    p = F.col(predicted)
    bin_no = F.lit(-1)
    for i, e in enumerate(edges):
        bin_no = F.when(p >= e, i).otherwise(bin_no)
    known = df.where(p.isNotNull() & F.col(actual).isNotNull()).withColumn("bin", bin_no)
    found = known.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.avg(p - F.col(actual)).alias("bias"), F.avg(F.abs(p - F.col(actual))).alias("mae"), F.sqrt(F.avg(F.pow(p - F.col(actual), 2))).alias("rmse"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    return spine.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
