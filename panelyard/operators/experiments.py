"""Candidate experiments: rows per candidate, common-pair comparison, gates, and calibration."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import ranks
from panelyard.operators.metrics import forecast_metrics
from panelyard.scratch import written

#: Bounds of opponent factors and the least matches behind one.
FACTOR_MIN, FACTOR_MAX, LEAST_MATCHES, ROLLING_MATCHES = 0.70, 1.30, 3, 6


def common_pairs(df: DataFrame, keys: Sequence[str], candidate: str, control: str, predicted: str, actual: str) -> DataFrame:
    """Each candidate's rows beside the control's where both and the actual are known: keys, candidate, predicted, control, actual."""
    known = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    base = known.where(F.col(candidate) == control).select(*keys, F.col(predicted).alias("control"))
    return known.where(F.col(candidate) != control).join(base, list(keys)).select(*keys, candidate, F.col(predicted).alias("predicted"), "control", F.col(actual).alias("actual"))


def common_pair_metrics(df: DataFrame, keys: Sequence[str], candidate: str, control: str, predicted: str, actual: str) -> DataFrame:
    """MAE and RMSE of candidate and control on the same keys, and the reductions in per cent."""
    pairs = common_pairs(df, keys, candidate, control, predicted, actual)
    a, b = F.col("predicted") - F.col("actual"), F.col("control") - F.col("actual")
    out = pairs.groupBy(candidate).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(a)).alias("mae"), F.avg(F.abs(b)).alias("control_mae"), F.sqrt(F.avg(a * a)).alias("rmse"), F.sqrt(F.avg(b * b)).alias("control_rmse"))
    fall = lambda m: F.try_divide((F.col(f"control_{m}") - F.col(m)) * 100.0, F.nullif(F.col(f"control_{m}"), F.lit(0.0)))
    return out.withColumns({"mae_reduction_pct": fall("mae"), "rmse_reduction_pct": fall("rmse")})


def gate_table(values: DataFrame, gates: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """A row per row of values and gate: gate, value, comparison, threshold, passed. A null value fails.

    gates: name -> (column, one of >= <= > <, threshold).
    """
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(op).alias("comparison"), F.lit(float(t)).alias("threshold")) for g, (c, op, t) in gates.items()])
    others = [c for c in values.columns if c not in {c for c, _, _ in gates.values()}]
    out = values.select(*others, F.explode(rows).alias("_g")).select(*others, "_g.*")
    v, t, op = F.col("value"), F.col("threshold"), F.col("comparison")
    passed = F.when(op == ">=", v >= t).when(op == "<=", v <= t).when(op == ">", v > t).when(op == "<", v < t)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def gate_selection(values: DataFrame, candidate: str, gates: Mapping[str, tuple[str, str, float]], order: Sequence[Column]) -> DataFrame:
    """values with qualifies and winner: of the candidates that pass every gate, the first in order, or none."""
    passed = gate_table(values.select(candidate, *{c for c, _, _ in gates.values()}), gates).groupBy(candidate).agg(F.bool_and("passed").alias("qualifies"))
    out = values.join(passed, candidate)
    place = F.row_number().over(Window.partitionBy("qualifies").orderBy(*order, candidate))  # a row per candidate
    return out.withColumn("winner", F.col("qualifies") & (place == 1))


def opponent_factor(rate: Column, league: Column, matches: Column) -> tuple[Column, Column, Column]:
    """Raw factor, factor in bounds (1.0 for too few matches) and the reason for a neutral one."""
    raw = F.try_divide(rate, F.nullif(league, F.lit(0.0)))
    few = matches < LEAST_MATCHES
    return raw, F.when(few, 1.0).when(raw.isNotNull(), F.least(F.lit(FACTOR_MAX), F.greatest(F.lit(FACTOR_MIN), raw))), F.when(few, "fewer_than_3_prior_matches")


def linear_calibration(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: n, slope, intercept by least squares; null slope for a constant predictor."""
    both = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    x, y = F.col(predicted).cast("double"), F.col(actual).cast("double")
    slope = F.when(F.max(x) > F.min(x), F.try_divide(F.covar_pop(x, y), F.var_pop(x)))
    return both.agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my")).select("n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def pooled_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """lower_x, upper_x, sum_y, weight of neighbours in order, pooled while one's mean lies above the next one's."""
    out: list[list] = []
    for lower, upper, sum_y, weight in rows.sort_values("lower_x")[["lower_x", "upper_x", "sum_y", "weight"]].itertuples(index=False):
        out.append([lower, upper, sum_y, weight])
        while len(out) > 1 and out[-2][2] / out[-2][3] > out[-1][2] / out[-1][3]:
            right = out.pop()
            out[-1][1:] = [right[1], out[-1][2] + right[2], out[-1][3] + right[3]]
    return pd.DataFrame(out, columns=["lower_x", "upper_x", "sum_y", "weight"]).astype({"weight": "int64"})


BLOCK = "part long, lower_x double, upper_x double, sum_y double, weight long"
#: So many neighbouring pieces are merged in a task.
FAN_IN = 16


def isotonic_blocks(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Blocks of an increasing least-squares fit: block (from 0), lower_x, upper_x, fitted_y, weight, from_x.

    Rows are summed by predicted value and pooled inside range partitions. A block that lies at or under every value that
    later pieces can pool to, and at or over those of earlier ones, is final; only the others meet, FAN_IN pieces a task, until
    one piece is left. Neighbours of equal mean stay two blocks. from_x is where the step begins: half-way from the block
    before, minus infinity for the first.
    """
    both = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(F.col(predicted).cast("double").alias("lower_x"))
    points = both.agg(F.sum(F.col(actual).cast("double")).alias("sum_y"), F.count(F.lit(1)).alias("weight"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # blocks so far: never more than the piece's own
        for batch in batches:
            kept = pooled_blocks(batch if kept is None else pd.concat([kept, batch]))
        if kept is not None:
            yield kept

    pieces = points.withColumn("upper_x", F.col("lower_x")).repartitionByRange(n_parts, "lower_x").sortWithinPartitions("lower_x").mapInPandas(pool, BLOCK.removeprefix("part long, "))
    open_ = written(pieces.withColumn("part", F.spark_partition_id().cast("bigint")), "blocks")
    final: list[DataFrame] = []
    while True:
        mean = F.col("sum_y") / F.col("weight")
        ends = open_.groupBy("part").agg(F.min(mean).alias("low"), F.max(mean).alias("high"))
        if len(ends.take(2)) < 2:
            final.append(open_)
            break
        order = Window.orderBy("part")  # a row per piece
        reach = ends.select("part", F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"), F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
        safe = F.coalesce(mean <= F.col("later"), F.lit(True)) & F.coalesce(mean >= F.col("earlier"), F.lit(True))
        marked = written(open_.join(reach, "part").withColumn("safe", safe).drop("later", "earlier"), "marked")
        final.append(marked.where("safe").drop("safe"))
        merge = lambda key, rows: pooled_blocks(rows).assign(part=key[0])[["part", "lower_x", "upper_x", "sum_y", "weight"]]
        open_ = written(marked.where("not safe").drop("safe").groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(merge, BLOCK), "blocks")
    blocks = ranks.row_numbers(reduce(DataFrame.unionByName, final), [], [F.col("lower_x")], "block").withColumn("block", (F.col("block") - 1).cast("bigint"))
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("upper_x").alias("_upper"))
    from_x = F.coalesce((F.col("_upper") + F.col("lower_x")) / 2.0, F.lit(float("-inf")))
    return written(blocks.join(before, "block", "left").select("block", "lower_x", "upper_x", (F.col("sum_y") / F.col("weight")).alias("fitted_y"), "weight", from_x.alias("from_x")), "isotonic")


def isotonic_step_apply(df: DataFrame, blocks: DataFrame, x: str, name: str = "calibrated") -> DataFrame:
    """df with the fitted value of the block that x falls into: right-continuous steps, constant beyond the ends.

    Distinct values and steps are put in one order; how many steps stand before a value is the number of its block.
    Null values stay null; without blocks all are.
    """
    values = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.lit(0).alias("step")).distinct()
    line = values.unionByName(blocks.select(F.col("from_x").alias("x"), F.lit(1).alias("step")))
    placed = ranks.running_totals(line, [], [F.col("x"), F.desc("step")], "step").where("step = 0").select(F.col("x").alias("_x"), (F.col("before") - 1).alias("block"))
    fitted = placed.join(blocks.select("block", F.col("fitted_y").alias(name)), "block").drop("block")
    return df.join(fitted, F.col(x).cast("double") == F.col("_x"), "left").drop("_x")


#: The forecasts at which the fitted mappings are shown.
EXAMPLES = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)
#: How the candidates are named.
CALIBRATIONS = {"C0": "identity", "C1": "ordinary_least_squares_with_intercept", "C2": "pool_adjacent_violators_least_squares"}


def calibrated(df: DataFrame, predicted: str, line: DataFrame, blocks: DataFrame) -> DataFrame:
    """df three times: candidate and calibrated, the forecast as it is (C0), on the fitted line (C1) and by isotonic steps (C2)."""
    fit = F.broadcast(line.select("slope", "intercept"))  # one row
    both = isotonic_step_apply(df.join(fit, F.lit(True)), blocks, predicted, "_steps")
    values = {"C0": F.col(predicted).cast("double"), "C1": F.col("intercept") + F.col("slope") * F.col(predicted), "C2": F.col("_steps")}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), v.alias("calibrated")) for c, v in values.items()]))
    return both.select(*df.columns, rows.alias("_c")).select(*df.columns, "_c.*")


def calibration_parameters(line: DataFrame, blocks: DataFrame) -> DataFrame:
    """candidate, method, development_n, intercept, slope, isotonic_blocks: a row for each fitted mapping."""
    n = line.select("n", "slope", "intercept").join(blocks.agg(F.count(F.lit(1)).alias("_blocks")), F.lit(True))  # one row each
    known = {"C0": (F.lit(0.0), F.lit(1.0), F.lit(None)), "C1": (F.col("intercept"), F.col("slope"), F.lit(None)), "C2": (F.lit(None), F.lit(None), F.col("_blocks"))}
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(m).alias("method"), F.col("n").alias("development_n"), known[c][0].cast("double").alias("intercept"), known[c][1].cast("double").alias("slope"), known[c][2].cast("bigint").alias("isotonic_blocks")) for c, m in CALIBRATIONS.items()])
    return n.select(F.explode(rows).alias("_p")).select("_p.*")


def calibration_examples(line: DataFrame, blocks: DataFrame, points: Sequence[float] = EXAMPLES) -> DataFrame:
    """candidate, raw, calibrated: every mapping at the points."""
    raw = line.sparkSession.createDataFrame([(float(p),) for p in points], "raw double")
    return calibrated(raw, "raw", line, blocks).select("candidate", "raw", "calibrated")


def candidate_metrics(df: DataFrame, candidate: str, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    return forecast_metrics(df, predicted, actual, [candidate, *by])
