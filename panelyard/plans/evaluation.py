"""A forecast of one target against what happened: outcomes by component, baselines, metrics by group, ranks and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import ranks
from panelyard.plans.player_features import POSITIONS, period_predictions
from panelyard.scratch import written

#: What is forecast, and who forecasts it: (target, predictor, its column, the actual's column).
INPUTS = (
    ("modeled_points", "projection", "gameweek_points", "actual_modeled_points"), ("full_points", "projection", "gameweek_points", "actual_total_points"), ("full_points", "next_estimate", "next_estimate", "actual_total_points"),
    ("full_points", "previous_gameweek_points", "previous_gameweek_points", "actual_total_points"), ("full_points", "average_prior_points", "average_prior_points", "actual_total_points"),
)
PARTS = ("minutes", "appearance_points", "goals", "goal_points", "assists", "assist_points", "modeled_points", "total_points")


def outcomes(history: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """player_id (and also, where history has several targets) and sums over the fixtures that he played. history: player_id, minutes, goals, assists, total_points."""
    return history.groupBy("player_id", *also).agg(
        F.count(F.lit(1)).alias("realized_fixture_count"), F.sum("minutes").alias("minutes"), F.sum(X.appearance_points(F.col("minutes").cast("double"))).alias("appearance_points"),
        F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), F.sum("total_points").alias("total_points"),
    )


def player_evaluation(predictions: DataFrame, actual: DataFrame, baselines: DataFrame) -> DataFrame:
    """A row per player who was forecast or played, with actual_* and the errors.

    predictions: what period_predictions() gives for one target; actual: outcomes(); baselines: player_id, next_estimate,
    previous_gameweek_points, average_prior_points. A player of the forecast whose team had no fixture and who has no outcome
    did nothing: his actuals are 0. Whoever else has no outcome is unknown; goals count by the position of the forecast.
    """
    a = actual.select("player_id", "realized_fixture_count", *[F.col(c).alias(f"_{c}") for c in actual.columns if c not in ("player_id", "realized_fixture_count")])
    rows = predictions.join(a, "player_id", "full").join(baselines, "player_id", "left")
    kind = F.lit(None).cast("string")
    for position, own in POSITIONS.items():
        kind = F.when(F.col("position") == position, own).otherwise(kind)
    found = F.col("realized_fixture_count").isNotNull()
    blank = ~found & (F.col("fixture_count") == 0)
    values = {c: F.col(f"_{c}").cast("double") for c in ("minutes", "appearance_points", "goals", "assists", "total_points")}
    values |= {"goal_points": values["goals"] * X.class_points(kind), "assist_points": values["assists"] * X.ASSIST_POINTS}
    values["modeled_points"] = values["appearance_points"] + values["goal_points"] + values["assist_points"]
    rows = rows.withColumns({f"actual_{c}": F.when(found, values[c]).when(blank, 0.0) for c in PARTS})
    e, absolute, square = X.errors(F.col("gameweek_points"), F.col("actual_modeled_points"))
    e2, absolute2, square2 = X.errors(F.col("gameweek_points"), F.col("actual_total_points"))
    return rows.select(
        "player_id", "position", "fixture_count", "realized_fixture_count", "gameweek_points", "gameweek_expected_minutes", "low_sample", "attacking_rate_available", *[f"actual_{c}" for c in PARTS], "next_estimate", "previous_gameweek_points", "average_prior_points",
        e.alias("modeled_points_error"), absolute.alias("modeled_points_absolute_error"), square.alias("modeled_points_squared_error"), e2.alias("total_points_error"), absolute2.alias("total_points_absolute_error"), square2.alias("total_points_squared_error"),
    )


def metric_inputs(rows: DataFrame) -> DataFrame:
    """target_name, predictor, prediction, actual: a row for each player and forecast of INPUTS, with the player's groups."""
    inputs = F.explode(F.array(*[F.struct(F.lit(t).alias("target_name"), F.lit(p).alias("predictor"), F.col(c).cast("double").alias("prediction"), F.col(a).alias("actual")) for t, p, c, a in INPUTS]))
    return rows.select("player_id", "position", "actual_minutes", "low_sample", "attacking_rate_available", inputs.alias("_i")).select("*", "_i.*").drop("_i")


def groups() -> dict[str, Column]:
    """Group types and the value that a row has in each; null where it belongs to none. The diagnostic ones are of the projection only."""
    m = F.col("actual_minutes")
    own = lambda c: F.when(F.col("predictor") == "projection", c)
    return {
        "overall": F.lit("all"), "position": F.col("position"), "actual_minutes": own(F.when(m == 0, "0 minutes").when(m < 60, "1-59 minutes").when(m.isNotNull(), "60+ minutes")),
        "low_sample": own(F.col("low_sample").cast("string")), "attacking_rate_available": own(F.col("attacking_rate_available").cast("string")),
    }


def evaluation(rows: DataFrame, top_n: int = 10) -> DataFrame:
    """Metrics of each target, predictor and group; Spearman, top lists and their overlap where the group is everybody.

    The rows travel once for all groups; ranks are those of operators.ranks, which hold no group in one task. What rows come
    from is worked out once, for metrics, ranks and top lists together.
    """
    inputs = metric_inputs(written(rows, "evaluated"))
    tags = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("group_type"), v.alias("group_value")) for k, v in groups().items()]), lambda x: x["group_value"].isNotNull()))
    long = inputs.select("target_name", "predictor", "prediction", "actual", tags.alias("_t")).select("*", "_t.*").drop("_t")
    by = ["target_name", "predictor", "group_type", "group_value"]
    e = F.col("prediction") - F.col("actual")
    n, known = F.count(F.lit(1)), F.count(e)
    metrics = long.groupBy(*by).agg(
        n.alias("total_rows"), F.count("prediction").alias("predictions"), F.count("actual").alias("actuals"), known.alias("evaluated"), F.count_if(F.col("prediction").isNull()).alias("missing_predictions"), F.count_if(F.col("actual").isNull()).alias("missing_actuals"),
        (F.count("prediction") * 100.0 / n).alias("prediction_coverage_pct"), F.try_divide(known * 100.0, F.nullif(F.count("actual"), F.lit(0).cast("bigint"))).alias("evaluation_coverage_pct"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
    )
    return metrics.join(ranking(inputs, top_n).withColumn("group_type", F.lit("overall")), ["target_name", "predictor", "group_type"], "left")


def ranking(inputs: DataFrame, top_n: int) -> DataFrame:
    """target_name, predictor, spearman, top_n, predicted_top and actual_top (ids in order), overlap, overlap_pct of the pairs known on both sides."""
    by: Sequence[str] = ["target_name", "predictor"]
    both = inputs.where("prediction is not null and actual is not null")
    out = ranks.spearman_by_group(both, "prediction", "actual", by).drop("pairs").withColumn("top_n", F.lit(top_n))
    for name, score in (("predicted_top", "prediction"), ("actual_top", "actual")):
        out = out.join(ranks.top_n_lists(both, score, "player_id", by, top_n).withColumnRenamed("keys", name), list(by), "left")
    return out.join(ranks.top_n_overlap(both, "prediction", "actual", "player_id", by, (top_n,), strict=False).drop("n", "pairs"), list(by), "left")


def observations(fixtures: DataFrame, actual: DataFrame) -> DataFrame:
    """A backtest's row per player and target: projection, actuals, the states of both, bands and errors.

    fixtures: what fixture_predictions() gives, of any number of targets; actual: season, target_gameweek, player_id and what
    outcomes() has. A blank's actuals are 0; of a player with a fixture but no outcome they are unknown.
    """
    has = F.col("target_has_fixture")
    n, minutes = F.count_if(has), F.when(has, F.col("expected_minutes"))
    keys = ["season", "target_gameweek", "player_id"]
    more = fixtures.groupBy(*keys).agg(F.when(n == 0, 0.0).when(F.count(minutes) == n, F.sum(minutes)).alias("known_expected_minutes"), F.min("availability_status").alias("availability_status"), F.min("chance_of_playing_next_round").alias("chance_of_playing_next_round"))
    return period_observations(period_predictions(fixtures).join(more, keys), actual)


def period_observations(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """observations() from what period_projections() gives."""
    keys = ["season", "target_gameweek", "player_id"]
    found = actual.select(*keys, "realized_fixture_count", *[F.col(c).cast("double").alias(f"_{c}") for c in ("minutes", "appearance_points", "goals", "assists", "total_points")])
    rows = predictions.join(found, keys, "left")
    kind = F.lit(None).cast("string")
    for position, own in POSITIONS.items():
        kind = F.when(F.col("position") == position, own).otherwise(kind)
    blank, known = F.col("fixture_count") == 0, F.col("realized_fixture_count").isNotNull()
    values = {"minutes": F.col("_minutes"), "appearance_points": F.col("_appearance_points"), "goal_points": F.col("_goals") * X.class_points(kind), "assist_points": F.col("_assists") * X.ASSIST_POINTS}
    values |= {"modeled_points": values["appearance_points"] + values["goal_points"] + values["assist_points"], "total_points": F.col("_total_points")}
    rows = rows.withColumns({f"actual_{c}": F.when(blank, 0.0).otherwise(v) for c, v in values.items()})
    points, band = F.col("gameweek_points"), X.minute_band(F.col("known_expected_minutes"))
    return rows.select(
        *keys, "position", "team_id", "fixture_count", F.when(blank, 0).otherwise(F.col("realized_fixture_count")).cast("bigint").alias("actual_fixture_count"), "known_expected_minutes", points, *[f"actual_{c}" for c in values],
        F.when(blank, "verified_blank").when(~known, "missing_or_corrupt_actual").when(F.col("_minutes") == 0, "actual_zero_minutes").otherwise("actual_available").alias("actual_state"),
        F.when(blank, "verified_blank").when(points.isNull(), "missing_expected_minutes").when(~F.col("prediction_complete"), "incomplete_attacking_rate").otherwise("valid_prediction").alias("prediction_state"),
        F.when(F.col("known_expected_minutes").isNotNull() & blank, "0").otherwise(band).alias("expected_minutes_band"), X.prior_sample_band(F.col("attacking_rate_available"), F.col("prior_gameweeks_with_data")).alias("prior_sample_band"),
        X.availability_band(F.col("availability_status"), F.col("chance_of_playing_next_round")).alias("availability_band"), (points - F.col("actual_modeled_points")).alias("modeled_error"), (points - F.col("actual_total_points")).alias("total_error"),
    )
