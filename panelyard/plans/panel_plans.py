"""Composite jobs over the history panel: features, scoring, contexts, actuals, backtests and experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import asof, joins


def pair_state(predicted: Column, actual: Column) -> Column:
    return (
        F.when(actual.isNull() & predicted.isNull(), "both_missing").when(actual.isNull(), "missing_actual").when(predicted.isNull(), "missing_prediction").when(actual == 0, "actual_zero").otherwise("valid")
    )


def candidate_rates(history: DataFrame, target: int) -> DataFrame:
    """Entity rates under the four stabilisers: raw, shrunk by 450 and 900 pseudo-minutes, threshold of 180 minutes."""
    before = history.where(F.col("period") < target)
    own = before.groupBy("entity", "class").agg(F.sum("xg").alias("x"), F.sum("minutes").alias("m"))
    group = before.groupBy("class").agg(*[c.alias(n) for n, c in asof.group_rate_sums("xg", "minutes").items()])
    prior = X.per_90(F.col("xg_sum"), F.col("xg_minutes"))
    rows = own.join(group.select("class", prior.alias("prior")), "class").withColumn("rate", X.per_90(F.col("x"), F.col("m")))
    rate, m, p = F.col("rate"), F.col("m"), F.col("prior")
    return rows.select("entity", rate.alias("s0"), X.shrunk_rate(rate, m, p, 450.0).alias("s1"), X.shrunk_rate(rate, m, p, 900.0).alias("s2"), X.threshold_rate(rate, m, p).alias("s3"))


def build_features(history: DataFrame, universe: DataFrame, target: int, measures: Sequence[str] = ("minutes", "points", "xg", "xa")) -> DataFrame:
    """A row per entity of the universe with prior, previous and window features and rates; blanks keep their row.

    One aggregation to periods, one conditional aggregation over them, one join: all keyed by entity.
    """
    periods = asof.agg_entity_period(history.where(F.col("period") < target), ["entity"], "period", measures, F.col("appeared"))
    wide = asof.feat_windows(periods, ["entity"], "period", measures, target)
    out = universe.join(wide, "entity", "left")
    rates = {f"{span}_{m}_90": X.per_90(F.col(f"{span}_{m}"), F.col(f"{span}_minutes")) for span in ("prior", "last3", "last5") for m in ("xg", "xa")}
    return out.withColumns(rates | {"previous_has_data": F.col("previous_minutes").isNotNull(), "low_sample": F.coalesce("prior_periods", F.lit(0)) < 3})


def scored(features: DataFrame, reason: Column | None = None) -> DataFrame:
    """Expected minutes, appearance, goal and assist parts and their total; only goals and assists count as 0 when unknown."""
    minutes = X.gated_minutes(F.col("previous_minutes"), F.lit(None).cast("string") if reason is None else reason)
    df = features.withColumn("expected_minutes", minutes)
    share = F.col("expected_minutes") / X.FULL_MINUTES
    df = df.withColumns({
        "appearance": X.appearance_points(F.col("expected_minutes")),
        "goal": F.col("prior_xg_90") * share * X.class_points(F.col("class")),
        "assist": F.col("prior_xa_90") * share * X.ASSIST_POINTS,
    })
    return df.withColumn("total", F.col("appearance") + F.coalesce("goal", F.lit(0.0)) + F.coalesce("assist", F.lit(0.0)))


def scored_entities(history: DataFrame, target: int) -> DataFrame:
    """Projection of every entity that has history before target."""
    universe = history.where(F.col("period") < target).select("entity", "class").distinct()
    return scored(build_features(history, universe, target)).select("entity", "class", "expected_minutes", "appearance", "goal", "assist", "total", "low_sample")


def dedup_first_row(df: DataFrame, keys: Sequence[str], order: str, content: Sequence[str]) -> DataFrame:
    """The first row of each key with the number of its copies and of distinct contents; more than one variant is a conflict."""
    out = df.groupBy(*keys).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"), F.count_distinct(*content).alias("variants"))
    return out.select(*keys, order, "copies", "variants")


def fixture_to_period(fixtures: DataFrame, keys: Sequence[str], measures: Sequence[str], has_fixture: str) -> DataFrame:
    """Fixture rows rolled up: blank groups are 0, partly known sums are null, flags are and-ed and or-ed."""
    has = F.col(has_fixture)
    cols = [F.count_if(has).alias("fixtures")]
    for m in measures:
        known = F.count(F.when(has, F.col(m)))
        cols += [F.coalesce(F.sum(F.when(has, F.col(m))), F.lit(0.0)).alias(f"{m}_sum"), F.when(F.count_if(has) == 0, 0.0).when(known == F.count_if(has), F.sum(F.when(has, F.col(m)))).alias(f"{m}_strict")]
    return fixtures.groupBy(*keys).agg(*cols)


#: How the period before a target is called; of pairs the first is for a player with minutes.
NO_PRIOR, NOT_IN_UNIVERSE, BLANK = "no_prior_gameweek_in_scope", "player_not_in_previous_predeadline_universe", "verified_team_blank"
NOT_KICKED_OFF, NO_HISTORY = "fixture_not_kicked_off_before_target_deadline", "missing_history"
MOVED = ("played_after_deadline_team_change", "zero_minutes_after_deadline_team_change")
PARTIAL = ("partially_played_before_target_deadline", "partial_gameweek_zero_minutes_before_target_deadline")
PLAYED = ("played", "fixture_existed_zero_minutes")


def previous_context(states: DataFrame, fixtures: DataFrame, history: DataFrame) -> DataFrame:
    """status of the period before each target.

    states: entity, team, target, deadline (the universe of each target); fixtures: team, period, kickoff;
    history: entity, period, minutes, teams (array) of what was played before the target's deadline, with its target.
    """
    before = states.select("entity", (F.col("target") + 1).alias("target"), F.col("team").alias("prior_team"))
    rows = states.join(before, ["entity", "target"], "left")
    games = rows.join(fixtures, (F.col("prior_team") == fixtures["team"]) & (fixtures["period"] == F.col("target") - 1), "left")
    games = games.groupBy("entity", "target").agg(F.count("kickoff").alias("games"), F.count_if(F.col("kickoff") < F.col("deadline")).alias("early"))
    rows = rows.join(games, ["entity", "target"]).join(history, ["entity", "target"], "left")
    moved = ~F.coalesce(F.array_distinct("teams").eqNullSafe(F.array("prior_team")), F.lit(False))
    some = F.col("minutes") > 0
    named = lambda names: F.when(some, names[0]).otherwise(names[1])
    status = (
        F.when(F.col("target") == 1, NO_PRIOR).when(F.col("prior_team").isNull(), NOT_IN_UNIVERSE).when(F.col("games") == 0, BLANK).when(F.col("early") == 0, NOT_KICKED_OFF)
        .when(F.col("minutes").isNull(), NO_HISTORY).when(moved, named(MOVED)).when(F.col("games") > F.col("early"), named(PARTIAL)).otherwise(named(PLAYED))
    )
    return rows.select("entity", "target", status.alias("status"), F.when(F.col("early") > 0, F.col("minutes")).alias("minutes"))


def historical_features(history: DataFrame, targets: DataFrame) -> DataFrame:
    """As-of features for every entity and target: two guards, prior and window sums, in one range join and one aggregate."""
    joined = asof.join_asof_range(targets, history, ["entity"], "period", "ts", "target", "deadline")
    inside = lambda k: F.col("period") >= F.col("target") - k
    return joined.groupBy("entity", "target").agg(
        F.sum("minutes").alias("prior_minutes"), F.count_distinct("period").alias("prior_periods"),
        F.sum(F.when(inside(1), F.col("minutes"))).alias("previous_minutes"), F.sum(F.when(inside(3), F.col("minutes"))).alias("last3_minutes"),
        F.sum(F.when(inside(5), F.col("minutes"))).alias("last5_minutes"), F.max("period").alias("max_period"), F.max("ts").alias("latest"),
    )


def minute_candidates(history: DataFrame, targets: DataFrame) -> DataFrame:
    """M0 previous period, M1 and M2 means of the last 3 and 5, M3 recency mean: a row per entity, target and candidate."""
    seen = asof.join_asof_range(targets, history, ["entity"], "period", "ts", "target", "deadline", back=5)
    seen = seen.groupBy("entity", "target", "period").agg(F.sum("minutes").cast("double").alias("minutes"))
    lag, m = F.col("target") - F.col("period"), F.col("minutes")
    wide = seen.groupBy("entity", "target").agg(F.max(F.when(lag == 1, m)).alias("M0"), F.avg(F.when(lag <= 3, m)).alias("M1"), F.avg(m).alias("M2"), asof.weighted_recency_mean(lag, m).alias("M3"))
    wide = targets.select("entity", "target").join(wide, ["entity", "target"], "left")
    return wide.unpivot(["entity", "target"], ["M0", "M1", "M2", "M3"], "candidate", "predicted").withColumn("predicted", X.clamp(F.col("predicted"), 0.0, 90.0))


def team_match_defense(fixtures: DataFrame) -> DataFrame:
    """Both sides of each fixture as defender: conceded and expected conceded. fixtures: fixture, home, away, kickoff, home_score, away_score, home_x, away_x."""
    sides = joins.side_rows(fixtures, "home", "away", team="defender", opponent="attacker")
    at_home = F.col("side") == "H"
    return sides.select("fixture", "kickoff", "defender", "attacker", F.when(at_home, F.col("away_score")).otherwise(F.col("home_score")).alias("conceded"), F.when(at_home, F.col("away_x")).otherwise(F.col("home_x")).alias("expected"))
