"""The experiment that scales a player's attacking rates by how much his opponent has conceded: F0 not at all, F1 by goals, F2 by expected goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import asof, joins, ranks
from panelyard.operators.experiments import FACTOR_MAX, FACTOR_MIN, LEAST_MATCHES, ROLLING_MATCHES
from panelyard.operators.metrics import pearson_by_group
from panelyard.plans.player_features import target_sides

#: The candidates and the factor that each one applies.
CANDIDATES = {"F0": None, "F1": "factor_gc", "F2": "factor_xgc"}
KEYS = ("season", "target_gameweek", "player_id", "fixture_id")


def defended(matches: DataFrame) -> DataFrame:
    """season, gameweek_id, fixture_id, team, gc, xgc: both sides of each match and what they conceded.

    matches: season, fixture_id, gameweek_id, home_team_id, away_team_id, home_goals, away_goals, home_xg, away_xg.
    """
    sides = joins.side_rows(matches, "home_team_id", "away_team_id", team="team", opponent="_other")
    home = F.col("side") == "H"
    return sides.select("season", "gameweek_id", "fixture_id", "team", F.when(home, F.col("away_goals")).otherwise(F.col("home_goals")).alias("gc"), F.when(home, F.col("away_xg")).otherwise(F.col("home_xg")).alias("xgc"))


def opponent_contexts(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """season, target_gameweek, team, matches, raw_factor_*, factor_* and neutral_reason of every team that has played before a target.

    A team's rate is that of its last ROLLING_MATCHES matches of earlier periods, the league's that of all of them. targets: season,
    target_gameweek. Of a team's period only its last ROLLING_MATCHES matches can be among them, and only these meet the targets.
    """
    rows = defended(matches)
    due = F.broadcast(targets.select("season", "target_gameweek").distinct())  # a row per target
    latest = asof.last_k(rows, ["season", "team", "gameweek_id"], [F.desc("fixture_id")], ROLLING_MATCHES).drop("rank")
    seen = latest.join(due, "season").where("gameweek_id < target_gameweek")
    last = asof.last_k(seen, ["season", "target_gameweek", "team"], [F.desc("gameweek_id"), F.desc("fixture_id")], ROLLING_MATCHES)
    own = last.groupBy("season", "target_gameweek", "team").agg(F.count(F.lit(1)).alias("matches"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("gc", "xgc")])
    by_period = rows.groupBy("season", "gameweek_id").agg(F.count(F.lit(1)).alias("n"), F.sum("gc").alias("gc"), F.sum("xgc").alias("xgc"))
    league = by_period.join(due, "season").where("gameweek_id < target_gameweek").groupBy("season", "target_gameweek").agg(*[(F.sum(c) / F.sum("n")).alias(f"league_{c}") for c in ("gc", "xgc")])
    out, few = own.join(league, ["season", "target_gameweek"]), F.col("matches") < LEAST_MATCHES
    for c in ("gc", "xgc"):
        raw = F.try_divide(F.col(c), F.nullif(F.col(f"league_{c}"), F.lit(0.0)))
        out = out.withColumns({f"raw_factor_{c}": raw, f"factor_{c}": F.round(F.when(few | raw.isNull(), 1.0).otherwise(X.clamp(raw, FACTOR_MIN, FACTOR_MAX)), 8)})
    return out.select("season", "target_gameweek", "team", "matches", "raw_factor_gc", "factor_gc", "raw_factor_xgc", "factor_xgc", F.when(few, "fewer_than_3_prior_matches").alias("neutral_reason"))


def candidate_fixtures(predictions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each fixture projection once per candidate: opponent_factor, candidate_goal, candidate_assist, candidate_points, candidate_complete.

    predictions: what player_features.fixture_predictions() gives. An opponent without matches leaves the factor unknown, and
    with it F1 and F2; a blank has no points and is complete.
    """
    at = contexts.withColumnRenamed("team", "opponent_team_id").select("season", "target_gameweek", "opponent_team_id", "factor_gc", "factor_xgc")
    rows = predictions.join(at, ["season", "target_gameweek", "opponent_team_id"], "left")
    factors = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), (F.lit(1.0) if f is None else F.col(f)).alias("opponent_factor")) for c, f in CANDIDATES.items()]))
    rows = rows.select(*predictions.columns, factors.alias("_c")).select(*predictions.columns, "_c.*")
    part = lambda c: F.col(c) * F.col("opponent_factor")
    rows = rows.withColumns({"candidate_goal": part("goal_points"), "candidate_assist": part("assist_points")})
    has, known = F.col("target_has_fixture"), F.col("appearance_points").isNotNull()
    points = F.col("appearance_points") + F.coalesce("candidate_goal", F.lit(0.0)) + F.coalesce("candidate_assist", F.lit(0.0))
    complete = ~has | (known & F.col("candidate_goal").isNotNull() & F.col("candidate_assist").isNotNull())
    return rows.withColumns({"candidate_points": F.when(has & F.col("opponent_factor").isNotNull(), points), "candidate_complete": complete})


def candidate_periods(fixtures: DataFrame) -> DataFrame:
    """Candidate fixtures rolled up to periods: a blank is 0, a sum with an unknown part is unknown."""
    has = F.col("target_has_fixture")
    n = F.count_if(has)
    def strict(value: Column) -> Column:  # noqa: E306
        own = F.when(has, value)
        return F.when(n == 0, 0.0).when(F.count(own) == n, F.sum(own))

    return fixtures.groupBy("season", "candidate", "target_gameweek", "player_id").agg(
        F.min("position").alias("position"), n.alias("fixture_count"), strict(F.col("expected_minutes")).alias("expected_minutes"), strict(F.col("appearance_points")).alias("appearance"), strict(F.col("candidate_goal")).alias("goal"), strict(F.col("candidate_assist")).alias("assist"),
        strict(F.col("candidate_goal") + F.col("candidate_assist")).alias("attacking"), strict(F.col("candidate_points")).alias("points"), F.coalesce(F.bool_and(F.when(has, F.col("candidate_complete"))), F.lit(True)).alias("complete"),
        F.min(F.when(has, F.col("opponent_factor"))).alias("least_factor"), F.max(F.when(has, F.col("opponent_factor"))).alias("most_factor"), (n != 1).alias("rearrangement_risk"),
    )


def period_factors(fixtures: DataFrame, targets: DataFrame, contexts: DataFrame) -> DataFrame:
    """season, target_gameweek, team_id and _f: for each candidate how many of a team's fixtures of a target have a factor, their factors' sum, least and most.

    contexts: what opponent_contexts() gives. Fixtures are summed up here, by team, before they meet the players.
    """
    due = F.broadcast(targets.select("season", "target_gameweek").distinct())  # a row per target
    sides = target_sides(fixtures).select("season", "target_gameweek", F.col("_team").alias("team_id"), "target_opponent_team_id").join(due, ["season", "target_gameweek"], "left_semi")
    at = contexts.select("season", "target_gameweek", F.col("team").alias("target_opponent_team_id"), "factor_gc", "factor_xgc")
    rows = sides.join(at, ["season", "target_gameweek", "target_opponent_team_id"], "left")
    stats = []
    for name, f in CANDIDATES.items():
        x = F.lit(1.0) if f is None else F.col(f)
        stats.append(F.struct(F.lit(name).alias("candidate"), F.count(x).alias("known"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most")))
    return rows.groupBy("season", "target_gameweek", "team_id").agg(F.array(*stats).alias("_f"))


def period_candidates(predictions: DataFrame, factors: DataFrame) -> DataFrame:
    """candidate_periods() from rows that each stand for all fixtures of a player's period (fixture_predictions() of period_features()) and period_factors().

    A part of a projection is the same in each of a player's fixtures but for the factor, so it is multiplied by the factors'
    sum; players never meet the fixtures themselves.
    """
    none = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(0).cast("bigint").alias("known"), *[F.lit(None).cast("double").alias(k) for k in ("total", "least", "most")]) for c in CANDIDATES])
    rows = predictions.join(factors, ["season", "target_gameweek", "team_id"], "left").withColumn("_c", F.explode(F.coalesce("_f", none)))
    n, known = F.col("target_fixture_count"), F.col("_c.known") == F.col("target_fixture_count")
    times = lambda c, k: F.when(n == 0, 0.0).otherwise(F.col(c) * k)
    total = F.when(known, F.col("_c.total"))
    goal, assist, appearance = F.col("goal_points") * total, F.col("assist_points") * total, F.col("appearance_points") * n
    points = F.when(known, appearance + F.coalesce(goal, F.lit(0.0)) + F.coalesce(assist, F.lit(0.0)))
    blank = lambda v: F.when(n == 0, 0.0).otherwise(v)
    return rows.select(
        "season", "_c.candidate", "target_gameweek", "player_id", "position", n.alias("fixture_count"), times("expected_minutes", n).alias("expected_minutes"), times("appearance_points", n).alias("appearance"), blank(goal).alias("goal"), blank(assist).alias("assist"), blank(goal + assist).alias("attacking"), blank(points).alias("points"),
        ((n == 0) | (appearance.isNotNull() & goal.isNotNull() & assist.isNotNull())).alias("complete"), F.col("_c.least").alias("least_factor"), F.col("_c.most").alias("most_factor"), (n != 1).alias("rearrangement_risk"),
    )


def factor_correlation(contexts: DataFrame) -> DataFrame:
    """One row: pairs, and the Pearson and Spearman correlation of the two clipped factors."""
    pearson = pearson_by_group(contexts, "factor_gc", "factor_xgc", [])
    return pearson.join(ranks.spearman_by_group(contexts, "factor_gc", "factor_xgc", []).drop("pairs"), F.lit(True), "left")  # one row each


def primary_residuals(fixtures: DataFrame, actuals: DataFrame) -> DataFrame:
    """Candidate fixtures of single periods in which the player took part, beside the control's: residual (actual less control) and candidate_residual.

    actuals: season, target_gameweek, player_id, minutes, attacking; of a period with one fixture they are the fixture's.
    """
    known = fixtures.where("target_has_fixture and target_fixture_count = 1 and candidate_goal is not null and candidate_assist is not null").select(*KEYS, "candidate", "opponent_factor", (F.col("candidate_goal") + F.col("candidate_assist")).alias("attacking_points"))
    both = joins.against_control(known, KEYS, "candidate", "F0", ["attacking_points"]).where("candidate <> 'F0'")
    both = both.join(actuals.where("minutes > 0 and attacking is not null"), ["season", "target_gameweek", "player_id"])
    return both.withColumns({"residual": F.col("attacking") - F.col("control_attacking_points"), "candidate_residual": F.col("attacking") - F.col("attacking_points")})


def factor_band_residuals(residuals: DataFrame) -> DataFrame:
    """Residuals of control and candidate by candidate and band of the factor; empty bands stay with n = 0."""
    r, c = F.col("residual"), F.col("candidate_residual")
    found = residuals.groupBy("candidate", X.factor_band(F.col("opponent_factor")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("opponent_factor").alias("mean_factor"), F.avg(r).alias("control_residual"), F.avg(c).alias("candidate_residual"), F.avg(F.abs(r)).alias("control_mae"), F.avg(F.abs(c)).alias("candidate_mae"), F.sqrt(F.avg(r * r)).alias("control_rmse"), F.sqrt(F.avg(c * c)).alias("candidate_rmse")
    )
    rows = F.array(*[F.struct(F.lit(k).alias("candidate"), F.lit(b).alias("band")) for k in CANDIDATES if k != "F0" for b in X.FACTOR_BANDS])
    spine = residuals.sparkSession.range(1).select(F.explode(rows).alias("_s")).select("_s.*")
    return spine.join(found, ["candidate", "band"], "left").na.fill(0, ["n"])
