"""The opponent experiment over the projections of queries.players: orders as matches with goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import metrics
from panelyard.plans import opponent as O
from panelyard.plans import player_features as P
from panelyard.queries import players
from panelyard.queries.aggregates import METRIC_COLUMNS, METRICS
from panelyard.queries.base import panel, query, sql


def _contexts(data) -> DataFrame:
    return O.opponent_contexts(data["fixtures"], data["contexts"])


def _candidate_periods(s, d) -> DataFrame:
    data = players.inputs(s, d, provenance=False)
    return O.period_candidates(players.period_rows(data), O.period_factors(data["fixtures"], data["contexts"], _contexts(data)))


def _single_fixtures(s, d) -> DataFrame:
    """Candidates of the fixtures of teams that have one in a target period; all others are out before players meet them."""
    data = players.inputs(s, d, provenance=False)
    sides = P.target_sides(data["fixtures"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("season", "target_gameweek", "_team")))
    rows = P.period_features(**data).where("target_fixture_count = 1").drop(*P.FIXTURE)
    one = rows.join(sides.where("_n = 1").drop("_n").withColumnRenamed("_team", "snapshot_team_id"), ["season", "target_gameweek", "snapshot_team_id"])
    return O.candidate_fixtures(P.fixture_predictions(one, F.lit("")), _contexts(data))


def _actuals(s, d) -> DataFrame:
    """What players did in a period: minutes, goals and assists by class, points with appearances."""
    p = panel(s, d)
    kind = F.element_at(F.array(*[F.lit(k) for k in P.POSITIONS.values()]), (F.col("player_id") % 4 + 1).cast("int"))
    sums = p.groupBy(F.lit(players.SEASON).alias("season"), F.col("entity").alias("player_id"), F.col("period").alias("target_gameweek")).agg(F.sum("minutes").alias("minutes"), F.sum("starts").alias("g"), F.count_if(F.col("event_type") == "click").alias("a"), F.sum(X.appearance_points(F.col("minutes").cast("double"))).alias("appearance"))
    attacking = F.col("g") * X.class_points(kind) + F.col("a") * X.ASSIST_POINTS
    return sums.select("season", "player_id", "target_gameweek", "minutes", attacking.alias("attacking"), (F.col("appearance") + attacking).alias("actual"))


CONTEXTS = f"""{players.PREDICTIONS}, scores AS (SELECT fixture_id, gameweek_id, home_team_id, away_team_id, CAST(floor(o_totalprice) AS BIGINT) % 4 hg, o_orderkey % 3 ag, (CAST(floor(o_totalprice) AS BIGINT) % 40) / 10.0::DOUBLE hx, (o_orderkey % 30) / 10.0::DOUBLE ax FROM fixtures_in JOIN orders ON o_orderkey = fixture_id),
con AS (SELECT gameweek_id, fixture_id, home_team_id team, ag gc, ax xgc FROM scores UNION ALL SELECT gameweek_id, fixture_id, away_team_id, hg, hx FROM scores),
seenm AS (SELECT target, team, gc, xgc, row_number() OVER (PARTITION BY target, team ORDER BY gameweek_id DESC, fixture_id DESC) r FROM con JOIN targets ON gameweek_id < target),
ownm AS (SELECT target, team, count(*) matches, avg(CAST(gc AS DOUBLE)) gc, avg(xgc) xgc FROM seenm WHERE r <= 6 GROUP BY 1, 2), lgm AS (SELECT target, sum(gc) / count(*)::DOUBLE lgc, sum(xgc) / count(*) lxgc FROM con JOIN targets ON gameweek_id < target GROUP BY 1),
ctx AS (SELECT '{players.SEASON}' season, o.target target_gameweek, team, matches, {', '.join(f"{c} / l{c} raw_factor_{c}, round(CASE WHEN matches < 3 THEN 1.0 ELSE greatest(0.7, least(1.3, {c} / l{c})) END, 8) factor_{c}" for c in ('gc', 'xgc'))}, CASE WHEN matches < 3 THEN 'fewer_than_3_prior_matches' END neutral_reason FROM ownm o JOIN lgm USING (target))"""
CANDIDATE_FIXTURES = f"""{CONTEXTS}, cf AS (SELECT p.*, candidate, CASE candidate WHEN 'F0' THEN 1.0::DOUBLE WHEN 'F1' THEN factor_gc ELSE factor_xgc END fac FROM preds p LEFT JOIN ctx c ON c.target_gameweek = p.target_gameweek AND c.team = p.opponent_team_id CROSS JOIN (VALUES ('F0'), ('F1'), ('F2')) v(candidate)),
cfx AS (SELECT *, goal_points * fac cg, assist_points * fac ca, CASE WHEN target_has_fixture AND fac IS NOT NULL THEN appearance_points + coalesce(goal_points * fac, 0) + coalesce(assist_points * fac, 0) END cp, NOT target_has_fixture OR (appearance_points IS NOT NULL AND goal_points * fac IS NOT NULL AND assist_points * fac IS NOT NULL) cc FROM cf)"""
_STRICT = lambda x: f"CASE WHEN count(fixture_id) = 0 THEN 0.0 WHEN count({x}) FILTER (WHERE target_has_fixture) = count(fixture_id) THEN sum({x}) FILTER (WHERE target_has_fixture) END"
CANDIDATE_PERIODS = f"""{CANDIDATE_FIXTURES}, cper AS (SELECT season, candidate, target_gameweek, player_id, any_value("position") AS "position", count(fixture_id) fixture_count, {', '.join(f'{_STRICT(x)} {n}' for x, n in (('expected_minutes', 'expected_minutes'), ('appearance_points', 'appearance'), ('cg', 'goal'), ('ca', 'assist'), ('(cg + ca)', 'attacking'), ('cp', 'points')))},
 coalesce(bool_and(cc) FILTER (WHERE target_has_fixture), TRUE) complete, min(fac) FILTER (WHERE target_has_fixture) least_factor, max(fac) FILTER (WHERE target_has_fixture) most_factor, count(fixture_id) <> 1 rearrangement_risk FROM cfx GROUP BY 1, 2, 3, 4)"""
ACTUALS = """acts AS (SELECT player_id, target_gameweek, minutes, g * CASE player_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 4 END + a * 3.0::DOUBLE attacking, appearance FROM (SELECT entity player_id, period target_gameweek, sum(minutes) AS minutes, sum(starts) g, count(*) FILTER (WHERE event_type = 'click') a, sum(CASE WHEN minutes <= 0 THEN 0 WHEN minutes < 60 THEN 1 ELSE 2 END) appearance FROM panel GROUP BY 1, 2))"""


@query(sql(f"{CONTEXTS} SELECT * FROM ctx"), "raw_factor_gc factor_gc raw_factor_xgc factor_xgc")
def opponent_contexts(s, d):
    """Both factors of every team before each target."""
    return _contexts(players.inputs(s, d, provenance=False))


@query(sql(f"{CONTEXTS}, r AS (SELECT *, rank() OVER (ORDER BY factor_gc) + (count(*) OVER (PARTITION BY factor_gc) - 1) / 2.0 ra, rank() OVER (ORDER BY factor_xgc) + (count(*) OVER (PARTITION BY factor_xgc) - 1) / 2.0 rb FROM ctx) SELECT count(*) pairs, covar_pop(factor_gc, factor_xgc) / sqrt(var_pop(factor_gc) * var_pop(factor_xgc)) pearson, covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) spearman FROM r"), "pearson spearman")
def factor_correlation(s, d):
    return O.factor_correlation(_contexts(players.inputs(s, d, provenance=False)))


@query(sql(f"{CANDIDATE_PERIODS} SELECT * FROM cper"), "expected_minutes appearance goal assist attacking points least_factor most_factor")
def agg_candidate_period(s, d):
    """Fixture projections of F0 to F2 rolled up to periods."""
    return _candidate_periods(s, d)


@query(sql(f"{CANDIDATE_PERIODS}, {ACTUALS}, pairs2 AS (SELECT candidate, points predicted, CASE WHEN fixture_count = 0 THEN 0.0 ELSE a.attacking + a.appearance END actual FROM cper c LEFT JOIN acts a ON a.player_id = c.player_id AND a.target_gameweek = c.target_gameweek) SELECT candidate, {METRICS} FROM (SELECT *, predicted - actual e FROM pairs2) GROUP BY 1"), METRIC_COLUMNS)
def exp_opponent(s, d):
    """F0 to F2 against what players did; a verified blank did nothing."""
    rows = _candidate_periods(s, d).join(_actuals(s, d).drop("attacking", "minutes"), ["season", "target_gameweek", "player_id"], "left")
    rows = rows.withColumn("actual", F.when(F.col("fixture_count") == 0, 0.0).otherwise(F.col("actual")))
    return metrics.forecast_metrics(rows, "points", "actual", ["candidate"])


_BAND = "CASE WHEN fac = 0.7 THEN '0.70' WHEN fac < 0.85 THEN '>0.70-<0.85' WHEN fac < 0.95 THEN '0.85-<0.95' WHEN fac < 1.05 THEN '0.95-<1.05' WHEN fac < 1.15 THEN '1.05-<1.15' WHEN fac < 1.3 THEN '1.15-<1.30' ELSE '1.30' END"


@query(sql(f"""{CANDIDATE_FIXTURES}, {ACTUALS}, single AS (SELECT candidate, target_gameweek, player_id, fixture_id, fac, cg + ca pts FROM cfx WHERE target_has_fixture AND target_fixture_count = 1 AND cg + ca IS NOT NULL),
res2 AS (SELECT s.candidate, s.fac, a.attacking - c.pts r, a.attacking - s.pts k FROM single s JOIN single c ON c.candidate = 'F0' AND c.target_gameweek = s.target_gameweek AND c.player_id = s.player_id AND c.fixture_id = s.fixture_id JOIN acts a ON a.player_id = s.player_id AND a.target_gameweek = s.target_gameweek AND a.minutes > 0 WHERE s.candidate <> 'F0')
SELECT v.candidate, b.band, count(r) n, avg(fac) mean_factor, avg(r) control_residual, avg(k) candidate_residual, avg(abs(r)) control_mae, avg(abs(k)) candidate_mae, sqrt(avg(r * r)) control_rmse, sqrt(avg(k * k)) candidate_rmse FROM (VALUES ('F1'), ('F2')) v(candidate) CROSS JOIN (VALUES {', '.join(f"('{b}')" for b in X.FACTOR_BANDS)}) b(band) LEFT JOIN (SELECT *, {_BAND} band FROM res2) x ON x.candidate = v.candidate AND x.band = b.band GROUP BY 1, 2"""), "mean_factor control_residual candidate_residual control_mae candidate_mae control_rmse candidate_rmse")
def factor_band_residuals(s, d):
    """Residuals of the attacking projection by the band of the opponent's factor."""
    return O.factor_band_residuals(O.primary_residuals(_single_fixtures(s, d), _actuals(s, d).drop("actual")))
