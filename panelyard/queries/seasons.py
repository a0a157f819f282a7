"""The season-prior experiment over the driver's events: the first twelve days are the season before, the rest the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans import season_prior as S
from panelyard.queries.base import panel, query, sql
from panelyard.scratch import written

LAST_DAY = 12


def _players(s, d) -> DataFrame:
    """Current players with codes of which some are missing or shared, and classes of which some change."""
    i = F.col("entity")
    kind = F.when((i % 53 == 6) & (F.col("period") > 20), "GK").otherwise(F.col("class"))
    now = panel(s, d).where(F.col("period") > LAST_DAY).groupBy(i.alias("player_id")).agg(F.min("class").alias("class"), F.count_distinct(kind).alias("class_count"))
    p = F.col("player_id")
    return now.withColumn("code", F.when(p % 29 == 3, None).when(p % 31 == 7, p - 1).otherwise(p))


def _totals(s, d) -> DataFrame:
    """The season before, with every anomaly that keeps a player from borrowing."""
    i = F.col("entity")
    rows = panel(s, d).where((F.col("period") <= LAST_DAY) & (i % 23 != 9)).select(
        i.alias("player_id"), F.when(i % 37 == 30, i - 1).otherwise(i).alias("code"), F.when(i % 19 == 5, "XX").when(i % 11 == 4, F.lit("GK")).otherwise(F.col("class")).alias("class"),
        F.when(i % 47 == 2, None).when(i % 41 == 11, 0).when(i % 43 == 8, F.col("minutes") % 10).otherwise(F.col("minutes")).alias("minutes"),
        F.when(i % 17 == 12, None).when((i % 13 == 1) & (F.col("event_id") % 3 == 0), float("nan")).otherwise(F.coalesce("xg", F.lit(0.0))).alias("xg"),
        F.when(i % 16 == 10, None).when((i % 15 == 7) & (F.col("event_id") % 3 == 0), float("inf")).otherwise(F.coalesce("xa", F.lit(0.0))).alias("xa"),
        (i % 59 != 1).alias("performed"), ((i % 14 == 2) & (F.col("event_id") % 5 == 1)).alias("exception"),
    )
    return S.season_totals(rows)


def _reasoned(s, d) -> DataFrame:
    return S.with_reasons(_players(s, d), _totals(s, d))


def _candidates(s, d) -> DataFrame:
    """Written once, since metrics, ranks and coverage each read them."""
    periods = panel(s, d).where(F.col("period") > LAST_DAY).groupBy(F.col("entity").alias("player_id"), (F.col("period") - LAST_DAY).alias("period")).agg(
        F.sum("minutes").alias("minutes"), F.sum(F.coalesce("xg", F.lit(0.0))).alias("xg"), F.sum(F.coalesce("xa", F.lit(0.0))).alias("xa"), F.sum("starts").alias("goals"), F.count_if(F.col("event_type") == "click").alias("assists")
    )
    return written(S.candidates(periods, _reasoned(s, d)), "candidates")


REASONED = f""", cur AS (SELECT player_id, class, class_count, CASE WHEN player_id % 29 = 3 THEN NULL WHEN player_id % 31 = 7 THEN player_id - 1 ELSE player_id END code FROM (SELECT entity player_id, min(class) AS class, count(DISTINCT CASE WHEN entity % 53 = 6 AND period > 20 THEN 'GK' ELSE class END) class_count FROM panel WHERE period > {LAST_DAY} GROUP BY 1)),
prow AS (SELECT entity player_id, CASE WHEN entity % 37 = 30 THEN entity - 1 ELSE entity END code, CASE WHEN entity % 19 = 5 THEN 'XX' WHEN entity % 11 = 4 THEN 'GK' ELSE class END AS class, CASE WHEN entity % 47 = 2 THEN NULL WHEN entity % 41 = 11 THEN 0 WHEN entity % 43 = 8 THEN minutes % 10 ELSE minutes END AS minutes,
 CASE WHEN entity % 17 = 12 THEN NULL WHEN entity % 13 = 1 AND event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE coalesce(xg, 0.0) END xg, CASE WHEN entity % 16 = 10 THEN NULL WHEN entity % 15 = 7 AND event_id % 3 = 0 THEN 'inf'::DOUBLE ELSE coalesce(xa, 0.0) END xa, entity % 59 <> 1 performed, entity % 14 = 2 AND event_id % 5 = 1 exception
 FROM panel WHERE period <= {LAST_DAY} AND entity % 23 <> 9),
tot AS (SELECT code, count(DISTINCT player_id) identity_count, count(*) FILTER (WHERE exception) exception_rows, min(class) AS class, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) FILTER (WHERE performed) source_rows, {', '.join(f"count(*) FILTER (WHERE performed AND {c} IS NULL) null_{c}, count(*) FILTER (WHERE performed AND {c} IS NOT NULL AND NOT isfinite({c})) odd_{c}, sum({c}) FILTER (WHERE performed AND isfinite({c})) {c}" for c in ('xg', 'xa'))} FROM prow GROUP BY 1),
cc AS (SELECT code, count(DISTINCT player_id) code_count FROM cur WHERE code IS NOT NULL GROUP BY 1),
rs AS (SELECT c.player_id, c.class, t.minutes pm, t.xg pxg, t.xa pxa, CASE {' '.join(f"WHEN {cond} THEN '{name}'" for cond, name in zip(("c.code IS NULL", "code_count <> 1", "class_count <> 1", "t.code IS NULL", "identity_count <> 1", "exception_rows > 0", "t.class NOT IN ('GK', 'DEF', 'MID', 'FWD')", "t.class <> c.class", "t.minutes IS NULL", "t.minutes = 0", "t.minutes < 450", "source_rows = 0", "null_xg > 0 OR t.xg IS NULL", "odd_xg > 0", "null_xa > 0 OR t.xa IS NULL", "odd_xa > 0"), S.REASONS, strict=False))} ELSE 'eligible' END reason
 FROM cur c LEFT JOIN cc USING (code) LEFT JOIN tot t ON t.code = c.code)"""

_RATE = {x: f"CASE WHEN m > 0 THEN {x} * 90 / m END" for x in ("xg", "xa")}
_LENT = {x: f"CASE WHEN reason = 'eligible' THEN CASE WHEN m > 0 THEN ({x} + p{x} * 90 / pm * 450 / 90) * 90 / (m + 450) END ELSE {_RATE[x]} END" for x in ("xg", "xa")}
CANDIDATES = f"""{REASONED}, gw AS (SELECT entity player_id, period - {LAST_DAY} period, sum(minutes) AS minutes, sum(coalesce(xg, 0.0)) xg, sum(coalesce(xa, 0.0)) xa, sum(starts) goals, count(*) FILTER (WHERE event_type = 'click') assists FROM panel WHERE period > {LAST_DAY} GROUP BY 1, 2),
past AS (SELECT g.player_id, g.period, g.minutes, g.goals, g.assists, sum(h.minutes) m, sum(h.xg) xg, sum(h.xa) xa, max(h.minutes) FILTER (WHERE h.period = g.period - 1) last FROM gw g LEFT JOIN gw h ON h.player_id = g.player_id AND h.period < g.period GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT *, CASE WHEN last IS NOT NULL THEN greatest(0.0, least(90.0, CAST(last AS DOUBLE))) END em, CASE class WHEN 'GK' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END worth FROM past JOIN rs USING (player_id)),
f AS (SELECT player_id, period, ({_RATE['xg']}) * em / 90 * worth c0_goal, ({_LENT['xg']}) * em / 90 * worth c1_goal, goals * worth::DOUBLE actual_goal, ({_RATE['xa']}) * em / 90 * 3 c0_assist, ({_LENT['xa']}) * em / 90 * 3 c1_assist, assists * 3.0::DOUBLE actual_assist,
 CAST(CASE WHEN em IS NULL THEN NULL WHEN em <= 0 THEN 0 WHEN em < 60 THEN 1 ELSE 2 END AS DOUBLE) app, CAST(CASE WHEN minutes <= 0 THEN 0 WHEN minutes < 60 THEN 1 ELSE 2 END AS DOUBLE) played FROM e),
wide AS (SELECT player_id, period, {', '.join(f"round({s}_goal, 8) {s}_goal, round({s}_assist, 8) {s}_assist, round({s}_goal + {s}_assist, 8) {s}_attacking_combined, round({a} + {s}_goal + {s}_assist, 8) {s}_modeled_xfp" for s, a in (('c0', 'app'), ('c1', 'app'), ('actual', 'played')))} FROM f)"""
_LONG = " UNION ALL ".join(f"SELECT period, '{c}' component, c0_{c} c0, c1_{c} c1, actual_{c} actual FROM wide" for c in S.COMPONENTS)
_RANK = lambda x: f"rank() OVER (PARTITION BY scope, component ORDER BY {x}) + (count(*) OVER (PARTITION BY scope, component, {x}) - 1) / 2.0 r_{x}"
_CORR = lambda x: f"CASE WHEN count(*) > 1 AND max(r_{x}) > min(r_{x}) AND max(r_actual) > min(r_actual) THEN covar_pop(r_{x}, r_actual) / sqrt(var_pop(r_{x}) * var_pop(r_actual)) END"
COMMON = f"""{CANDIDATES}, scoped AS (SELECT scope, component, c0, c1, actual FROM ({_LONG}) JOIN (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in S.SCOPES.items())}) v(scope, low, high) ON period BETWEEN low AND high WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND actual IS NOT NULL),
ranked AS (SELECT *, {_RANK('c0')}, {_RANK('c1')}, {_RANK('actual')} FROM scoped),
base AS (SELECT scope, component, count(*) pairs, {', '.join(f"avg(abs({s} - actual)) {s}_mae, sqrt(avg(({s} - actual) ** 2)) {s}_rmse, avg({s} - actual) {s}_bias, {_CORR(s)} {s}_spearman" for s in ('c0', 'c1'))} FROM ranked GROUP BY 1, 2),
cm AS MATERIALIZED (SELECT *, (c0_mae - c1_mae) * 100 / nullif(c0_mae, 0) mae_improvement, (c0_rmse - c1_rmse) * 100 / nullif(c0_rmse, 0) rmse_improvement, abs(c1_bias) - abs(c0_bias) absolute_bias_increase, c1_spearman - c0_spearman spearman_change FROM base),
cov AS (SELECT count(c0_modeled_xfp) * 100.0 / count(*) c0, count(c1_modeled_xfp) * 100.0 / count(*) c1 FROM wide)"""
COMMON_DOUBLES = "c0_mae c0_rmse c0_bias c1_mae c1_rmse c1_bias c0_spearman c1_spearman mae_improvement rmse_improvement absolute_bias_increase spearman_change"


def _gate_sql() -> str:
    rows = []
    for scope, gate, what, component, comparison, threshold in S.gate_specs():
        at = lambda f, c=component: f"(SELECT {f} FROM cm WHERE scope = '{scope}' AND component = '{c}')"  # noqa: B023, E731
        if what == "coverage_drop":
            c0, c1, change = "(SELECT c0 FROM cov)", "(SELECT c1 FROM cov)", "(SELECT c0 - c1 FROM cov)"
        elif what.endswith("_spearman"):
            pick = "greatest" if what.startswith("best") else "least"
            known = f"{at('spearman_change', 'goal')} + {at('spearman_change', 'assist')} IS NOT NULL"
            c0, c1, change = [f"CASE WHEN {known} THEN {pick}({at(f, 'goal')}, {at(f, 'assist')}) END" for f in ("c0_spearman", "c1_spearman", "spearman_change")]
        else:
            measure = "bias" if what == "absolute_bias_increase" else what.split("_")[0]
            c0, c1, change = at(f"c0_{measure}"), at(f"c1_{measure}"), f"-{at(f'{measure}_improvement')}" if what.endswith("worsening") else at(what)
        rows.append(f"SELECT '{scope}' scope, '{gate}' gate, {c0} c0, {c1} c1, {change} change, '{comparison}' comparison, {threshold}::DOUBLE threshold")
    return f"{COMMON}, gates AS (SELECT *, coalesce(CASE comparison WHEN '>=' THEN change >= threshold ELSE change <= threshold END, FALSE) passed FROM ({' UNION ALL '.join(rows)}))"


@query(sql(f"{REASONED} SELECT reason, count(*) n FROM rs GROUP BY 1"))
def eligibility_reasons(s, d):
    """How many players may borrow, and why the others may not."""
    return _reasoned(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"{COMMON} SELECT * FROM cm"), COMMON_DOUBLES)
def exp_season_prior(s, d):
    """C0, a player's own rates, and C1, blended with those of the season before, on the pairs that both predict."""
    return S.common_metrics(_candidates(s, d))


@query(sql(f"{_gate_sql()} SELECT * FROM gates"), "c0 c1 change threshold")
def gate_table(s, d):
    """The 21 gates of the season-prior experiment."""
    rows = _candidates(s, d)
    return S.development_gates(S.common_metrics(rows), S.coverage(rows))


@query(sql(f"{_gate_sql()} SELECT count(*) gates, count(*) FILTER (WHERE passed) passed, bool_and(passed) qualifies FROM gates"))
def gate_decision(s, d):
    return S.decision(gate_table(s, d))
