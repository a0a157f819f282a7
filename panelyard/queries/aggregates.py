"""Metrics, rank statistics, calibration and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import experiments as E
from panelyard.operators import lineup, metrics, ranks
from panelyard.plans import panel_plans
from panelyard.queries.base import TARGET, entities, forecast_pairs, panel, periods, query, sql, t, targets
from panelyard.queries.features import FIXTURES, SEASONS, fixtures, seasons

METRICS = """count(*) eligible, count(e) pairs, count(*) FILTER (WHERE predicted IS NULL) missing_predictions, count(*) FILTER (WHERE actual IS NULL) missing_actuals, count(e) * 100.0 / count(*) coverage_pct,
avg(abs(e)) mae, sqrt(avg(e * e)) rmse, avg(e) bias, avg(predicted) FILTER (WHERE e IS NOT NULL) mean_predicted, avg(actual) FILTER (WHERE e IS NOT NULL) mean_actual, sum(predicted) FILTER (WHERE e IS NOT NULL) total_predicted, sum(actual) FILTER (WHERE e IS NOT NULL) total_actual"""
METRIC_COLUMNS = "coverage_pct mae rmse bias mean_predicted mean_actual total_predicted total_actual"
PAIRS = "(SELECT *, predicted - actual e FROM pairs)"


@query(sql(f"SELECT {METRICS} FROM {PAIRS}"), METRIC_COLUMNS)
def forecast_metrics(s, d):
    return metrics.forecast_metrics(forecast_pairs(s, d), "predicted", "actual")


@query(sql(f"""SELECT scope, "group", {METRICS} FROM {PAIRS}, LATERAL (VALUES ('overall', 'all'), ('class', class), ('period', CAST(period AS VARCHAR))) v(scope, "group") GROUP BY 1, 2"""), METRIC_COLUMNS)
def metrics_by_scope(s, d):
    return metrics.metrics_by_scope(forecast_pairs(s, d), "predicted", "actual", {"overall": F.lit("all"), "class": F.col("class"), "period": F.col("period")})


BASELINES = """, b AS (SELECT a.entity, a.period, a.predicted previous, a.actual, avg(p.minutes) mean_prior FROM pairs a LEFT JOIN periods p ON p.entity = a.entity AND p.period < a.period GROUP BY ALL),
long AS (SELECT 'zero' predictor, 0.0::DOUBLE predicted, actual FROM b UNION ALL SELECT 'zero_scored_only', 0.0, actual FROM b WHERE previous IS NOT NULL UNION ALL SELECT 'previous', previous, actual FROM b UNION ALL SELECT 'mean_prior', mean_prior, actual FROM b)"""


def baselines(s, d) -> DataFrame:
    """Forecasts that need no model, long: predictor, predicted, actual."""
    from pyspark.sql import Window

    before = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    mean = periods(s, d).select("entity", "period", F.avg("minutes").over(before).alias("mean_prior"))
    b = forecast_pairs(s, d).join(mean, ["entity", "period"])
    rows = F.array(
        F.struct(F.lit("zero").alias("predictor"), F.lit(0.0).alias("predicted")), F.when(F.col("predicted").isNotNull(), F.struct(F.lit("zero_scored_only").alias("predictor"), F.lit(0.0).alias("predicted"))),
        F.struct(F.lit("previous").alias("predictor"), F.col("predicted").alias("predicted")), F.struct(F.lit("mean_prior").alias("predictor"), F.col("mean_prior").alias("predicted")),
    )
    return b.select("entity", "period", "actual", F.explode(F.array_compact(rows)).alias("r")).select("r.*", "actual")


@query(sql(f"{BASELINES} SELECT predictor, {METRICS} FROM (SELECT *, predicted - actual e FROM long) GROUP BY 1"), METRIC_COLUMNS)
def reference_baselines(s, d):
    return metrics.forecast_metrics(baselines(s, d), "predicted", "actual", ["predictor"])


@query(sql(f"{BASELINES} SELECT predictor, count(*) n, count(predicted) known, sum(predicted) total FROM long GROUP BY 1"), "total")
def union_metric_inputs(s, d):
    return baselines(s, d).groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("known"), F.sum("predicted").alias("total"))


@query(sql(", u AS (SELECT 'development' phase, minutes FROM periods WHERE period <= 15 UNION ALL SELECT 'holdout', minutes FROM periods WHERE period > 15) SELECT phase, count(*) n, CAST(sum(minutes) AS BIGINT) AS minutes FROM u GROUP BY 1"))
def union_phases(s, d):
    p = periods(s, d)
    both = p.where("period <= 15").withColumn("phase", F.lit("development")).unionByName(p.where("period > 15").withColumn("phase", F.lit("holdout")))
    return both.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))


@query(sql("""SELECT name, "group", count(*) n FROM periods, LATERAL (VALUES ('class', class), ('sample', CASE WHEN "rows" > 1 THEN 'many' ELSE 'one' END)) v(name, "group") GROUP BY 1, 2"""))
def union_diagnostic_groups(s, d):
    rows = metrics.scoped(periods(s, d), {"class": F.col("class"), "sample": F.when(F.col("rows") > 1, "many").otherwise("one")})
    return rows.groupBy(F.col("scope").alias("name"), "group").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_universe(s, d):
    """Customers without an order of any status."""
    return t(s, d, "customer").select("c_custkey").subtract(t(s, d, "orders").select("o_custkey"))


RANKS = """SELECT *, rank() OVER (PARTITION BY {0} ORDER BY predicted) + (count(*) OVER (PARTITION BY {0}, predicted) - 1) / 2.0 rx, rank() OVER (PARTITION BY {0} ORDER BY actual) + (count(*) OVER (PARTITION BY {0}, actual) - 1) / 2.0 ry FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL"""


@query(sql(f"SELECT period, count(*) pairs, CASE WHEN count(*) > 1 AND max(rx) > min(rx) AND max(ry) > min(ry) THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END spearman FROM ({RANKS.format('period')}) GROUP BY 1"), "spearman")
def spearman_by_group(s, d):
    return ranks.spearman_by_group(forecast_pairs(s, d), "predicted", "actual", ["period"])


@query(sql("SELECT class, count(*) pairs, CASE WHEN count(*) > 1 AND max(predicted) > min(predicted) AND max(actual) > min(actual) THEN covar_pop(predicted, actual) / sqrt(var_pop(predicted) * var_pop(actual)) END pearson FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY 1"), "pearson")
def pearson_by_group(s, d):
    return metrics.pearson_by_group(forecast_pairs(s, d), "predicted", "actual", ["class"])


BIN = "CASE WHEN predicted < 0 THEN NULL WHEN predicted < 1 THEN 0 WHEN predicted < 2 THEN 1 WHEN predicted < 3 THEN 2 WHEN predicted < 4 THEN 3 WHEN predicted < 5 THEN 4 WHEN predicted < 7 THEN 5 ELSE 6 END"


@query(sql(f"SELECT CAST(b.bin AS INTEGER) bin, count(p.predicted) n, avg(p.predicted) mean_predicted, avg(p.actual) mean_actual, avg(p.predicted - p.actual) bias, avg(abs(p.predicted - p.actual)) mae, sqrt(avg((p.predicted - p.actual) ** 2)) rmse FROM range(0, 7) b(bin) LEFT JOIN (SELECT *, {BIN} bin FROM (SELECT predicted / 20 predicted, actual / 20 actual FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL)) p ON p.bin = b.bin GROUP BY 1"), "mean_predicted mean_actual bias mae rmse")
def calibration_bins(s, d):
    return metrics.calibration_bins(forecast_pairs(s, d).withColumns({"predicted": F.col("predicted") / 20, "actual": F.col("actual") / 20}), "predicted", "actual")


@query(sql(f"SELECT g.class, CAST(b.bin AS INTEGER) bin, count(p.predicted) n, avg(p.predicted) mean_predicted, avg(p.actual) mean_actual, avg(p.predicted - p.actual) bias, avg(abs(p.predicted - p.actual)) mae, sqrt(avg((p.predicted - p.actual) ** 2)) rmse FROM (SELECT DISTINCT class FROM pairs) g CROSS JOIN range(0, 7) b(bin) LEFT JOIN (SELECT *, {BIN} bin FROM (SELECT class, predicted / 20 predicted, actual / 20 actual FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL)) p ON p.bin = b.bin AND p.class = g.class GROUP BY 1, 2"), "mean_predicted mean_actual bias mae rmse")
def calibration_bands(s, d):
    return metrics.calibration_bins(forecast_pairs(s, d).withColumns({"predicted": F.col("predicted") / 20, "actual": F.col("actual") / 20}), "predicted", "actual", ["class"])


TOP = """, r AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY predicted DESC, k) p, row_number() OVER (PARTITION BY class ORDER BY actual DESC, k) a FROM (SELECT *, entity * 100 + period k FROM pairs) WHERE predicted IS NOT NULL AND actual IS NOT NULL),
o AS (SELECT class, CAST(n AS INTEGER) n, count(*) pairs, count(*) FILTER (WHERE p <= n AND a <= n) overlap FROM r, (VALUES (10), (25), (50)) v(n) GROUP BY 1, 2)"""


def keyed(s, d) -> DataFrame:
    return forecast_pairs(s, d).withColumn("k", F.col("entity") * 100 + F.col("period"))


@query(sql(f"{TOP} SELECT class, n, pairs, CASE WHEN pairs >= n THEN overlap END overlap, CASE WHEN pairs >= n THEN overlap * 100.0 / n END overlap_pct FROM o"), "overlap_pct")
def topn_overlap(s, d):
    return ranks.top_n_overlap(keyed(s, d), "predicted", "actual", "k", ["class"])


@query(sql(f"{TOP} SELECT class, n, pairs, overlap, overlap * 100.0 / least(n, pairs) overlap_pct FROM o"), "overlap_pct", name="topn_overlap_least")
def topn_overlap_least(s, d):
    return ranks.top_n_overlap(keyed(s, d), "predicted", "actual", "k", ["class"], strict=False)


@query(sql(", k AS (SELECT *, entity * 100 + period k FROM pairs WHERE predicted IS NOT NULL), r AS (SELECT class, k, row_number() OVER (PARTITION BY class ORDER BY predicted DESC, k) r FROM k) SELECT class, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) top FROM r WHERE r <= 10 GROUP BY 1"))
def topn_overlap_lists(s, d):
    lists = ranks.top_n_lists(keyed(s, d), "predicted", "k", ["class"], 10)
    return lists.select("class", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("top"))


@query(sql(f"{TOP} SELECT n, avg(CASE WHEN pairs >= n THEN overlap * 100.0 / n END) mean_overlap_pct FROM o GROUP BY 1"), "mean_overlap_pct")
def topn_summary(s, d):
    return topn_overlap(s, d).groupBy("n").agg(F.avg("overlap_pct").alias("mean_overlap_pct"))


CANDIDATES = """, seen AS (SELECT e.entity, t.target, p.period, CAST(sum(p.minutes) AS DOUBLE) m FROM (SELECT DISTINCT entity FROM panel) e CROSS JOIN targets t JOIN panel p ON p.entity = e.entity AND p.period < t.target AND p.period >= t.target - 5 AND p.ts < t.deadline GROUP BY 1, 2, 3),
wide AS (SELECT entity, target, max(m) FILTER (WHERE target - period = 1) M0, avg(m) FILTER (WHERE target - period <= 3) M1, avg(m) M2, sum(m * CASE target - period WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3 WHEN 3 THEN 0.1 END) / sum(CASE target - period WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3 WHEN 3 THEN 0.1 END) M3 FROM seen GROUP BY 1, 2),
long AS (SELECT e.entity, t.target, candidate, CASE candidate WHEN 'M0' THEN M0 WHEN 'M1' THEN M1 WHEN 'M2' THEN M2 ELSE M3 END x FROM (SELECT DISTINCT entity FROM panel) e CROSS JOIN targets t CROSS JOIN (VALUES ('M0'), ('M1'), ('M2'), ('M3')) c(candidate) LEFT JOIN wide w ON w.entity = e.entity AND w.target = t.target),
exp AS (SELECT l.entity, l.target, candidate, CASE WHEN x IS NOT NULL THEN greatest(0.0, least(90.0, x)) END predicted, CASE WHEN p.minutes IS NOT NULL THEN least(90.0, CAST(p.minutes AS DOUBLE)) END actual FROM long l LEFT JOIN periods p ON p.entity = l.entity AND p.period = l.target)"""


def minutes_experiment(s, d) -> DataFrame:
    """entity, target, candidate, predicted, actual of the minute candidates."""
    want = entities(s, d).select("entity").crossJoin(F.broadcast(targets(s)))  # six targets
    found = panel_plans.minute_candidates(panel(s, d), want)
    actual = periods(s, d).select("entity", F.col("period").alias("target"), F.least(F.lit(90.0), F.col("minutes").cast("double")).alias("actual"))
    return found.join(actual, ["entity", "target"], "left")


@query(sql(f"{CANDIDATES} SELECT entity, target, candidate, predicted, actual FROM exp"), "predicted actual")
def exp_minutes(s, d):
    return minutes_experiment(s, d).select("entity", "target", "candidate", "predicted", "actual")


@query(sql(f"{CANDIDATES} SELECT candidate, {METRICS} FROM (SELECT *, predicted - actual e FROM exp) GROUP BY 1"), METRIC_COLUMNS, name="agg_candidate_target")
def agg_candidate_target(s, d):
    return E.candidate_metrics(minutes_experiment(s, d), "candidate", "predicted", "actual")


COMMON = f"""{CANDIDATES}, common AS (SELECT a.candidate, a.predicted, b.predicted control, a.actual FROM exp a JOIN exp b ON a.entity = b.entity AND a.target = b.target AND b.candidate = 'M0' AND b.predicted IS NOT NULL WHERE a.candidate <> 'M0' AND a.predicted IS NOT NULL AND a.actual IS NOT NULL),
cm AS (SELECT candidate, count(*) pairs, avg(abs(predicted - actual)) mae, avg(abs(control - actual)) control_mae, sqrt(avg((predicted - actual) ** 2)) rmse, sqrt(avg((control - actual) ** 2)) control_rmse FROM common GROUP BY 1),
cr AS (SELECT *, (control_mae - mae) * 100 / nullif(control_mae, 0) mae_reduction_pct, (control_rmse - rmse) * 100 / nullif(control_rmse, 0) rmse_reduction_pct FROM cm)"""
COMMON_COLUMNS = "mae control_mae rmse control_rmse mae_reduction_pct rmse_reduction_pct"


def _common(s, d) -> DataFrame:
    return E.common_pair_metrics(minutes_experiment(s, d), ["entity", "target"], "candidate", "M0", "predicted", "actual")


@query(sql(f"{COMMON} SELECT * FROM cr"), COMMON_COLUMNS)
def common_pair_metrics(s, d):
    return _common(s, d)


@query(sql(f"{COMMON}, r AS (SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY predicted DESC, k) p, row_number() OVER (PARTITION BY candidate ORDER BY actual DESC, k) a FROM (SELECT a.candidate, a.predicted, a.actual, a.entity * 100 + a.target k FROM exp a JOIN exp b ON a.entity = b.entity AND a.target = b.target AND b.candidate = 'M0' AND b.predicted IS NOT NULL WHERE a.candidate <> 'M0' AND a.predicted IS NOT NULL AND a.actual IS NOT NULL)) SELECT candidate, 25 AS n, count(*) pairs, count(*) FILTER (WHERE p <= 25 AND a <= 25) overlap, count(*) FILTER (WHERE p <= 25 AND a <= 25) * 100.0 / 25 overlap_pct FROM r GROUP BY 1"), "overlap_pct")
def topn_common_pairs(s, d):
    pairs = E.common_pairs(minutes_experiment(s, d), ["entity", "target"], "candidate", "M0", "predicted", "actual").withColumn("k", F.col("entity") * 100 + F.col("target"))
    return ranks.top_n_overlap(pairs, "predicted", "actual", "k", ["candidate"], ns=(25,))


GATES = {"mae": ("mae_reduction_pct", ">=", 5.0), "rmse": ("rmse_reduction_pct", ">=", 3.0)}


@query(sql(f"{COMMON}, g AS (SELECT candidate, gate, value, '>=' comparison, threshold FROM cr, LATERAL (VALUES ('mae', mae_reduction_pct, 5.0::DOUBLE), ('rmse', rmse_reduction_pct, 3.0)) v(gate, value, threshold)) SELECT *, coalesce(value >= threshold, FALSE) passed FROM g"), "value threshold", name="gate_table_minutes")
def gate_table_minutes(s, d):
    return E.gate_table(_common(s, d).select("candidate", "mae_reduction_pct", "rmse_reduction_pct"), GATES)


@query(sql(f"{COMMON}, q AS (SELECT candidate, mae_reduction_pct, rmse, coalesce(mae_reduction_pct >= 5 AND rmse_reduction_pct >= 3, FALSE) qualifies FROM cr) SELECT *, qualifies AND row_number() OVER (PARTITION BY qualifies ORDER BY mae_reduction_pct DESC, rmse, candidate) = 1 winner FROM q"), "mae_reduction_pct rmse")
def gate_selection(s, d):
    out = E.gate_selection(_common(s, d), "candidate", GATES, [F.desc("mae_reduction_pct"), F.col("rmse")])
    return out.select("candidate", "mae_reduction_pct", "rmse", "qualifies", "winner")


RATE = """, own AS (SELECT entity, class, sum(xg) * 90.0 / nullif(sum(minutes), 0) rate, sum(minutes) m FROM periods WHERE period < 20 GROUP BY 1, 2),
grp AS (SELECT class, sum(xg) * 90.0 / nullif(sum(minutes) FILTER (WHERE xg IS NOT NULL), 0) prior FROM panel WHERE period < 20 GROUP BY 1),
later AS (SELECT entity, sum(xg) * 90.0 / nullif(sum(minutes), 0) actual FROM periods WHERE period >= 20 GROUP BY 1),
rates AS (SELECT entity, class, m, candidate, CASE candidate WHEN 's0' THEN rate WHEN 's1' THEN (rate * m + prior * 450) / (m + 450) WHEN 's2' THEN (rate * m + prior * 900) / (m + 900) ELSE CASE WHEN m < 180 THEN prior ELSE rate END END predicted, actual FROM own JOIN grp USING (class) CROSS JOIN (VALUES ('s0'), ('s1'), ('s2'), ('s3')) c(candidate) LEFT JOIN later USING (entity))"""


def rates_experiment(s, d) -> DataFrame:
    """entity, candidate, predicted, actual rate of the four stabilisers."""
    rates = panel_plans.candidate_rates(panel(s, d), TARGET).unpivot(["entity"], ["s0", "s1", "s2", "s3"], "candidate", "predicted")
    later = periods(s, d).where(F.col("period") >= TARGET).groupBy("entity").agg(F.sum("xg").alias("x"), F.sum("minutes").alias("m"))
    return rates.join(later.select("entity", X.per_90(F.col("x"), F.col("m")).alias("actual")), "entity", "left")


@query(sql(f"{RATE} SELECT candidate, {METRICS} FROM (SELECT *, predicted - actual e FROM rates) GROUP BY 1"), METRIC_COLUMNS)
def exp_rates(s, d):
    return E.candidate_metrics(rates_experiment(s, d), "candidate", "predicted", "actual")


@query(sql(f"{RATE} SELECT band, candidate, count(*) n, avg(predicted) mean_rate, avg(predicted - control) mean_change FROM (SELECT r.entity, r.candidate, r.predicted, c.predicted control, CASE WHEN r.m < 500 THEN 'under_500' ELSE 'from_500' END band FROM rates r JOIN rates c ON c.entity = r.entity AND c.candidate = 's0') GROUP BY 1, 2"), "mean_rate mean_change")
def rate_change_summary(s, d):
    rates = panel_plans.candidate_rates(panel(s, d), TARGET)
    m = panel(s, d).where(F.col("period") < TARGET).groupBy("entity").agg(F.sum("minutes").alias("m"))
    long = rates.withColumn("control", F.col("s0")).unpivot(["entity", "control"], ["s0", "s1", "s2", "s3"], "candidate", "predicted").join(m, "entity")
    band = F.when(F.col("m") < 500, "under_500").otherwise("from_500").alias("band")
    return long.groupBy(band, "candidate").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_rate"), F.avg(F.col("predicted") - F.col("control")).alias("mean_change"))


OLS = ", o AS (SELECT count(*) n, covar_pop(predicted, actual) / var_pop(predicted) slope, avg(predicted) mx, avg(actual) my FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL)"


# The fit at point i is the greatest, over first points j up to i, of the least mean of j to k from i on. A block ends where no
# mean of points up to i lies above one of points from i + 1 on.
ISOTONIC = """, pt AS MATERIALIZED (SELECT x, total, w, row_number() OVER (ORDER BY x) i, sum(total) OVER (ORDER BY x) st, sum(w) OVER (ORDER BY x) sw FROM (SELECT predicted x, sum(actual) total, count(*) w FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY 1)),
means AS MATERIALIZED (SELECT a.i j, b.i k, (b.st - a.st + a.total) / (b.sw - a.sw + a.w) m FROM pt a JOIN pt b ON b.i >= a.i),
least_mean AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) m FROM means),
fit AS (SELECT k i, max(m) y FROM least_mean GROUP BY 1),
up AS (SELECT k i, max(m) m FROM means GROUP BY 1), down AS (SELECT j i, min(m) m FROM means GROUP BY 1),
piece AS (SELECT pt.*, y, sum(CASE WHEN u.m <= d.m OR pt.i = 1 THEN 1 ELSE 0 END) OVER (ORDER BY pt.i) - 1 AS block FROM pt JOIN fit USING (i) LEFT JOIN up u ON u.i = pt.i - 1 LEFT JOIN down d ON d.i = pt.i),
blocks AS MATERIALIZED (SELECT CAST(block AS BIGINT) block, min(x) lower_x, max(x) upper_x, max(y) fitted_y, CAST(sum(w) AS BIGINT) weight FROM piece GROUP BY 1),
steps AS MATERIALIZED (SELECT *, coalesce((lag(upper_x) OVER (ORDER BY block) + lower_x) / 2, CAST('-infinity' AS DOUBLE)) from_x FROM blocks)"""


def _calibration(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecast pairs, the line and the isotonic blocks fitted to them."""
    pairs = forecast_pairs(s, d)
    return pairs, E.linear_calibration(pairs, "predicted", "actual"), E.isotonic_blocks(pairs, "predicted", "actual")


@query(sql(f"{OLS}{ISOTONIC} SELECT candidate, method, n development_n, CASE candidate WHEN 'C0' THEN 0.0 WHEN 'C1' THEN my - slope * mx END intercept, CASE candidate WHEN 'C0' THEN 1.0 WHEN 'C1' THEN slope END slope, CASE candidate WHEN 'C2' THEN (SELECT count(*) FROM blocks) END isotonic_blocks FROM o, (VALUES {', '.join(map(str, E.CALIBRATIONS.items()))}) c(candidate, method)"), "intercept slope")
def calibration_tables(s, d):
    _, line, blocks = _calibration(s, d)
    return E.calibration_parameters(line, blocks)


@query(sql(f"{ISOTONIC} SELECT block, lower_x, upper_x, fitted_y, weight, CASE WHEN block > 0 THEN from_x END from_x FROM steps"), "lower_x upper_x fitted_y from_x")
def calibration_blocks(s, d):
    """The isotonic blocks; the first one's step begins nowhere."""
    return _calibration(s, d)[2].withColumn("from_x", F.when(F.col("block") > 0, F.col("from_x")))


@query(sql(f"{OLS}{ISOTONIC}, raw AS (SELECT CAST(unnest({list(E.EXAMPLES)}) AS DOUBLE) AS raw), applied AS (SELECT raw, fitted_y FROM raw ASOF JOIN steps ON raw >= from_x) SELECT candidate, raw, CASE candidate WHEN 'C0' THEN raw WHEN 'C1' THEN my + slope * (raw - mx) ELSE fitted_y END calibrated FROM applied, o, (VALUES ('C0'), ('C1'), ('C2')) c(candidate)"), "raw calibrated")
def calibration_examples(s, d):
    _, line, blocks = _calibration(s, d)
    return E.calibration_examples(line, blocks)


@query(sql(f"{OLS}{ISOTONIC}, cal AS (SELECT p.*, fitted_y FROM pairs p ASOF LEFT JOIN steps ON p.predicted >= from_x), c AS (SELECT 'C0' candidate, predicted, actual FROM pairs UNION ALL SELECT 'C1', my + slope * (predicted - mx), actual FROM pairs, o UNION ALL SELECT 'C2', fitted_y, actual FROM cal) SELECT candidate, {METRICS} FROM (SELECT *, predicted - actual e FROM c) GROUP BY 1"), METRIC_COLUMNS)
def exp_calibration(s, d):
    """Identity, the line and the isotonic steps over the same pairs; a missing forecast stays missing in each."""
    pairs, line, blocks = _calibration(s, d)
    return E.candidate_metrics(E.calibrated(pairs, "predicted", line, blocks), "candidate", "calibrated", "actual")


@query(sql(f"{ISOTONIC} SELECT entity, period, predicted, fitted_y calibrated FROM pairs p ASOF LEFT JOIN steps ON p.predicted >= from_x"), "predicted calibrated")
def isotonic_step_apply(s, d):
    """Isotonic blocks of the forecast, applied as steps."""
    pairs, _, blocks = _calibration(s, d)
    return E.isotonic_step_apply(pairs, blocks, "predicted").select("entity", "period", "predicted", "calibrated")


DEFENSE = f"""WITH {FIXTURES}, sides AS (SELECT home defender, away attacker, kickoff, score conceded, x expected, l_orderkey * 10 + l_linenumber fixture FROM fixtures UNION ALL SELECT away, home, kickoff, 51 - score, x / 2, l_orderkey * 10 + l_linenumber FROM fixtures)"""


def defense(s, d) -> DataFrame:
    f = fixtures(s, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fixture"), "home", "away", "kickoff", (51 - F.col("score")).alias("home_score"), F.col("score").alias("away_score"), (F.col("x") / 2).alias("home_x"), F.col("x").alias("away_x"))
    return panel_plans.team_match_defense(f)


@query(f"{DEFENSE} SELECT defender, count(*) n, sum(conceded) conceded, sum(expected) expected FROM sides GROUP BY 1", "conceded expected")
def team_match_defense(s, d):
    return defense(s, d).groupBy("defender").agg(F.count(F.lit(1)).alias("n"), F.sum("conceded").alias("conceded"), F.sum("expected").alias("expected"))


# The six latest kick-offs, all matches of a kick-off together, so that ties need no arbitrary order.
FACTORS = f"""{DEFENSE}, cut AS (SELECT DISTINCT n_nationkey team, TIMESTAMP '1997-01-01' + to_days(CAST(q * 180 AS INTEGER)) deadline FROM nation, range(0, 6) r(q)),
days AS (SELECT defender, kickoff, sum(conceded) conceded, sum(expected) expected, count(*) n FROM sides GROUP BY 1, 2),
lastk AS (SELECT team, deadline, conceded, expected, n, row_number() OVER (PARTITION BY team, deadline ORDER BY kickoff DESC) r FROM cut JOIN days ON defender = team AND kickoff < deadline),
opp AS (SELECT team, deadline, sum(conceded) / sum(n) rate, CAST(sum(n) AS BIGINT) matches FROM lastk WHERE r <= 6 GROUP BY 1, 2),
lg AS (SELECT deadline, sum(conceded) / sum(n) league FROM (SELECT DISTINCT deadline FROM cut) JOIN days ON kickoff < deadline GROUP BY 1),
factors AS (SELECT team, deadline, matches, rate / league raw, CASE WHEN matches < 3 THEN 1.0 ELSE least(1.3, greatest(0.7, rate / league)) END factor, CASE WHEN matches < 3 THEN 'fewer_than_3_prior_matches' END reason FROM opp JOIN lg USING (deadline))"""


def factors(s, d) -> DataFrame:
    from panelyard.operators.asof import last_k

    days = defense(s, d).groupBy("defender", "kickoff").agg(F.sum("conceded").alias("conceded"), F.count(F.lit(1)).alias("n"))
    cut = s.range(0, 6).select(F.expr("timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(cast(id * 180 as int))").alias("deadline"))
    teams = t(s, d, "nation").select(F.col("n_nationkey").alias("defender")).crossJoin(F.broadcast(cut))  # six deadlines
    last = last_k(teams.join(days, "defender").where("kickoff < deadline"), ["defender", "deadline"], [F.desc("kickoff")], 6)
    opp = last.groupBy("defender", "deadline").agg((F.sum("conceded") / F.sum("n")).alias("rate"), F.sum("n").alias("matches"))
    by_day = days.groupBy("kickoff").agg(F.sum("conceded").alias("conceded"), F.sum("n").alias("n"))
    league = F.broadcast(cut).join(by_day, F.col("kickoff") < F.col("deadline")).groupBy("deadline").agg((F.sum("conceded") / F.sum("n")).alias("league"))  # six deadlines
    raw, factor, reason = E.opponent_factor(F.col("rate"), F.col("league"), F.col("matches"))
    return opp.join(league, "deadline").select(F.col("defender").alias("team"), "deadline", "matches", raw.alias("raw"), factor.alias("factor"), reason.alias("reason"))


@query(f"{FACTORS} SELECT * FROM factors", "raw factor")
def opponent_factor(s, d):
    return factors(s, d)


@query(f"{FACTORS} SELECT min(factor) AS low, quantile_cont(factor, 0.05) p05, quantile_cont(factor, 0.5) p50, quantile_cont(factor, 0.95) p95, max(factor) high, count(*) FILTER (WHERE factor <> raw AND reason IS NULL) * 100.0 / count(*) clipped_pct, count(*) FILTER (WHERE reason IS NOT NULL) * 100.0 / count(*) neutral_pct FROM factors", "low p05 p50 p95 high clipped_pct neutral_pct")
def factor_distribution(s, d):
    f = factors(s, d)
    out = f.agg(F.min("factor").alias("low"), F.max("factor").alias("high"), (F.count_if((F.col("factor") != F.col("raw")) & F.col("reason").isNull()) * 100.0 / F.count(F.lit(1))).alias("clipped_pct"), (F.count_if(F.col("reason").isNotNull()) * 100.0 / F.count(F.lit(1))).alias("neutral_pct"))
    return ranks.matched(out, ranks.exact_quantiles(f, [], "factor", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), [], "left")


@query(f"{FACTORS} SELECT team, count(*) contexts, count(*) FILTER (WHERE reason IS NOT NULL) neutral, avg(raw) mean_raw, avg(factor) mean_factor, min(factor) low, max(factor) high FROM factors GROUP BY 1", "mean_raw mean_factor low high")
def factor_by_opponent(s, d):
    return factors(s, d).groupBy("team").agg(F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("reason").isNotNull()).alias("neutral"), F.avg("raw").alias("mean_raw"), F.avg("factor").alias("mean_factor"), F.min("factor").alias("low"), F.max("factor").alias("high"))


@query(f"{FACTORS} SELECT count(*) pairs, covar_pop(raw, factor) / sqrt(var_pop(raw) * var_pop(factor)) pearson FROM factors", "pearson", name="factor_raw_correlation")
def factor_raw_correlation(s, d):
    return metrics.pearson_by_group(factors(s, d), "raw", "factor", [])


def _residuals(s, d) -> DataFrame:
    """Forecast pairs with a factor by entity, for the confound tables."""
    f = (70 + (F.col("entity") * 7 + F.col("period") * 13) % 61) / 100.0
    return forecast_pairs(s, d).where("predicted is not null and actual is not null").withColumn("factor", f).withColumn("residual", F.col("predicted") - F.col("actual"))


RES = ", res AS (SELECT *, (70 + (entity * 7 + period * 13) % 61) / 100.0 factor, predicted - actual residual FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL), resd AS (SELECT entity, period, class, predicted, actual, CAST(factor AS DOUBLE) factor, residual FROM res)"


FACTOR_BAND = "CASE WHEN factor = 0.7 THEN '0.70' WHEN factor < 0.85 THEN '>0.70-<0.85' WHEN factor < 0.95 THEN '0.85-<0.95' WHEN factor < 1.05 THEN '0.95-<1.05' WHEN factor < 1.15 THEN '1.05-<1.15' WHEN factor < 1.3 THEN '1.15-<1.30' ELSE '1.30' END"
BAND_NAMES = ", ".join(f"('{b}')" for b in X.FACTOR_BANDS)


@query(sql(f"{RES} SELECT b.band, count(r.residual) n, avg(residual) control_bias, avg(abs(residual)) control_mae, avg(predicted * factor - actual) bias, sqrt(avg((predicted * factor - actual) ** 2)) rmse FROM (VALUES {BAND_NAMES}) b(band) LEFT JOIN (SELECT *, {FACTOR_BAND} band FROM resd) r ON r.band = b.band GROUP BY 1"), "control_bias control_mae bias rmse", name="factor_band_residuals_minutes")
def factor_band_residuals_minutes(s, d):
    e = F.col("predicted") * F.col("factor") - F.col("actual")
    found = _residuals(s, d).groupBy(X.factor_band(F.col("factor")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("control_bias"), F.avg(F.abs("residual")).alias("control_mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))
    spine = s.range(1).select(F.explode(F.array(*[F.lit(b) for b in X.FACTOR_BANDS])).alias("band"))
    return spine.join(found, "band", "left").na.fill(0, ["n"])


@query(sql(f"{RES} SELECT entity, count(*) pairs, CASE WHEN max(residual) > min(residual) THEN covar_pop(factor, residual) / sqrt(var_pop(factor) * var_pop(residual)) END pearson FROM resd GROUP BY 1 HAVING count(*) >= 6 AND max(factor) - min(factor) >= 0.2"), "pearson")
def within_player_confound(s, d):
    rows = _residuals(s, d)
    wide = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), (F.max("factor") - F.min("factor")).alias("spread")).where("n >= 6 and spread >= 0.2")
    return metrics.pearson_by_group(rows.join(wide, "entity", "left_semi"), "factor", "residual", ["entity"])


@query(sql(f"{RES} SELECT CASE WHEN predicted < 30 THEN 'low' WHEN predicted < 80 THEN 'middle' ELSE 'high' END tier, count(*) pairs, covar_pop(factor, residual) / sqrt(var_pop(factor) * var_pop(residual)) pearson FROM resd GROUP BY 1"), "pearson")
def rate_tier_confound(s, d):
    tier = F.when(F.col("predicted") < 30, "low").when(F.col("predicted") < 80, "middle").otherwise("high")
    return metrics.pearson_by_group(_residuals(s, d).withColumn("tier", tier), "factor", "residual", ["tier"])


@query(f"{FACTORS}, b AS (SELECT f.team, f.deadline, candidate, CASE candidate WHEN 'F0' THEN 10.0 WHEN 'F1' THEN 10.0 * factor ELSE 10.0 * (1 + factor) / 2 END predicted FROM factors f, (VALUES ('F0'), ('F1'), ('F2')) c(candidate)) SELECT candidate, count(*) n, sum(predicted) total FROM b GROUP BY 1", "total", name="exp_opponent_totals")
def exp_opponent_totals(s, d):
    f = F.col("factor")
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), v.alias("predicted")) for c, v in {"F0": F.lit(10.0), "F1": 10.0 * f, "F2": 10.0 * (1 + f) / 2}.items()])
    return factors(s, d).select(F.explode(rows).alias("r")).select("r.*").groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("total"))


@query("SELECT p_type AS class, quantile_cont(p_retailprice, 0.9) FILTER (WHERE p_size > 5) p90, quantile_cont(p_retailprice, 0.95) FILTER (WHERE p_size > 5) p95, quantile_cont(p_retailprice, 0.99) FILTER (WHERE p_size > 5) p99, count(*) FILTER (WHERE p_size > 5) used, count(*) FILTER (WHERE p_size <= 5) excluded FROM part GROUP BY 1", "p90 p95 p99")
def rate_reference(s, d):
    return lineup.rate_reference(t(s, d, "part").withColumnRenamed("p_type", "class"), ["class"], "p_retailprice", F.col("p_size") > 5)


@query(sql("SELECT state, count(*) n FROM (SELECT CASE WHEN predicted IS NULL THEN 'missing_prediction' WHEN actual IS NULL THEN 'missing_actual' END state FROM pairs) WHERE state IS NOT NULL GROUP BY 1"))
def exclusion_counts(s, d):
    state = F.when(F.col("predicted").isNull(), "missing_prediction").when(F.col("actual").isNull(), "missing_actual")
    return forecast_pairs(s, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n")).where("state is not null")


ELIGIBLE = f""", {SEASONS}, el AS (SELECT code, n.minutes, o.minutes prior, CASE WHEN o.code IS NULL THEN 'no_previous_season_code_match' WHEN o.class <> n.class THEN 'position_mismatch' WHEN o.minutes = 0 THEN 'zero_previous_season_minutes' WHEN o.minutes < 450 THEN 'previous_season_minutes_below_450' ELSE 'eligible' END reason FROM new n LEFT JOIN old o USING (code))"""


def eligible(s, d) -> DataFrame:
    from panelyard.operators.joins import code_bridge

    old, new = seasons(s, d)
    rows = code_bridge(new, old, "code", "left")
    reason = F.when(F.col("prior_minutes").isNull(), "no_previous_season_code_match").when(F.col("prior_class") != F.col("class"), "position_mismatch").when(F.col("prior_minutes") == 0, "zero_previous_season_minutes").when(F.col("prior_minutes") < 450, "previous_season_minutes_below_450").otherwise("eligible")
    return rows.withColumn("reason", reason)


@query(sql(f"{ELIGIBLE} SELECT reason, count(*) n FROM el GROUP BY 1"), name="eligibility_customers")
def eligibility_customers(s, d):
    return eligible(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"{ELIGIBLE} SELECT candidate, count(*) n, sum(CASE WHEN candidate = 'C1' AND reason = 'eligible' THEN (minutes * minutes + prior * 450.0) / (minutes + 450.0) ELSE minutes END) total FROM el, (VALUES ('C0'), ('C1')) v(candidate) GROUP BY 1"), "total", name="exp_season_prior_minutes")
def exp_season_prior_minutes(s, d):
    m, p = F.col("minutes").cast("double"), F.col("prior_minutes").cast("double")
    c1 = F.when(F.col("reason") == "eligible", X.shrunk_rate(m, m, p, 450.0)).otherwise(m)
    rows = F.array(F.struct(F.lit("C0").alias("candidate"), m.alias("v")), F.struct(F.lit("C1").alias("candidate"), c1.alias("v")))
    return eligible(s, d).select(F.explode(rows).alias("r")).select("r.*").groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("SELECT o_orderkey, sum(l_extendedprice) lines, any_value(o_totalprice) stated, sum(l_extendedprice) - any_value(o_totalprice) gap, abs(sum(l_extendedprice) - any_value(o_totalprice)) > 0.05 material FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING abs(sum(l_extendedprice) - any_value(o_totalprice)) > 0.001", "lines stated gap")
def season_reconciliation(s, d):
    sums = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(X.strict_sum(F.col("l_extendedprice")).alias("lines"))
    rows = sums.join(t(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated")), "o_orderkey").withColumn("gap", F.col("lines") - F.col("stated"))
    return rows.where(F.abs("gap") > 0.001).withColumn("material", F.abs("gap") > 0.05)


@query(sql("SELECT field, count(*) n, CAST(sum(difference) AS BIGINT) difference FROM (SELECT p.entity, unnest(['minutes', 'starts']) field, unnest([e.m - p.minutes, e.s - p.starts]) difference FROM periods p JOIN (SELECT user_id, day(ts) d, sum(CAST(floor(value) AS BIGINT)) + CASE WHEN user_id % 9 = 4 AND day(ts) = 5 THEN 1 ELSE 0 END m, count(*) FILTER (WHERE event_type = 'purchase' AND value < 240) s FROM events GROUP BY 1, 2, user_id % 9) e ON e.user_id = p.entity AND e.d = p.period) WHERE difference <> 0 GROUP BY 1"))
def exact_reconciliation(s, d):
    """Period sums against a source that says otherwise of some users' fifth day and misses dear purchases: fields, how many rows differ, by how much."""
    e = t(s, d, "events")
    direct = e.groupBy(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("period")).agg(F.sum(F.floor("value")).alias("m"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") < 240)).alias("s"))
    seeded = F.when((F.col("entity") % 9 == 4) & (F.col("period") == 5), 1).otherwise(0)
    both = periods(s, d).join(direct, ["entity", "period"]).withColumns({"minutes": F.col("m") + seeded - F.col("minutes"), "starts": F.col("s") - F.col("starts")})
    return both.unpivot(["entity", "period"], ["minutes", "starts"], "field", "difference").where("difference <> 0").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("difference").alias("difference"))


@query(f"WITH {FIXTURES}, s AS (SELECT year(kickoff) period, home team FROM fixtures UNION ALL SELECT year(kickoff), away FROM fixtures), g AS (SELECT y.period, n_nationkey team, count(s.team) n FROM (SELECT DISTINCT period FROM s) y CROSS JOIN nation LEFT JOIN s ON s.period = y.period AND s.team = n_nationkey GROUP BY 1, 2) SELECT CAST(period AS INTEGER) period, count(*) FILTER (WHERE n = 0) blanks, count(*) FILTER (WHERE n > 1) doubles, string_agg(CAST(team AS VARCHAR), ',' ORDER BY team) FILTER (WHERE n > 1) double_teams FROM g GROUP BY 1")
def fixture_structure(s, d):
    from panelyard.operators.joins import side_rows

    sides = side_rows(fixtures(s, d), "home", "away").groupBy(F.year("kickoff").alias("period"), "team").agg(F.count(F.lit(1)).alias("n"))
    spine = sides.select("period").distinct().join(t(s, d, "nation").select(F.col("n_nationkey").alias("team")), F.lit(True))
    grid = spine.join(sides, ["period", "team"], "left").na.fill(0, ["n"])
    doubles = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("team"))))
    return grid.groupBy("period").agg(F.count_if(F.col("n") == 0).alias("blanks"), F.count_if(F.col("n") > 1).alias("doubles"), F.nullif(F.array_join(F.transform(doubles, lambda x: x.cast("string")), ","), F.lit("")).alias("double_teams"))


@query(sql(f", {SEASONS} SELECT count(*) shared, count(*) FILTER (WHERE o.minutes <> n.minutes) changed_minutes, count(*) FILTER (WHERE o.class <> n.class) changed_class FROM old o JOIN new n USING (code)"))
def identity_transition(s, d):
    old, new = seasons(s, d)
    rows = new.join(old.select("code", F.col("class").alias("c"), F.col("minutes").alias("m")), "code")
    return rows.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("m") != F.col("minutes")).alias("changed_minutes"), F.count_if(F.col("c") != F.col("class")).alias("changed_class"))


@query("SELECT p_brand, count(DISTINCT p_name) names, string_agg(DISTINCT p_name, ',' ORDER BY p_name) variants FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def name_variants(s, d):
    g = t(s, d, "part").groupBy("p_brand").agg(F.count_distinct("p_name").alias("names"), F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("variants"))
    return g.where("names > 1")


@query("SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def group_by_all_having(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


@query("SELECT o_custkey, count(*) n, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) fixtures, coalesce(sum(x) FILTER (WHERE o_orderstatus <> 'P'), 0.0) x_sum, CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') = 0 THEN 0.0 WHEN count(x) FILTER (WHERE o_orderstatus <> 'P') = count(*) FILTER (WHERE o_orderstatus <> 'P') THEN sum(x) FILTER (WHERE o_orderstatus <> 'P') END x_strict, bool_and(o_orderstatus = 'F') all_final, bool_or(o_orderstatus = 'O') any_open FROM (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END x FROM orders) GROUP BY 1", "x_sum x_strict")
def agg_fixture_to_period(s, d):
    o = t(s, d, "orders").withColumns({"x": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")), "has": F.col("o_orderstatus") != "P"})
    rolled = panel_plans.fixture_to_period(o, ["o_custkey"], ["x"], "has")
    flags = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"), F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))
    return rolled.join(flags, "o_custkey")


@query(sql("SELECT entity, period, class, count(*) fixtures, CAST(sum(minutes) AS BIGINT) AS minutes, sum(CASE WHEN NOT appeared THEN NULL WHEN minutes <= 0 THEN 0.0 WHEN minutes < 60 THEN 1.0 ELSE 2.0 END) appearance, CAST(sum(points * CASE class WHEN 'GK' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END) AS DOUBLE) goal_points FROM panel GROUP BY 1, 2, 3"), "appearance goal_points")
def agg_actuals(s, d):
    p = panel(s, d).withColumn("a", X.appearance_points(F.when(F.col("appeared"), F.col("minutes"))))
    return p.groupBy("entity", "period", "class").agg(F.count(F.lit(1)).alias("fixtures"), F.sum("minutes").alias("minutes"), F.sum("a").alias("appearance"), F.sum(F.col("points") * X.class_points(F.col("class"))).alias("goal_points"))
