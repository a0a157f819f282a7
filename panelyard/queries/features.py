"""Expressions, as-of features and joins over the history panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import asof, joins, ranks
from panelyard.plans import panel_plans
from panelyard.queries.base import MEASURES, TARGET, entities, forecast_pairs, panel, periods, query, sql, t, targets

# Scalar expressions


@query("""SELECT event_id, CASE WHEN v LIKE 'x%' THEN 'x' ELSE v END AS raw, CASE WHEN isfinite(x) THEN x END cleaned, trim(v) <> '' AND (x IS NULL OR NOT isfinite(x)) violation
FROM (SELECT event_id, v, TRY_CAST(nullif(trim(v), '') AS DOUBLE) x FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'x' || value WHEN 2 THEN 'Infinity' ELSE ' ' || CAST(floor(value) AS BIGINT) END v FROM events))""", "cleaned")
def clean_numeric(s, d):
    v = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 5 == 1, F.concat(F.lit("x"), F.col("value").cast("string"))).when(F.col("event_id") % 5 == 2, "Infinity").otherwise(F.concat(F.lit(" "), F.floor("value").cast("string")))
    e = t(s, d, "events").select("event_id", v.alias("raw"))
    out = e.withColumn("cleaned", X.clean_numeric(F.col("raw"))).withColumn("violation", X.violates(F.col("raw"), F.col("cleaned")))
    return out.withColumn("raw", F.when(F.col("event_id") % 5 == 1, "x").otherwise(F.col("raw")))


@query("""SELECT event_id, CASE WHEN trim(v) ~ '^[+-]?[0-9]+$' THEN CAST(trim(v) AS BIGINT) END cleaned, NOT coalesce(trim(v) ~ '^[+-]?[0-9]+$', FALSE) violation
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '1.5' ELSE ' ' || event_id END v FROM events)""")
def clean_int(s, d):
    v = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "1.5").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    e = t(s, d, "events").select("event_id", v.alias("raw")).withColumn("cleaned", X.clean_int(F.col("raw")))
    return e.select("event_id", "cleaned", X.violates(F.col("raw"), F.col("cleaned"), nullable=False).alias("violation"))


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE END cleaned, event_type NOT IN ('view', 'click') violation, count(*) n FROM events GROUP BY 1, 2, 3""")
def clean_bool(s, d):
    v = F.when(F.col("event_type") == "view", "True").when(F.col("event_type") == "click", "False").otherwise(F.col("event_type"))
    e = t(s, d, "events").withColumn("raw", v).withColumn("cleaned", X.clean_bool(F.col("raw")))
    return e.groupBy("event_type", "cleaned", X.violates(F.col("raw"), F.col("cleaned")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS micros FROM events""")
def clean_utc_ts(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "").otherwise("Z"))
    return t(s, d, "events").select("event_id", F.unix_micros(X.clean_utc_ts(text)).alias("micros"))


@query("""SELECT p_partkey, CAST(round(p_retailprice * 10) AS INTEGER) tenths, round(p_retailprice * 10) / 10 millions FROM part""", "millions")
def price_scale(s, d):
    p = t(s, d, "part").select("p_partkey", X.to_tenths(F.col("p_retailprice")).alias("tenths"))
    return p.withColumn("millions", X.to_millions(F.col("tenths")))


FIXTURES = """fixtures AS (SELECT l_orderkey, l_linenumber, s_nationkey home, c_nationkey away, l_shipdate kickoff, l_quantity score, l_extendedprice x, l_partkey, l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


def fixtures(s, d) -> DataFrame:
    """Order lines as fixtures: the supplier's nation at home to the customer's."""
    li = t(s, d, "lineitem").join(t(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return li.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("home"), F.col("c_nationkey").alias("away"), F.col("l_shipdate").alias("kickoff"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("x"), "l_partkey", "l_suppkey")


@query(f"""WITH {FIXTURES} SELECT CASE WHEN home = 3 THEN 'H' WHEN away = 3 THEN 'A' END side, CASE WHEN home = 3 THEN away WHEN away = 3 THEN home END opponent, count(*) n FROM fixtures GROUP BY 1, 2""")
def home_away_derive(s, d):
    side, opponent = X.sides(F.lit(3), F.col("home"), F.col("away"))
    return fixtures(s, d).groupBy(side.alias("side"), opponent.alias("opponent")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT event_id, CASE WHEN NOT appeared THEN NULL WHEN minutes <= 0 THEN 0.0::DOUBLE WHEN minutes < 60 THEN 1.0 ELSE 2.0 END AS appearance FROM panel"), "appearance")
def appearance_points(s, d):
    return panel(s, d).select("event_id", X.appearance_points(F.when(F.col("appeared"), F.col("minutes"))).alias("appearance"))


@query(sql("SELECT class, count(*) n, min(CASE class WHEN 'GK' THEN 10.0::DOUBLE WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END) weight FROM panel GROUP BY 1"), "weight")
def position_points(s, d):
    return panel(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(X.class_points(F.col("class"))).alias("weight"))


@query(sql("SELECT event_id, CASE WHEN xg IS NOT NULL THEN greatest(0.0, least(20.0, xg - 1)) END clamped FROM panel"), "clamped")
def clamp(s, d):
    return panel(s, d).select("event_id", X.clamp(F.col("xg") - 1, 0.0, 20.0).alias("clamped"))


GATE = """SELECT event_id, CASE WHEN k AND c AND chance = 0 THEN 'explicit_zero_chance' WHEN k AND st = 's' THEN 'suspended' WHEN k AND st = 'u' THEN 'unavailable' END reason, CAST(minutes AS DOUBLE) m
FROM (SELECT event_id, minutes, substr(event_type, 1, 1) st, event_id % 3 <> 0 k, event_id % 2 = 0 c, event_id % 4 * 25 chance FROM panel)"""


@query(sql(f"SELECT event_id, reason, CASE WHEN reason IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(90.0, m)) END expected FROM ({GATE})"), "expected")
def availability_gate(s, d):
    p = panel(s, d).withColumn("reason", X.availability_reason(F.substring("event_type", 1, 1), F.col("event_id") % 4 * 25, F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0))
    return p.select("event_id", "reason", X.gated_minutes(F.col("minutes"), F.col("reason")).alias("expected"))


@query(sql("SELECT event_id, CASE WHEN period = 20 THEN minutes END chance FROM panel"))
def conditional_exposure(s, d):
    return panel(s, d).select("event_id", X.exposed_if(F.col("minutes"), F.col("period") == TARGET).alias("chance"))


@query(sql("SELECT entity, period, CASE WHEN minutes > 0 THEN xg * 90.0 / minutes END xg_90, CASE WHEN minutes > 0 THEN xa * 90.0 / minutes END xa_90 FROM periods"), "xg_90 xa_90")
def per_90_rate(s, d):
    return periods(s, d).select("entity", "period", X.per_90(F.col("xg"), F.col("minutes")).alias("xg_90"), X.per_90(F.col("xa"), F.col("minutes")).alias("xa_90"))


BANDS = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} = 0 THEN '0' WHEN {0} < 30 THEN '1-29' WHEN {0} < 60 THEN '30-59' WHEN {0} < 90 THEN '60-89' ELSE '90' END"


@query(sql(f"SELECT {BANDS.format('predicted')} AS band, count(*) n FROM pairs GROUP BY 1"), name="band_labels_minutes")
def band_labels_minutes(s, d):
    return forecast_pairs(s, d).groupBy(X.minute_band(F.col("predicted")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT entity, period, CASE WHEN actual IS NULL AND predicted IS NULL THEN 'both_missing' WHEN actual IS NULL THEN 'missing_actual' WHEN predicted IS NULL THEN 'missing_prediction' WHEN actual = 0 THEN 'actual_zero' ELSE 'valid' END state FROM pairs"))
def state_classify(s, d):
    return forecast_pairs(s, d).select("entity", "period", panel_plans.pair_state(F.col("predicted"), F.col("actual")).alias("state"))


@query(sql("SELECT entity, period, predicted - actual AS error, abs(predicted - actual) absolute, (predicted - actual) ** 2 squared FROM pairs"), "error absolute squared")
def error_columns(s, d):
    e, a, q = X.errors(F.col("predicted"), F.col("actual"))
    return forecast_pairs(s, d).select("entity", "period", e.alias("error"), a.alias("absolute"), q.alias("squared"))


POPULATIONS = "(VALUES ('all', TRUE), ('early', period <= 10), ('low', predicted < 30), ('gk', class = 'GK')) v(population, member)"


@query(sql(f"SELECT population, count(*) n, sum(predicted) total FROM pairs, {POPULATIONS} WHERE member GROUP BY 1"), "total")
def population_filter(s, d):
    names = X.named_rows({"all": F.lit(True), "early": F.col("period") <= 10, "low": F.col("predicted") < 30, "gk": F.col("class") == "GK"})
    return forecast_pairs(s, d).withColumn("population", F.explode(names)).groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("total"))


@query(sql("SELECT scope, count(*) n FROM pairs, (VALUES ('P2-5', period BETWEEN 2 AND 5), ('P6-10', period BETWEEN 6 AND 10), ('P11+', period >= 11), ('overall', TRUE)) v(scope, member) WHERE member GROUP BY 1"))
def scope_filter(s, d):
    p = F.col("period")
    names = X.named_rows({"P2-5": p.between(2, 5), "P6-10": p.between(6, 10), "P11+": p >= 11, "overall": F.lit(True)})
    return forecast_pairs(s, d).withColumn("scope", F.explode(names)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


RATES = """own AS (SELECT entity, class, sum(xg) * 90.0 / nullif(sum(minutes), 0) rate, sum(minutes) m FROM periods WHERE period < 20 GROUP BY 1, 2),
grp AS (SELECT class, sum(xg) * 90.0 / nullif(sum(minutes) FILTER (WHERE xg IS NOT NULL), 0) prior FROM panel WHERE period < 20 GROUP BY 1)"""


@query(sql(f", {RATES} SELECT entity, rate AS s0, (rate * m + prior * 450) / (m + 450) s1, (rate * m + prior * 900) / (m + 900) s2, CASE WHEN m < 180 THEN prior ELSE rate END s3 FROM own JOIN grp USING (class)"), "s0 s1 s2 s3")
def stabilized_rate(s, d):
    return panel_plans.candidate_rates(panel(s, d), TARGET)


@query(sql(", own AS (SELECT entity, sum(xg) FILTER (WHERE period > 15) * 90.0 / nullif(sum(minutes) FILTER (WHERE period > 15), 0) now, sum(minutes) FILTER (WHERE period > 15) m, sum(xg) FILTER (WHERE period <= 15) * 90.0 / nullif(sum(minutes) FILTER (WHERE period <= 15), 0) old FROM periods GROUP BY 1) SELECT entity, (now * m + old * 450) / (m + 450) blended FROM own"), "blended")
def season_blend_rate(s, d):
    late, p = F.col("period") > 15, periods(s, d)
    own = p.groupBy("entity").agg(F.sum(F.when(late, F.col("xg"))).alias("x"), F.sum(F.when(late, F.col("minutes"))).alias("m"), F.sum(F.when(~late, F.col("xg"))).alias("px"), F.sum(F.when(~late, F.col("minutes"))).alias("pm"))
    return own.select("entity", X.shrunk_rate(X.per_90(F.col("x"), F.col("m")), F.nullif("m", F.lit(0)), X.per_90(F.col("px"), F.col("pm")), 450.0).alias("blended"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR p_partkey = 7 ORDER BY p_name, p_partkey LIMIT 20 OFFSET 5")
def catalogue_search(s, d):
    p = t(s, d, "part")
    return p.where(F.lower("p_name").contains("ring") | (F.col("p_partkey") == 7)).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(5).limit(20)


# As-of features


@query(sql('SELECT entity, class, period, "rows", appearances, minutes, starts, points, xg, xa FROM periods'), "xg xa")
def agg_entity_period(s, d):
    return periods(s, d)


@query(sql('SELECT entity, period, count(*) AS "rows", count(*) FILTER (WHERE appeared) appearances, CASE WHEN count(xg) = count(*) THEN sum(xg) END xg FROM panel GROUP BY 1, 2'), "xg", name="agg_entity_period_strict")
def agg_entity_period_strict(s, d):
    return asof.agg_entity_period(panel(s, d), ["entity"], "period", ["xg"], F.col("appeared"), strict=True)


@query(sql('SELECT entity, count(*) periods, CAST(sum("rows") AS BIGINT) AS "rows", CAST(sum(appearances) AS BIGINT) appearances, CAST(sum(minutes) AS BIGINT) prior_minutes, sum(xg) prior_xg, avg(minutes) prior_avg_minutes, avg(xg) prior_avg_xg, max(period) max_period FROM periods WHERE period < 20 GROUP BY 1'), "prior_xg prior_avg_minutes prior_avg_xg")
def feat_prior(s, d):
    return asof.feat_prior(periods(s, d), ["entity"], "period", ["minutes", "xg"], TARGET)


@query(sql("SELECT entity, minutes, points, xg FROM periods WHERE period = 19"), "xg")
def feat_previous_period(s, d):
    return asof.feat_previous_period(periods(s, d), "period", TARGET).select("entity", "minutes", "points", "xg")


WINDOWS = """SELECT entity, count(*) prior_periods, max(period) max_period, CAST(sum(minutes) AS BIGINT) prior_minutes, avg(minutes) prior_avg_minutes, CAST(sum(minutes) FILTER (WHERE period = 19) AS BIGINT) previous_minutes, sum(xg) prior_xg, avg(xg) prior_avg_xg, sum(xg) FILTER (WHERE period = 19) previous_xg,
  count(*) FILTER (WHERE period >= 17) last3_periods, CAST(sum(minutes) FILTER (WHERE period >= 17) AS BIGINT) last3_minutes, avg(minutes) FILTER (WHERE period >= 17) last3_avg_minutes, sum(xg) FILTER (WHERE period >= 17) last3_xg, avg(xg) FILTER (WHERE period >= 17) last3_avg_xg,
  count(*) FILTER (WHERE period >= 15) last5_periods, CAST(sum(minutes) FILTER (WHERE period >= 15) AS BIGINT) last5_minutes, avg(minutes) FILTER (WHERE period >= 15) last5_avg_minutes, sum(xg) FILTER (WHERE period >= 15) last5_xg, avg(xg) FILTER (WHERE period >= 15) last5_avg_xg
FROM periods WHERE period < 20 GROUP BY 1"""


@query(sql(WINDOWS), "prior_avg_minutes prior_xg prior_avg_xg previous_xg last3_avg_minutes last3_xg last3_avg_xg last5_avg_minutes last5_xg last5_avg_xg")
def feat_rolling_window(s, d):
    return asof.feat_windows(periods(s, d), ["entity"], "period", ["minutes", "xg"], TARGET)


@query(sql("SELECT c.entity, c.period, count(p.period) last3_periods, CAST(sum(p.minutes) AS BIGINT) last3_minutes FROM periods c LEFT JOIN periods p ON p.entity = c.entity AND p.period BETWEEN c.period - 3 AND c.period - 1 GROUP BY 1, 2"), name="feat_rolling_all_periods")
def feat_rolling_all_periods(s, d):
    return asof.feat_rolling_all(periods(s, d), ["entity"], "period", ["minutes"], 3)


@query(sql("SELECT target, entity, count(*) n, CAST(sum(minutes) AS BIGINT) AS minutes, max(ts) latest FROM targets JOIN panel ON period < target AND period >= target - 5 AND ts < deadline GROUP BY 1, 2"))
def join_asof_range(s, d):
    want = entities(s, d).select("entity").crossJoin(F.broadcast(targets(s)))  # six targets
    joined = asof.join_asof_range(want, panel(s, d), ["entity"], "period", "ts", "target", "deadline", back=5)
    return joined.groupBy("target", "entity").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"), F.max("ts").alias("latest"))


GROUP_RATE = "SELECT target, deadline, class, sum(xg) xg_sum, CAST(sum(minutes) FILTER (WHERE xg IS NOT NULL) AS BIGINT) xg_minutes FROM targets JOIN panel ON period < target AND ts < deadline GROUP BY 1, 2, 3"


def _group_history(s, d) -> DataFrame:
    want = entities(s, d).select("class").distinct().crossJoin(F.broadcast(targets(s)))  # six targets
    return asof.join_group_history(want, panel(s, d), "class", "period", "ts", "target", "deadline", asof.group_rate_sums("xg", "minutes"))


@query(sql(GROUP_RATE), "xg_sum")
def join_group_history(s, d):
    return _group_history(s, d)


@query(sql(f"SELECT target, class, xg_sum * 90.0 / xg_minutes AS rate FROM ({GROUP_RATE})"), "rate")
def group_rate_prior(s, d):
    return _group_history(s, d).select("target", "class", X.per_90(F.col("xg_sum"), F.col("xg_minutes")).alias("rate"))


@query(sql(f"SELECT target, sum(xg_sum) * 90.0 / sum(xg_minutes) AS rate FROM ({GROUP_RATE}) GROUP BY 1"), "rate")
def league_baseline(s, d):
    g = _group_history(s, d).groupBy("target").agg(F.sum("xg_sum").alias("x"), F.sum("xg_minutes").alias("m"))
    return g.select("target", X.per_90(F.col("x"), F.col("m")).alias("rate"))


@query(sql("SELECT entity, sum(minutes * w) / sum(w) recency FROM (SELECT entity, minutes, CASE 20 - period WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3 WHEN 3 THEN 0.1 END w FROM periods WHERE period BETWEEN 17 AND 19) GROUP BY 1"), "recency")
def weighted_recency_mean(s, d):
    p = periods(s, d).where(F.col("period").between(TARGET - 3, TARGET - 1))
    return p.groupBy("entity").agg(asof.weighted_recency_mean(TARGET - F.col("period"), F.col("minutes")).alias("recency"))


# Joins


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def join_lookup(s, d):
    c = joins.join_lookup(t(s, d, "customer"), t(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return joins.join_lookup(c, t(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("c_custkey", "c_name", "n_name", "r_name")


@query(f"WITH {FIXTURES} SELECT n_nationkey team, n_name, count(home) n, coalesce(CAST(sum(CASE WHEN n_nationkey = home AND home <> away THEN 1 ELSE 0 END) AS BIGINT), 0) home_only FROM nation LEFT JOIN fixtures ON n_nationkey = home OR n_nationkey = away GROUP BY 1, 2")
def join_side_or(s, d):
    sides = joins.side_rows(fixtures(s, d), "home", "away")
    sides = sides.where((F.col("side") == "H") | (F.col("home") != F.col("away")))
    n = sides.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("side") == "H") & (F.col("home") != F.col("away"))).alias("home_only"))
    return t(s, d, "nation").select(F.col("n_nationkey").alias("team"), "n_name").join(n, "team", "left").na.fill(0, ["n", "home_only"])


@query(sql("SELECT candidate, count(*) n, CAST(sum(minutes) AS BIGINT) AS minutes FROM periods, (VALUES ('M0'), ('M1'), ('M2')) v(candidate) GROUP BY 1"))
def join_cross_candidates(s, d):
    return joins.join_candidates(periods(s, d), ["M0", "M1", "M2"]).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))


@query(sql("SELECT entity, period, minutes FROM periods p WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = p.entity AND o_orderstatus = 'F')"))
def join_semi_universe(s, d):
    known = t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"))
    return periods(s, d).join(known, "entity", "left_semi").select("entity", "period", "minutes")


@query(sql("SELECT e.entity, t.target, lag, t.target - lag AS source_period, p.minutes FROM (SELECT DISTINCT entity FROM panel) e, (SELECT target FROM targets WHERE target >= 19) t, range(1, 6) r(lag) LEFT JOIN periods p ON p.entity = e.entity AND p.period = t.target - lag").replace("lag, t.target", "CAST(lag AS INTEGER) lag, t.target").replace("t.target - lag AS", "CAST(t.target - lag AS INTEGER) AS"))
def join_lag_expand(s, d):
    want = entities(s, d).select("entity").crossJoin(F.broadcast(targets(s, 19, 20).select("target")))  # two targets
    return joins.lag_expand(want, "target", 5).join(periods(s, d).select("entity", F.col("period").alias("source_period"), "minutes"), ["entity", "source_period"], "left")


@query(sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT entity FROM panel)"))
def join_anti_missing(s, d):
    return joins.anti(t(s, d, "customer").select("c_custkey"), panel(s, d).withColumnRenamed("entity", "c_custkey"), ["c_custkey"])


@query(sql("SELECT coalesce(a.entity, b.entity) entity, a.minutes AS first, b.minutes AS second FROM (SELECT entity, minutes FROM periods WHERE period = 3) a FULL JOIN (SELECT entity, minutes FROM periods WHERE period = 4) b ON a.entity = b.entity"))
def join_full_outer_outcome(s, d):
    p = periods(s, d)
    return joins.full_outcome(p.where("period = 3").select("entity", F.col("minutes").alias("first")), p.where("period = 4").select("entity", F.col("minutes").alias("second")), ["entity"])


@query(sql(", k AS (SELECT entity, period, CASE WHEN period % 5 <> 0 THEN minutes END fixture FROM periods) SELECT a.entity, a.fixture, a.period, b.period other FROM k a JOIN k b ON a.entity = b.entity AND a.fixture IS NOT DISTINCT FROM b.fixture AND a.period < b.period"))
def join_null_safe_key(s, d):
    k = periods(s, d).select("entity", "period", F.when(F.col("period") % 5 != 0, F.col("minutes")).alias("fixture"))
    return joins.null_safe(k, k.withColumnRenamed("period", "other"), ["entity", "fixture"]).where("period < other").select("entity", "fixture", "period", "other")


@query(sql(", c AS (SELECT entity, period, candidate, minutes * f AS value FROM periods, (VALUES ('M0', 1), ('M1', 2)) v(candidate, f)) SELECT a.entity, a.period, a.candidate, a.value - b.value delta FROM c a JOIN c b ON a.entity = b.entity AND a.period = b.period AND b.candidate = 'M0'"))
def join_self_candidate(s, d):
    c = joins.join_candidates(periods(s, d), ["M0", "M1"]).withColumn("value", F.col("minutes") * F.when(F.col("candidate") == "M0", 1).otherwise(2))
    out = joins.against_control(c, ["entity", "period"], "candidate", "M0", ["value"])
    return out.select("entity", "period", "candidate", (F.col("value") - F.col("control_value")).alias("delta"))


SEASONS = "old AS (SELECT entity code, class, CAST(sum(minutes) AS BIGINT) AS minutes FROM periods WHERE period <= 15 GROUP BY 1, 2), new AS (SELECT entity code, class, CAST(sum(minutes) AS BIGINT) AS minutes FROM periods WHERE period > 15 GROUP BY 1, 2)"


def seasons(s, d) -> tuple[DataFrame, DataFrame]:
    p = periods(s, d)
    total = lambda x: x.groupBy(F.col("entity").alias("code"), "class").agg(F.sum("minutes").alias("minutes"))
    return total(p.where("period <= 15")), total(p.where("period > 15"))


@query(sql(f", {SEASONS} SELECT code, n.class, n.minutes, o.class prior_class, o.minutes prior_minutes FROM new n LEFT JOIN old o USING (code)"))
def join_code_bridge(s, d):
    old, new = seasons(s, d)
    return joins.code_bridge(new, old, "code", "left")


# Windows


@query(f"WITH {FIXTURES} SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) fixture_count FROM fixtures")
def win_fixture_count(s, d):
    return fixtures(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("fixture_count"))


@query(sql("SELECT entity, period, rank() OVER (PARTITION BY period ORDER BY minutes) + (count(*) OVER (PARTITION BY period, minutes) - 1) / 2.0 average_rank FROM periods"), "average_rank")
def win_average_rank(s, d):
    return ranks.average_rank(periods(s, d), "minutes", ["period"], "average_rank").select("entity", "period", "average_rank")


LAST6 = "SELECT entity, event_id, ts, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rank FROM panel WHERE ts < TIMESTAMP '2024-01-19 18:00:00'"


def _last6(s, d) -> DataFrame:
    before = panel(s, d).where("ts < timestamp_ntz'2024-01-19 18:00:00'").select("entity", "event_id", "ts")
    return asof.last_k(before, ["entity"], [F.desc("ts"), F.desc("event_id")], 6)


@query(sql(f"SELECT entity, event_id, CAST(rank AS INTEGER) AS rank FROM ({LAST6}) WHERE rank <= 6"))
def win_last_k_matches(s, d):
    return _last6(s, d).select("entity", "event_id", "rank")


@query(sql(f"SELECT entity, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rank) sources FROM ({LAST6}) WHERE rank <= 6 GROUP BY 1"))
def win_source_list(s, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string"))
    return _last6(s, d).groupBy("entity").agg(F.array_join(ids, ",").alias("sources"))


SCORED = """, f AS (SELECT entity, class, sum(minutes) m, sum(xg) xg, sum(xa) xa, max(minutes) FILTER (WHERE period = 19) previous, count(*) n FROM periods WHERE period < 20 GROUP BY 1, 2),
e AS (SELECT *, greatest(0.0, least(90.0, CAST(previous AS DOUBLE))) FILTER_m FROM f),
scored AS (SELECT entity, class, CASE WHEN previous IS NOT NULL THEN FILTER_m END expected_minutes,
  CASE WHEN previous IS NULL THEN NULL WHEN FILTER_m <= 0 THEN 0.0 WHEN FILTER_m < 60 THEN 1.0 ELSE 2.0 END AS appearance,
  CASE WHEN previous IS NOT NULL AND m > 0 THEN xg * 90.0 / m * FILTER_m / 90.0 * CASE class WHEN 'GK' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END END goal,
  CASE WHEN previous IS NOT NULL AND m > 0 THEN xa * 90.0 / m * FILTER_m / 90.0 * 3.0 END assist, n < 3 low_sample FROM e)""".replace("FILTER_m", "em")


@query(sql(f"{SCORED} SELECT entity, class, expected_minutes, appearance, goal, assist, appearance + coalesce(goal, 0.0) + coalesce(assist, 0.0) total, low_sample FROM scored"), "expected_minutes appearance goal assist total")
def component_score(s, d):
    return panel_plans.scored_entities(panel(s, d), TARGET)


@query(sql(f"{SCORED} SELECT entity, class, appearance + coalesce(goal, 0.0) + coalesce(assist, 0.0) total FROM scored ORDER BY round(total, 6) DESC NULLS LAST, entity LIMIT 10"), "total")
def topk_query(s, d):
    return panel_plans.scored_entities(panel(s, d), TARGET).select("entity", "class", "total").orderBy(F.round("total", 6).desc_nulls_last(), "entity").limit(10)


@query(sql("SELECT entity, period, minutes FROM periods ORDER BY minutes DESC NULLS LAST, entity, period"))
def sort_deterministic(s, d):
    return periods(s, d).select("entity", "period", "minutes").orderBy(F.desc_nulls_last("minutes"), "entity", "period")


@query(sql("SELECT entity, period, event_id, copies, variants FROM (SELECT entity, period, event_id, row_number() OVER (PARTITION BY entity, period ORDER BY event_id) r, count(*) OVER (PARTITION BY entity, period) copies FROM panel) JOIN (SELECT entity, period, count(DISTINCT minutes) variants FROM panel GROUP BY 1, 2) USING (entity, period) WHERE r = 1"))
def dedup_first_row(s, d):
    return panel_plans.dedup_first_row(panel(s, d), ["entity", "period"], "event_id", ["minutes"])
