"""Data-quality rules over the driver's tables: clean tables give no violations, seeded ones do."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import quality as Q
from panelyard.queries.aggregates import CANDIDATES, minutes_experiment
from panelyard.queries.base import digest_sql, forecast_pairs, panel, periods, query, sql, t, targets
from panelyard.queries.features import fixtures
from panelyard.sources.sinks import content_digest


def verdict(rule: str, body: str, key: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) violations, min(CAST({key} AS VARCHAR)) AS sample FROM ({body})"


@query("SELECT 'row_count' AS rule, abs((SELECT count(*) FROM orders WHERE o_totalprice > 0) - (SELECT count(*) FROM orders)) violations, CAST(NULL AS VARCHAR) AS sample")
def dq_row_count(s, d):
    o = t(s, d, "orders")
    return Q.dq_row_count(o.where("o_totalprice > 0"), o)


@query(verdict("unique_key", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "l_orderkey || '|' || l_linenumber"))
def dq_unique_key(s, d):
    return Q.dq_unique_key(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(verdict("referential", "SELECT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)", "user_id"))
def dq_referential(s, d):
    return Q.dq_referential(t(s, d, "events"), "user_id", t(s, d, "orders"), "o_custkey")


@query(verdict("finite", "SELECT event_id FROM events WHERE event_id % 1000 = 7 OR NOT isfinite(value)", "event_id"))
def dq_finite(s, d):
    e = t(s, d, "events").withColumn("value", F.when(F.col("event_id") % 1000 == 7, float("inf")).otherwise(F.col("value")))
    return Q.dq_finite(e, ["value"], ["event_id"])


@query(verdict("range", "SELECT event_id FROM events WHERE value NOT BETWEEN 0 AND 300", "event_id"))
def dq_range(s, d):
    return Q.dq_range(t(s, d, "events"), "value", 0.0, 300.0, ["event_id"])


@query(verdict("domain", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "o_orderkey"))
def dq_domain(s, d):
    return Q.dq_domain(t(s, d, "orders"), "o_orderstatus", ["F", "O"], ["o_orderkey"])


@query("SELECT 'side_consistency' AS rule, count(*) violations, min(l_orderkey || '|' || l_linenumber) AS sample FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey = c_nationkey")
def dq_side_consistency(s, d):
    side, opponent = X.sides(F.col("home"), F.col("home"), F.col("away"))
    return Q.dq_predicate(fixtures(s, d), "side_consistency", (side == "H") & (opponent != F.col("home")), ["l_orderkey", "l_linenumber"])


@query(sql(verdict("grain", "SELECT entity, period, count(*) n FROM panel GROUP BY 1, 2 HAVING count(*) <> 1", "entity || '|' || period")))
def dq_grain(s, d):
    p = panel(s, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n"))
    return Q.dq_predicate(p, "grain", F.col("n") == 1, ["entity", "period"])


@query(sql(verdict("leakage", "SELECT event_id FROM panel WHERE period >= 20 OR ts >= TIMESTAMP '2024-01-19 18:00:00'", "event_id")))
def dq_leakage(s, d):
    return Q.dq_leakage(panel(s, d), ["event_id"], F.col("period") < 20, F.col("ts") < F.expr("timestamp_ntz'2024-01-19 18:00:00'"))


@query(sql(verdict("additive", "SELECT entity, period FROM periods WHERE abs(coalesce(xg, 0) + coalesce(xa, 0) - minutes * 0.15) > 1e-6", "entity || '|' || period")))
def dq_additive(s, d):
    p = periods(s, d).withColumn("total", F.col("minutes") * 0.15)
    return Q.dq_additive(p, ["xg", "xa"], "total", ["entity", "period"], 1e-6)


@query(sql(verdict("flag_consistency", "SELECT event_id FROM panel WHERE appeared <> (minutes > 0)", "event_id")))
def dq_flag_consistency(s, d):
    return Q.dq_predicate(panel(s, d), "flag_consistency", F.col("appeared") == (F.col("minutes") > 0), ["event_id"])


@query("SELECT 'provenance_single' AS rule, count(*) violations, min(c) AS sample FROM (SELECT 'month' c, count(DISTINCT month(ts)) n FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events) WHERE n <> 1")
def dq_provenance_single(s, d):
    return Q.dq_single_value(t(s, d, "events").select(F.month("ts").alias("month"), "event_type"), ["month", "event_type"])


#: Three tables of a snapshot and what is digested of them.
COHERENT = {"supplier": ["s_suppkey", "s_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "orders": ["o_orderkey", "o_custkey"]}


@query(f"SELECT 'snapshot_coherence' AS rule, count(*) violations, min(t) AS sample FROM (SELECT 'supplier' t, {digest_sql(COHERENT['supplier'], 'supplier')} a, {digest_sql(COHERENT['supplier'], 'supplier')} b UNION ALL SELECT 'nation', {digest_sql(COHERENT['nation'], 'nation')}, {digest_sql(COHERENT['nation'], 'nation')} UNION ALL SELECT 'orders', {digest_sql(COHERENT['orders'], 'orders')}, {digest_sql(COHERENT['orders'], '(SELECT * FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders))')}) WHERE a IS DISTINCT FROM b")
def dq_snapshot_coherence(s, d):
    """Three tables against the digests that their snapshot stated: orders have one row more than when they were digested."""
    tables = {n: t(s, d, n) for n in COHERENT}
    last = tables["orders"].agg(F.max("o_orderkey").alias("k"))  # one row
    before = tables | {"orders": tables["orders"].join(F.broadcast(last), F.col("o_orderkey") == F.col("k"), "left_anti")}
    stated = None
    for n, df in before.items():
        own = df.agg(content_digest(COHERENT[n]).alias("digest")).select(F.lit(n).alias("table"), F.lit("20240114").alias("snapshot"), "digest")
        stated = own if stated is None else stated.unionByName(own)
    return Q.dq_snapshot_coherence(tables, stated, COHERENT)


@query("SELECT 'order_lines' AS rule, count(*) violations, min(CAST(o_orderkey AS VARCHAR)) AS sample FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)", name="dq_order_lines")
def dq_order_lines(s, d):
    """Orders that no line belongs to."""
    ids = t(s, d, "orders").select("o_orderkey").join(t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return Q.verdict(ids, "order_lines", ["o_orderkey"])


@query("SELECT 'finalized_gate' AS rule, count(*) violations, min(CAST(o_orderkey AS VARCHAR)) AS sample FROM (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus HAVING NOT (o_orderstatus = 'F' AND bool_and(l_linestatus = 'F')))")
def dq_finalized_gate(s, d):
    o = t(s, d, "orders").join(t(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = o.groupBy("o_orderkey", "o_orderstatus").agg(F.bool_and(F.col("l_linestatus") == "F").alias("done"))
    return Q.dq_predicate(g, "finalized_gate", (F.col("o_orderstatus") == "F") & F.col("done"), ["o_orderkey"])


@query(sql("SELECT 'prediction_grain' AS rule, count(*) violations, min(coalesce(a.entity, b.entity) || '|' || coalesce(a.period, b.period)) AS sample FROM (SELECT entity, period, CAST(sum(minutes) AS BIGINT) AS minutes FROM panel WHERE appeared GROUP BY 1, 2) a FULL JOIN periods b ON a.entity = b.entity AND a.period = b.period WHERE a.minutes IS DISTINCT FROM b.minutes"))
def dq_prediction_grain_reconcile(s, d):
    a = panel(s, d).where("appeared").groupBy("entity", "period").agg(F.sum("minutes").alias("minutes"))
    return Q.dq_same_rows(a, periods(s, d), ["entity", "period"], ["minutes"], "prediction_grain")


@query(sql(f"{CANDIDATES}, ctl AS (SELECT entity, target, predicted FROM exp WHERE candidate = 'M0' AND predicted IS NOT NULL), base AS (SELECT entity, target, least(90.0, CAST(sum(minutes) AS DOUBLE)) predicted FROM panel JOIN targets ON period = target - 1 GROUP BY 1, 2) SELECT 'control_reproduction' AS rule, count(*) violations, min(coalesce(c.entity, b.entity) || '|' || coalesce(c.target, b.target)) AS sample FROM ctl c FULL JOIN base b ON c.entity = b.entity AND c.target = b.target WHERE c.predicted IS DISTINCT FROM b.predicted"))
def dq_control_reproduction(s, d):
    """The control candidate against a baseline that forgot the deadline: what came after it makes the difference."""
    before = panel(s, d).join(F.broadcast(targets(s)), F.col("period") == F.col("target") - 1)  # six targets
    base = before.groupBy("entity", "target").agg(F.least(F.lit(90.0), F.sum("minutes").cast("double")).alias("predicted"))
    control = minutes_experiment(s, d).where("candidate = 'M0' and predicted is not null").select("entity", "target", "predicted")
    return Q.dq_same_rows(control, base, ["entity", "target"], ["predicted"], "control_reproduction")


@query(sql("SELECT 'frozen_invariance' AS rule, count(*) violations, min(entity || '|' || period) AS sample FROM periods WHERE minutes * 2 <> minutes"))
def dq_frozen_invariance(s, d):
    p = periods(s, d)
    return Q.dq_same_rows(p, p.withColumn("minutes", F.col("minutes") * 2), ["entity", "period"], ["minutes", "points"], "frozen_invariance")


@query(sql("SELECT 'missing_observation' AS rule, count(*) violations, min(entity || '|' || period) AS sample FROM (SELECT a.entity, b.period FROM (SELECT DISTINCT entity FROM panel) a CROSS JOIN (SELECT DISTINCT period FROM panel) b EXCEPT SELECT entity, period FROM panel)"))
def dq_missing_observation(s, d):
    p = panel(s, d)
    want = p.select("entity").distinct().join(F.broadcast(p.select("period").distinct()), F.lit(True))  # days of a month
    return Q.verdict(want.join(p, ["entity", "period"], "left_anti"), "missing_observation", ["entity", "period"])


@query(verdict("constant_per_group", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1", "l_orderkey"))
def dq_constant_per_group(s, d):
    return Q.dq_constant_per_group(t(s, d, "lineitem"), ["l_orderkey"], ["l_returnflag"])


@query(sql(verdict("null_history", "SELECT entity, period FROM pairs WHERE predicted IS NULL AND actual IS NOT NULL", "entity || '|' || period")))
def dq_null_history(s, d):
    ok = F.col("predicted").isNotNull() | F.col("actual").isNull()
    return Q.dq_predicate(forecast_pairs(s, d), "null_history", ok, ["entity", "period"])


@query("SELECT 'selection_reconstruct' AS rule, count(*) violations, min(CAST(o_orderkey AS VARCHAR)) AS sample FROM (SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice HAVING abs(coalesce(sum(l_extendedprice), 0) - o_totalprice) > 0.01)")
def dq_selection_reconstruct(s, d):
    rows = t(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return Q.dq_totals(rows, t(s, d, "orders"), ["o_orderkey"], "l_extendedprice", "o_totalprice", 0.01, "selection_reconstruct")


@query(sql(verdict("holdout_seal", "SELECT entity, period FROM periods WHERE period > 15", "entity || '|' || period")))
def dq_holdout_seal(s, d):
    return Q.dq_predicate(periods(s, d), "holdout_seal", F.col("period") <= 15, ["entity", "period"])
