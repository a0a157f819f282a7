"""Composite jobs and streams over the driver's tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import asof, metrics
from panelyard.plans import panel_plans
from panelyard.queries.aggregates import METRIC_COLUMNS, METRICS
from panelyard.queries.base import TARGET, entities, forecast_pairs, panel, periods, query, scratch, sql, t, targets
from panelyard.queries.features import SCORED, WINDOWS
from panelyard.streaming import monitors


@query(sql(f", w AS ({WINDOWS}) SELECT u.entity, class, prior_minutes, prior_avg_minutes, previous_minutes, last3_minutes, last5_minutes, last3_xg, CASE WHEN prior_minutes > 0 THEN prior_xg * 90 / prior_minutes END prior_xg_90, CASE WHEN last3_minutes > 0 THEN last3_xg * 90 / last3_minutes END last3_xg_90, previous_minutes IS NOT NULL previous_has_data, coalesce(prior_periods, 0) < 3 low_sample FROM (SELECT DISTINCT entity, class FROM panel) u LEFT JOIN w ON w.entity = u.entity"), "prior_avg_minutes last3_xg prior_xg_90 last3_xg_90", name="build_features_entities")
def build_features_entities(s, d):
    out = panel_plans.build_features(panel(s, d), entities(s, d), TARGET)
    return out.select("entity", "class", "prior_minutes", "prior_avg_minutes", "previous_minutes", "last3_minutes", "last5_minutes", "last3_xg", "prior_xg_90", "last3_xg_90", "previous_has_data", "low_sample")


@query(sql(f"{SCORED} SELECT class, count(*) n, count(appearance) complete, sum(appearance + coalesce(goal, 0.0) + coalesce(assist, 0.0)) total FROM scored GROUP BY 1"), "total", name="predict_class_totals")
def predict_class_totals(s, d):
    out = panel_plans.scored_entities(panel(s, d), TARGET)
    return out.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count("appearance").alias("complete"), F.sum("total").alias("total"))


STATES = """, seen AS (SELECT o_custkey entity, CAST(year(o_orderdate) - 1994 AS INTEGER) target, max(o_orderkey) k FROM orders GROUP BY 1, 2), state AS (SELECT entity, target, CAST(k % 125 AS INTEGER) team, TIMESTAMP '1994-10-01' + to_years(target - 1) deadline FROM seen),
games AS (SELECT DISTINCT CAST(l_suppkey % 150 AS INTEGER) team, CAST(year(l_shipdate) - 1994 AS INTEGER) period, date_trunc('month', l_shipdate) kickoff FROM lineitem),
hist AS (SELECT s.entity, s.target, CAST(sum(floor(o_totalprice)) AS BIGINT) % 3 AS minutes, list_sort(list(DISTINCT CAST(o_orderkey % 125 AS INTEGER))) teams FROM state s JOIN orders ON o_custkey = s.entity AND year(o_orderdate) - 1994 = s.target - 1 AND o_orderdate < s.deadline GROUP BY 1, 2),
prev AS (SELECT s.entity, s.target, s.deadline, p.team FROM state s LEFT JOIN state p ON p.entity = s.entity AND p.target = s.target - 1),
cnt AS (SELECT v.entity, v.target, v.team, count(kickoff) games, count(kickoff) FILTER (WHERE kickoff < deadline) early FROM prev v LEFT JOIN games g ON g.team = v.team AND g.period = v.target - 1 GROUP BY 1, 2, 3)"""

#: How the SQL tells what plans.panel_plans.previous_context() does.
CONTEXT = f"""CASE WHEN c.target = 1 THEN '{panel_plans.NO_PRIOR}' WHEN team IS NULL THEN '{panel_plans.NOT_IN_UNIVERSE}' WHEN games = 0 THEN '{panel_plans.BLANK}' WHEN early = 0 THEN '{panel_plans.NOT_KICKED_OFF}' WHEN minutes IS NULL THEN '{panel_plans.NO_HISTORY}'
WHEN teams <> [team] THEN CASE WHEN minutes > 0 THEN '{panel_plans.MOVED[0]}' ELSE '{panel_plans.MOVED[1]}' END WHEN games > early THEN CASE WHEN minutes > 0 THEN '{panel_plans.PARTIAL[0]}' ELSE '{panel_plans.PARTIAL[1]}' END ELSE CASE WHEN minutes > 0 THEN '{panel_plans.PLAYED[0]}' ELSE '{panel_plans.PLAYED[1]}' END END"""


@query(sql(f"""{STATES} SELECT c.entity, c.target, {CONTEXT} status, CASE WHEN early > 0 THEN minutes END AS minutes FROM cnt c LEFT JOIN hist h ON h.entity = c.entity AND h.target = c.target"""))
def previous_context(s, d):
    """Customers as players, whose last order of a year tells their team; the teams that they ordered for before the deadline may be others."""
    o = t(s, d, "orders")
    target = (F.year("o_orderdate") - 1994).cast("int")
    team = (F.col("o_orderkey") % 125).cast("int")
    seen = o.groupBy(F.col("o_custkey").alias("entity"), target.alias("target")).agg(F.max("o_orderkey").alias("o_orderkey"))
    states = seen.select("entity", "target", team.alias("team"), F.expr("timestamp_ntz'1994-10-01 00:00:00' + make_ym_interval(target - 1)").alias("deadline"))
    games = t(s, d, "lineitem").select((F.col("l_suppkey") % 150).cast("int").alias("team"), (F.year("l_shipdate") - 1994).cast("int").alias("period"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("kickoff")).distinct()
    own = o.select(F.col("o_custkey").alias("entity"), (target + 1).alias("target"), "o_orderdate", "o_totalprice", team.alias("for_team")).join(states, ["entity", "target"]).where("o_orderdate < deadline")
    hist = own.groupBy("entity", "target").agg((F.sum(F.floor("o_totalprice")) % 3).cast("bigint").alias("minutes"), F.array_sort(F.collect_set("for_team")).alias("teams"))
    return panel_plans.previous_context(states, games, hist)


@query(sql("SELECT e.entity, target, CAST(sum(minutes) AS BIGINT) prior_minutes, count(DISTINCT period) prior_periods, CAST(sum(minutes) FILTER (WHERE period >= target - 1) AS BIGINT) previous_minutes, CAST(sum(minutes) FILTER (WHERE period >= target - 3) AS BIGINT) last3_minutes, CAST(sum(minutes) FILTER (WHERE period >= target - 5) AS BIGINT) last5_minutes, max(period) max_period, max(ts) latest FROM panel e JOIN targets ON period < target AND ts < deadline GROUP BY 1, 2"))
def historical_features(s, d):
    want = entities(s, d).select("entity").crossJoin(F.broadcast(targets(s)))  # six targets
    return panel_plans.historical_features(panel(s, d), want)


@query(sql("SELECT entity, period, count(*) fixtures, CAST(sum(minutes) AS BIGINT) AS minutes, count(DISTINCT event_type) > 1 changed, string_agg(DISTINCT event_type, ',' ORDER BY event_type) kinds FROM panel GROUP BY 1, 2"))
def historical_actuals(s, d):
    g = panel(s, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("fixtures"), F.sum("minutes").alias("minutes"), F.array_sort(F.collect_set("event_type")).alias("k"))
    return g.select("entity", "period", "fixtures", "minutes", (F.size("k") > 1).alias("changed"), F.array_join("k", ",").alias("kinds"))


@query(sql("SELECT target, count(*) late_rows, count(DISTINCT entity) entities, min(ts) first_late FROM targets JOIN panel ON period < target AND ts >= deadline GROUP BY 1"))
def chronology_audit(s, d):
    late = panel(s, d).join(F.broadcast(targets(s)), (F.col("period") < F.col("target")) & (F.col("ts") >= F.col("deadline")))  # six targets
    return late.groupBy("target").agg(F.count(F.lit(1)).alias("late_rows"), F.count_distinct("entity").alias("entities"), F.min("ts").alias("first_late"))


@query(sql(f"""SELECT scope, "group", {METRICS} FROM (SELECT *, predicted - actual e FROM pairs), LATERAL (VALUES ('overall', 'all'), ('class', class), ('state', CASE WHEN predicted IS NULL OR actual IS NULL THEN 'missing' ELSE 'valid' END)) v(scope, "group") GROUP BY 1, 2"""), METRIC_COLUMNS, name="evaluate_scopes")
def evaluate_scopes(s, d):
    state = F.when(F.col("predicted").isNull() | F.col("actual").isNull(), "missing").otherwise("valid")
    return metrics.metrics_by_scope(forecast_pairs(s, d), "predicted", "actual", {"overall": F.lit("all"), "class": F.col("class"), "state": state})


@query(sql("SELECT entity, period, predicted, actual, predicted - actual AS error, CASE WHEN actual IS NULL AND predicted IS NULL THEN 'both_missing' WHEN actual IS NULL THEN 'missing_actual' WHEN predicted IS NULL THEN 'missing_prediction' WHEN actual = 0 THEN 'actual_zero' ELSE 'valid' END state, CASE WHEN predicted IS NULL THEN 'unknown' WHEN predicted = 0 THEN '0' WHEN predicted < 30 THEN '1-29' WHEN predicted < 60 THEN '30-59' WHEN predicted < 90 THEN '60-89' ELSE '90' END band FROM pairs"), "predicted actual error", name="backtest_pairs")
def backtest_pairs(s, d):
    from panelyard.functions import expressions as X

    p = forecast_pairs(s, d)
    return p.select("entity", "period", "predicted", "actual", X.errors(F.col("predicted"), F.col("actual"))[0].alias("error"), panel_plans.pair_state(F.col("predicted"), F.col("actual")).alias("state"), X.minute_band(F.col("predicted")).alias("band"))


# Streams: each runs over files that Spark writes from events, to the end of what is there.

PROBES = ", probe AS (SELECT 'user' || entity AS target, ts observed_at, event_type <> 'error' ready, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END digest, event_id FROM panel)"


def _probes(s, d) -> DataFrame:
    digest = F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b")
    return panel(s, d).select(F.concat(F.lit("user"), F.col("entity").cast("string")).alias("target"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("event_type") != "error").alias("ready"), digest.alias("digest"))


#: Batches in which a table arrives.
BATCHES = 4


def _arrivals(df: DataFrame, time: str) -> list[DataFrame]:
    """df cut into BATCHES spans of time, earliest first; each row is in one of them, a null time in the first."""
    first, last = df.agg(F.min(time), F.max(time)).first()
    if first is None:
        return [df]
    cuts = [F.lit(first + (last - first) * i / BATCHES).cast(df.schema[time].dataType) for i in range(1, BATCHES)]
    at = F.col(time)
    spans = [at.isNull() | (at < cuts[0]), *[(at >= a) & (at < b) for a, b in itertools.pairwise(cuts)], at >= cuts[-1]]
    return [df.where(span) for span in spans]


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _finished(s, df: DataFrame, time: str, run: Callable[[DataFrame], DataFrame], mode: str = "append", state: str | None = None) -> DataFrame:
    """run's rows for a stream of df that arrives in order of time: files of its own partitioning for each span.

    The stream runs to the end of a span's files before those of the next come, and resumes from its checkpoint, so
    state passes from batch to batch. state: the state store that run needs, where it isn't the session's own.
    """
    path, out, progress = scratch(s, "stream"), scratch(s, "streamed"), scratch(s, "progress")
    before = s.conf.get(STATE_STORE)
    s.conf.set(STATE_STORE, state or before)
    try:
        for part in _arrivals(df, time):
            part.write.mode("append").parquet(path)
            stream = run(s.readStream.schema(df.schema).parquet(path))
            stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(STATE_STORE, before)
    return s.read.schema(stream.schema).parquet(out)


RUNS = """, r AS (SELECT *, CASE WHEN ready AND lag(ready) OVER w AND digest = lag(digest) OVER w THEN 0 ELSE 1 END n FROM probe WINDOW w AS (PARTITION BY target ORDER BY observed_at, digest)), g AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY observed_at, digest) run FROM r),
f AS (SELECT target, observed_at, digest, min(observed_at) OVER (PARTITION BY target, run) first_seen FROM g WHERE ready)
SELECT target, arg_min(first_seen, observed_at) first_seen, min(observed_at) final_at, arg_min(digest, observed_at) digest FROM f WHERE observed_at >= first_seen + INTERVAL 15 MINUTE GROUP BY 1"""


@query(sql(PROBES + RUNS))
def stream_finalization(s, d):
    out = _finished(s, _probes(s, d), "observed_at", monitors.stream_finalization, state=monitors.ROCKSDB)
    return out.select("target", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("final_at").cast("timestamp_ntz").alias("final_at"), "digest")


@query(sql(PROBES + RUNS), name="batch_finalization")
def batch_finalization(s, d):
    out = monitors.batch_finalization(_probes(s, d))
    return out.select("target", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("final_at").cast("timestamp_ntz").alias("final_at"), "digest")


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'", "value")
def stream_snapshot_ingest(s, d):
    """Errors lose their required value on the way and end in quarantine."""
    source, clean = scratch(s, "captures"), scratch(s, "clean")
    e = t(s, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    e.write.json(source)
    monitors.stream_snapshot_ingest(s, source, "event_id bigint, user_id bigint, value double", ["value"], clean, scratch(s, "quarantine"), scratch(s, "progress")).start().awaitTermination()
    return s.read.parquet(clean).select("event_id", "user_id", "value")


@query(sql("SELECT event_id, target, ts < deadline usable FROM panel JOIN targets ON target = period + 1"))
def stream_late_guard(s, d):
    def guarded(stream: DataFrame) -> DataFrame:
        due = stream.join(F.broadcast(targets(s)), F.col("target") == F.col("period") + 1)  # six targets
        return monitors.stream_late_guard(due, "ts", "deadline").select("event_id", "target", "usable")

    return _finished(s, panel(s, d).select("event_id", "period", "ts"), "ts", guarded)


@query(sql("SELECT DISTINCT entity, period, event_type digest FROM panel"))
def stream_dedup(s, d):
    rows = panel(s, d).select("entity", "period", F.col("event_type").alias("digest"), F.col("ts").cast("timestamp").alias("at"))
    out = _finished(s, rows, "at", lambda stream: monitors.stream_dedup(stream, ["entity", "period"], "digest", "at", "40 days"))
    return out.select("entity", "period", "digest")


@query(sql("SELECT entity, period, count(DISTINCT event_type) variants FROM panel GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1"), name="stream_dedup_conflicts")
def stream_dedup_conflicts(s, d):
    return monitors.key_conflicts(panel(s, d), ["entity", "period"], "event_type")
