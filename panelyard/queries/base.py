"""The registry, and the driver's tables in the roles the operators know: history panel, targets, fixtures, squads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.scratch import scratch_path as scratch  # noqa: F401

TARGET, DIGITS = 20, 6
MEASURES = ("minutes", "starts", "points", "xg", "xa")


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded at the comparison edge."""
    return df.select(*[F.round(F.col(f"`{c}`"), DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None, doubles: str = "", name: str | None = None, ready: bool = False):
    """Registers a query under its function's name. doubles: the result's double columns, rounded on both sides. ready: it has rounded them itself, before they were repeated."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir) if ready else rounded(f(spark, sf_dir))

        text = sql
        if text and doubles:
            text = f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in doubles.split())}) FROM ({sql})"
        REGISTRY[name or f.__name__] = Query(run, text)
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Events as history: a user is an entity, a day of the month is a period."""
    e = t(spark, d, "events")
    return e.select(
        F.col("user_id").alias("entity"),
        F.dayofmonth("ts").alias("period"),
        "ts",
        "event_id",
        "event_type",
        F.col("value"),
        F.floor("value").cast("bigint").alias("minutes"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("starts"),
        F.floor(F.col("value") / 10).cast("bigint").alias("points"),
        F.when(F.col("event_type") != "view", F.floor(F.col("value")) / 10).alias("xg"),
        F.when(F.col("event_type") != "click", F.floor(F.col("value")) / 20).alias("xa"),
        (F.col("event_type") != "error").alias("appeared"),
        F.element_at(F.array(*[F.lit(k) for k in ("GK", "DEF", "MID", "FWD")]), (F.col("user_id") % 4 + 1).cast("int")).alias("class"),
    )


def targets(spark: SparkSession, first: int = 15, last: int = 20) -> DataFrame:
    """Target periods; each deadline falls into the evening of the day before, so that late events miss it."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("target"), F.expr("timestamp_ntz'2024-01-01 18:00:00' + make_dt_interval(cast(id - 2 as int))").alias("deadline"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("entity", "class").distinct()


#: The same roles as common table expressions.
CTE = """WITH RECURSIVE panel AS (SELECT user_id entity, CAST(day(ts) AS INTEGER) period, ts, event_id, event_type, value, CAST(floor(value) AS BIGINT) AS minutes,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) starts, CAST(floor(value / 10) AS BIGINT) points,
  CASE WHEN event_type <> 'view' THEN floor(value) / 10 END xg, CASE WHEN event_type <> 'click' THEN floor(value) / 20 END xa, event_type <> 'error' appeared,
  CASE user_id % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS class FROM events),
targets AS (SELECT CAST(p AS INTEGER) target, TIMESTAMP '2024-01-01 18:00:00' + to_days(CAST(p - 2 AS INTEGER)) deadline FROM range(15, 21) r(p)),
periods AS (SELECT entity, period, class, count(*) AS "rows", count(*) FILTER (WHERE appeared) appearances, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(starts) AS BIGINT) starts,
  CAST(sum(points) AS BIGINT) points, sum(xg) xg, sum(xa) xa FROM panel GROUP BY entity, period, class),
pairs AS (SELECT c.entity, c.period, c.class, CAST(p.minutes AS DOUBLE) predicted, CASE WHEN c.period % 7 <> 0 THEN CAST(c.minutes AS DOUBLE) END actual FROM periods c LEFT JOIN periods p ON p.entity = c.entity AND p.period = c.period - 1)
"""


def sql(body: str) -> str:
    return CTE + body


def periods(spark: SparkSession, d: str) -> DataFrame:
    from panelyard.operators.asof import agg_entity_period

    return agg_entity_period(panel(spark, d), ["entity", "class"], "period", MEASURES, F.col("appeared"))


def forecast_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The day before as forecast of a day's minutes; some actuals are held back as unknown."""
    p = periods(spark, d)
    before = p.select("entity", (F.col("period") + 1).alias("period"), F.col("minutes").cast("double").alias("predicted"))
    actual = F.when(F.col("period") % 7 != 0, F.col("minutes").cast("double"))
    return p.select("entity", "period", "class", actual.alias("actual")).join(before, ["entity", "period"], "left").select("entity", "period", "class", "predicted", "actual")


def squads(spark: SparkSession, d: str, among: Callable[[DataFrame], DataFrame] = lambda ids: ids) -> DataFrame:
    """Suppliers as squads: the 15 members are its parts (among those that among() leaves) of lowest key in each of four classes of part size."""
    from pyspark.sql import Window

    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("squad_id"), F.col("l_partkey").alias("id")).distinct()
    rows = among(li).join(pool(spark, d), "id").withColumn("r", F.row_number().over(Window.partitionBy("squad_id", "class").orderBy("id")))
    need = F.when(F.col("class") == "GK", 2).when(F.col("class") == "FWD", 3).otherwise(5)
    return rows.where(F.col("r") <= need).select("squad_id", "id", "class", "club", "price", "projection")


def pool(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.element_at(F.array(*[F.lit(k) for k in ("GK", "DEF", "MID", "FWD")]), (F.col("p_size") % 4 + 1).cast("int")).alias("class"),
        F.col("p_brand").alias("club"),
        F.floor(F.col("p_retailprice") / 10).cast("int").alias("price"),
        F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 37 % 101).cast("double") / 10).alias("projection"),
    )


POOL = """pool AS (SELECT p_partkey id, CASE p_size % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS class, p_brand club, CAST(floor(p_retailprice / 10) AS INTEGER) price,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey * 37 % 101 AS DOUBLE) / 10 END projection FROM part),
squads AS (SELECT squad_id, id, class, club, price, projection FROM (SELECT l.squad_id, p.*, row_number() OVER (PARTITION BY squad_id, class ORDER BY id) r
  FROM (SELECT DISTINCT l_suppkey squad_id, l_partkey id FROM lineitem) l JOIN pool p USING (id)) WHERE r <= CASE class WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END)
"""


def digest_sql(columns: Sequence[str], table: str) -> str:
    """The content digest (sources.sinks.content_digest) of whole-number columns of a table."""
    row = "'{' || concat_ws(',', " + ", ".join(f"""'"{c}":' || {c}""" for c in sorted(columns)) + ") || '}'"
    return f"(SELECT sha256(count(*) || ':' || coalesce(sum(CAST(CAST('0x' || substr(sha256({row}), 1, 15) AS BIGINT) AS DECIMAL(38, 0))), 0)) FROM {table})"
