"""Column expressions: strict cleaning, scoring parts and band labels. Missing is never zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points per goal by class, per assist, and appearance points.
GOAL_POINTS = {"GK": 10, "DEF": 6, "MID": 5, "FWD": 4}
ASSIST_POINTS = 3.0
FULL_MINUTES, FULL_APPEARANCE = 90.0, 60
#: Weights of the last three periods in the recency mean.
RECENCY_WEIGHTS = {1: 0.60, 2: 0.30, 3: 0.10}


def finite(x: Column) -> Column:
    """Null for null, else whether x is neither NaN nor infinite."""
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def clean_numeric(text: Column) -> Column:
    """Text as a finite double; blank, malformed and non-finite text is null."""
    x = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(finite(x), x)


def clean_int(text: Column) -> Column:
    """Text as a long; only plain digits with an optional sign pass."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))


def clean_bool(text: Column) -> Column:
    return F.when(text == "True", True).when(text == "False", False)


def clean_utc_ts(text: Column) -> Column:
    """ISO-8601 text with a zone as an instant; text without a zone is refused."""
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def violates(text: Column, cleaned: Column, nullable: bool = True) -> Column:
    """Whether cleaning lost something: text stood there and no value came of it, or a value is required."""
    lost = ~blank(text) & cleaned.isNull()
    return lost if nullable else lost | blank(text)


def to_millions(tenths: Column) -> Column:
    return tenths.cast("double") / 10.0


def to_tenths(millions: Column) -> Column:
    """Exact integer tenths; null where the amount is no whole number of tenths."""
    exact = millions.cast("decimal(18,6)") * 10
    return F.when(exact == F.floor(exact), exact.cast("int"))


def sides(own: Column, home: Column, away: Column) -> tuple[Column, Column]:
    """'H' or 'A' and the opponent; null where own is neither."""
    return F.when(own == home, "H").when(own == away, "A"), F.when(own == home, away).when(own == away, home)


def appearance_points(minutes: Column) -> Column:
    return F.when(minutes.isNull(), None).when(minutes <= 0, 0.0).when(minutes < FULL_APPEARANCE, 1.0).otherwise(2.0)


def class_points(kind: Column, points: Mapping[str, float] = GOAL_POINTS) -> Column:
    out = F.lit(None).cast("double")
    for name, value in points.items():
        out = F.when(kind == name, float(value)).otherwise(out)
    return out


def clamp(x: Column, low: float = 0.0, high: float = FULL_MINUTES) -> Column:
    """x between low and high; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def availability_reason(status: Column, chance: Column, known: Column, current: Column) -> Column:
    """Why expected minutes are forced to zero, or null. current: the chance speaks of the target period."""
    return F.when(known & current & (chance == 0), "explicit_zero_chance").when(known & (F.lower(status) == "s"), "suspended").when(known & (F.lower(status) == "u"), "unavailable")


def gated_minutes(minutes: Column, reason: Column) -> Column:
    return F.when(minutes.isNull(), None).when(reason.isNotNull(), 0.0).otherwise(clamp(minutes.cast("double")))


def exposed_if(value: Column, current: Column) -> Column:
    return F.when(current, value)


def per_90(x: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, x * F.lit(FULL_MINUTES) / minutes)


def strict_sum(x: Column) -> Column:
    """Sum that is null as soon as one value is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


#: Bands of opponent factors; the first and the last are the bounds themselves.
FACTOR_BANDS = ("0.70", ">0.70-<0.85", "0.85-<0.95", "0.95-<1.05", "1.05-<1.15", "1.15-<1.30", "1.30")


def factor_band(x: Column) -> Column:
    inner = bands(x, tuple(zip((0.85, 0.95, 1.05, 1.15, 1.3), FACTOR_BANDS[1:-1], strict=True)), FACTOR_BANDS[-1], "unknown")
    return F.when(x == 0.7, FACTOR_BANDS[0]).otherwise(inner)


def bands(x: Column, edges: Sequence[tuple[float, str]], last: str, unknown: str) -> Column:
    """Label of the first edge that x lies under; last beyond all edges, unknown for null."""
    out = F.when(x.isNull(), unknown)
    for edge, label in edges:
        out = out.when(x < edge, label)
    return out.otherwise(last)


#: Upper edges and names of the bands of expected minutes; "0" holds nothing but 0.
MINUTE_BANDS = ((30, "1-29"), (60, "30-59"), (90, "60-89"))


def minute_band(x: Column) -> Column:
    return F.when(x == 0, "0").otherwise(bands(x, MINUTE_BANDS, "90", "unknown"))


#: Bands of prior minutes (upper edges included), of periods behind a rate, of raw scores and of attacking rates.
PRIOR_MINUTE_BANDS = ((1, "0"), (91, "1-90"), (271, "91-270"), (451, "271-450"), (901, "451-900"))
RAW_SCORE_BANDS = ((1.0, "0-<1"), (2.0, "1-<2"), (3.0, "2-<3"), (4.0, "3-<4"), (5.0, "4-<5"), (7.0, "5-<7"))
RATE_TIERS = ((0.25, "0-<0.25"), (0.50, "0.25-<0.50"), (0.75, "0.50-<0.75"))
#: Fixed value: digits of a score or rate that are held to an edge; sums of doubles in another order differ far behind them.
EDGE_PLACES = 8


def prior_minutes_band(minutes: Column) -> Column:
    return bands(minutes, PRIOR_MINUTE_BANDS, "901+", "missing")


def raw_score_band(x: Column) -> Column:
    return bands(F.round(x, EDGE_PLACES), RAW_SCORE_BANDS, "7+", "unknown")


def rate_tier(x: Column) -> Column:
    return bands(F.round(x, EDGE_PLACES), RATE_TIERS, "0.75+", "unknown")


def prior_sample_band(has_rate: Column, periods: Column) -> Column:
    """How many periods are behind a rate. The names."""
    named = F.when(periods == 1, "1_prior_GW").when(periods.between(2, 3), "2-3_prior_GWs").when(periods.between(4, 5), "4-5_prior_GWs").otherwise("6+_prior_GWs")
    return F.when(F.coalesce(has_rate, F.lit(False)), named).otherwise("no_usable_prior_attacking_sample")


def availability_band(status: Column, chance: Column) -> Column:
    """Status letters, chances and the names."""
    s = F.lower(status)
    out = F.when(s.isin("s", "u") | (chance == 0), "unavailable_or_suspended").when(s.isin("d", "i") | chance.isin(25, 50, 75), "doubtful_or_chance_limited")
    return out.when(s == "a", "available").otherwise("unknown")


def named_rows(conditions: Mapping[str, Column]) -> Column:
    """An array of the names whose condition holds; exploded, one pass serves many populations."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def shrunk_rate(rate: Column, minutes: Column, prior: Column, pseudo: float) -> Column:
    """Rate pulled to the group's by pseudo-minutes; the group's own for zero minutes; null where either is unknown."""
    mixed = (rate * minutes + prior * F.lit(pseudo)) / (minutes + F.lit(pseudo))
    return F.when(prior.isNull() | minutes.isNull(), None).when(minutes == 0, prior).otherwise(mixed)


def threshold_rate(rate: Column, minutes: Column, prior: Column, least: float = 180.0) -> Column:
    return F.when(minutes.isNull(), None).when(minutes < least, prior).otherwise(rate)


def errors(predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    e = predicted - actual
    return e, F.abs(e), e * e


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0).cast("double")))
