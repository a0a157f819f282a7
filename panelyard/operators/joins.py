"""Joins by shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """A dimension's columns by key. Spark sends the dimension to all tasks where its size allows, else shuffles."""
    return df.join(dimension, on, how)


def side_rows(fixtures: DataFrame, home: str, away: str, team: str = "team", side: str = "side", opponent: str = "opponent") -> DataFrame:
    """Two rows per fixture, one for each side, so that `team = home or team = away` becomes an equi-join."""
    rows = F.array(F.struct(F.col(home).alias(team), F.lit("H").alias(side), F.col(away).alias(opponent)), F.struct(F.col(away).alias(team), F.lit("A").alias(side), F.col(home).alias(opponent)))
    return fixtures.select("*", F.explode(rows).alias("_s")).select(*fixtures.columns, "_s.*")


def join_candidates(df: DataFrame, candidates: Sequence[str], name: str = "candidate") -> DataFrame:
    """A row per candidate; the fixed list is exploded in place, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(c) for c in candidates])))


def lag_expand(targets: DataFrame, period: str, lags: int = 5, name: str = "source_period") -> DataFrame:
    return targets.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn(name, F.col(period) - F.col("lag"))


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def full_outcome(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join with coalesced keys."""
    return left.join(right, list(keys), "full")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that lets null keys meet."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on, how).select(F.col("l.*"), *rest)


def against_control(df: DataFrame, keys: Sequence[str], candidate: str, control: str, values: Sequence[str]) -> DataFrame:
    """Each row with the control candidate's values under the same keys, as control_<value>."""
    base = df.where(F.col(candidate) == control).select(*keys, *[F.col(v).alias(f"control_{v}") for v in values])
    return df.join(base, list(keys))


def code_bridge(left: DataFrame, right: DataFrame, code: str, how: str = "inner") -> DataFrame:
    """Two seasons' rows of one person, by the code that outlives season ids. Columns of right get the prefix prior_."""
    return left.join(right.select(code, *[F.col(c).alias(f"prior_{c}") for c in right.columns if c != code]), code, how)


def any_different(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether any pair differs, nulls being equal."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out
