"""Data-quality rules. Each gives one row: rule, violations, sample (an offending key as text, the smallest)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.expressions import finite
from panelyard.operators.joins import any_different
from panelyard.sources.sinks import content_digest


def _key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def verdict(bad: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations"), F.min(_key(keys)).alias("sample")).select(F.lit(rule).alias("rule"), "violations", "sample")


def dq_predicate(df: DataFrame, rule: str, ok: Column, keys: Sequence[str]) -> DataFrame:
    """Rows for which ok isn't true; null counts as a violation."""
    return verdict(df.where(~F.coalesce(ok, F.lit(False))), rule, keys)


def dq_row_count(clean: DataFrame, raw: DataFrame) -> DataFrame:
    n = clean.agg(F.count(F.lit(1)).alias("a")).join(raw.agg(F.count(F.lit(1)).alias("b")), F.lit(True))
    return n.select(F.lit("row_count").alias("rule"), F.abs(F.col("a") - F.col("b")).alias("violations"), F.when(F.col("a") != F.col("b"), F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).alias("sample"))


def dq_unique_key(df: DataFrame, keys: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Keys that repeat, or are null where they may not be."""
    required = [k for k in keys if k not in nullable]
    missing = F.lit(False)
    for k in required:
        missing = missing | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return verdict(groups.where((F.col("_n") > 1) | missing), "unique_key", keys)


def dq_referential(df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    known = reference.select(F.col(reference_key).alias(key)).distinct()
    return verdict(df.where(F.col(key).isNotNull()).join(known, key, "left_anti"), "referential", [key])


def dq_finite(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(~finite(F.col(c).cast("double")), F.lit(False))
    return verdict(df.where(bad), "finite", keys)


def dq_range(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str]) -> DataFrame:
    return verdict(df.where(~F.col(column).between(low, high)), "range", keys)


def dq_domain(df: DataFrame, column: str, values: Sequence, keys: Sequence[str]) -> DataFrame:
    return verdict(df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))), "domain", keys)


def dq_leakage(df: DataFrame, keys: Sequence[str], *rules: Column) -> DataFrame:
    """Rows that break one of the rules "source before target"; null sources are no leak."""
    bad = F.lit(False)
    for ok in rules:
        bad = bad | F.coalesce(~ok, F.lit(False))
    return verdict(df.where(bad), "leakage", keys)


def dq_additive(df: DataFrame, parts: Sequence[str], total: str, keys: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    added = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return verdict(df.where(F.abs(added - F.col(total)) > tolerance), "additive", keys)


def dq_single_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Provenance columns that hold more or less than one value, a null being a value."""
    counts = df.agg(*[F.count_distinct(F.struct(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns])
    return verdict(counts.select(F.explode(rows).alias("r")).select("r.*").where("n <> 1"), "provenance_single", ["c"])


def dq_constant_per_group(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    groups = df.groupBy(*group).agg(F.count_distinct(F.struct(*columns)).alias("_n"))
    return verdict(groups.where("_n > 1"), "constant_per_group", group)


def dq_same_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], rule: str) -> DataFrame:
    """Keys that only one side has, or whose columns differ; nulls are equal."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full")
    differ = any_different([(F.col(f"l_{c}"), F.col(f"r_{c}")) for c in columns])
    return verdict(both.where(F.col("_l").isNull() | F.col("_r").isNull() | differ), rule, keys)


def dq_totals(rows: DataFrame, heads: DataFrame, keys: Sequence[str], part: str, total: str, tolerance: float, rule: str) -> DataFrame:
    """Stored totals that the sum of their rows does not give."""
    sums = rows.groupBy(*keys).agg(F.sum(part).alias("_sum"))
    both = heads.join(sums, list(keys), "left")
    return verdict(both.where(F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col(total)) > tolerance), rule, keys)


def snapshot_coherence(tables: Mapping[str, DataFrame], stated: DataFrame, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """table, digest, digest_matches, snapshot_agrees: tables of one snapshot against what their manifests state.

    stated: table, snapshot, digest. A table's digest is one aggregate of its rows, summed up before it is shuffled.
    A snapshot agrees if all tables state the same one. A table that states nothing, or that isn't there, matches nothing.
    """
    found = None
    for name, df in tables.items():
        own = df.agg(content_digest((columns or {}).get(name) or df.columns).alias("digest")).select(F.lit(name).alias("table"), "digest")
        found = own if found is None else found.unionByName(own)
    ids = stated.agg(F.count_distinct("snapshot").alias("_ids"), F.count_if(F.col("snapshot").isNull()).alias("_none"))  # one row
    both = found.join(stated.select("table", F.col("digest").alias("_stated"), "snapshot"), "table", "full").join(F.broadcast(ids), F.lit(True))
    return both.select("table", "digest", F.coalesce(F.col("digest") == F.col("_stated"), F.lit(False)).alias("digest_matches"), (F.col("snapshot").isNotNull() & (F.col("_ids") == 1) & (F.col("_none") == 0)).alias("snapshot_agrees"))


def dq_snapshot_coherence(tables: Mapping[str, DataFrame], stated: DataFrame, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    return dq_predicate(snapshot_coherence(tables, stated, columns), "snapshot_coherence", F.col("digest_matches") & F.col("snapshot_agrees"), ["table"])
