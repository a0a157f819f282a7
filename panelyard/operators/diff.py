"""Differences between snapshots and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed: key, status, changed (sorted column names)."""
    a = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in columns]))
    both = a.join(b, key, "full").withColumn("_d", F.array_sort(differs))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.size("_d") > 0, "changed")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.col("_d")).otherwise(F.array().cast("array<string>")).alias("changed")).where("status is not null")


def run_diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A row per key and numeric field that differs: key, field, before, after, delta; a missing side is null."""
    long = lambda df, name: df.unpivot([key], list(columns), "field", name)
    cast = lambda df: df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    both = long(cast(left), "before").join(long(cast(right), "after"), [key, "field"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("delta", F.col("after") - F.col("before"))


def set_diff(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """Ids added to and removed from each group, as sorted arrays."""
    a = left.groupBy(group).agg(F.collect_set(key).alias("_l"))
    b = right.groupBy(group).agg(F.collect_set(key).alias("_r"))
    empty = F.array().cast(f"array<{left.schema[key].dataType.simpleString()}>")
    both = a.join(b, group, "full").select(group, F.coalesce("_l", empty).alias("l"), F.coalesce("_r", empty).alias("r"))
    return both.select(group, F.array_sort(F.array_except("r", "l")).alias("added"), F.array_sort(F.array_except("l", "r")).alias("removed"))


def changed_values(left: DataFrame, right: DataFrame, keys: Sequence[str], item: Sequence[str], columns: Sequence[str], section: str) -> DataFrame:
    """keys, section, item, field, before, after: a row for each value that differs, as text; a missing side is null.

    item names what is compared inside keys, such as a member; a row that only one side has is a change of the field 'present'.
    """
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in item])
    def long(df: DataFrame, value: str) -> DataFrame:  # noqa: E306
        values = [F.struct(F.lit("present").alias("field"), F.lit("yes").alias(value)), *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(value)) for c in columns]]
        return df.select(*keys, name.alias("item"), F.explode(F.array(*values)).alias("_v")).select(*keys, "item", "_v.*")

    both = long(left, "before").join(long(right, "after"), [*keys, "item", "field"], "full")
    # Of a row that one side lacks, its presence says everything.
    whole = long(left, "_l").where("field = 'present'").join(long(right, "_r").where("field = 'present'"), [*keys, "item"], "inner").select(*keys, "item").withColumn("_both", F.lit(True))
    both = both.join(whole, [*keys, "item"], "left").where((F.col("field") == "present") | F.col("_both"))
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, F.lit(section).alias("section"), "item", "field", "before", "after")


def run_changes(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], keys: Sequence[str], sections: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """All that differs between two runs: keys, section, item, field, before, after.

    sections: name -> (what an item is called by inside keys, value columns); left and right hold a table for each.
    """
    out = None
    for name, (item, columns) in sections.items():
        rows = changed_values(left[name], right[name], keys, item, columns, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def run_flags(changes: DataFrame, keys: Sequence[str], sections: Sequence[str]) -> DataFrame:
    """A row per keys with changes: how many there are in each section, and whether anything but provenance moved."""
    counts = [F.count_if(F.col("section") == s).alias(f"{s}_changes") for s in sections]
    return changes.groupBy(*keys).agg(*counts).withColumn("changed", sum((F.col(f"{s}_changes") for s in sections if s != "provenance"), F.lit(0)) > 0)
