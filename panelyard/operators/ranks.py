"""Ranks, quantiles and top rows of groups of any size; no task ever holds a whole group.

Rows are put in order by range partitions of (group, order) and written once, so that every row keeps its piece and its
place in it. What stands before a piece is a running sum over pieces, one row for each partition and group in it;
windows are over a group's rows of one piece. Ties are summed up to (group, value) counts first, so that a value which
many rows share is one row of the sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.scratch import written

#: Top rows are first found in this many parts of a group.
TOURNAMENT = 64


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, joined on keys of which nulls agree. AQE splits hot keys of the sort-merge join."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """df with before, the weights (or rows) that precede a row in its group, and total, those of the whole group.

    Rows that are equal in order stand in any order among themselves; a null key is a group.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = df.withColumns({"_g": F.struct(F.lit(0).alias("_"), *by), "_w": F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")})
    keys = [F.col("_g"), *order]
    at = F.monotonically_increasing_id()
    rows = written(ready.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int")), "ordered")
    piece, group = Window.partitionBy("_g", "_part"), Window.partitionBy("_g")
    pieces = rows.groupBy("_g", "_part").agg(F.sum("_w").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select("_g", "_part", earlier.alias("_start"), F.sum("_n").over(group).alias("total"))
    inside = F.coalesce(F.sum("_w").over(piece.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_before", inside).join(starts, ["_g", "_part"])
    return placed.withColumn("before", F.col("_start") + F.col("_before")).select(*df.columns, "before", "total")


def value_ranks(df: DataFrame, by: Sequence[str], x: str, weight: str | None = None) -> DataFrame:
    """by, x, n, before, total: the known values of each group, how many rows have each, and how many have a smaller one."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(n.alias("n"))
    return running_totals(counts, by, [F.col(x)], "n")


def average_rank(df: DataFrame, x: str, by: Sequence[str], name: str) -> DataFrame:
    """Rank of x inside by, ties sharing their mean rank; null for a null x."""
    ranks = value_ranks(df, by, x).select(*by, x, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return matched(df, ranks, [*by, x], "left")


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with a row's number (from 1) in its group. order ends in what tells rows apart."""
    return running_totals(df, by, order).withColumn(name, F.col("before") + 1).drop("before", "total")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], spread: str, n: int, name: str) -> DataFrame:
    """Each group's first n rows in order, numbered from 1.

    Tasks keep n rows of each group before anything is shuffled; then parts of groups, dealt by the column spread, do the same.
    """
    part = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(TOURNAMENT)))
    some = part.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col(name) <= n).drop("_part", name)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).where(F.col(name) <= n)


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, qs: Mapping[str, float]) -> DataFrame:
    """by and a column for each of qs (name -> share): exact quantiles of the known values, interpolated linearly.

    A quantile lies at position share * (rows - 1); the two values around it are looked up in the cumulative counts.
    Groups without a known value have no row.
    """
    ranks = value_ranks(df, by, x)
    v, picks = F.col(x).cast("double"), []
    for i, q in enumerate(qs.values()):
        at = F.lit(float(q)) * (F.col("total") - 1)
        holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
        picks += [F.max(F.when(holds(F.floor(at)), v)).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), v)).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
    found = ranks.groupBy(*by).agg(*picks)
    if not by:
        found = found.where("_lo0 is not null")
    return found.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name) for i, name in enumerate(qs)])


def empirical_percentile(df: DataFrame, by: Sequence[str], x: str, key: str = "id") -> DataFrame:
    """Rows of known x with rank, from the top (ties by key), and percentile, the share of peers at or below in per cent."""
    known = df.where(F.col(x).isNotNull())
    share = value_ranks(known, by, x).select(*by, x, ((F.col("before") + F.col("n")) / F.col("total") * 100.0).alias("percentile"))
    return matched(row_numbers(known, by, [F.desc(x), F.col(key)], "rank"), share, [*by, x])


def spearman_by_group(df: DataFrame, x: str, y: str, by: Sequence[str], name: str = "spearman") -> DataFrame:
    """Pearson correlation of tie-averaged ranks, taken inside each group over rows of which both values are known.

    Null for fewer than two pairs or where a side is constant. Pairs of equal values are counted first and travel as one row.
    """
    pairs = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_m")), "pairs")
    # Ranks less their mean, (total + 1) / 2.
    rank = lambda c, out: value_ranks(pairs, by, c, "_m").select(*by, c, (F.col("before") + (F.col("n") - F.col("total")) / 2.0).alias(out))
    both = matched(matched(pairs, rank(x, "_a"), [*by, x]), rank(y, "_b"), [*by, y])
    m, a, b = F.col("_m"), F.col("_a"), F.col("_b")
    sums = both.groupBy(*by).agg(F.sum("_m").alias("pairs"), F.sum(m * a * b).alias("_ab"), F.sum(m * a * a).alias("_aa"), F.sum(m * b * b).alias("_bb"))
    if not by:
        sums = sums.where("pairs is not null")
    value = F.when((F.col("pairs") > 1) & (F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*by, "pairs", value.alias(name))


def spearman_against(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """by, pairs and <x>_spearman for each of xs (doubles, like y): spearman_by_group() of each with y, over rows of which all are known.

    All columns are ranked in one sort, and y once for all of xs.
    """
    columns = [*xs, y]
    known = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))
    pairs = written(known.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("_m")), "pairs")
    values = pairs.select(*by, "_m", F.explode(F.array(*[F.struct(F.lit(c).alias("_which"), F.col(c).alias("_v")) for c in columns])).alias("_x")).select(*by, "_m", "_x.*")
    # Ranks less their mean, (total + 1) / 2.
    ranked = value_ranks(values, [*by, "_which"], "_v", "_m").withColumn("_rank", F.col("before") + (F.col("n") - F.col("total")) / 2.0)
    both = pairs
    for c in columns:
        both = matched(both, ranked.where(F.col("_which") == c).select(*by, F.col("_v").alias(c), F.col("_rank").alias(f"_rank_{c}")), [*by, c])
    m, b, n = F.col("_m"), F.col(f"_rank_{y}"), F.sum("_m")
    out = []
    for x in xs:
        a = F.col(f"_rank_{x}")
        aa, bb = F.sum(m * a * a), F.sum(m * b * b)
        out.append(F.when((n > 1) & (aa > 0) & (bb > 0), F.sum(m * a * b) / F.sqrt(aa * bb)).alias(f"{x}_spearman"))
    return both.groupBy(*by).agg(n.alias("pairs"), *out)


def top_n_overlap(df: DataFrame, predicted: str, actual: str, key: str, by: Sequence[str], ns: Sequence[int] = (10, 25, 50), strict: bool = True) -> DataFrame:
    """How many of the N highest predicted are among the N highest actual rows; ties by key, which names a row of its group.

    strict: null where a group has fewer than N pairs, and the share is of N; else the share is of least(N, pairs).
    """
    both = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).select(*by, key, predicted, actual)
    top = lambda c, name: top_rows(both, by, [F.desc(c), F.col(key)], key, max(ns), name).select(*by, key, name)
    # A row per key of either list: at most twice the largest N a group.
    lists = top(predicted, "_p").unionByName(top(actual, "_a"), allowMissingColumns=True).groupBy(*by, key).agg(F.max("_p").alias("_p"), F.max("_a").alias("_a"))
    found = lists.groupBy(*by).agg(F.array(*[F.count_if((F.col("_p") <= n) & (F.col("_a") <= n)) for n in ns]).alias("_overlaps"))
    counts = both.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs")).where("pairs > 0")
    rows = matched(counts, found, by).select(*by, "pairs", "_overlaps", F.posexplode(F.array(*[F.lit(n) for n in ns])).alias("_i", "n"))
    enough = F.col("pairs") >= F.col("n") if strict else F.lit(True)
    base = F.col("n") if strict else F.least("n", F.col("pairs"))
    overlap = F.get("_overlaps", F.col("_i"))
    return rows.select(*by, "n", "pairs", F.when(enough, overlap).alias("overlap"), F.when(enough, F.try_divide(overlap * 100.0, base)).alias("overlap_pct"))


def top_n_lists(df: DataFrame, score: str, key: str, by: Sequence[str], n: int) -> DataFrame:
    """The keys of each group's n highest rows, in order."""
    top = top_rows(df.where(F.col(score).isNotNull()), by, [F.desc(score), F.col(key)], key, n, "_r")
    return top.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("keys"))
