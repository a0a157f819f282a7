"""Mixing sources to target weights with pivotal dependent rounding.

Each source's target over its size is the number of copies wanted of each of its documents; the whole part is taken
outright and the fraction is rounded dependently. Pairs of fractional documents pass mass between them at random,
keeping the expected words of the pair, until one of them is 0 or 1; so a group of documents ends with one fraction.
Groups of bounded size do that side by side, and the fractions left over are gathered by a reduction tree of fixed
fan-in until one is left per source, which is rounded by chance. In a pair the larger document stays, so that one is
large, and what its rounding adds or takes is settled with small ones: a few, drawn by hash from each grade of sizes,
are rounded the other way, largest first, until none brings the source nearer. A document gets the copies wanted rounded down
or up, and a source misses its target by less than its smallest documents that could still be turned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import tidied, written

GROUP_ROWS, FAN_IN = 4096, 64
#: Documents of a source, a grade of sizes and a direction that may be rounded the other way to settle the last one's rounding.
SETTLERS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), max_ratio: float = 3.0) -> DataFrame:
    """source, n_docs, source_size, target for sizes(source, size); written, a row per source.

    Sources are ranked by code point, null last, and take the weights in turn. Targets are shares of all sizes by
    weight; what would pass max_ratio times a source's size is shared again among the others. That fixed point is
    min(max_ratio * size, weight * level) for one level, found by aggregates over the table of sources; the table
    itself stays distributed, and ranks come from its sorted partitions' counts.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    stats = stats.repartitionByRange(order).sortWithinPartitions(order)
    stats = written(stats.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "sources")
    counts = dict(stats.groupBy("_part").count().collect())  # a row per partition
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before % len(weights)
        before += counts[part]
    base = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_part int, _base int")
    turn = (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_base")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    stats = stats.join(F.broadcast(base), "_part").select("source", "n_docs", "source_size", weight.alias("weight"))  # a row per partition of stats
    level, held = 0.0, -1
    while True:
        over = F.col("weight") * level > max_ratio * F.col("source_size")
        n, total, fixed, free = stats.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, max_ratio * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not total or not free:
            break
        held, level = n, (total - (fixed or 0.0)) / free
    return stats.select("source", "n_docs", "source_size", F.least(max_ratio * F.col("source_size"), F.col("weight") * level).alias("target"))


def pivot(p: list[float], size: list[int], u: list[float], last: list[float] | None = None) -> list[float]:
    """Rounds all but one of p to 0 or 1, keeping every p's mean and, pair by pair, the sum of p * size.

    u: a random number per document, which decides its pair. last: another, which rounds the one that is left.
    """
    out, c = list(p), None
    for i, q in enumerate(p):
        if not 0.0 < q < 1.0:
            continue
        if c is None:
            c = i
            continue
        a, b, ratio = out[c], q, size[i] / size[c]
        up, down = min(1.0 - a, b * ratio), min(a, (1.0 - b) * ratio)
        shift = up if u[i] * (up + down) < down else -down
        a, b = a + shift, b - shift / ratio
        if min(a, 1.0 - a) <= min(b, 1.0 - b):
            out[c], out[i] = float(round(a)), min(1.0, max(0.0, b))
            c = i
        else:
            out[i], out[c] = float(round(b)), min(1.0, max(0.0, a))
        if min(out[c], 1.0 - out[c]) < 1e-12:
            out[c], c = float(round(out[c])), None
    if last is not None and c is not None:
        out[c] = 1.0 if last[c] < out[c] else 0.0
    return out


def rounding(fields: list[str], last: bool):
    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        # Largest first, so that what is left over at the end is a small document.
        pdf = pdf.sort_values(["size", "o", "_nth"], ascending=[False, True, True], kind="stable")
        pdf["p"] = pivot(pdf["p"].tolist(), pdf["size"].tolist(), pdf["u"].tolist(), pdf["v"].tolist() if last else None)
        return pdf[fields]

    return rounded


def settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """_key of the documents of one source that are rounded the other way, for rows (_key, size, draw, p, extra): words beyond the target."""
    left = float(pdf["extra"].iloc[0])
    pdf = pdf.sort_values(["size", "draw"], ascending=[False, True], kind="stable")
    key, size, up = pdf["_key"].to_numpy(), pdf["size"].to_numpy(), pdf["p"].to_numpy() == 1.0
    now = up.copy()
    while True:
        # Those that bring it nearer without passing the target, then one that passes it by less than is missing; every turn brings it nearer.
        before = left
        for i in np.flatnonzero(now == (left > 0)):
            if size[i] <= abs(left) and left:
                left -= size[i] if now[i] else -size[i]
                now[i] = not now[i]
        over = np.flatnonzero((now == (left > 0)) & (size < 2 * abs(left)))
        if len(over):
            i = over[np.abs(size[over] - abs(left)).argmin()]
            left -= size[i] if now[i] else -size[i]
            now[i] = not now[i]
        if left == before:
            return pd.DataFrame({"_key": pd.Series(key[now != up], dtype="int64")})


@tidied
def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), max_ratio: float = 3.0, seed: int = 17, keep: tuple = ()) -> DataFrame:
    """id, source, size, source_size, target, copies, taken (copies * size), and the columns of docs named in keep.

    Null texts and texts without a word have size 0; null sources are one source, the last. Empty documents follow
    their source's fraction by chance. Random choices come from hashes of id, size, keep and a number for rows that
    repeat, so reruns agree and repeated rows are rounded one by one. An empty table gives an empty result. Only ids,
    sizes and keep are shuffled, never texts.
    """
    own = ["id", "source", "size", *keep]
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c) for c in keep])
    sizes = sizes.groupBy(*own).agg(F.count(F.lit(1)).alias("_times")).select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_nth"))
    sizes = written(sizes, "sizes")
    stats = written(source_targets(sizes, weights, max_ratio), "targets")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chance = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", "size", "_nth", *keep), F.lit(1 << 52)).cast("double") / float(1 << 52)
    rows = sizes.join(stats.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    p = want - F.floor(want)
    p = F.when(F.col("size") == 0, F.when(chance("empty") < p, 1.0).otherwise(0.0)).otherwise(p)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "_nth", *keep), F.ceil(F.col("n_docs") / GROUP_ROWS))
    fields = [*own, "_nth", "source_size", "target", "base", "bucket", "open", "p"]
    rows = rows.withColumns({"base": F.floor(want), "p": p, "bucket": bucket})
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    rows = rows.withColumn("open", open_).select(fields)
    done, rest = [rows.where(~open_)], rows.where(open_)
    largest = stats.agg(F.max(F.ceil(F.col("n_docs") / GROUP_ROWS))).first()[0] or 1
    levels = max(0, math.ceil(math.log(largest, FAN_IN) - 1e-9)) if largest > 1 else 0
    for level in range(levels + 1):
        last = level == levels
        step = rest.withColumns({"u": chance(f"u{level}"), "o": chance(f"o{level}"), "v": chance(f"v{level}")})
        if level:
            step = step.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        out = written(step.groupBy("source", "bucket").applyInPandas(rounding(fields, last), rest.schema), "rounded")
        done.append(out if last else out.where(~open_))
        rest = out.where(open_)
    union = done[0]
    for df in done[1:]:
        union = union.unionByName(df)
    union = written(union.withColumn("_key", F.monotonically_increasing_id()), "copies")
    extra = union.groupBy("source").agg((F.sum((F.col("base") + F.col("p")) * F.col("size")) - F.first("target")).alias("extra"))
    extra = written(extra.where("extra <> 0").withColumnRenamed("source", "_source"), "extra")
    turned = union.where("open and size > 0").join(extra, F.col("source").eqNullSafe(F.col("_source")))
    turned = turned.select("source", "_key", "size", "p", chance("settle").alias("draw"), "extra", F.length(F.bin("size")).alias("grade"))
    turned = turned.withColumn("_nr", F.row_number().over(Window.partitionBy("source", "grade", "p").orderBy("draw", "_key"))).where(F.col("_nr") <= SETTLERS)
    turned = written(turned.groupBy("source").applyInPandas(settled, "_key bigint"), "turned").withColumn("_turned", F.lit(True))
    union = union.join(turned, "_key", "left")
    copies = (F.col("base") + F.when(F.col("_turned"), 1 - F.col("p")).otherwise(F.col("p"))).cast("long")
    return union.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", *keep, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as mixed_copies() says; docs' own columns.

    docs is read twice and its rows are matched by their place, so it has to be a table that reads alike each time,
    as a Parquet folder does.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id())
    columns = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | {k: options.pop(k) for k in list(options) if k.endswith("_col")}
    own = {k: names[docs.columns.index(c)] for k, c in columns.items()}
    copies = mixed_copies(placed, keep=("_row",), **own, **options).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    # The texts stream past a hash table of their partition's copies, a few bytes a document, and needn't be sorted for it.
    copies = copies.hint("shuffle_hash")
    out = placed.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(names).toDF(*docs.columns)
