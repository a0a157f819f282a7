"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Documents of equal text are one indivisible group. A partial partition holds k sums; the two with the largest spread
are combined again and again, the larger sums of one with the smaller ones of the other, until one is left. The few
groups that are large beside a shard are differenced together; buckets of the others do it side by side, each with the
large groups' loads, scaled to its share, as one more partial partition, which it so evens out.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import keyed_join, tidied, written

BUCKET_GROUPS, LARGE, SLOT_ROWS = 4096, 64, 50_000


def difference(sums: np.ndarray) -> np.ndarray:
    """For m partial partitions of k sums each: the final part of each one's k subsets. Largest spreads first."""
    m, k = sums.shape
    first = np.argsort(-sums, axis=1, kind="stable")
    held = [row[o] for row, o in zip(sums, first, strict=True)]
    heap = [(int(h[-1] - h[0]), i) for i, h in enumerate(held)]
    heapq.heapify(heap)
    joins = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = held[a] + held[b][::-1]
        order = np.argsort(-both, kind="stable")
        held[a] = held[b] = None
        held.append(both[order])
        joins.append((a, b, order))
        heapq.heappush(heap, (int(held[-1][-1] - held[-1][0]), len(held) - 1))
    part = [None] * len(held)
    part[-1] = np.arange(k)
    for node in range(len(held) - 1, m - 1, -1):
        a, b, order = joins[node - m]
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[order] = part[node]
        right[k - 1 - order] = part[node]
        part[a], part[b], part[node] = left, right, None
    out = np.empty((m, k), np.int64)
    for i in range(m):
        out[i, first[i]] = part[i]
    return out


def balanced(n_shards: int, loads: np.ndarray | None, rest: int):
    """Gives a bucket's groups (key, bytes) their shards.

    loads, the bytes that the shards have from large groups, joins the differencing as one more partial partition,
    scaled to the bucket's share of the rest: so a bucket makes up for its part of them. The subset in which load j
    ends is shard j; without loads, subsets are dealt to shards at random, so that buckets' remainders don't add up.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(pdf) + 1, n_shards), np.int64)
        sums[1:, 0] = pdf["bytes"]
        if loads is not None and loads.any():
            sums[0] = loads * (int(pdf["bytes"].sum()) / rest)
        part = difference(sums)
        if sums[0].any():
            shard = np.argsort(part[0])
        else:
            shard = np.random.default_rng(int(pdf["bytes"].sum())).permutation(n_shards)
        return pdf.assign(shard=shard[part[1:, 0]].astype("int32"))[["key", "n", "bytes", "shard"]]

    return place


@tidied
def sharded(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot per row of docs: sizes are UTF-8 bytes plus overhead, equal texts stay together.

    Null texts count no bytes and are a group of their own, apart from empty texts; repeated rows are rows. Slots
    number a shard's rows from 0 by (part of the shard, id, checksum, size), parts being of bounded size. A group
    larger than a shard's share fills a shard alone. An empty table gives an empty result. Texts are read once and
    not shuffled: a digest stands for them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit(b"\0")).otherwise(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))).alias("key"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    n_rows, (n_groups, total) = rows.count(), groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # No more than n_shards * LARGE groups can be large: these are balanced first, in one task.
    large = F.col("bytes") * n_shards * LARGE >= total
    first = written(groups.where(large).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(balanced(n_shards, None, 1), "key binary, n bigint, bytes bigint, shard int"), "large")
    load = dict(first.groupBy("shard").agg(F.sum("bytes")).collect())  # a row per shard
    loads = np.array([load.get(j, 0) for j in range(n_shards)], np.int64)
    n_buckets = max(1, math.ceil(n_groups / BUCKET_GROUPS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets))
    rest = groups.where(~large).groupBy(bucket).applyInPandas(balanced(n_shards, loads, max(1, total - int(loads.sum()))), "key binary, n bigint, bytes bigint, shard int")
    shard_of = first.unionByName(rest)
    # The copies of one text may be any share of the rows.
    placed = keyed_join(rows, shard_of.select("key", "n", "shard"), "key", "row", n_rows).drop("n", "row")
    n_parts = max(1, math.ceil(n_rows / (n_shards * SLOT_ROWS)))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(n_parts)))
    at = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "text_crc32", "size")) - 1
    placed = placed.withColumn("slot", at.cast("long"))
    if n_parts > 1:
        before = placed.groupBy("shard", "sub").count()
        before = before.select("shard", "sub", (F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")).alias("before"))
        placed = placed.join(before, ["shard", "sub"]).withColumn("slot", F.col("slot") + F.col("before"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
