"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of a label are laid out by the grid cells, of side epsilon, of their leading principal components; epsilon is
the distance between unit vectors at the wanted cosine. The sequence is cut into blocks of bounded size, blocks lie in
partitions and partitions in runs. Pairs of intervals are joined recursively from runs to partitions to blocks, and a
pair is skipped as soon as its bounding boxes in the leading components are farther apart than epsilon, which no pair
of vectors inside can undo. The surviving block pairs are gathered by pairs of tiles of neighbouring blocks, so that a
block travels once per tile and not once per block, and compared in double precision; a task gives counts and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.minhash_join import forest
from panelyard.llm.shared import connected_components, keyed_join, lowest, tidied, written

BLOCK_ROWS, TILE_BLOCKS, RUN_PARTITIONS = 512, 8, 64
GROUP = ["label", "length"]


def usable(vec: str = "vec") -> F.Column:
    """Vectors that can link: neither null, empty nor zero, and every component finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Leading axes of the unit vectors of the commonest length, as rows; the first coordinates where there is little to fit.

    The axes only steer the order and what can be skipped, so vectors of other lengths go without.
    """
    lengths = vectors.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths:
        return np.zeros((0, 0))
    length, n = lengths[0]
    dims = min(dims, length)
    if n < 2 * dims:
        return np.eye(length)[:dims]
    own = vectors.where(F.col("length") == length)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = own.select(norm.alias("n"), "vec").select(array_to_vector(F.transform("vec", lambda x: x.cast("double") / F.col("n"))).alias("v"))
    axes = PCA(k=dims, inputCol="v", outputCol="p").fit(unit).pc.toArray().T
    return axes if np.isfinite(axes).all() else np.eye(length)[:dims]


def laid_out(reps: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """reps with cells (array<int>) and place (array<double>), their leading components."""
    names = [*GROUP, "rep", "copies", "vec"]
    dims = axes.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec"))
            place = np.zeros((batch.num_rows, dims))
            for i, x in enumerate(vectors):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(v) == axes.shape[1]:
                    scaled = v / np.abs(v).max()
                    place[i] = axes @ (scaled / np.linalg.norm(scaled))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            cells = pa.ListArray.from_arrays(offsets, pa.array(np.floor(place / eps).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], cells, pa.ListArray.from_arrays(offsets, pa.array(place.ravel()))], names=[*names, "cells", "place"])

    fields = ", ".join(f"{c} {reps.schema[c].dataType.simpleString()}" for c in names)
    return reps.select(names).mapInArrow(run, f"{fields}, cells array<int>, place array<double>")


def boxes(df: DataFrame, key: str, dims: int, points: bool) -> DataFrame:
    """label, length, key, lo_i, hi_i: bounding boxes of the intervals named by key."""
    low = [F.min(F.get("place", i) if points else F.col(f"lo{i}")).alias(f"lo{i}") for i in range(dims)]
    high = [F.max(F.get("place", i) if points else F.col(f"hi{i}")).alias(f"hi{i}") for i in range(dims)]
    return df.groupBy(*GROUP, key).agg(F.first("up" if "up" in df.columns else key).alias("up"), *low, *high)


def near_pairs(left: DataFrame, right: DataFrame, on, eps: float, dims: int, spine: list) -> DataFrame:
    """Pairs of intervals, left key <= right key, whose boxes are no more than eps apart."""
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"))
    apart = sum((gap(i) * gap(i) for i in range(dims)), F.lit(0.0))
    joined = left.alias("a").join(right.alias("b"), on)
    return joined.where((F.col("a.key") <= F.col("b.key")) & (apart <= eps * eps + 1e-9)).select(*spine)


def compare(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links, other: weighted counts (other null) and forest edges (links null) for rows(left, right, pairs): two tiles and their block pairs."""

    def tile(x: pa.Scalar) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        items = x.values
        node, block, copies = (items.field(c).to_numpy(zero_copy_only=False) for c in ("node", "block", "copies"))
        v = items.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1)
        v /= np.abs(v).max(axis=1, keepdims=True)
        return {b: np.flatnonzero(block == b) for b in np.unique(block).tolist()}, node, copies, v / np.linalg.norm(v, axis=1, keepdims=True)

    def pair(left: tuple, right: tuple, x: int, y: int) -> tuple[list, list]:
        a, b = left[0][x], right[0][y]
        hit = left[3][a] @ right[3][b].T >= threshold
        if x == y:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return [], []
        if x == y:
            node, square, links = left[1][a], hit, hit @ left[2][a]
        else:
            node = np.concatenate([left[1][a], right[1][b]])
            square = np.zeros((len(node), len(node)), bool)
            square[: len(a), len(a) :] = hit
            square[len(a) :, : len(a)] = hit.T
            links = np.concatenate([hit @ right[2][b], hit.T @ left[2][a]])
        some = np.flatnonzero(links)
        edges = forest(square[np.ix_(some, some)])
        return list(zip(node[some].tolist(), links[some].tolist(), strict=True)), [(int(node[some[i]]), int(node[some[j]])) for i, j in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = tile(batch.column(0)[i]), tile(batch.column(1)[i])
                count, edges = {}, []
                for p in batch.column(2)[i].as_py():
                    found, links = pair(left, right, p["x"], p["y"])
                    edges += links
                    for node, n in found:
                        count[node] = count.get(node, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*count, *[a for a, _ in edges]], pa.int64()),
                        pa.array([*count.values(), *[None] * len(edges)], pa.int64()),
                        pa.array([*[None] * len(count), *[b for _, b in edges]], pa.int64()),
                    ],
                    names=["node", "links", "other"],
                )

    return rows.mapInArrow(run, "node bigint, links bigint, other bigint")


@tidied
def near_vectors(vectors: DataFrame, threshold: float = 0.93, dims: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n_links, component_id, kept per row of vectors; links join equal labels at a cosine of threshold or more.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing and
    are their own component; so do vectors of different lengths. Equal vectors are compared once and counted as often
    as they stand there, so repeated rows link with each other. component_id is the smallest id reachable by links, a
    null id never being the smallest. An empty table gives an empty result. Other columns are not looked at.
    """
    eps = math.sqrt(max(0.0, 2.0 * (1.0 - threshold)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.withColumn("length", F.size("vec"))
    reps = rows.where(usable()).groupBy(*GROUP, "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps, "vectors")
    axes = principal_axes(reps, dims)
    dims = axes.shape[0]
    order = [*GROUP, "cells", "rep", F.xxhash64("vec")]
    nodes = laid_out(reps, axes, max(eps, 1e-6)).repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "layout")
    part = F.shiftright("node", 33)
    nodes = nodes.withColumn("part", part).withColumn("block", part * (1 << 24) + F.floor(F.col("node").bitwiseAND((1 << 33) - 1) / block_rows))
    block = written(boxes(nodes.withColumn("up", F.col("part")), "block", dims, True), "blocks")
    parts = boxes(block.select("*", F.col("up").alias("part")).drop("up").withColumn("up", F.floor(F.col("part") / RUN_PARTITIONS)), "part", dims, False)
    parts = written(parts, "partitions")
    runs = boxes(parts.select("*", F.col("up").alias("run")).drop("up"), "run", dims, False)
    level = lambda df, key: df.withColumnRenamed(key, "key")
    group = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in GROUP]
    # All runs of a label meet; the left ones are dealt over tasks, the right ones, 1 / RUN_PARTITIONS of the partitions, are copied to them.
    dealt = level(runs, "run").withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(16)))
    copied = level(runs, "run").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    pairs = near_pairs(dealt, copied, [*group, F.col("a._part") == F.col("b._part")], eps, dims, [*[f"a.{c}" for c in GROUP], F.col("a.key").alias("x"), F.col("b.key").alias("y")])
    for table, key in ((parts, "part"), (block, "block")):
        child = level(table, key)
        left = pairs.join(child.withColumnRenamed("up", "x"), [*GROUP, "x"])
        on = [*group, F.col("a.y") == F.col("b.up")]
        pairs = near_pairs(left, child, on, eps, dims, [*[f"a.{c}" for c in GROUP], F.col("a.key").alias("x"), F.col("b.key").alias("y")])
    pairs = written(pairs.distinct(), "pairs")
    of = lambda c: F.floor(F.col(c) / TILE_BLOCKS)
    tiles = written(nodes.groupBy(*GROUP, of("block").alias("tile")).agg(F.collect_list(F.struct("node", "block", "copies", "vec")).alias("items")), "tiles")
    work = pairs.groupBy(*GROUP, of("x").alias("tx"), of("y").alias("ty")).agg(F.collect_list(F.struct("x", "y")).alias("pairs"))
    here = lambda key, name: tiles.select(*GROUP, F.col("tile").alias(key), F.col("items").alias(name))
    work = work.join(here("tx", "left"), [*GROUP, "tx"]).join(here("ty", "right"), [*GROUP, "ty"])
    found = written(compare(work.select("left", "right", "pairs"), threshold), "found")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    ids = nodes.select("node", *GROUP, "vec", "rep", "copies")
    low = lowest(member.join(ids.select("node", "rep"), "node"), "rep")
    ids = ids.join(links, "node", "left").join(low, "node", "left")
    ids = ids.select(F.xxhash64("label", "vec").alias("key"), F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("low", "rep").alias("low"), F.col("copies").alias("n"))
    able = rows.where(usable()).withColumn("key", F.xxhash64("label", "vec"))
    total = reps.agg(F.sum("copies")).first()[0] or 0
    out = keyed_join(able, ids, "key", "id", total).where((F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec"))).select("id", "links", "low")
    out = out.union(rows.where(~usable()).select("id", F.lit(0).cast("long"), "id"))
    component = F.coalesce("low", "id")
    return out.select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
