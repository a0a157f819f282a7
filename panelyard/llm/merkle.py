"""Merkle manifest of a dataset: a tree of digests over every source's documents and one over the sources.

Leaves are put in order by range partitions and counts per partition, so that each knows its place; 4096 places in a
row are a superblock, whose top is one node of its source's tree. The few tops are reduced level by level. What a
superblock lacks for its proofs, the siblings of its top and of all nodes above, is passed down from the root, and
leaves and those outer nodes are cogrouped by superblock: the local levels are reduced again, proofs joined and
folded up to the root within one task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import dropped, tidied, written

ARITY = 16
#: A superblock is a subtree of this many levels: ARITY ** LEVELS leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

OUTER = "array<struct<slot:int,run:array<string>>>"
PROVED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**values: Column) -> Column:
    """H of the fields in order, each '-' if null, else its UTF-8 byte count, ':' and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and changed: the leaf of the tampered text where the row is one of those tampered with, else null."""
    fields = {k: F.col(k).cast("string") for k in FIELDS}
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.encode(fields["doc_id"], "UTF-8")) % 5 == 0
    return docs.select("doc_id", "source", leaf_digest(**fields).alias("leaf"), F.when(tampered, leaf_digest(**fields | {"text": lower})).alias("changed"))


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with place (from 0) and total within their tree, in the order of the given columns; as a written table.

    Rows are sorted by range partitions; how many rows of a tree stand in the partitions before is a table of a row for
    each partition and tree in it, at most their numbers added. Rows that are equal in all of this are dealt by chance of a hash.
    """
    # In a range sort each partition holds a contiguous piece; ids within it count up by one.
    tie = F.xxhash64(F.monotonically_increasing_id())
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("_tie", tie).repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    own = written(ordered.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_tie"), name)
    pieces = own.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("low"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select(tree, "_part", (before - F.col("low")).alias("shift"), F.sum("n").over(w).alias("total"))
    return own.join(offsets, [tree, "_part"]).withColumn("place", F.col("_row") + F.col("shift")).drop("_part", "_row", "shift")


def reduced(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The levels of a local tree from its leaves: so many more levels, or to a single node where levels is None."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([digest(*low[i : i + ARITY]) for i in range(0, len(low), ARITY)])
    return out


def local_levels(rows: pd.DataFrame, height: int) -> list[list[str]]:
    """The levels of a superblock's rows, which are in order: height more, fewer where the whole tree is lower."""
    return reduced(rows["leaf"].tolist(), height if rows["total"].iloc[0] > ARITY**height else None)


def _top(rows: pd.DataFrame, height: int) -> pd.DataFrame:
    """The top of one superblock (ARITY ** height rows at most)."""
    rows = rows.sort_values("place")
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "idx": [rows["block"].iloc[0]], "total": [-(-int(rows["total"].iloc[0]) // ARITY**height)], "node": [local_levels(rows, height)[-1][0]]})


def raised(tops: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above tops(tree, idx, total, node) and the roots.

    Each level has tree, idx, total, node and run, the digests below; a group is a run of ARITY nodes at most.
    Roots are the nodes of their trees' last levels: tree, node, level (0: among the tops).
    """
    level, roots, above = tops.withColumn("run", F.array().cast("array<string>")), [], []
    while True:
        roots.append(level.where("total = 1").select("tree", "node", F.lit(len(above)).alias("level")))
        parent = level.where("total > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx")).agg(
            F.first(F.ceil(F.col("total") / ARITY)).alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"]).alias("run")
        )
        parent = written(parent.select("tree", "idx", "total", F.sha2(F.array_join("run", ""), 256).alias("node"), "run"), "level")
        if not parent.take(1):
            dropped(parent)
            break
        above.append(parent)
        level = parent
    return above, reduce(DataFrame.unionByName, roots)


def handed_down(above: list[DataFrame], roots: DataFrame) -> DataFrame:
    """tree, idx, outer and whatever else roots has, for each node that the levels began with.

    roots(tree, level, outer, ...): what stands outside each root. outer lists, from low to high, the run that a node
    stands in and its slot there; each level adds one to what its parent has.
    """
    extra = [c for c in roots.columns if c not in ("tree", "level")]
    found = None
    for k in range(len(above), -1, -1):
        begin = roots.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("idx"), *extra)
        if found is None:
            found = begin
            continue
        parents = found.join(above[k].select("tree", "idx", "run"), ["tree", "idx"])
        own = F.array(F.struct(F.col("slot").alias("slot"), F.col("run").alias("run"))).cast(OUTER)
        below = parents.select("tree", "idx", *extra, "run", F.posexplode("run").alias("slot", "_node")).select(
            "tree", (F.col("idx") * ARITY + F.col("slot")).cast("long").alias("idx"), *[F.concat(own, "outer").alias("outer") if c == "outer" else F.col(c) for c in extra]
        )
        found = begin.unionByName(below)
    return found


def siblings(run: list[str], slot: int) -> tuple[str, str]:
    return "".join(run[:slot]), "".join(run[slot + 1 :])


def _prove(rows: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """Proofs of the leaves of one superblock: local runs first, then the outer ones that all its leaves share."""
    rows = rows.sort_values("place")
    out = {"id": rows["id"], "leaf": rows["leaf"]}
    if rows.empty:
        return pd.DataFrame(out).assign(subroot="", root="", proof_sha256="", folded_root="", verified=False)
    top = outer.iloc[0]
    levels = local_levels(rows, height)
    shared = [siblings(list(x["run"]), x["slot"]) for x in top["outer"]]
    beyond = "".join(a + b for a, b in shared)
    proofs, folded = [], []
    for i, (leaf, changed) in enumerate(zip(rows["leaf"], rows["changed"], strict=True)):
        at, path = i, []
        for low in levels[:-1]:
            first = at - at % ARITY
            path.append(siblings(low[first : first + ARITY], at - first))
            at //= ARITY
        h = hashlib.sha256("".join(a + b for a, b in path).encode())
        h.update(beyond.encode())
        proofs.append(h.hexdigest())
        folded.append(reduce(lambda node, x: digest(x[0], node, x[1]), path + shared, leaf if changed is None else changed))
    return pd.DataFrame(out | {"subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": folded, "verified": [f == top["root"] for f in folded]})


@tidied
def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A proof for each row of docs(doc_id, source, lang, n_chars, text) under one root.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Leaves stand in the order of doc_id, null ids
    first, rows of one id in the order of their digests; rows that are equal in every field have places of their own. A null
    source is a source, and the first; null fields are told apart from empty ones. Rows without an id aren't tampered with.
    Very long texts are hashed where they are read and don't travel. Other columns are not part of a leaf. An
    empty table has no root and no rows. levels is the height of a superblock, and changes no result.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    own = written(leaves(docs).withColumn("tree", key).drop("source"), "digests")
    rows = written(placed(own, "tree", ["doc_id", "leaf"], "leaves").withColumn("block", F.floor(F.col("place") / ARITY**levels)), "places")
    tops = written(rows.select("tree", "block", "total", "place", "leaf").groupBy("tree", "block").applyInPandas(lambda rows: _top(rows, levels), "tree string, idx long, total long, node string"), "tops")
    above, subroots = raised(tops)
    # The sources are the leaves of one more tree; its levels are reduced from the sources themselves.
    named = written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node").alias("leaf"), "level"), "subroots")
    ranked = written(placed(named, "tree", ["name"], "sources"), "ranked")
    source_levels, root = raised(ranked.select("tree", F.col("place").alias("idx"), "total", F.col("leaf").alias("node")))
    start = root.select("tree", "level", F.col("node").alias("root"), F.array().cast(OUTER).alias("outer"))
    by_source = handed_down(source_levels, start).select(F.col("idx").alias("place"), "root", "outer")
    sources = written(ranked.join(by_source, "place").select(F.col("name").alias("tree"), "level", F.col("leaf").alias("subroot"), "root", "outer"), "paths")
    outer = written(handed_down(above, sources), "outer").withColumnRenamed("idx", "block")
    proved = rows.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id").groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(lambda rows, above: _prove(rows, above, levels), PROVED)
    return proved.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), *proved.columns[1:])
