"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Every document's shingle set is sketched by minwise values, one per coordinate; documents with equal sets are one from
there on. Independent trees branch the sketches: a node picks a coordinate by a hash of its path, now and then a
second one (1/threshold on average, so that a pair at the threshold keeps one common child), and parts its documents by
their value there. Nodes small enough are compared exhaustively; larger ones branch again. Sketches choose the documents
that need their texts, and links are confirmed on full shingle sets.

Only components are wanted, so large groups of near copies are linked to a pivot each first, by confirmed links. What is
left inside such a group is found by differences from the pivot: a document that doesn't link to the pivot can only
link to one with which it shares a good part of that one's difference, so the rarest differences find them all. Trees then need no comparison inside a group: in
a large node whose commonest group leaves few others, these are compared with blocks of that group; a node of a block's size
is compared as it is. So rows grow with
documents, not with pairs. What is still large and mixed in the deepest level is compared exactly, block against block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import connected_components, dropped, keyed_join, lowest, tidied, written

COORDINATES, TREES, LEAF, BLOCK, MAX_DEPTH = 64, 8, 250, 1000, 16
#: Coordinates of a band and bands of a sketch that show groups of near copies, and how often pivots are looked for.
BAND, BANDS, PIVOT_ROUNDS = 4, 8, 3
#: Least similarity to its pivot at which a document counts as one of the pivot's group.
GROUP_SIMILARITY = 0.5
#: Size of a cluster whose texts travel together, in shingles or 8 characters of text; a larger one is cut into pairs of blocks.
CLUSTER_SIZE = 2_000_000
#: Chance that a pair right at the threshold is lost, for the trees and for the sketches' agreement each.
MISS = 1e-4
_RNG = np.random.default_rng(20240521)
SPREAD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASK = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
FACTOR = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORDS: dict[bytes, int] = {}


def word_hashes(text: str | None, max_kept: int = 150_000) -> np.ndarray:
    """64-bit hashes of the words of text: A-Z as a-z, parted by ASCII white space."""
    if len(_WORDS) > max_kept:
        _WORDS.clear()
    words = (text or "").encode().lower().split()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of k words; fewer words are one shingle, no word gives none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += (w[i : len(w) - n + 1 + i] ^ (w[i : len(w) - n + 1 + i] >> np.uint64(29))) * SPREAD[i % 64]
        h ^= h >> np.uint64(32)
    return np.unique(h * SPREAD[63])


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's permutation over the set."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        y = (x[i : i + 512, None] ^ MASK) * FACTOR
        y ^= y >> np.uint32(15)
        np.minimum(low, (y * np.uint32(0x2C1B3C6D)).min(axis=0), out=low)
    return low


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key (digest of the shingle set), weight (shingles, or characters / 8 if more), sketch per row of docs; one map over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights, keys, low = [], [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                s = shingle_set(text, k)
                sizes.append(len(s))
                weights.append(max(len(s), len(text) // 8))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low.append(minwise(s) if len(s) else np.zeros(COORDINATES, np.uint32))
            flat = pa.array(np.concatenate(low).view(np.int32) if low else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * COORDINATES), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(weights, pa.int64()), lists], names=["id", "n_shingles", "set_key", "weight", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_shingles bigint, set_key binary, weight bigint, sketch array<int>")


def branch(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes(path, used, sketch, ...) a level deeper: new path and used, the bits of the coordinates a path has taken.

    A node's coordinates depend on its path alone and are ones that it hasn't taken yet (its first choice, where eight
    are all taken).
    """
    path, used = F.col("path"), F.col("used")
    one = F.lit(1).cast("long")

    def choice(salt: str, taken: Column) -> Column:
        tries = [F.pmod(F.xxhash64(path, F.lit(f"{salt}{j}")), F.lit(COORDINATES)).cast("int") for j in range(8)]
        bit = lambda i: F.call_function("shiftleft", one, i)
        return F.coalesce(*[F.when(taken.bitwiseAND(bit(i)) == 0, i) for i in tries], tries[0])

    bit = lambda i: F.call_function("shiftleft", one, i)
    nodes = nodes.withColumn("_a", choice("a", used)).withColumn("_b", choice("b", used.bitwiseOR(bit(F.col("_a")))))
    second = F.pmod(F.xxhash64(path, F.lit("second")), F.lit(10_000)) < int(10_000 * (1 / threshold - 1))
    child = lambda i: F.struct(F.xxhash64(path, i, F.get("sketch", i)).alias("path"), used.bitwiseOR(bit(i)).alias("used"))
    both = F.when(second, F.array(child(F.col("_a")), child(F.col("_b")))).otherwise(F.array(child(F.col("_a"))))
    others = [c for c in nodes.columns if c not in ("path", "used", "_a", "_b")]
    return nodes.withColumn("_child", F.explode(both)).select("_child.*", *others)


def agreement_floor(threshold: float) -> int:
    """Greatest number of equal coordinates that a pair at the threshold falls short of with a chance of MISS / 10 at most."""
    below, floor = 0.0, 0
    while True:
        below += math.comb(COORDINATES, floor) * threshold**floor * (1 - threshold) ** (COORDINATES - floor)
        if below > MISS / 10:
            return floor
        floor += 1


def trees_for(depth: int, threshold: float) -> int:
    """How many trees lose a pair right at the threshold with a chance of MISS at most, when it is parted depth times."""
    alive, second = 1.0, 1.0 / threshold - 1.0
    for _ in range(depth):
        alive = 1.0 - (1.0 - threshold * alive) * (1.0 - second * threshold * alive)
    return math.ceil(math.log(MISS) / math.log(1.0 - alive))


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges to each linked row's smallest reachable row, for a symmetric boolean matrix."""
    n = len(links)
    low = np.arange(n, dtype=np.int32)
    links = links | np.eye(n, dtype=bool)
    while True:
        new = np.where(links, low, np.int32(n)).min(axis=1)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(i, int(low[i])) for i in range(n) if low[i] != i]


def agreeing(left: np.ndarray, right: np.ndarray, floor: int) -> np.ndarray:
    """Pairs of a row of left and one of right that agree in floor coordinates or more."""
    if len(left) * len(right) <= 1600:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2) >= floor
    same = np.zeros((len(left), len(right)), np.uint8)
    for c in range(left.shape[1]):
        same += left[:, c, None] == right[None, :, c]
    return same >= floor


def linked(sets: list[np.ndarray], threshold: float, whole: np.ndarray | None = None) -> np.ndarray:
    """Pairs with intersection >= threshold * union, exactly, over full sets; all pairs at once by a 0/1 product.

    Where whole is given, sets are differences of sets of these sizes from one and the same set: two sets differ where
    their differences do.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    ids = np.concatenate(sets)
    rows = np.repeat(np.arange(n), size)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    col = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    count = np.bincount(col) if len(col) else np.zeros(0, np.int64)
    inter = np.zeros(n * n, np.int64)
    # Shingles of many documents by a product of 0/1 matrices, those of few by pairs at each distance in their lists.
    many = count > max(16, n // 16)
    heavy = many[col]
    width = max(64, 2_000_000 // n)
    place = (np.cumsum(many) - 1)[col[heavy]]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(many.sum()), width):
        inside = (place >= lo) & (place < lo + width)
        part = np.zeros((n, min(width, int(many.sum()) - lo)), np.float32)
        part[rows[heavy][inside], place[inside] - lo] = 1
        both += part @ part.T
    few, few_col = rows[~heavy], col[~heavy]
    for gap in range(1, int(count[~many].max(initial=0))):
        pair = few_col[gap:] == few_col[:-gap]
        if not pair.any():
            break
        inter += np.bincount(few[:-gap][pair] * n + few[gap:][pair], minlength=n * n)
    inter = inter.reshape(n, n)
    percent = round(threshold * 100)
    out = np.empty((n, n), bool)
    for i in range(n):  # row by row: no more than a few arrays of n x n at once
        own = inter[i] + inter[:, i] + np.rint(both[i]).astype(np.int64)
        total = size[i] + size
        if whole is not None:
            own, total = (whole[i] + whole - total + 2 * own) // 2, whole[i] + whole
        out[i] = 100 * own >= percent * (total - own)
    np.fill_diagonal(out, False)
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return column.offsets.to_numpy(), column.values


def candidate_clusters(groups: DataFrame, threshold: float) -> DataFrame:
    """cluster: sorted set keys that their sketches hold together, for groups(members: array of set_key, sketch, cls, grp).

    Documents of one class are linked already, and those of one group are compared by their differences; neither are
    compared here.
    """
    floor = agreement_floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = lists(batch.column(0))
            keys, low = values.field("set_key"), values.field("sketch")
            classes, near = (values.field(f).to_numpy(zero_copy_only=False) for f in ("cls", "grp"))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = low.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, COORDINATES)
                cls, grp = classes[a:b], near[a:b]
                names = keys.slice(a, b - a).to_pylist()
                # The commonest group comes last and is only compared with the others.
                kinds, which, count = np.unique(grp, return_inverse=True, return_counts=True)
                order = np.argsort(which == count.argmax(), kind="stable")
                own, cls, grp = own[order], cls[order], grp[order]
                few = max(1, int(b - a - count.max()))
                close = agreeing(own[:few], own, floor) & (cls[:few, None] != cls[None, :]) & (grp[:few, None] != grp[None, :])
                if not close.any():
                    continue
                for members in held_together(close):
                    out.append(sorted(names[order[i]] for i in members))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["cluster"])

    return groups.mapInArrow(run, "cluster array<binary>")


def held_together(close: np.ndarray) -> list[np.ndarray]:
    """Groups of two or more rows that close holds together, for a matrix of the first rows against all rows."""
    few, n = close.shape
    low = np.arange(n)
    while True:
        new = low.copy()
        new[:few] = np.minimum(low[:few], np.where(close, low[None, :], n).min(axis=1))
        new = np.minimum(new, np.where(close, new[:few, None], n).min(axis=0))
        new = new[new]
        if (new == low).all():
            break
        low = new
    order = np.argsort(low, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(low[order])) + 1) if len(g) > 1]


def confirmed_edges(clusters: DataFrame, k: int, threshold: float) -> DataFrame:
    """a, b: the classes that a spanning forest of each cluster's links joins, for clusters(texts: array of cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = lists(batch.column(0))
            classes, texts = values.field("cls"), values.field("text")
            left, right = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                sets = [shingle_set(texts[int(i)].as_py(), k) for i in range(a, b)]
                for i, j in forest(linked(sets, threshold)):
                    left.append(classes[int(a + i)].as_py())
                    right.append(classes[int(a + j)].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return clusters.mapInArrow(run, "a bigint, b bigint")


def around_pivots(parts: DataFrame, k: int, threshold: float) -> DataFrame:
    """set_key, pivot, link, whole, size, apart for parts(pivot, texts: array of set_key, text).

    Rows with a link are a spanning forest of a part's links. The others are the documents of the pivot's group, one row
    each: its differences (apart, the shingles in only one of the two sets), the size of its set, and whether it has no
    link to the pivot (whole).
    """
    kind = "set_key binary, pivot binary, link binary, whole boolean, size bigint, apart array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = lists(batch.column(1))
            keys, texts = values.field("set_key"), values.field("text")
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                pivot = batch.column(0)[row].as_py()
                own = keys.slice(a, b - a).to_pylist()
                if pivot not in own:
                    continue
                order = sorted(range(b - a), key=lambda i: (own[i] != pivot, own[i]))
                own = [own[i] for i in order]
                sets = [shingle_set(texts[int(a + i)].as_py(), k) for i in order]
                links = linked(sets, threshold)
                salt = np.uint64(xxhash.xxh3_64_intdigest(pivot))
                rows = [(own[i], own[j], None, None, None) for i, j in forest(links)]
                for i in range(1, len(sets)):
                    apart = np.setxor1d(sets[i], sets[0], assume_unique=True)
                    both = (len(sets[i]) + len(sets[0]) - len(apart)) / 2
                    if both >= GROUP_SIMILARITY * (both + len(apart)):
                        mixed = np.sort((apart ^ salt) * SPREAD[1]).view(np.int64)
                        rows.append((own[i], None, not links[i, 0], len(sets[i]), mixed))
                found, link, whole, size, apart = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array([pivot] * len(rows), pa.binary()), pa.array(link, pa.binary()), pa.array(whole, pa.bool_()), pa.array(size, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
                    names=["set_key", "pivot", "link", "whole", "size", "apart"],
                )

    return parts.mapInArrow(run, kind)


def linked_by_differences(groups: DataFrame, threshold: float) -> DataFrame:
    """a, b: the classes that a spanning forest of the links between them joins, for groups(members: array of cls, size, apart) of one pivot each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = lists(batch.column(0))
            apart = values.field("apart")
            classes, sizes = (values.field(f).to_numpy(zero_copy_only=False) for f in ("cls", "size"))
            left, right = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own, cls = apart.slice(a, b - a), classes[a:b]
                if (cls == cls[0]).all():
                    continue
                ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))
                sets = np.split(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1])
                for i, j in forest(linked(sets, threshold, sizes[a:b]) & (cls[:, None] != cls[None, :])):
                    left.append(int(cls[i]))
                    right.append(int(cls[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint")


class Texts:
    """The documents' table, from which a set's text is fetched when links are to be confirmed."""

    def __init__(self, docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str):
        self.docs, self.k, self.threshold, self.id_col, self.text_col = docs, k, threshold, id_col, text_col

    def of(self, ids: DataFrame) -> DataFrame:
        """set_key, text: one text for each set in ids(set_key, rep). Found by id; the text's own set decides, so ids may repeat or be null."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s := shingle_set(x.as_py(), k)) else None for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["set_key", "text"])

        picked = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).cast("string").alias("text"))
        picked = picked.join(ids.select("rep"), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
        found = picked.select("text").mapInArrow(run, "set_key binary, text string")
        return found.join(ids.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])

    def links(self, clusters: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b (written): the classes joined by confirmed links inside clusters(c, set_key), for sets(set_key, rep, weight, cls)."""
        ids = written(sets.select("set_key", "rep", "weight", "cls").join(clusters.select("set_key"), "set_key", "left_semi"), "wanted")
        cut = cut_to_size(clusters.join(ids.select("set_key", "weight", "cls"), "set_key"))
        gathered = cut.join(self.of(ids), "set_key").groupBy("c").agg(F.collect_list(F.struct("cls", "text")).alias("texts")).select("texts")
        links = written(confirmed_edges(gathered, self.k, self.threshold).distinct(), "links")
        dropped(ids)
        return links

    def around(self, parts: DataFrame) -> DataFrame:
        """set_key, pivot, link, whole, size, apart (written) for parts(c, pivot, set_key, rep), in which each part holds its pivot: see around_pivots()."""
        gathered = parts.drop("rep").join(self.of(parts), "set_key").groupBy("c", "pivot").agg(F.collect_list(F.struct("set_key", "text")).alias("texts")).select("pivot", "texts")
        return written(around_pivots(gathered, self.k, self.threshold), "around")


def cut_to_size(wanted: DataFrame) -> DataFrame:
    """c, set_key and wanted's other columns but weight: clusters of up to CLUSTER_SIZE as they are, larger ones as pairs of blocks that hold every pair.

    Clusters have a bounded number of documents, so the blocks of one are bounded too.
    """
    total = wanted.groupBy("c").agg(F.sum("weight").alias("total"))
    blocks = F.when(F.col("total") > CLUSTER_SIZE, F.ceil(2 * F.col("total") / CLUSTER_SIZE)).otherwise(F.lit(1).cast("long"))
    rows = wanted.join(total, "c").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    others = [c for c in wanted.columns if c not in ("c", "weight")]
    return rows.select(F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")).alias("c"), *others)


def pivot_links(texts: Texts, sets: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of confirmed links (set_key, link) in large groups of near copies, and the first one with differences, as in around_pivots().

    The sets that agree in a band of the sketch show a group. Its pivot is the member found in the most and largest of
    them, which is near the middle; a member takes the best pivot of its bands, and the members of a pivot are compared
    with it, and with one another, in parts of LEAF or of bounded size. Members without a link look for other pivots in
    the next round, unless nothing was linked in this one. A member is one row a round and band, however large its groups are.
    """
    links, first, rest = [], None, sets.select("set_key", "rep", "weight", "sketch")
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("sketch", F.lit(b * BAND + i)) for i in range(BAND)]) for b in range(BANDS)])
    for _ in range(PIVOT_ROUNDS):
        rows = rest.select("set_key", "rep", "weight", F.explode(bands).alias("band"))
        # Small tables are written where they are joined: Spark knows how few rows they have and needn't shuffle the others.
        large = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF), "bands")
        total = large.agg(F.sum("n")).first()[0]
        if not total:
            dropped(large)
            break
        member = keyed_join(rows, large, "band", "set_key", total).groupBy("set_key")
        member = written(member.agg(F.first("rep").alias("rep"), F.first("weight").alias("weight"), F.sum("n").alias("score"), F.collect_list("band").alias("bands")), "members")
        rows = member.select("set_key", "rep", "weight", "score", F.explode("bands").alias("band"))
        top = rows.groupBy("band").agg(F.max(F.struct("score", F.xxhash64("set_key").alias("h"), "set_key", "rep")).alias("top"), F.count(F.lit(1)).alias("n"))
        top = written(top, "tops")
        best = keyed_join(rows.drop("score"), top, "band", "set_key", total).groupBy("set_key").agg(F.max("top").alias("top"), F.first("rep").alias("rep"), F.first("weight").alias("weight"))
        best = written(best.select("set_key", "rep", "weight", F.col("top.set_key").alias("pivot"), F.col("top.rep").alias("pivot_rep")), "pivots")
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / LEAF), F.ceil(2 * F.sum("weight") / CLUSTER_SIZE))
        sizes = written(best.groupBy("pivot").agg(F.first("pivot_rep").alias("pivot_rep"), F.count(F.lit(1)).alias("n"), parts.alias("parts")), "sizes")
        members = sizes.agg(F.sum("n")).first()[0]
        dealt = keyed_join(best.where("set_key <> pivot").drop("pivot_rep"), sizes.drop("pivot_rep"), "pivot", "set_key", members)
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set_key", F.lit("part")), "parts")).select("part", "pivot", "set_key", "rep")
        own = sizes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pivot", F.col("pivot").alias("set_key"), F.col("pivot_rep").alias("rep"))
        dealt = written(dealt.union(own).select(F.xxhash64("pivot", "part").alias("c"), "pivot", "set_key", "rep"), "parts")
        found = texts.around(dealt)
        first = first or found
        links.append(found.where("link is not null").select(F.col("set_key").alias("a"), F.col("link").alias("b")))
        ends = links[-1].select(F.col("a").alias("set_key")).union(links[-1].select("b"))
        left = written(best.select("set_key", "rep", "weight").join(ends, "set_key", "left_anti"), "rest")
        dropped(large, member, top, best, sizes, dealt)
        if left.count() == members:  # nothing was linked: another round would have the same bands, pivots and parts
            break
        rest = left.join(sets.select("set_key", "sketch"), "set_key")
    return links, first


def classed(sets: DataFrame, links: list[DataFrame], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets with cls and grp (written), a, b: links between classes), for links and found as pivot_links() gives them.

    In a part, all that links to a set is linked to it directly or has the same link, so a link's end is the name of a
    class. A set with several links, such as a pivot that links to another one, takes the least name, and the
    names are linked; sets without a link are classes of their own. So classes need no rounds of connected components, only
    these links and those found later do.
    """
    own, name = F.xxhash64("set_key"), lambda c: F.xxhash64(c)
    ends, none = union(links), F.lit(None).cast("long")
    rows = ends.select(F.col("a").alias("set_key"), name("b").alias("at"), none.alias("grp")).union(ends.select("b", name("b"), none))
    rows = rows.union(found.where("apart is not null").select("set_key", none, name("pivot"))).union(found.select("pivot", none, name("pivot")))
    classes = written(rows.groupBy("set_key").agg(F.array_sort(F.collect_set("at")).alias("names"), F.min("grp").alias("grp")), "classes")
    several = classes.where(F.size("names") > 1).select(F.get("names", F.lit(0)).alias("b"), F.explode(F.slice("names", 2, F.size("names"))).alias("a"))
    several = written(several.distinct(), "several")
    least = several.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("least"))
    out = sets.join(classes, "set_key", "left").withColumns({"cls": F.coalesce(F.get("names", F.lit(0)), own), "grp": F.coalesce("grp", own)}).drop("names")
    out = out.join(least, "cls", "left").withColumn("cls", F.coalesce("least", "cls")).drop("least")
    return written(out, "ready"), several


def settled(state: DataFrame, by: str) -> tuple[list[DataFrame], DataFrame | None]:
    """(groups, rest) of nodes state(path, set_key, by, ...): small ones and the groups for those where one value of by leaves few others; the rest, if there are such nodes.

    Nodes with one value of by, which need no comparison, are left out. Nodes of up to BLOCK are one group, whatever they
    hold: to branch them further would only give more nodes, and call for more trees, to find the same links.
    """
    mixed = state.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi").select("path", "n")
    mixed = written(mixed, "paths")
    total, most = mixed.agg(F.sum("n"), F.max("n")).first()
    state = written(keyed_join(state, mixed, "path", "set_key", total or 0), "nodes")
    dropped(mixed)
    small = state.where(F.col("n") <= LEAF).select("path", "set_key")
    if (most or 0) <= LEAF:
        return [small], None
    large = state.where(F.col("n") > LEAF)
    sizes = large.groupBy("path", by).agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F.max_by(by, "c").alias("most"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("others"))
    sizes = written(sizes, "large")
    large = keyed_join(large.drop("n"), sizes, "path", "set_key", total)
    whole = (F.col("others") <= BLOCK // 2) | (F.col("n") <= BLOCK)
    more = sizes.agg(F.count_if(~whole)).first()[0]
    return [small, against_blocks(large.where(whole), by)], large.where(~whole) if more else None


def differing(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b (written): links between classes of documents of one pivot's group, which join all that its links join, for found as around_pivots() gives it.

    Let x have no link to the pivot and y link to x. Then at least threshold / (1 + threshold) of y's differences are x's
    as well. So with the commonest differences last, one of those before y's last that many, less one, is among them: its
    prefix. Where y has no link to the pivot either, x and y share one of both prefixes. So a difference needs the
    documents that have it in their prefix, and all without a link to the pivot if one of these has such a link. Those
    are compared by their differences, which are as exact as their sets and much smaller.
    """
    percent = round(threshold * 100)
    docs = found.where("apart is not null").select("set_key", "whole", "size", "apart")
    docs = written(docs.join(classes.select("set_key", "cls"), "set_key"), "docs")
    tokens = docs.select("set_key", "cls", "whole", F.size("apart").alias("apart"), F.explode("apart").alias("token"))
    some = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("w")).where("n > 1 and w > 0").select("token", "n")
    some = written(some, "tokens")
    total = some.agg(F.sum("n")).first()[0] or 0
    rows = keyed_join(tokens, some, "token", "set_key", total)
    last = F.row_number().over(Window.partitionBy("set_key").orderBy(F.desc("n"), "token"))
    prefix = 100 * last + percent * last >= percent * F.col("apart")
    rows = written(rows.select("token", "set_key", "cls", "whole", prefix.alias("prefix")), "differences")
    some = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("prefix").alias("p"), F.count_if(F.expr("prefix and not whole")).alias("linked"))
    some = written(some.where("p > 0 and n > 1 and (linked > 0 or p > 1)").select("token", "n", "linked"), "tokens")
    total = some.agg(F.sum("n")).first()[0] or 0
    rows = keyed_join(rows, some, "token", "set_key", total).where("prefix or whole and linked > 0").select(F.col("token").alias("path"), "set_key", "cls")
    groups, rest = settled(rows, "cls")
    nodes = distinct_nodes(groups if rest is None else [*groups, block_pairs(rest)]).withColumnRenamed("path", "c")
    nodes = written(nodes.join(docs.withColumn("weight", F.size("apart").cast("long")).drop("whole"), "set_key"), "compared")
    gathered = cut_to_size(nodes).groupBy("c").agg(F.collect_list(F.struct("cls", "size", "apart")).alias("members")).select("members")
    links = written(linked_by_differences(gathered, threshold).distinct(), "links")
    dropped(nodes, docs)
    return links


def distinct_nodes(groups: list[DataFrame]) -> DataFrame:
    """path, set_key of the nodes of two documents or more; of nodes with the same documents, as other trees have them, one."""
    nodes = union(groups).groupBy("path").agg(F.array_sort(F.collect_set("set_key")).alias("keys")).where(F.size("keys") > 1)
    nodes = nodes.groupBy(F.xxhash64("keys").alias("h"), F.col("keys")).agg(F.first("path").alias("path"))
    return nodes.select("path", F.explode("keys").alias("set_key"))


def grown(sets: DataFrame, trees: range, threshold: float) -> tuple[list[DataFrame], int, DataFrame | None]:
    """Nodes to compare as tables of (path, set_key), the deepest level, and the sets that went below the second level.

    sets: set_key, sketch, grp. Nodes of one document or one group are left out.
    """
    roots = F.array(*[F.xxhash64(F.lit(t), F.lit("root")) for t in trees])
    state = branch(branch(sets.select("set_key", "sketch", "grp", F.explode(roots).alias("path"), F.lit(0).cast("long").alias("used")), threshold), threshold)
    state, groups, deep, depth = state.select("path", "used", "set_key", "grp"), [], None, 2
    while True:
        own, rest = settled(state, "grp")
        groups += own
        if rest is None:
            return groups, depth, deep
        if depth == MAX_DEPTH:
            groups.append(block_pairs(rest))
            return groups, depth, deep
        rest = written(rest.select("path", "used", "set_key", "grp", *["sketch"] * (depth > 2)), "deep")
        if rest.isEmpty():
            return groups, depth, deep
        if depth == 2:  # from here on the few documents in large nodes carry their sketches along
            deep = rest.select("set_key").distinct()
            rest = rest.join(sets.select("set_key", "sketch"), "set_key")
        state, depth = branch(rest, threshold).select("path", "used", "set_key", "grp", "sketch"), depth + 1


def against_blocks(large: DataFrame, by: str) -> DataFrame:
    """path, set_key of groups of a block of a node's documents with its commonest value of by and all its others: BLOCK / 2 at most, or all of a node of one block."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("set_key"), blocks)
    all_blocks = F.sequence(F.lit(0).cast("long"), blocks - 1)
    rows = large.withColumn("block", F.explode(F.when(F.col(by) == F.col("most"), F.array(own)).otherwise(all_blocks)))
    return rows.select(F.xxhash64("path", "block").alias("path"), "set_key")


def block_pairs(dense: DataFrame) -> DataFrame:
    """path, set_key of groups of two blocks each, which together hold every pair of a node's documents.

    A document is in one block by its hash and in a group for each block that its own is paired with.
    """
    blocks = F.ceil(2 * F.col("n") / BLOCK)
    rows = dense.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    return rows.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "set_key")


@tidied
def similar_documents(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """id, n_shingles, component_id, kept per row of docs.

    Links join documents whose sets of `shingle`-word shingles have a Jaccard similarity of threshold or more
    (taken in whole hundredths). component_id is the smallest id reachable by links, kept says that it is the
    document's own. Documents without words have an empty set, link with nothing and are their own component; so is
    a document with a null id, unless it has links. Rows with equal sets are linked, repeated rows too. An empty
    table gives an empty result; other columns of docs aren't looked at. Each link is confirmed on full sets. A pair
    right at the threshold is lost with a chance of about MISS: where trees grow deep, more of them are grown over the
    documents that went there.
    """
    all_docs = written(sketches(docs, shingle, id_col, text_col), "sketches")
    sets = all_docs.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.max("weight").alias("weight"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    sets = written(sets, "sets")
    texts = Texts(docs, shingle, threshold, id_col, text_col)
    own = F.xxhash64("set_key")
    links, found = pivot_links(texts, sets)
    ready, edges = sets.withColumns({"cls": own, "grp": own}), []
    if found is not None:
        ready, several = classed(sets, links, found)
        edges = [several, differing(found, ready, threshold)]
    groups, depth, deep = grown(ready, range(trees), threshold)
    if deep is not None and (wanted := trees_for(depth, threshold)) > trees:
        groups += grown(ready.join(deep, "set_key", "left_semi"), range(trees, wanted), threshold)[0]
    gathered = distinct_nodes(groups).join(ready, "set_key")
    gathered = gathered.groupBy("path").agg(F.collect_list(F.struct("set_key", "sketch", "cls", "grp")).alias("members")).select("members")
    clusters = candidate_clusters(gathered, threshold).groupBy("cluster").agg(F.count(F.lit(1)).alias("times"))
    clusters = written(clusters.select(F.monotonically_increasing_id().alias("c"), "cluster"), "clusters")
    edges.append(texts.links(clusters.select("c", F.explode("cluster").alias("set_key")), ready))
    classes = ready.groupBy("cls").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = connected_components(union(edges)).join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    classes = classes.join(lowest(member, "rep").withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("low", "rep").alias("low"))
    low = keyed_join(ready.select("set_key", "cls", "copies"), classes, "cls", "set_key", sets.count()).select("set_key", F.col("copies").alias("n"), "low")
    some = all_docs.select("id", "n_shingles", "set_key").where("set_key is not null")
    out = keyed_join(some, low, "set_key", "id", all_docs.count()).select("id", "n_shingles", "low")
    out = out.union(all_docs.where("set_key is null").select("id", "n_shingles", F.col("id").alias("low")))
    component = F.col("low")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
