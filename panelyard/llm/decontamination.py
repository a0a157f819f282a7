"""Benchmark decontamination with suffix arrays over the training texts.

Each task takes its documents shard by shard. A shard's words become numbers of the benchmark's vocabulary (0: any
other word, and between documents); stretches of known words shorter than the shortest window cannot hold a match and
are left out. What remains gets a suffix array by prefix doubling, and every benchmark suffix is looked up in it by
binary search. The interval found for a window holds all its occurrences; narrowing it word by word gives the
suffix's longest verbatim match. The corpus is read once and not shuffled; the benchmark is taken in blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.shared import written

#: Bytes that stand in words: digits, letters (A-Z as a-z) and everything beyond ASCII; all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Probe:
    """A block of benchmark items as numbered words, with the suffixes to look up."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        coded = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32) for _, w in kept]
        self.words = np.concatenate([*coded, np.zeros(1, np.int32)])
        sizes = np.array([len(c) for c in coded], np.int64)
        starts = np.cumsum(sizes) - sizes
        # A window starts at each place that leaves a whole one; an item shorter than that is one window.
        spans = np.minimum(sizes, window)
        per_item = sizes - spans + 1
        self.item = np.repeat(np.arange(len(kept)), per_item)
        self.place = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.start = starts[self.item] + self.place
        self.span = spans[self.item]
        self.left = sizes[self.item] - self.place
        self.least = int(spans.min()) if len(kept) else 0
        # Equal windows are looked up once.
        self.group = np.zeros(len(self.start), np.int64)
        seen: dict[bytes, int] = {}
        for k, (s, n) in enumerate(zip(self.start, self.span, strict=True)):
            self.group[k] = seen.setdefault(self.words[s : s + n].tobytes(), len(seen))
        self.first = np.unique(self.group, return_index=True)[1] if len(seen) else np.zeros(0, np.int64)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places of words in the order of their suffixes; word 0 ends a suffix. Prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    rank[words == 0] = 0
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        ahead[rank == 0] = 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.r_[False, ordered[1:] != ordered[:-1]]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh) + 1
        new[words == 0] = 0
        step *= 2
        if step >= n or new.max() == rank.max():
            return order
        rank = new


def intervals(words: np.ndarray, order: np.ndarray, probe: Probe, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each picked window the interval of the suffix array whose suffixes begin with it, by binary search."""
    span, start = probe.span[pick], probe.start[pick]
    depth = int(span.max())
    padded = np.concatenate([words, np.zeros(depth, np.int32)])

    def compare(at: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix against the window, over the window's words."""
        out, open_ = np.zeros(len(at), np.int8), np.arange(len(at))
        for d in range(depth):
            open_ = open_[d < span[open_]]
            if not len(open_):
                break
            a, b = padded[order[at[open_]] + d], probe.words[start[open_] + d]
            out[open_] = np.sign(a - b)
            open_ = open_[a == b]
        return out

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(pick), np.int64), np.full(len(pick), len(order), np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(order) - 1)
            c = compare(mid)
            right = (lo < hi) & ((c <= 0) if upper else (c < 0))
            hi = np.where((lo < hi) & ~right, mid, hi)
            lo = np.where(right, mid + 1, lo)
        return lo

    return bound(False), bound(True)


class Shard:
    """Documents of one task, gathered until they are looked up together."""

    def __init__(self, probe: Probe):
        self.probe, self.parts, self.n = probe, [], 0
        self.counts: list[int] = []

    def add(self, text: str | None) -> None:
        words = words_of(text)
        get = self.probe.vocab.get
        codes = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.r_[0, codes != 0, 0]))
        starts, ends = known[::2], known[1::2]
        for s, e in zip(starts, ends, strict=True):
            if e - s >= self.probe.least > 0:
                self.parts.append((len(self.counts), int(s), codes[s:e]))
        self.counts.append(len(words))
        self.n += len(words)

    def look_up(self) -> tuple[list[list[int]], list[list[tuple]]]:
        """Per document: places of hit words, and (item, longest match, its place in the item, its place in the document) per item."""
        probe, n_docs = self.probe, len(self.counts)
        hits, found = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
        if not self.parts:
            return hits, found
        words = np.concatenate([np.r_[c, np.int32(0)] for _, _, c in self.parts]).astype(np.int32)
        sizes = np.array([len(c) + 1 for _, _, c in self.parts])
        doc = np.repeat([d for d, _, _ in self.parts], sizes)
        offset = np.repeat(np.array([s for _, s, _ in self.parts]) - (np.cumsum(sizes) - sizes), sizes)
        order = suffix_array(words)
        lo, hi = intervals(words, order, probe, probe.first)
        lo, hi = lo[probe.group], hi[probe.group]
        many = hi - lo
        if not many.any():
            return hits, found
        k = np.repeat(np.arange(len(many)), many)
        at = order[np.arange(len(k)) - np.repeat(np.cumsum(many) - many - lo, many)]
        n = len(words) + 1
        marks = np.bincount(at, minlength=n) - np.bincount(at + probe.span[k], minlength=n)
        covered = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
        cuts = np.flatnonzero(np.diff(doc[covered])) + 1
        for own in np.split(covered, cuts):
            hits[int(doc[own[0]])] = (own + offset[own]).tolist()
        # Windows that follow one another in both texts are one longer match.
        item, place = probe.item[k], probe.place[k]
        by = np.lexsort((place, at - place, item, doc[at]))
        k, at, item, place = k[by], at[by], item[by], place[by]
        same = (doc[at][1:] == doc[at][:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1)
        first = np.flatnonzero(np.r_[True, ~same])
        length = np.diff(np.r_[first, len(at)]) - 1 + probe.span[k[first]]
        at, item, place = at[first], item[first], place[first]
        by = np.lexsort((at, -length, item, doc[at]))
        at, item, place, length = at[by], item[by], place[by], length[by]
        top = np.r_[True, (doc[at][1:] != doc[at][:-1]) | (item[1:] != item[:-1])]
        for p, i, w, m in zip(at[top], item[top], place[top], length[top], strict=True):
            found[int(doc[p])].append((probe.ids[i], int(m), int(w), int(p + offset[p])))
        return hits, found


ITEM = [("item_id", pa.string()), ("longest", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64())]
MATCHES = "array<struct<item_id: string, longest: bigint, item_word: bigint, doc_word: bigint>>"


def looked_up(docs: DataFrame, probe, text_col: str, shard_words: int, only_hits: bool = False) -> DataFrame:
    """docs with _words, _hits (places of hit words) and _matches added; one map, shard by shard, for a broadcast Probe. only_hits: no other rows."""
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"_words bigint, _hits array<bigint>, _matches {MATCHES}").fields])
    own, out_type = docs.columns.index(text_col), pa.list_(pa.struct(ITEM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, shard = 0, Shard(probe.value)
            for i, x in enumerate(batch.column(own)):
                shard.add(x.as_py())
                if shard.n < shard_words and i + 1 < batch.num_rows:
                    continue
                hits, found = shard.look_up()
                found = [[dict(zip([n for n, _ in ITEM], m, strict=True)) for m in ms] for ms in found]
                added = [pa.array(shard.counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, out_type)]
                out = pa.RecordBatch.from_arrays([*[c.slice(begin, len(hits)) for c in batch.columns], *added], names=schema.names)
                yield out.filter(pa.array([bool(h) for h in hits])) if only_hits else out
                begin, shard = i + 1, Shard(probe.value)

    return docs.mapInArrow(run, schema)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 16_000_000,
    shard_words: int = 1_000_000,
) -> DataFrame:
    """docs with n_words, n_hit (longs) and matches (item_id as text, longest match in words, its places) added.

    A window is `window` consecutive words of an item, or the whole item where it is shorter. The benchmark is taken
    in blocks of about block_bytes of text, an item standing whole in one of them. One block is the rule: then this is
    one map over the documents, without a shuffle. With more, each block is a job of its own, which writes the rows of
    the documents that it hits, so that the driver and the tasks hold one block at a time however large the benchmark
    is; the few rows are merged by the documents' places in a copy of docs written first.
    Null or wordless documents have 0 words and no match; null or wordless items match nothing; repeated documents
    each get their row; items with equal texts all match; a null item_id is reported as null. Columns of docs named as
    those added are replaced. An empty benchmark gives n_hit 0 everywhere, empty documents an empty table.
    """
    spark = docs.sparkSession
    total = benchmark.select(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    others = [c for c in docs.columns if c not in ("n_words", "n_hit", "matches")]
    names = [f"c{i}" for i in range(len(others))]
    ready = docs.select(*[F.col(f"`{c}`") for c in others]).toDF(*names)
    text = names[others.index(text_col)]

    def probe(b: int):
        mine = benchmark.where(F.col(item_text_col).isNotNull() & (F.pmod(F.xxhash64(item_col, item_text_col), F.lit(n_blocks)) == b))
        rows = mine.select(F.col(item_col).cast("string"), F.col(item_text_col)).collect()  # block_bytes
        return spark.sparkContext.broadcast(Probe(sorted(map(tuple, rows), key=lambda r: (r[0] or "", r[1])), window))

    if n_blocks == 1:
        out = looked_up(ready, probe(0), text, shard_words)
    else:
        placed, found = written(ready.withColumn("_row", F.monotonically_increasing_id()), "documents"), None
        for b in range(n_blocks):
            block = probe(b)
            hit = written(looked_up(placed.select("_row", text), block, text, shard_words, only_hits=True).select("_row", "_hits", "_matches"), "matches")
            block.unpersist()
            found = hit if found is None else found.union(hit)
        found = found.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits")))).alias("_hits"), F.flatten(F.collect_list("_matches")).alias("_matches"))
        words = looked_up(placed, spark.sparkContext.broadcast(Probe([], window)), text, shard_words).drop("_hits", "_matches")
        none = F.array().cast("array<bigint>")
        out = words.join(found, "_row", "left").select(*names, "_words", F.coalesce("_hits", none).alias("_hits"), F.coalesce("_matches", F.array().cast(MATCHES)).alias("_matches"))
    return out.select(*names, "_words", F.size("_hits").cast("long"), "_matches").toDF(*others, "n_words", "n_hit", "matches")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a benchmark window, with docs' own columns, whatever they are named. Options as for benchmark_matches()."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = benchmark_matches(docs.toDF(*names), benchmark, text_col=names[docs.columns.index(text_col)], **options)
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)
