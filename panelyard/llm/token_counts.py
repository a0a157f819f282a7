"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch's texts are cut into chunks at single spaces, chunks into pre-tokens by the tokenizer's pattern. The
pre-tokens that this task has not met yet are held as one flat array of symbol ids with row offsets; in each step
every pre-token finds its lowest-rank adjacent pair and all pre-tokens apply theirs at once, until none has a pair
left. The surviving symbols are the tokens. Counts of chunks are kept per task in a table of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BESIDE_SPACE = re.compile(r" \s|\s ")
NO_RANK = np.int64(1) << 40


def byte_symbols() -> dict[int, str]:
    """Byte -> printable stand-in used in the vocabulary file: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_bpe(path: str) -> dict:
    """Byte ids, sorted pair keys with rank and product, and special strings of a byte-level BPE file.

    Symbol ids are places in the vocabulary. The arrays' size is fixed by the vocabulary, not by the data.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    names = byte_symbols()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    return {
        "bytes": np.array([vocab[names[b]] for b in range(256)], np.int32),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": made[order],
        "special": [t["content"] for t in spec.get("added_tokens", [])],
    }


def merge_counts(words: list[bytes], model: dict) -> np.ndarray:
    """Symbols left of each byte string after all merges; rank-synchronous over the whole list."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    out = lengths.copy()
    rows = np.repeat(np.arange(n), lengths)
    ids = model["bytes"][np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    keys, ranks, made = model["keys"], model["ranks"], model["made"]
    while len(ids) > 1:
        pair = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (rows[:-1] == rows[1:]), ranks[at], NO_RANK)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        best = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
        live = best < NO_RANK
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        hit = np.r_[(rank == best[group[:-1]]) & (rank < NO_RANK), False]
        # Runs of equal symbols give overlapping hits: take the first, third, fifth of each run.
        if (hit[1:] & hit[:-1]).any():
            where = np.flatnonzero(hit)
            first = np.r_[True, np.diff(where) > 1]
            place = np.arange(len(where)) - np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            hit[where[place % 2 == 1]] = False
        ids[hit] = made[at[np.flatnonzero(hit)]]
        keep = np.r_[True, ~hit[:-1]] & live[group]
        done = ~live
        out[rows[starts[done]]] = np.diff(np.r_[starts, len(ids)])[done]
        ids, rows = ids[keep], rows[keep]
    if len(ids) == 1:
        out[rows[0]] = 1
    return out


class ChunkCounter:
    """Counts tokens of texts, batch by batch; keeps the counts of up to max_kept chunks between batches."""

    def __init__(self, model: dict, max_kept: int = 400_000, max_chunk: int = 64):
        self.model, self.max_kept, self.max_chunk = model, max_kept, max_chunk
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, model["special"]))) if model["special"] else None
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> list[int]:
        """Token counts of pieces of text, through their distinct pre-tokens."""
        index: dict[str, int] = {}
        ids, sizes = [], []
        for piece in pieces:
            found = self.pattern.findall(piece)
            sizes.append(len(found))
            ids += [index.setdefault(t, len(index)) for t in found]
        counts = merge_counts([t.encode() for t in index], self.model) if index else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(counts[np.array(ids, np.int64)])] if ids else np.zeros(1, np.int64)
        ends = np.cumsum(np.array(sizes, np.int64))
        return (total[ends] - total[ends - np.array(sizes, np.int64)]).tolist() if pieces else []

    def segments(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text (a token each) and the text around them."""
        if self.special is None or not any(s in text for s in self.model["special"]):
            return 0, [text]
        return len(self.special.findall(text)), [s for s in self.special.split(text) if s]

    @staticmethod
    def chunks(segment: str) -> list[str] | None:
        """Parts between single spaces, or None where a space stands beside other white space and binds otherwise.

        A single space always starts a pre-token, so the parts can be counted one by one, each with its space.
        """
        return None if BESIDE_SPACE.search(segment) else segment.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.max_kept:
            self.known.clear()
        known, plans, fresh, odd = self.known, [], set(), []
        for text in texts:
            n, segments = self.segments(text)
            plan = []
            for segment in segments:
                parts = self.chunks(segment)
                if parts is None:
                    odd.append(segment)
                    plan.append((None, len(odd) - 1))
                else:
                    odd.append(parts.pop(0))
                    fresh |= set(parts).difference(known)
                    plan.append((parts, len(odd) - 1))
            plans.append((n, plan))
        new = list(fresh)
        for p, c in zip(new, self.learn([" " + p for p in new]), strict=True):
            known[p] = c
        got, out = self.learn(odd), []
        for n, plan in plans:
            for parts, k in plan:
                n += got[k]
                if parts is not None:
                    n += sum(map(known.__getitem__, parts))
            out.append(n)
        for p in new:
            if len(p) > self.max_chunk:
                del known[p]
        return out


_COUNTERS: dict[str, ChunkCounter] = {}


def worker_counter(path: str, model: dict) -> ChunkCounter:
    """The counter of this Python worker, which outlives a task; one per tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = ChunkCounter(model)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", max_chars: int = 2_000_000) -> DataFrame:
    """docs without its text, with n_bytes, n_tokens (longs) after the other columns.

    tokenizer: path of a byte-level BPE file, read by the driver. Null and empty texts have 0 bytes and 0 tokens;
    special strings inside a text are special tokens, as the library's default has it. Repeated rows stay repeated.
    Other columns pass through; a column of docs named n_bytes or n_tokens is replaced. An empty table stays empty.
    One pass, no shuffle; texts are handled in groups of about max_chars characters.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_bpe(tokenizer))
    others = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer, model.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sizes, counts, held, chars = [], [], [], 0
            for x in texts:
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                held.append(text)
                chars += len(text)
                if chars >= max_chars:
                    counts += counter.counts(held)
                    held, chars = [], 0
            counts += counter.counts(held)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*others, "n_bytes", "n_tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text_col]]).mapInArrow(run, schema)
