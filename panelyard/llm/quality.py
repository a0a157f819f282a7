"""Document quality by random-indexing word vectors and a small network.

Random indexing: every word has a fixed sparse random index vector, and a word's vector is the sum of the index vectors
of the words around it wherever it occurs, here in all documents. Words are hashed into a fixed number of rows, so the
table stays small however large the vocabulary gets; a word's shape (case, length, glued to the one before it, a repeat
of it) is a further word with a vector of its own, which speaks for words that are rare. A document pools the vectors of
its words; a network of two layers, fitted on a bounded sample of labelled documents, turns them into a probability that
a temperature calibrates.

The texts are read twice, to gather the vectors and to score; a few thousand more reads are those of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

BITS = 14
WORDS = 1 << BITS
LENGTH_EDGES = np.array([2, 3, 4, 8, 16])
SHAPES = 6 * 2 * 2 * (len(LENGTH_EDGES) + 1)
ROWS = WORDS + SHAPES
#: Stands where a text ends; has no index vector.
PAD = ROWS
DIMS, NONZERO, WINDOW = 32, 2, 2
PIECE = 1 << 17
#: A word of more characters than this is read in parts.
LONGEST_WORD = 1 << 10
SPACE, LETTER, CAPITAL, DIGIT, MARK = range(5)
SEED = 11
FEATURES = 3 * DIMS + 1


@cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, MARK, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            classes[i] = SPACE
        elif c.isalpha():
            classes[i] = CAPITAL if c.isupper() else LETTER
        elif c.isdigit():
            classes[i] = DIGIT
    return classes


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of every row's index vector."""
    rng = np.random.default_rng(SEED)
    at = np.array([rng.choice(DIMS, NONZERO, replace=False) for _ in range(ROWS)] + [[0] * NONZERO], np.int64)
    sign = rng.choice([-1.0, 1.0], (ROWS + 1, NONZERO))
    sign[PAD] = 0.0
    return at, sign


@cache
def powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(LONGEST_WORD, 0x100000001B3, np.uint64))


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces of PIECE characters or so, cut at white space where there is some."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        if end < len(text):
            near = text.rfind(" ", begin + PIECE - LONGEST_WORD, end)
            end = near if near > begin else end
        yield text[begin:end]
        begin = end


def words_and_shapes(piece: str) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word of a piece and row of its shape. A word is a run of letters, of digits or of other marks."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = character_classes()[codes]
    kinds = np.where(classes == CAPITAL, LETTER, classes)
    begins = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    at = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
    if at.max(initial=0) >= LONGEST_WORD:
        begins = np.flatnonzero(at % LONGEST_WORD == 0)
        at %= LONGEST_WORD
    mixed = (codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * np.uint64(0xFF51AFD7ED558CCD)
    h = np.add.reduceat((mixed ^ (mixed >> np.uint64(32))) * powers()[at], begins)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    length = np.diff(np.append(begins, len(codes)))
    capitals = np.add.reduceat((classes == CAPITAL).astype(np.int64), begins)
    kind, first = kinds[begins], classes[begins] == CAPITAL
    # 0 small, 1 capital first, 2 capitals only, 3 mixed, 4 digits, 5 marks
    case = np.select([kind == DIGIT, kind == MARK, capitals == 0, first & (capitals == 1), capitals == length], [4, 5, 0, 1, 2], 3)
    word = kind != SPACE
    glued = np.concatenate([[False], word[:-1]])[word]
    h, case, length = h[word], case[word], length[word]
    repeated = np.zeros(len(h), bool)
    repeated[1:] = h[1:] == h[:-1]
    shape = ((case * 2 + glued) * 2 + repeated) * (len(LENGTH_EDGES) + 1) + np.searchsorted(LENGTH_EDGES, length, "right")
    return (h >> np.uint64(64 - BITS)).astype(np.int64), WORDS + shape


class Contexts:
    """Running sums of index vectors around each row, in whole numbers so that any order of adding gives the same."""

    def __init__(self) -> None:
        self.sums, self.n = np.zeros((ROWS + 1) * DIMS, np.int64), np.zeros(ROWS + 1, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, text: str) -> None:
        for piece in pieces(text):
            self.held.append(words_and_shapes(piece))
            self.size += len(self.held[-1][0])
            if self.size > PIECE:
                # The last words stay, so that a piece's first ones see them.
                words, shapes = self.flush()
                self.held, self.size = [(words[-WINDOW:], shapes[-WINDOW:])], 0
                self.n -= np.bincount(np.concatenate(self.held[0]), minlength=ROWS + 1)
                self._around(*self.held[0], -1)
        self.held.append((np.full(WINDOW, PAD), np.full(WINDOW, PAD)))

    def _around(self, words: np.ndarray, shapes: np.ndarray, sign: int) -> None:
        at, signs = index_vectors()
        for target in (words, shapes):
            places, weights = [], []
            for apart in range(1, WINDOW + 1):
                for own, other in ((slice(apart, None), slice(None, -apart)), (slice(None, -apart), slice(apart, None))):
                    for context in (words[other], shapes[other]):
                        places.append((target[own, None] * DIMS + at[context]).ravel())
                        weights.append(signs[context].ravel())
            got = np.bincount(np.concatenate(places), np.concatenate(weights), len(self.sums))
            self.sums += sign * np.rint(got).astype(np.int64)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, shapes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self._around(words, shapes, 1)
        self.n += np.bincount(words, minlength=ROWS + 1) + np.bincount(shapes, minlength=ROWS + 1)
        self.held, self.size = [], 0
        return words, shapes


def word_sums(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each row occurs in all of texts(text), and the sum of the index vectors around it.

    A row per task and word row leaves the map, so what is shuffled grows with the tasks, and the result has ROWS rows.
    """
    names = [f"d{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Contexts()
        for batch in batches:
            for x in batch.column(0):
                if text := x.as_py():
                    seen.add(text)
        seen.flush()
        at = np.flatnonzero(seen.n[:ROWS])
        sums = seen.sums.reshape(-1, DIMS)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen.n[at], pa.int64()), *[pa.array(sums[:, i], pa.int64()) for i in range(DIMS)]], names=["row", "n", *names])

    schema = "row int, n bigint, " + ", ".join(f"{c} bigint" for c in names)
    got = texts.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()  # ROWS rows at most
    n, sums = np.zeros(ROWS, np.int64), np.zeros((ROWS, DIMS), np.int64)
    at = got.column("row").to_numpy()
    n[at] = got.column("n").to_numpy()
    for i, c in enumerate(names):
        sums[at, i] = got.column(c).to_numpy()
    return n, sums


def word_vectors(n: np.ndarray, sums: np.ndarray, shrink: float = 8.0) -> np.ndarray:
    """How a row's mean context differs from the mean one; what was seldom seen is drawn to zero."""
    mean = sums.sum(axis=0) / max(1, n.sum())
    return ((sums / np.maximum(n, 1)[:, None] - mean) * (n / (n + shrink))[:, None]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words, mean vector of their shapes, spread of the words' vectors, logarithm of their number."""
    total, shape, squares, n = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS), 0
    for piece in pieces(text or ""):
        words, shapes = words_and_shapes(piece)
        own = vectors[words].astype(np.float64)
        total += own.sum(axis=0)
        squares += (own * own).sum(axis=0)
        shape += vectors[shapes].sum(axis=0, dtype=np.float64)
        n += len(words)
    mean = total / max(1, n)
    return np.concatenate([mean, shape / max(1, n), np.sqrt(np.maximum(squares / max(1, n) - mean * mean, 0)), [np.log1p(n)]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class Network:
    """tanh layer and a logit over standardised features; without layers a constant."""

    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fitted(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = SEED) -> Network:
    """A network by Adam over rows of features and labels; the constant that the labels suggest where they all agree."""
    net = Network(x.mean(axis=0) if len(x) else np.zeros(FEATURES), x.std(axis=0) + 1e-6 if len(x) else np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        net.constant = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    rng = np.random.default_rng(seed)
    z = (x - net.center) / net.scale
    net.layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    step, size = 0, 512
    for _ in range(epochs * size // max(size, len(z)) + 60):
        order = rng.permutation(len(z))
        for begin in range(0, len(z), size):
            own = order[begin : begin + size]
            w1, b1, w2, b2 = net.layers
            a = np.tanh(z[own] @ w1 + b1)
            slope = (sigmoid(a @ w2 + b2[0]) - y[own]) / len(own)
            back = np.outer(slope, w2) * (1 - a * a)
            grads = [z[own].T @ back + decay * w1, back.sum(axis=0), a.T @ slope + decay * w2, np.array([slope.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.layers[i] = net.layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least loss on rows held back from fitting; labels are smoothed, so that no error doesn't mean certainty."""
    if not len(y):
        return 1.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(t: float) -> float:
        z = logits / t
        return float((np.logaddexp(0, z) - soft * z).mean())

    return float(min(np.exp(np.linspace(np.log(0.1), np.log(20.0), 160)), key=loss))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def pooled_rows(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and x, the pooled features, of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = StructType([docs.schema["doc_id"], StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pooled(t.as_py(), sent.value).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, seed: int = SEED) -> Model:
    """Word vectors of all docs(doc_id, text) and a network fitted on labels(doc_id, quality).

    sample_rows bounds what the network is fitted on: about as many labelled ids are drawn by a hash of the id, in the
    proportion in which the labels stand, and their pooled features travel to the driver. Every fifth of them is held
    back for the temperature. Null labels and ids teach nothing; an id with several labels has the more frequent one (1 if
    tied); an id with several texts is learned from one of them, the one whose features come first. Without labels, or with labels
    that all agree, the score is a constant.
    """
    vectors = word_vectors(*word_sums(docs.select("text")))
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(known.where(draw < min(1.0, sample_rows / max(1, total))))  # about sample_rows ids
    rows = pooled_rows(docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"), vectors)
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(picked, "doc_id").select("x", "y").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    kept = np.arange(len(y)) % 5 == 0
    net = fitted(x[~kept], y[~kept])
    if net.layers:
        net.temperature = fitted_temperature(net.logits(x[kept]), y[kept])
    return Model(vectors, net)


def scored(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, higher: good quality is likelier) and predicted (1 from least on).

    Only the text is looked at; whole texts are. Null and empty texts are documents of no words and are scored as such.
    Repeated rows get equal answers; columns of docs with those names are replaced. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x DIMS and the network, whatever the data's size
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    schema = StructType([*others.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at = others.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            x = np.array([pooled(t.as_py(), own.vectors) for t in batch.column(at)]).reshape(-1, FEATURES)
            score = own.network.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= least).astype(np.int32), pa.int32())], names=schema.names)

    return others.mapInArrow(run, schema)
