"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased words are hashed to a fixed number of features. Document
frequencies are counted over all training rows; the model is fitted on a bounded sample of them by
follow-the-regularised-leader with L1 and L2 penalties, and a temperature fitted on rows held back from that sample
calibrates its probabilities. Prediction is one map over the texts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
FEATURES = 1 << BITS
UNKNOWN = "und"
PIECE = 1 << 18
#: Everything but letters becomes one space before n-grams are taken: marks, digits and signs here, numbers like ½ in numbers().
NOT_LETTERS = re.compile(r"[\W\d_]+")


@cache
def numbers() -> re.Pattern:
    """Runs of what counts as alphanumeric but isn't a letter (Unicode category L)."""
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha()) + "]+")


MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def letters(text: str | None) -> str:
    """The text's letters in lower case, words parted and surrounded by a space; empty where there is none."""
    kept = NOT_LETTERS.sub(" ", text or "")
    if not kept.isascii() and not kept.replace(" ", "").isalpha():
        kept = numbers().sub(" ", kept)
    kept = " ".join(kept.split()).lower()
    return f" {kept} " if kept else ""


def term_counts(kept: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the n-grams of letters() and how often each occurs."""
    total = np.zeros(FEATURES, np.int64)
    for begin in range(0, len(kept), PIECE):
        # The n-grams that begin in a piece; very long texts take no more memory than that.
        c = np.frombuffer(kept[begin : begin + PIECE + 2].encode("utf-32-le"), np.uint32)
        h = c * MIX[0]
        for n in range(3):
            if n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * MIX[n] + c[n:]
            g = (h[:PIECE] ^ (h[:PIECE] >> np.uint32(16))) * np.uint32(0x45D9F3B)
            total += np.bincount(g >> np.uint32(32 - BITS), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(n)) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1.0)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighted(at, n, self.idf) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        kept = letters(text)
        if not kept:
            return UNKNOWN, 0.0
        z = self.logits(*term_counts(kept)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.labels[best], float(p[best] / p.sum())


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of texts(text) each feature occurs; a row per task and feature leaves the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                if kept := letters(x.as_py()):
                    df[term_counts(kept)[0]] += 1
                    rows += 1
        df[FEATURES] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["feature", "n"])

    found = texts.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in found:
        out[feature] = n
    return out


def ftrl(rows: list[tuple], n_labels: int, idf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights (features x labels) by FTRL-proximal steps over rows of (features, counts, label)."""
    z, n = np.zeros((FEATURES, n_labels)), np.zeros((FEATURES, n_labels))

    def current(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, count, y = rows[i]
            x = weighted(at, count, idf)
            w = current(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return current(np.arange(FEATURES)).astype(np.float32)


def fitted_temperature(model: Model, rows: list[tuple]) -> float:
    """The temperature with the least negative log-likelihood on rows, searched on a log scale.

    Targets are smoothed as in Platt scaling, so that rows without an error don't call for certainty.
    """
    if not rows:
        return 1.0
    z = np.array([model.logits(at, n) for at, n, _ in rows])
    y = np.array([label for _, _, label in rows])
    slack = 1.0 / (len(y) + 2.0)

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        log_p = s - top[:, None] - np.log(np.exp(s - top[:, None]).sum(axis=1, keepdims=True))
        own = log_p[np.arange(len(y)), y]
        return float(-((1 - slack) * own + slack / max(1, z.shape[1] - 1) * (log_p.sum(axis=1) - own)).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(10.0), 120))
    return float(min(grid, key=loss))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 2400, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, seed: int = 7, max_labels: int = 500) -> Model:
    """A model of the languages that label_col names.

    sample_rows bounds the rows that the classifier is fitted on: about sample_rows divided by the number of labels
    are drawn of each label by a hash of the id, whole texts, and travel to the driver as sparse counts. Every fifth
    of them is held back for the temperature. Document frequencies are those of all rows of docs with a label and a
    letter. Null labels and null texts teach nothing. More than max_labels labels are refused, as the weights are an
    array of features x labels in every task. Repeated rows count as often as they stand there; other columns aren't
    looked at. Without labelled rows the model predicts nothing but "und".
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    counts = {label: n for label, n in rows.groupBy("label").count().limit(max_labels + 1).collect()}  # a row per label
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels: the model's weights would not fit a task")
    if not counts:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)))
    labels = sorted(counts)
    df = document_frequencies(rows.select("text"))
    idf = np.log((1.0 + df[FEATURES]) / (1.0 + df[:FEATURES])) + 1.0
    share = max(10, sample_rows // len(labels))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for label in labels for x in (label, min(1.0, share / counts[label]))]), F.col("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(label.as_py(), *map(np.ndarray.tolist, term_counts(kept))) for x, label in zip(batch.column(0), batch.column(1), strict=True) if (kept := letters(x.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.int32())), pa.array([r[2] for r in out], pa.list_(pa.int32()))], names=["label", "at", "n"])

    picked = rows.where(draw < rate).select("text", "label", "id")
    sample = picked.select("text", "label").mapInArrow(counted, "label string, at array<int>, n array<int>")
    index = {label: i for i, label in enumerate(labels)}
    got = sorted(((np.array(r.at, np.uint16), np.array(r.n, np.float32), index[r.label]) for r in sample.toLocalIterator()), key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    fit, kept = [r for i, r in enumerate(got) if i % 5], got[::5]
    model = Model(labels, idf, ftrl(fit or kept, len(labels), idf, epochs, alpha, beta, l1, l2, seed))
    model.temperature = fitted_temperature(model, kept)
    return model


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, calibrated probability of lang_pred).

    "und" with score 0 where the text is null or has no letter, or the model knows no language. Only the text is
    looked at; whole texts are. Repeated rows get equal answers; columns of docs with those names are replaced. An
    empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x labels, whatever the data's size
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    ready = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            got = [own.predict(x.as_py()) if own.labels else (UNKNOWN, 0.0) for x in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return ready.mapInArrow(run, schema)
