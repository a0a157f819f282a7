"""Audit of filters that interact: what each removes in every order in which they could be applied.

Every document gets a mask of the filters that it fails. Documents of one part (a language) and one mask are alike, so
a part is at most 32 cells of counts. A Gray-code walk over the 32 subsets of filters toggles one filter at a time: each
cell counts how many of its failed filters are switched on, and enters or leaves the running survivors when that
counter leaves or reaches zero. The survivors of the 32 subsets are stored; whatever an order of filters does step by
step is a difference of two of them.

The texts are read once, by column expressions; only ids, digests and masks are shuffled.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import keyed_join, tidied, written

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
COUNTS = ("docs", "good", "toxic")

#: Characters of white space, and the thresholds of the filters.
SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 100, 80, 10
MARKS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """The filters that a text fails by itself (all but E), as bits in the order of FILTERS."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * LEAST_DISTINCT_PCT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS_PCT,
        "D": text.rlike(MARKS),
    }
    return sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in fails.items()), F.lit(0)).cast("int")


def gray_walk(cells: dict[int, tuple[int, ...]]) -> np.ndarray:
    """survivors[subset] of the cells mask -> counts, for every subset of the filters (a bit each)."""
    masks = np.array(list(cells), np.int64)
    counts = np.array(list(cells.values()), np.int64).reshape(len(masks), -1)
    active = np.zeros(len(masks), np.int64)  # how many of a cell's failed filters are on
    out = np.zeros((SUBSETS, counts.shape[1]), np.int64)
    running, state = counts.sum(axis=0), 0
    out[state] = running
    for step in range(1, SUBSETS):
        bit = (step & -step).bit_length() - 1  # the filter that a Gray code toggles in this step
        state ^= 1 << bit
        touched = (masks >> bit) & 1 == 1
        if state >> bit & 1:
            active[touched] += 1
            running = running - counts[touched & (active == 1)].sum(axis=0)
        else:
            active[touched] -= 1
            running = running + counts[touched & (active == 0)].sum(axis=0)
        out[state] = running
    return out


def _walked(cells: pd.DataFrame) -> pd.DataFrame:
    """One row for a part's cells, 32 of them at most: its survivors by subset, a list for each kind of count."""
    states = gray_walk({int(m): tuple(map(int, c)) for m, *c in cells[["mask", *COUNTS]].itertuples(index=False)})
    return pd.DataFrame({"part": [cells["part"].iloc[0]]} | {c: [states[:, i].tolist()] for i, c in enumerate(COUNTS)})


def masked(docs: DataFrame) -> DataFrame:
    """row, doc_id, part, digest and mask (without E) of each row of docs(doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail exactly the filters of a mask.

    E is the one filter that looks at other rows: only texts that occur more than once are joined, copies of a common text
    dealt over tasks. A row that is moved to a cell with E counts -1 where it was and 1 where it is.
    """
    rows = written(masked(docs), "masked")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = written(texts.where("n > 1 and first < last").select("digest", "first", "n"), "repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = keyed_join(rows.where("doc_id is not null"), repeated, "digest", "row", total).where("doc_id > first")
    moves = F.explode(F.array(F.struct(F.col("mask").alias("to"), F.lit(-1).alias("w")), F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("to"), F.lit(1).alias("w"))))
    moved = written(later.select("doc_id", "part", moves.alias("m")).select("doc_id", "part", F.col("m.to").alias("mask"), F.col("m.w").alias("w")), "moved")
    parts = rows.select("doc_id", "part", "mask", F.lit(1).alias("w")).unionByName(moved)
    marks = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = parts.groupBy("part", "mask").agg(F.sum("w").alias("docs"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = parts.join(marks, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("docs"), F.sum(F.col("w") * F.col("good")).alias("good"), F.sum(F.col("w") * F.col("toxic")).alias("toxic"))
    return counted.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def subset_states(cells: DataFrame) -> DataFrame:
    """part and, by the filters' subset (an index of 0 to 31), the documents, good and toxic ones that survive it."""
    return cells.groupBy("part").applyInPandas(_walked, "part string, " + ", ".join(f"{c} array<bigint>" for c in COUNTS))


def step_rows(states: DataFrame) -> DataFrame:
    """A row for each part, order of all filters and step of it; all counts are differences of two or four states."""
    everything = SUBSETS - 1
    plan = []
    for order in permutations(FILTERS):
        on = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            plan.append(("".join(order), step, on, on | bit, bit, FILTERS.index(letter)))
            on |= bit
    steps = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"a":{a},"b":{b},"f":{f},"i":{i}}}' for o, s, a, b, f, i in plan) + "]"), "array<struct<o:string,s:int,a:int,b:int,f:int,i:int>>")
    at = lambda c, i: F.get(c, i if isinstance(i, Column) else F.lit(i))
    # In (k)! (4 - k)! of the orders exactly the k filters of a subset come before a given one.
    ways = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in range(SUBSETS - 1)}
    shapley = [sum((at("docs", s) - at("docs", s | 1 << f)) * ways[s] for s in range(SUBSETS) if not s >> f & 1) for f in range(len(FILTERS))]
    t = F.col("t")
    removed = at("docs", t["a"]) - at("docs", t["b"])
    return states.select("*", F.array(*shapley).alias("shares")).select("*", F.explode(steps).alias("t")).select(
        "part", t["o"].alias("filter_order"), t["s"].alias("step"), at("docs", t["b"]).alias("kept"), removed.alias("removed"),
        (at("docs", 0) - at("docs", t["f"]) - removed).alias("redundant"),
        (at("docs", F.lit(everything) - t["f"]) - at("docs", everything)).alias("unique_fails"),
        (at("good", t["a"]) - at("good", t["b"])).alias("good_lost"), (at("toxic", t["a"]) - at("toxic", t["b"])).alias("toxic_lost"), at("shares", t["i"]).alias("shapley"),
    )


@tidied
def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs(doc_id, text, lang) with labels(doc_id, quality, toxic).

    A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Null
    texts are empty, null languages are the part ''. A row without an id fails E never and makes no other row fail it; rows
    of one id and one text fail it only where a smaller id has that text. A document is good or toxic if any of its
    labels says so; labels of unknown ids, null ids and null values count for nothing. Repeated rows count as often
    as they stand there. Other columns aren't looked at. Without documents there are no parts and no rows.
    """
    wanted = docs.select("doc_id", "text", "lang")
    return step_rows(subset_states(mask_cells(wanted, labels.select("doc_id", "quality", "toxic"))))
