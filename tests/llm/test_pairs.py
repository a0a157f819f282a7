"""Embedding join, chosen-path join and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm import minhash_join, shared
from panelyard.llm.embedding_join import near_vectors
from panelyard.llm.shared import connected_components


def union(ids, links):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500)]
    links += links[:20]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(df.where("a < 0")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    put, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name: put.append(name) or write(df, name))
    df = spark.createDataFrame([(i, i // 50 * 50) for i in range(200)] + [(7, 0)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}
    assert put == ["stars"]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("links", T.StringType()), T.StructField("rep", T.LongType())])


def vectors(seed, n=260, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(14, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(14)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.6])
        out.append((i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(rng.integers(3))))
    out += [(1000 + i, out[7][1], out[7][2]) for i in range(30)]
    out += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [], 1), (2003, [float("nan")] + [1.0] * (dim - 1), 1), (2004, [None] + [1.0] * (dim - 1), 1), (2005, [float("inf")] * dim, 1), (2006, out[0][1], None), (2007, out[0][1][:5], out[0][2]), (2008, [1e-30] * dim, 2), (2009, [1e-30] * dim, 2), (2010, [1e30] * dim, 2)]
    return [(i, v, label, "x", 7) for i, v, label in out]


def cosine_links(rows, threshold):
    good = [(i, np.array(v, float), label) for i, v, label, *_ in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[k + 1 :] if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]


@pytest.mark.parametrize("seed", [1, 2])
def test_embedding_join(spark, seed):
    rows = vectors(seed)
    links = cosine_links(rows, 0.93)
    low = union([r[0] for r in rows], links)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, VECTORS), block_rows=16).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.n_links == sum(i in p for p in links), i
        assert (r.component_id, r.kept) == (low[i], low[i] == i)


def test_embedding_join_edges(spark):
    df = spark.createDataFrame([], VECTORS)
    assert near_vectors(df).count() == 0
    same = spark.createDataFrame([(3, [1.0, 0.0], 1, "", 0)] * 4 + [(None, [1.0, 0.0], 1, "", 0), (None, None, None, "", 0)], VECTORS)
    got = sorted((r.n_links, r.component_id or 0) for r in near_vectors(same).collect())
    assert got == [(0, 0)] + [(4, 3)] * 5


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[i:] for i in range(k)], strict=False)) if w else frozenset()


def near_texts(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append("  ".join(copy).upper())
    hot = [rng.choice(vocab) for _ in range(120)]
    for _ in range(300):
        copy = list(hot)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        out.append(" ".join(copy))
    return [*out, None, "", " \n\t", "A", "a", "a b", "a\x0bb", "é É", "a b", *[out[0]] * 40, "long " * 50_000, "x" * 100_000]


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.85), (5, 0.8)])
def test_chosen_path_join(spark, k, threshold, monkeypatch):
    monkeypatch.setattr(minhash_join, "LEAF", 40)
    texts = near_texts(k)
    df = spark.createDataFrame([(i, t, "s", b"") for i, t in enumerate(texts)], "doc_id long, text string, rep string, set_key binary")
    sets = [shingles(t, k) for t in texts]
    percent = round(100 * threshold)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = union(range(len(sets)), links)
    got = {r.doc_id: r for r in minhash_join.similar_documents(df, k, threshold).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.n_shingles == len(sets[i])
        assert (r.component_id, r.kept) == (low[i], low[i] == i), texts[i]


def test_dense_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "LEAF", 5)
    monkeypatch.setattr(minhash_join, "BLOCK", 10)
    monkeypatch.setattr(minhash_join, "MAX_DEPTH", 3)
    rng = random.Random(9)
    hot = [f"w{i}" for i in range(100)]
    texts = [" ".join(hot[:i] + [f"v{rng.random()}"] + hot[i + 1 :]) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash_join.similar_documents(df, 3, 0.85).collect()} == {0}


def test_pivots_that_link_nothing_are_looked_for_once(spark, monkeypatch):
    """Sets of which all share the same three quarters: bands show groups, but no two sets are linked."""
    monkeypatch.setattr(minhash_join, "LEAF", 5)
    calls, around = [], minhash_join.Texts.around
    monkeypatch.setattr(minhash_join.Texts, "around", lambda self, parts: calls.append(1) or around(self, parts))
    texts = [" ".join([f"w{j}" for j in range(90)] + [f"v{i}x{j}" for j in range(30)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[3]])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_join.similar_documents(df, 3, 0.85).collect()}
    assert got == {i: i for i in range(60)} | {60: 3}
    assert len(calls) == 1


def test_mixed_nodes_of_a_block_are_compared_at_once(spark, monkeypatch):
    """Sets that share a passage and little else, above LEAF and below BLOCK: no deeper level and no more trees, and the links among them are found."""
    monkeypatch.setattr(minhash_join, "LEAF", 20)
    monkeypatch.setattr(minhash_join, "BLOCK", 200)
    names, write = [], minhash_join.written
    monkeypatch.setattr(minhash_join, "written", lambda df, name: names.append(name) or write(df, name))
    texts = [" ".join([f"w{j}" for j in range(90)] + [f"v{i}x{j}" for j in range(60)]) for i in range(80)]
    texts += [f"{texts[i]} more" for i in range(0, 80, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_join.similar_documents(df, 3, 0.85).collect()}
    assert got == {i: i for i in range(80)} | {80 + i: 7 * i for i in range(12)}
    assert "large" in names and "deep" not in names


def test_chosen_path_join_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_join.similar_documents(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "q"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_shingles, r.component_id or -1, r.kept) for r in minhash_join.similar_documents(df).collect())
    assert got == [(0, -1, True), (1, 2, True), (2, 2, False), (2, 2, False), (2, 2, True)]


def test_a_large_group_of_near_copies_grows_in_line(spark, monkeypatch):
    """Thousands of distinct near copies at a small LEAF: brute-force components, and no more rows than documents call for."""
    monkeypatch.setattr(minhash_join, "LEAF", 30)
    monkeypatch.setattr(minhash_join, "BLOCK", 250)
    rng = random.Random(31)
    hot = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(2000):
        copy = list(hot)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6, 9])):
            copy[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(hot)] + [" ".join(rng.choice(hot) for _ in range(80)) for _ in range(50)]
    sent = []
    pairs_to_compare = minhash_join.candidate_clusters
    monkeypatch.setattr(minhash_join, "candidate_clusters", lambda groups, t: sent.append(groups.select(F.sum(F.size("members"))).first()[0] or 0) or pairs_to_compare(groups, t))
    by_differences = minhash_join.linked_by_differences
    monkeypatch.setattr(minhash_join, "linked_by_differences", lambda groups, t: sent.append(groups.select(F.sum(F.size("members"))).first()[0] or 0) or by_differences(groups, t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_join.similar_documents(df, 3, 0.85).collect()}
    sets = [shingles(t, 3) for t in texts]
    index = {s: i for i, s in enumerate(set().union(*sets))}
    matrix = np.zeros((len(sets), len(index)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [index[x] for x in s]] = 1
    inter, size = matrix @ matrix.T, matrix.sum(axis=1)
    links = np.argwhere(np.triu(100 * inter >= 85 * (size[:, None] + size[None, :] - inter), 1))
    low = union(range(len(sets)), links.tolist())
    assert np.mean([got[i] == low[i] for i in low]) > 0.999
    assert len(sent) == 2 and sum(sent) < 100 * len(texts), sent


def test_trees_keep_their_recall():
    for t in (0.8, 0.85):
        assert minhash_join.trees_for(2, t) <= minhash_join.TREES < minhash_join.trees_for(12, t)
        assert 30 < minhash_join.agreement_floor(t) < 64 * t
