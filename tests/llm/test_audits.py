"""Quality scores, the filter audit and the Merkle manifest."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm import filter_audit, merkle, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, mask int, part string, tree string"


# ---- quality


def brute_words(text):
    """(word, its characters' kind) of runs of letters, of digits and of other marks, glued and repeated marks."""
    kind = lambda c: 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    runs, last = [], 0
    for c in text:
        if kind(c) and kind(c) == last:
            runs[-1][0] += c
        elif kind(c):
            runs.append([c, bool(last)])
        last = kind(c)
    return runs


def brute_shape(runs, i):
    word, glued = runs[i]
    capitals = sum(c.isupper() for c in word)
    if word[0].isdigit():
        case = 4
    elif not word[0].isalpha():
        case = 5
    elif not capitals:
        case = 0
    elif capitals == 1 and word[0].isupper():
        case = 1
    else:
        case = 2 if capitals == len(word) else 3
    n = len(word)
    length = 0 if n < 2 else 1 if n < 3 else 2 if n < 4 else 3 if n < 8 else 4 if n < 16 else 5
    return ((case * 2 + glued) * 2 + (i > 0 and runs[i - 1][0] == word)) * 6 + length


TEXT = st.text(st.sampled_from("aaabÀZß09 \n\t!#é 日"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_and_shapes(text):
    runs = brute_words(text)
    words, shapes = quality.words_and_shapes(text) if text else ([], [])
    assert [s - quality.WORDS for s in shapes] == [brute_shape(runs, i) for i in range(len(runs))]
    same = {}
    for (word, _), row in zip(runs, words, strict=True):
        assert same.setdefault(word, row) == row


def brute_contexts(texts):
    at, sign = quality.index_vectors()
    sums, n = np.zeros((quality.ROWS, quality.DIMS), np.int64), np.zeros(quality.ROWS, np.int64)
    for text in texts:
        if not text:
            continue
        words, shapes = quality.words_and_shapes(text)
        for i in range(len(words)):
            for row in (words[i], shapes[i]):
                n[row] += 1
                for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                    for context in (words[j], shapes[j]):
                        if j != i:
                            for k in range(quality.NONZERO):
                                sums[row, at[context, k]] += int(sign[context, k])
    return n, sums


@pytest.mark.parametrize("piece", [1 << 17, 1100])
def test_contexts_against_brute_force(spark, monkeypatch, piece):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "Two", "THREE", "4", "five5", "six!!"]) for _ in range(rng.randrange(900))) for _ in range(12)] + ["", "x", None, "x x x x x"]
    n, sums = brute_contexts(texts)
    monkeypatch.setattr(quality, "PIECE", piece)
    seen = quality.Contexts()
    for t in texts:
        if t:
            seen.add(t)
    seen.flush()
    assert (seen.n[: quality.ROWS] == n).all() and (seen.sums.reshape(-1, quality.DIMS)[: quality.ROWS] == sums).all()
    if piece == 1 << 17:
        got = quality.word_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
        assert (got[0] == n).all() and (got[1] == sums).all()


def test_pieces_keep_whole_texts(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 4000)
    text = "word " * 5000 + "é" * 9000 + " end"
    assert "".join(quality.pieces(text)) == text
    vectors = np.random.default_rng(1).normal(size=(quality.ROWS, quality.DIMS)).astype(np.float32)
    words = quality.words_and_shapes("word " * 5000)[0]
    assert len(words) == 5000 and len(set(words.tolist())) == 1
    assert quality.pooled("word " * 5000, vectors)[-1] == pytest.approx(np.log1p(5000))


def quality_rows(n=900):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        bad = i % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1, "x", 1, "p", "t"))
        labels.append((i, int(not bad), 0, "score"))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int, extra string"


def test_quality_tells_held_out_documents(spark):
    docs, labels = quality_rows()
    d, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    test = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(docs))]
    model = quality.train(d, marks.where(~quality.held_out(marks.doc_id)))
    got = {r.doc_id: r for r in quality.scored(d, model).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [got[i].predicted == labels[i][1] for i in range(len(docs)) if test[i]]
    assert len(held) > 150 and sum(held) / len(held) > 0.97
    again = quality.scored(d.repartition(5), quality.train(d.repartition(5), marks.where(~quality.held_out(marks.doc_id)).repartition(2)))
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}


def test_temperature_is_the_best_one():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < quality.sigmoid(z)).astype(float)
    assert quality.fitted_temperature(3 * z, y) == pytest.approx(3, rel=0.15)
    assert quality.fitted_temperature(z[:0], y[:0]) == 1.0


def test_quality_edges(spark):
    docs, labels = quality_rows(60)
    long = (70, "word " * 300_000 + "a" * 200_000, None, None, None, "x", 1, "p", "t")
    rows = [*docs, long, (71, None, *[None] * 7), (72, "", *[None] * 7), (72, "", *[None] * 7), (None, "a b c", *[None] * 7)]
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("mask", "score").withColumnRenamed("part", "predicted")
    marks = spark.createDataFrame([*labels, (None, 1, 1, ""), (1, None, None, ""), (2, 0, 0, ""), (2, 1, 0, ""), (99, 0, 0, ""), (71, 1, 0, ""), (72, 7, 0, "")], LABELS)
    got = quality.scored(d, quality.train(d, marks))
    assert got.columns.count("score") == 1 and got.columns.count("predicted") == 1
    scores = got.collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if not r.text}) == 1
    empty = d.limit(0)
    assert quality.scored(empty, quality.train(empty, marks.limit(0))).count() == 0
    # No labels, or labels of one kind: a constant.
    assert {r.score for r in quality.scored(d, quality.train(d, marks.limit(0))).collect()} == {0.5}
    assert len({r.score for r in quality.scored(d, quality.train(d, marks.where("quality = 1"))).collect()}) == 1


# ---- filter audit


def brute_audit(docs, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and least[t] < i)
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shares, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                lines.append((f, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, *line[1:], shares[line[0]]) for line in lines]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(9)
    docs = []
    for i in range(160):
        n = rng.choice([0, 3, 99, 100, 101, 140])
        words = [f"w{rng.randrange(rng.choice([40, 4000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        docs.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\x0b", "\n ", " "]).join(words), rng.choice(["en", "de", None, ""]), "s", 1, "x", 1, "p", "t"))
    docs += [(300 - i, "same copy", rng.choice(["en", "de"]), "s", 1, "x", 1, "p", "t") for i in range(90)]
    docs += [(5, "same copy", "fr", "s", 1, "x", 1, "p", "t")] * 3 + [(None, None, None, None, None, None, None, None, None), (400, None, "en", "s", 1, "x", 1, "p", "t"), (401, "", "en", "s", 1, "x", 1, "p", "t")]
    docs += [(500, "Word " * 60_000, "en", "s", 1, "x", 1, "p", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "") for i in range(0, 310, 2)] + [(7, 1, 0, ""), (7, 0, 1, ""), (None, 1, 1, ""), (9999, 1, 1, ""), (10, 1, 1, ""), (10, 1, 1, "")]
    return docs, labels


def test_audit_against_brute_force(spark):
    docs, labels = audit_rows()
    got = filter_audit.audited(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r[c] for c in AUDIT) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert filter_audit.audited(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audited(spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.removed for r in one if r.step == 1} == {0, 1}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=1))
def test_gray_walk_counts_survivors(cells):
    states = filter_audit.gray_walk(cells)
    for subset in range(32):
        assert states[subset].tolist() == [sum(c[k] for m, c in cells.items() if not m & subset) for k in range(3)]


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes, arity=16):
    """Root, and for each leaf its levels of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % arity : i - i % arity + arity]
            paths[leaf].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], paths


def brute_manifest(docs):
    by = {}
    for i, text, lang, source, n, *_ in docs:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = h(field(i), field(source), field(lang), field(n), field(text))
        changed = h(field(i), field(source), field(lang), field(n), field(low)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        by.setdefault(source, []).append((i is not None, i or 0, leaf, i, changed))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(by[s]), *brute_tree([r[2] for r in sorted(by[s])])) for s in order]
    root, upper = brute_tree([t[1] for t in trees])
    out = []
    for (rows, subroot, paths), above in zip(trees, upper, strict=True):
        for (_, _, leaf, i, changed), path in zip(rows, paths, strict=True):
            node = changed
            for a, b in path + above:
                node = h(a, node, b)
            out.append((str(i), leaf, subroot, root, h(*[a + b for a, b in path + above]), node, node == root))
    return sorted(out)


def manifest_rows(sources=40):
    rng = random.Random(2)
    docs = [(i, rng.choice(["Text", "text", "É", ""]) + str(i), rng.choice(["en", None]), rng.choice(["hot"] * 20 + [None, "", "é", "z"] + [f"s{k}" for k in range(sources)]), i, "x", 1, "p", "t") for i in range(900)]
    docs += [(7, "Same", "en", "hot", 1, "x", 1, "p", "t")] * 5 + [(7, "Other", "en", "hot", 1, "x", 1, "p", "t"), (None, "Null id", "en", "hot", 1, "x", 1, "p", "t"), (None, None, None, None, None, None, None, None, None)]
    return [*docs, (2**60 + 1, "Large id", None, "hot", None, "x", 1, "p", "t"), (9_000, "Long " * 100_000, "en", "lone", 5, "x", 1, "p", "t")]


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("levels", "sources"), [(3, 40), (1, 400), (2, 3)])
def test_manifest_against_brute_force(spark, levels, sources):
    docs = manifest_rows(sources)
    got = merkle.manifest(spark.createDataFrame(docs, DOCS).repartition(5), levels).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in PROOF[1:]]) for r in got) == brute_manifest(docs)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("docs", [[], [(1, "T", "en", "a", 1, "x", 1, "p", "t")], [(i, "T", None, None, 1, "x", 1, "p", "t") for i in range(17)]])
def test_small_manifests(spark, docs):
    got = merkle.manifest(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in PROOF[1:]]) for r in got) == (brute_manifest(docs) if docs else [])
