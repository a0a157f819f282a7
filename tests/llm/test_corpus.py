"""Mixing, sharding, archives and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from panelyard.llm import decontamination, mixing, sharding, warc


def brute_targets(sizes):
    """sizes: source -> words. Shares by weight; what passes three times a source's size is shared again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def corpus(seed, n=700):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "b", "c", "c", "c", "d", "é", "", None])
        out.append((i, " ".join(["w"] * int(rng.paretovariate(0.8)) * 2)[:20_000], source, "x", 5))
    return [*out, (9000, None, "a", "x", 5), (9001, "", "z", "x", 5), (9002, " \x0b ", None, "x", 5), (9003, "w " * 40_000, "b", "x", 5), (None, "w w", "c", "x", 5), (3, "w w w", "c", "x", 5), (3, "w w w", "c", "x", 5)]


DOCS = "doc_id long, text string, source string, size string, id int"


def turnable(rows, target):
    """Sizes of the documents of one source that rounding the other way would bring nearer to the target."""
    ratio = target / max(1, sum(r["size"] for r in rows))
    less = sum(r.taken for r in rows) > target
    return [r["size"] for r in rows if r["size"] and ratio % 1 and r.copies == int(ratio) + less]


def test_mixing_meets_targets_of_documents(spark):
    """sf0.01: every source within half of its median document."""
    got = mixing.mixed_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= sorted(r["size"] for r in rows)[len(rows) // 2] / 2


@pytest.mark.parametrize("group_rows", [4096, 16])
def test_mixing(spark, monkeypatch, group_rows):
    monkeypatch.setattr(mixing, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = corpus(1)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mixed_copies(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_copies(df).collect()))
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        ratio = want[s] / sizes[s] if sizes[s] else 0.0
        assert all(r.copies in (int(ratio), math.ceil(ratio)) for r in got if r.source == s)
        small = turnable([r for r in got if r.source == s], want[s])
        assert abs(taken[s] - want[s]) <= min(small, default=max(r["size"] for r in got if r.source == s)) + 1e-6
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mixed_copies(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1000), st.floats(0, 0.999)), min_size=1, max_size=40))
def test_pivot_keeps_the_sum(rows):
    p, size, u = map(list, zip(*rows, strict=True))
    out = mixing.pivot(p, size, u)
    assert sum(0 < q < 1 for q in out) <= 1
    assert sum(q * s for q, s in zip(out, size, strict=True)) == pytest.approx(sum(q * s for q, s in zip(p, size, strict=True)), abs=1e-6)
    assert all(0 < q < 1 for q in mixing.pivot(p, size, u, u)) is False


def test_pivot_keeps_the_means():
    rng = np.random.default_rng(1)
    p, size = [0.3] * 6, [5, 9, 2, 7, 1, 30]
    mean = np.mean([mixing.pivot(p, size, rng.random(6).tolist(), rng.random(6).tolist()) for _ in range(20_000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.02


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.lists(st.integers(0, 1000), min_size=5, max_size=5), min_size=1, max_size=20))
def test_difference_is_a_partition(k, rows):
    sums = np.array(rows, np.int64)[:, :k]
    parts = sharding.difference(sums)
    assert all(sorted(r) == list(range(k)) for r in parts.tolist())


@pytest.mark.parametrize("bucket", [4096, 20])
def test_sharding(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", bucket)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rng = random.Random(2)
    texts = ["t" * rng.randrange(1, 3000) + str(i) for i in range(600)] + [None, None, "", "", *["copy " * 30] * 500, "é" * 9000]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(5, texts[5], 1, "k")], "doc_id long, text string, bytes int, shard string")
    got = sharding.sharded(df, n_shards=7).collect()
    assert len(got) == len(texts) + 1
    home, total, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        home[texts[r.doc_id]].add(r.shard)
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(total) == 7 and max(total.values()) - min(total.values()) < (0.002 if bucket > 100 else 0.08) * sum(total.values()) / 7
    assert sharding.sharded(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 18])
def test_archives_round_trip(spark, tmp_path, chunk_bytes):
    big = "xé" * 1000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "abc"), (4, "u", "abc"), (5, "u", "d" * 100), (9, "u", "d" * 100), (6, None, "d" * 100), (7, "u\r\nq", big + warc.MARK + big), (8, "u", warc.MARK * 3 + "x\r\n"), (None, "u", "d" * 100), (11, "u", "\r\n\r\n"), (12, "u", "q" * 300 + "\r\n\r\nWA"), (13, "u", "\r\n" * 200), (13, "u", "\r\n" * 200), (14, "u", "a\nb\r" * 100_000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, chunk string, record_type string")
    out = warc.round_trip(df, path=str(tmp_path / "warc"), chunk_bytes=chunk_bytes).collect()
    want = sorted((i or 0, len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), *(("revisit", 5) if h == "d" * 100 and i != 5 else ("response", None))) for i, _, h in rows)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(r.intact for r in out)
    raw = next(p for p in (tmp_path / "warc").glob("part-*") if p.stat().st_size).read_bytes()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes", [7, 64, 1 << 18])
def test_payloads_may_be_archives(spark, chunk_bytes):
    version = warc.VERSION
    dump = version + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = [version, version + "x", dump * 3, "\r\n" + dump, "q" * 64 + version + "é", "q" * 62 + "\r\n" + dump, "x\r\n\r\nWARC/1.1", "WARC/1.1", "\r\nWARC/1.1", "WARC/1.1\r", "q" * 64 + "WARC/1.1", "é" * 32 + dump, "a", "\r\n\r\n" + dump]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    out = warc.round_trip(df, chunk_bytes=chunk_bytes).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.intact) for r in out) == [(i, len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), True) for i, t in enumerate(texts)]


def test_near_duplicates_decide_row_by_row(spark, tmp_path):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("a") + " end"), (None, text("a")), (3, text("b")), (4, text("b")), (4, text("c")), (None, text("d")), (None, text("d")), (None, text("e")), (5, text("e")), (6, ""), (6, ""), (None, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in [(1, text("a")), (3, text("b")), (4, text("c")), (None, text("d")), (5, text("e")), (6, ""), (6, ""), (None, None)])


def test_pipeline(spark, tmp_path):
    """Each stage on sf0.001 against what it should keep."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, d)
        kept.write.mode("overwrite").parquet(path := str(tmp_path / name))
        kept = spark.read.parquet(path)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":
            gone = before.join(kept, "doc_id", "left_anti")
            assert gone.where(F.regexp_like("text", F.lit(r"\p{L}{3}"))).count() == 0
        if name == "near_duplicates":
            from test_pairs import shingles, union

            rows = before.select("doc_id", "text").collect()
            sets = {r.doc_id: shingles(r.text, 5) for r in rows}
            ids = sorted(sets)
            links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert sorted(r.doc_id for r in kept.collect()) == sorted(set(union(ids, links).values()))
        if name == "decontamination":
            bench = spark.read.parquet(f"{d}/benchmark.parquet")
            hit = {r.doc_id for r in decontamination.benchmark_matches(before, bench).where("n_hit > 0").collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - hit
        if name == "mixing":
            assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before.collect()}
    shards = corpus_pipeline.run(spark, d)
    assert shards.count() == kept.count() and shards.where("shard not between 0 and 39").count() == 0
