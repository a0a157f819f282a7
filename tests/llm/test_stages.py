"""The pipeline's language, mixing and sharding stages: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables; sharding against a greedy partition."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelyard.llm import sharding
from test_corpus import brute_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, score double, lang_pred string, copies int, key string, shard int"
EXTRA = (1, 2.0, "xx", 9, "k", 3)
EN = "the quick brown fox jumps over the lazy dog and then it runs through this old house with them".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er durch dieses alte haus mit ihnen".split()


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words, lang = ((EN, "en"), (DE, "de"))[i % 2]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 60))), lang, rng.choice(["a", "a", "b", None, "é"]), 5, *EXTRA))
    rows += [(1000, None, "en", "a", None, *EXTRA), (1001, "", "en", "a", 0, *EXTRA), (1002, " 12 !! \x0b", None, None, 9, *EXTRA), (1003, " ".join(EN) * 20_000, "en", "b", 5, *EXTRA)]
    return [*rows, rows[3], rows[3], (None, rows[4][1], "en", "b", 5, *EXTRA), (None, None, None, None, None, *EXTRA)]


@pytest.fixture
def docs(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def plain(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def test_language_stage(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    want = Counter(r[:5] for r in documents() if any(c.isalpha() for c in r[1] or ""))
    assert plain(out.collect()) == want  # clean documents stay, repeated rows and rows without an id as well
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_mixing_stage(spark, docs):
    out = corpus_pipeline.mixing(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got, known = plain(out.collect()), plain(docs.collect())
    assert got.keys() <= known.keys() and all(n <= 3 * known[r] for r, n in got.items())
    words = lambda t: len((t or "").split())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r, n in known.items():
        sizes[r[3]] += n * words(r[1])
    for r, n in got.items():
        taken[r[3]] += n * words(r[1])
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 60 or source == "b" and abs(taken[source] - target) <= words(documents()[243][1])
    assert got == plain(corpus_pipeline.mixing(spark, docs, "").collect())
    assert corpus_pipeline.mixing(spark, docs.limit(0), "").count() == 0


def test_sharding_stage(spark, docs):
    got = corpus_pipeline.sharding(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in documents())
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(raw(r[1])) + 16, zlib.crc32(raw(r[1]))) for r in documents())
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for k, h in homes.items() if k[0] > 16) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert corpus_pipeline.sharding(spark, docs.limit(0), "").count() == 0


def greedy(sizes, k):
    """Largest group first, to the emptiest shard: the spread between the fullest and the emptiest."""
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return max(loads) - min(loads)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_differencing_is_no_worse_than_greedy(spark, seed):
    rng = random.Random(seed)
    texts = ["w" * int(rng.paretovariate(0.7) * 20) + str(i % 150) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loads, groups = Counter(), Counter()
    for r in sharding.sharded(df, n_shards=5).collect():
        loads[r.shard] += r["size"]
        groups[texts[r.doc_id]] += r["size"]
    total = sum(groups.values())
    assert sum(loads.values()) == total
    got = max(loads.values()) - min(loads[j] for j in range(5))
    assert got <= max(greedy(list(groups.values()), 5), 16)


def test_copies_of_one_text_are_dealt(spark, monkeypatch):
    from panelyard.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    monkeypatch.setattr(shared, "LEAST_HOT", 10)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(900)], "doc_id long, text string")
    got = sharding.sharded(df, n_shards=3).collect()
    assert len(got) == 900 and len({r.shard for r in got if r.doc_id % 3}) == 1
