"""Distributed ranks, quantiles and top rows against brute force, and on a group that no task could hold."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import lineup, metrics, ranks

SCHEMA = "g string, id long, x double, y double"


def table(seed, n=400):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, -0.0, 0.0, 1.5, 2.5, rng.randrange(40) / 4, rng.random()])
    hot = [("hot", 10_000 + i, 7.0, rng.choice([7.0, None, 1.0])) for i in range(n)]  # ties without end
    return [(rng.choice(["a", "b", None, ""]), i, value(), value()) for i in range(n)] + hot + [("one", 1, 3.0, 3.0), ("none", 2, None, None)]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def brute_rank(values, v):
    return sum(u < v for u in values) + (sum(u == v for u in values) + 1) / 2


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return table(request.param)


def test_average_ranks(spark, rows):
    got = {(r.g, r.id): r.r for r in ranks.average_rank(spark.createDataFrame(rows, SCHEMA).repartition(5), "x", ["g"], "r").collect()}
    want = {}
    for g, own in groups(rows).items():
        known = [r[2] for r in own if r[2] is not None]
        want |= {(g, r[1]): None if r[2] is None else brute_rank(known, r[2]) for r in own}
    assert got == want


def test_ranks_and_percentiles(spark, rows):
    got = {(r.g, r.id): (r["rank"], round(r.percentile, 9)) for r in lineup.empirical_percentile(spark.createDataFrame(rows, SCHEMA), ["g"], "x").collect()}
    want = {}
    for g, own in groups(rows).items():
        known = sorted((r for r in own if r[2] is not None), key=lambda r: (-r[2], r[1]))
        want |= {(g, r[1]): (i, round(sum(o[2] <= r[2] for o in known) / len(known) * 100, 9)) for i, r in enumerate(known, 1)}
    assert got == want
    plain = lineup.rank_within_class(spark.createDataFrame(rows, SCHEMA), ["g"], "x")
    assert {(r.g, r.id): r["rank"] for r in plain.collect()} == {k: v[0] for k, v in want.items()}


def test_quantiles(spark, rows):
    qs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.g: [r[c] for c in qs] for r in ranks.exact_quantiles(df, ["g"], "x", qs).collect()}
    want = {g: np.quantile([r[2] for r in own if r[2] is not None], list(qs.values())).tolist() for g, own in groups(rows).items() if any(r[2] is not None for r in own)}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    whole = ranks.exact_quantiles(df, [], "x", qs).collect()
    assert [list(r) for r in whole] == [pytest.approx(np.quantile([r[2] for r in rows if r[2] is not None], list(qs.values())).tolist())]
    assert ranks.exact_quantiles(df.where("g = 'none'"), [], "x", qs).collect() == []
    ref = {r.g: r for r in lineup.rate_reference(df, ["g"], "x", F.col("id") % 2 == 0).collect()}
    assert (ref["none"].used, ref["none"].excluded, ref["none"].p90) == (0, 1, None)
    assert sum(r.used + r.excluded for r in ref.values()) == len(rows)


def test_spearman(spark, rows):
    got = {r.g: (r.pairs, r.spearman) for r in metrics.spearman_by_group(spark.createDataFrame(rows, SCHEMA), "x", "y", ["g"]).collect()}
    for g, own in groups(rows).items():
        both = [(r[2], r[3]) for r in own if r[2] is not None and r[3] is not None]
        if not both:
            assert g not in got
            continue
        xs, ys = zip(*both, strict=True)
        a, b = [brute_rank(xs, v) for v in xs], [brute_rank(ys, v) for v in ys]
        want = statistics.correlation(a, b) if len(set(a)) > 1 and len(set(b)) > 1 else None
        assert got[g][0] == len(both) and (got[g][1] is None if want is None else got[g][1] == pytest.approx(want))
    assert metrics.spearman_by_group(spark.createDataFrame(rows, SCHEMA).limit(0), "x", "y", []).count() == 0


@pytest.mark.parametrize("strict", [True, False])
def test_overlaps(spark, rows, strict):
    ns = (3, 25, 300)
    got = {(r.g, r.n): (r.pairs, r.overlap, r.overlap_pct) for r in metrics.top_n_overlap(spark.createDataFrame(rows, SCHEMA), "x", "y", "id", ["g"], ns, strict).collect()}
    want = {}
    for g, own in groups(rows).items():
        both = [r for r in own if r[2] is not None and r[3] is not None]
        for n in ns if both else ():
            top = lambda c: {r[1] for r in sorted(both, key=lambda r: (-r[c], r[1]))[:n]}  # noqa: B023, E731
            o = len(top(2) & top(3))
            want[g, n] = (len(both), None, None) if strict and len(both) < n else (len(both), o, pytest.approx(o * 100 / (n if strict else min(n, len(both)))))
    assert got == want
    lists = {r.g: r["keys"] for r in metrics.top_n_lists(spark.createDataFrame(rows, SCHEMA), "x", "id", ["g"], 5).collect()}
    assert lists == {g: [r[1] for r in sorted((r for r in own if r[2] is not None), key=lambda r: (-r[2], r[1]))[:5]] for g, own in groups(rows).items() if any(r[2] is not None for r in own)}


def test_a_group_of_a_million_rows_is_spread(spark, monkeypatch):
    """One group of 10^6 distinct values: pieces stay even, and no window or exchange is by the group alone."""
    pieces = []
    real = ranks.written

    def spy(df, name):
        out = real(df, name)
        if name == "ordered":
            pieces.append([r["count"] for r in out.groupBy("_part").count().collect()])
        return out

    monkeypatch.setattr(ranks, "written", spy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.lit("g").alias("g"), "id", (F.col("id") * 7919 % n).cast("double").alias("x"))
        got = ranks.row_numbers(df, ["g"], [F.desc("x"), F.col("id")], "r")
        assert got.where(F.col("r") != n - F.col("x")).count() == 0 and got.count() == n
        plan = got._jdf.queryExecution().toString()
        q = ranks.exact_quantiles(df, ["g"], "x", {"p90": 0.9}).collect()[0]
        assert q.p90 == pytest.approx(0.9 * (n - 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(max(p) < 0.2 * n for p in pieces) and len(pieces) == 2
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line and "_before" in line)


def test_several_correlations_with_one_column_are_those_of_each(spark):
    rows = [(g, float(i * 7 % 5), float(i * 11 % 13), float(i * 3 % 4)) for g in ("a", "b") for i in range(40)] + [("c", 1.0, 2.0, 1.0), ("c", 1.0, 3.0, 2.0), ("d", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, z double, y double")
    got = {r.g: (r.pairs, r.x_spearman, r.z_spearman) for r in ranks.spearman_against(df, ["x", "z"], "y", ["g"]).collect()}
    both = df.where("z is not null")
    of = lambda c: {r.g: (r.pairs, r.spearman) for r in ranks.spearman_by_group(both, c, "y", ["g"]).collect()}
    x, z = of("x"), of("z")
    assert set(got) == set(x) == {"a", "b", "c"} and got["c"][1] is None
    for g, (n, a, b) in got.items():
        assert (n, a, b) == (x[g][0], x[g][1] if x[g][1] is None else pytest.approx(x[g][1]), pytest.approx(z[g][1]))
