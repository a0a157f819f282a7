"""The distributed isotonic fit against pooling in one list."""

import itertools
import random

import pytest

from panelyard.operators import experiments


def brute(pairs):
    grouped = {}
    for x, y in pairs:
        grouped.setdefault(x, []).append(y)
    blocks = []
    for x in sorted(grouped):
        blocks.append([x, x, sum(grouped[x]), len(grouped[x])])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] > blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1][1:] = [b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(lo, hi, pytest.approx(t / n), n) for lo, hi, t, n in blocks]


def shapes():
    rng = random.Random(4)
    yield "hand", [(0.0, 0.0), (1.0, 2.0), (2.0, 1.0), (3.0, 3.0)]
    yield "noise", [(float(rng.randrange(300)), float(rng.randrange(50))) for _ in range(900)]
    yield "trend", [(x / 4, x // 9 + float(rng.randrange(12))) for x in range(800)]
    yield "rising", [(float(x), float(x)) for x in range(500)]
    yield "falling", [(float(x), float(-x)) for x in range(500)]
    yield "saw", [(float(x), float(x % 40)) for x in range(800)]
    yield "ties", [(float(x), float(x // 100)) for x in range(400)] + [(7.0, 5.0)] * 500
    yield "one", [(1.0, 2.0)]


@pytest.mark.parametrize(("name", "pairs"), list(shapes()))
def test_blocks(spark, monkeypatch, name, pairs):
    monkeypatch.setattr(experiments, "FAN_IN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame([*pairs, (None, 1.0), (1.0, None)], "p double, a double")
        blocks = experiments.isotonic_blocks(df, "p", "a")
        got = sorted(tuple(r) for r in blocks.collect())
        applied = {r.p: r.calibrated for r in experiments.isotonic_step_apply(df.selectExpr("p").union(spark.createDataFrame([(-9.0,), (1e6,)], "p double")), blocks, "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(pairs)
    assert [r[1:5] for r in got] == want and [r[0] for r in got] == list(range(len(want)))
    assert got[0][5] == float("-inf") and all(b[5] == (a[2] + b[1]) / 2 for a, b in itertools.pairwise(got))
    for x, y in applied.items():
        assert y is None if x is None else y == max((r for r in got if r[5] <= x), key=lambda r: r[0])[3]
    assert applied[-9.0] == got[0][3] and applied[1e6] == got[-1][3]


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "p double, a double")
    blocks = experiments.isotonic_blocks(df, "p", "a")
    assert blocks.count() == 0
    assert [r.calibrated for r in experiments.isotonic_step_apply(df, blocks, "p").collect()] == [None, None]


def test_tables_of_the_fits(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)], "p double, a double")
    line, blocks = experiments.linear_calibration(df, "p", "a"), experiments.isotonic_blocks(df, "p", "a")
    rows = {r.candidate: (r.development_n, r.intercept, r.slope, r.isotonic_blocks) for r in experiments.calibration_parameters(line, blocks).collect()}
    assert rows == {"C0": (3, 0.0, 1.0, None), "C1": (3, pytest.approx(1.0), pytest.approx(2.0), None), "C2": (3, None, None, 3)}
    shown = {(r.candidate, r.raw): r.calibrated for r in experiments.calibration_examples(line, blocks).collect()}
    assert len(shown) == 27 and shown["C1", 4.0] == pytest.approx(9.0)
    assert [shown["C2", x] for x in (0.0, 0.5, 1.0, 10.0)] == [1.0, 3.0, 3.0, 5.0]
