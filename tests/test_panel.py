"""Hand-computed cases of the panel operators."""

import datetime as dt
import itertools
import json
import lzma
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import expressions as X
from panelyard.operators import asof, diff, experiments, joins, lineup, metrics, quality
from panelyard.plans import decision_plans, panel_plans
from panelyard.sources import readers, sinks
from panelyard.streaming import monitors


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_cleaning(spark):
    df = spark.createDataFrame([("",), (None,), (" 1.5 ",), ("x",), ("NaN",), ("inf",), ("7",)], "t string")
    got = rows(df.select(X.clean_numeric(F.col("t")), X.clean_int(F.col("t")), X.violates(F.col("t"), X.clean_numeric(F.col("t")))))
    assert got == [(None, None, False), (None, None, False), (1.5, None, False), (None, None, True), (None, None, True), (None, None, True), (7.0, 7, False)]
    ts = spark.createDataFrame([("2024-01-01T10:00:00+02:00",), ("2024-01-01T10:00:00",), ("2024-01-01T10:00:00Z",)], "t string")
    got = [r[0] for r in ts.select(F.date_format(X.clean_utc_ts(F.col("t")), "HH:mm")).collect()]
    assert got == ["08:00", None, "10:00"]
    money = spark.createDataFrame([(5.5,), (5.55,)], "m double").select(X.to_tenths(F.col("m")))
    assert [r[0] for r in money.collect()] == [55, None]


def test_null_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 4.0)], "k int, x double")
    assert rows(df.groupBy("k").agg(F.sum("x"), X.strict_sum(F.col("x"))), "k") == [(1, 1.0, None), (2, 7.0, 7.0)]
    one = spark.createDataFrame([(None, 0), (120.0, 0), (30.0, 0)], "m double, z int")
    assert [r[0] for r in one.select(X.clamp(F.col("m"))).collect()] == [None, 90.0, 30.0]
    assert [r[0] for r in one.select(X.appearance_points(F.col("m"))).collect()] == [None, 2.0, 1.0]
    assert [r[0] for r in one.select(X.per_90(F.col("m"), F.col("z"))).collect()] == [None, None, None]


def history(spark, extra=()):
    base = [(1, 1, "GK", 90, 1, 0.5), (1, 2, "GK", 60, 2, None), (1, 4, "GK", 30, 3, 0.1), (2, 4, "DEF", 0, 4, 0.0)]
    data = [(e, p, c, m, i, x, x, m // 10, True, dt.datetime(2024, 1, p, 12)) for e, p, c, m, i, x in [*base, *extra]]
    return spark.createDataFrame(data, "entity long, period int, class string, minutes long, event_id long, xg double, xa double, points long, appeared boolean, ts timestamp_ntz")


def test_windows_are_by_calendar(spark):
    p = asof.agg_entity_period(history(spark), ["entity"], "period", ["minutes", "xg"], F.col("appeared"))
    got = {r.entity: r for r in asof.feat_windows(p, ["entity"], "period", ["minutes", "xg"], 5).collect()}
    one = got[1]
    assert (one.prior_minutes, one.prior_avg_minutes, one.previous_minutes, one.last3_periods, one.last3_minutes) == (180, 60.0, 30, 2, 90)
    assert got[2].previous_minutes == 0 and got[2].last5_minutes == 0


def test_future_rows_change_nothing(spark):
    universe = history(spark).select("entity", "class").distinct()
    leak = [(1, p, "GK", 999, 90 + p, 9.9) for p in (5, 6, 20)]
    before = rows(panel_plans.scored(panel_plans.build_features(history(spark), universe, 5)), "entity")
    after = rows(panel_plans.scored(panel_plans.build_features(history(spark, leak), universe, 5)), "entity")
    assert before == after
    targets = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 4, 0))], "entity long, target int, deadline timestamp_ntz")
    got = panel_plans.historical_features(history(spark, leak), targets).collect()[0]
    assert got.prior_minutes == 150 and got.max_period == 2  # period 4 is before the target but after the deadline


def test_scoring_by_hand(spark):
    universe = history(spark).select("entity", "class").distinct().union(spark.createDataFrame([(9, "FWD")], "entity long, class string"))
    got = {r.entity: r for r in panel_plans.scored(panel_plans.build_features(history(spark), universe, 5)).collect()}
    assert got[1].expected_minutes == 30.0 and got[1].appearance == 1.0
    assert got[1].goal == pytest.approx(0.6 * 90 / 180 * 30 / 90 * 10)
    assert got[2].total == 0.0 and got[2].goal is None
    assert got[9].total is None and got[9].low_sample


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0), (2, 2.0, 10.0), (3, 1.0, None), (4, None, 3.0)], "id int, p double, a double")
    m = metrics.forecast_metrics(df, "p", "a").collect()[0]
    assert (m.eligible, m.pairs, m.mae, m.bias) == (4, 2, 6.0, -6.0) and m.rmse == pytest.approx(math.sqrt(40))
    ranks = spark.createDataFrame([("g", x, y) for x, y in zip([1, 2, 3, 4], [1, 3, 2, 4], strict=True)] + [("c", 1, 1), ("c", 1, 2)], "g string, x int, y int")
    got = dict((r.g, r.spearman) for r in metrics.spearman_by_group(ranks, "x", "y", ["g"]).collect())
    assert got["g"] == pytest.approx(0.8) and got["c"] is None
    few = metrics.top_n_overlap(df.fillna(1.0), "p", "a", "id", [], ns=(2, 9)).collect()
    assert {r.n: r.overlap for r in few} == {2: 1, 9: None}
    bins = metrics.calibration_bins(df, "p", "a").orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 0, 1, 0, 0, 0, 0]


def pava(pairs):
    grouped = {}
    for x, y in pairs:
        grouped.setdefault(x, []).append(y)
    blocks = []
    for x in sorted(grouped):
        blocks.append([x, x, sum(grouped[x]), len(grouped[x])])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1][1:] = [b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return blocks


def test_isotonic_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(float(rng.randrange(12)), rng.random() * 5) for _ in range(60)]
    blocks = pava(pairs)
    df = spark.createDataFrame(pairs, "p double, a double")
    out = experiments.isotonic_step_apply(df, experiments.isotonic_blocks(df, "p", "a"), "p").select("p", "calibrated").distinct().collect()
    for x, got in out:
        want = next(b for b, nxt in itertools.zip_longest(blocks, blocks[1:]) if nxt is None or x < (b[1] + nxt[0]) / 2)
        assert got == pytest.approx(want[2] / want[3])


def test_gates(spark):
    df = spark.createDataFrame([("A", 6.0, 4.0), ("B", 9.0, None), ("C", 7.0, 3.0)], "candidate string, mae double, rmse double")
    gates = {"mae": ("mae", ">=", 5.0), "rmse": ("rmse", ">=", 3.0)}
    got = {r.candidate: (r.qualifies, r.winner) for r in experiments.gate_selection(df, "candidate", gates, [F.desc("mae")]).collect()}
    assert got == {"A": (True, False), "B": (False, False), "C": (True, True)}


def squad(rng, n_pool=40):
    kinds = [k for k, n in lineup.SQUAD.items() for _ in range(n)]
    own = [(1, i, k, f"c{i % 7}", 50, float(rng.randrange(0, 60)) / 10) for i, k in enumerate(kinds)]
    pool = [(100 + i, rng.choice(list(lineup.SQUAD)), f"c{i % 7}", rng.randrange(45, 56), float(rng.randrange(0, 80)) / 10) for i in range(n_pool)]
    return own, pool


def brute_lineup(members, captain=1.0):
    best = None
    by = {k: [m for m in members if m[2] == k] for k in lineup.SQUAD}
    for d, m, f in lineup.FORMATIONS:
        for xi in itertools.product(itertools.combinations(by["GK"], 1), itertools.combinations(by["DEF"], d), itertools.combinations(by["MID"], m), itertools.combinations(by["FWD"], f)):
            flat = [p for part in xi for p in part]
            score = round(sum(p[5] for p in flat) + captain * max(p[5] for p in flat), 8)
            key = (-score, sorted(p[1] for p in flat))
            best = key if best is None or key < best else best
    return -best[0], best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_lineup_and_swaps_against_brute_force(spark, seed):
    own, pool = squad(random.Random(seed))
    s = spark.createDataFrame(own, "squad_id long, id long, class string, club string, price int, projection double")
    p = spark.createDataFrame(pool, "id long, class string, club string, price int, projection double")
    h = spark.createDataFrame([(1, 2)], "squad_id long, bank int")
    got = lineup.best_lineup(s).collect()[0]
    want = brute_lineup(own)
    assert (got.objective, got.starters) == (pytest.approx(want[0]), want[1])
    found = {(r.out_id, r.in_id): r for r in lineup.swap_search(s, p, h).collect()}
    legal = {}
    for o in own:
        for q in pool:
            rest = [m for m in own if m[1] != o[1]]
            if q[1] == o[2] and q[3] <= o[4] + 2 and sum(m[3] == q[2] for m in rest) < 3:
                legal[o[1], q[0]] = brute_lineup([*rest, (1, q[0], q[1], q[2], q[3], q[4])])[0]
    assert found.keys() == legal.keys()
    assert all(found[k].objective == pytest.approx(v) for k, v in legal.items())
    ranks = sorted(legal, key=lambda k: (-round(legal[k], 8), k))
    assert [found[k]["rank"] for k in ranks] == list(range(1, len(ranks) + 1))
    views = decision_plans.sensitivity_views(s, decision_plans.with_reliability(p), h)
    plain = {r.view: r for r in views.collect()}["xi_only_without_captain_amplification"]
    single = lineup.swap_search(s, p, h, captain=0.0).where("rank = 1").collect()[0]
    assert (plain.out_id, plain.in_id, plain.gain) == (single.out_id, single.in_id, single.gain)


def test_legality(spark):
    own, _ = squad(random.Random(1))
    bad = [(2, *m[1:]) for m in own[:-1]] + [(2, 0, "GK", "c0", 50, 1.0)]
    df = spark.createDataFrame(own + bad, "squad_id long, id long, class string, club string, price int, projection double")
    got = {r.squad_id: r.violations for r in lineup.squad_legality(df, F.lit(10_000)).collect()}
    assert got[1] == [] and got[2] == ["duplicate_member", "wrong_count_FWD", "wrong_count_GK"]


def test_diffs_and_joins(spark):
    a = spark.createDataFrame([(1, 5, None), (2, 6, "x"), (3, 7, "y")], "k int, n int, s string")
    b = spark.createDataFrame([(1, 5, None), (2, 8, "x"), (4, 7, "y")], "k int, n int, s string")
    assert rows(diff.snapshot_diff(a, b, "k", ["n", "s"]), "k") == [(2, "changed", ["n"]), (3, "removed", []), (4, "added", [])]
    assert (2, "n", 6.0, 8.0, 2.0) in rows(diff.run_diff(a, b, "k", ["n"]))
    assert len(rows(joins.null_safe(a.select("s", "k"), b.select("s", F.col("k").alias("k2")), ["s"]))) == 3
    assert quality.dq_same_rows(a, b, ["k"], ["n", "s"], "r").collect()[0].violations == 3
    assert quality.dq_unique_key(a.union(a), ["k"]).collect()[0].violations == 3
    assert quality.dq_unique_key(a, ["s"]).collect()[0].violations == 1


def test_files(spark, tmp_path):
    doc = {"elements": [{"id": 1, "team": 2}, {"id": 2, "team": 9}], "teams": [{"id": 2, "name": "b"}]}
    (tmp_path / "boot.json").write_text(json.dumps(doc, indent=1))
    schema = "elements array<struct<id: int, team: int>>, teams array<struct<id: int, name: string>>"
    got = readers.scan_json_entities(spark, str(tmp_path / "boot.json"), schema, "elements", [("teams", "id", "team", {"name": "team_name"})])
    assert rows(got.select("id", "team_name"), "id") == [(1, "b"), (2, None)]
    hist = tmp_path / "h"
    hist.mkdir()
    for i, own in ((7, 7), (8, 9)):
        (hist / f"{i}.json").write_text(json.dumps({"history": [{"element": own, "minutes": 5}]}))
    got = readers.scan_json_histories(spark, str(hist), "history array<struct<element: bigint, minutes: int>>")
    assert rows(got.select("file_id", "file_id_matches"), "file_id") == [(7, True), (8, False)]
    (tmp_path / "a.csv").write_bytes("﻿id,name\n3,x\n4,\"y,z\"\n".encode())
    got = readers.scan_csv_rownum(spark, str(tmp_path / "a.csv"), "name string, id long")
    assert rows(got.select("source_row_number", "id", "name", "raw_record"), "id") == [(1, 3, "x", "3,x"), (2, 4, "y,z", '4,"y,z"')]
    xz = tmp_path / "x/2024/03/09"
    xz.mkdir(parents=True)
    (xz / "1830.json.xz").write_bytes(lzma.compress(json.dumps({"elements": [{"id": 1, "v": 2.5}, {"id": 2}]}).encode()))
    got = readers.scan_xz_snapshots(spark, str(tmp_path / "x"), "id long, v double")
    assert rows(got.select(F.date_format("captured_at", "yyyy-MM-dd HH:mm"), "id", "v"), "id") == [("2024-03-09 18:30", 1, 2.5), ("2024-03-09 18:30", 2, None)]


def test_sink_is_written_once(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path, "t")
    manifest = sinks.sink_immutable_parquet({"t": df}, path)
    with pytest.raises(FileExistsError):
        sinks.sink_immutable_parquet({"t": df}, path)
    assert sinks.read_published(spark, path, "t").count() == 5
    want = spark.read.json(manifest)
    assert sinks.content_hash_verify(sinks.manifest_table(spark, f"{path}/t"), want).count() == 0
    part = next((tmp_path / "out/t").glob("*.parquet"))
    (tmp_path / "out/t" / ("." + part.name + ".crc")).unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    assert [r.problem for r in sinks.content_hash_verify(sinks.manifest_table(spark, f"{path}/t"), want).collect()] == ["changed"]


def test_finalization_rules():
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    run = lambda obs: monitors.finalized(pd.DataFrame(obs, columns=["observed_at", "ready", "digest"]), None)[1]
    assert run([(at(0), True, "a"), (at(15), True, "a")]) == (at(0), at(15), "a")
    assert run([(at(0), True, "a"), (at(14), True, "a")]) is None
    assert run([(at(0), True, "a"), (at(10), True, "b"), (at(20), True, "b")]) is None
    assert run([(at(0), True, "a"), (at(5), False, "a"), (at(18), True, "a")]) is None


def test_fixed_bins_and_bands(spark):
    """Edges by hand: what each bin and band holds, and what none does."""
    from panelyard.operators import metrics
    from panelyard.plans import decision_plans

    rows = spark.createDataFrame([(-0.5, 0.0), (0.0, 1.0), (0.99, 1.0), (4.99, 5.0), (5.0, 5.0), (6.99, 7.0), (7.0, 7.0), (50.0, 1.0)], "p double, a double")
    assert {r.bin: r.n for r in metrics.calibration_bins(rows, "p", "a").collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 2}
    minutes = spark.createDataFrame([(0.0,), (0.3,), (29.9,), (30.0,), (60.0,), (89.9,), (90.0,), (None,)], "x double")
    assert [r[0] for r in minutes.select(X.minute_band(F.col("x"))).collect()] == ["0", "1-29", "1-29", "30-59", "60-89", "60-89", "90", "unknown"]
    factors = spark.createDataFrame([(0.7,), (0.71,), (0.85,), (0.95,), (1.05,), (1.15,), (1.29,), (1.3,)], "x double")
    assert [r[0] for r in factors.select(X.factor_band(F.col("x"))).collect()] == [*X.FACTOR_BANDS[:6], X.FACTOR_BANDS[5], X.FACTOR_BANDS[6]]
    assert decision_plans.sensitivity_names() == [
        *[f"minimum_prior_minutes_{m}" for m in (30, 60, 90, 91)], *[f"exclude_rates_above_position_p{p}" for p in (90, 95, 99)], *[f"cap_rates_at_position_p{p}" for p in (90, 95, 99)], "xi_only_without_captain_amplification",
    ]


def test_csv_of_many_columns_and_quoted_headers(spark, tmp_path):
    names = [f"c{i}" for i in range(90)] + ['"a, b"']
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(str(i) for i in range(90)) + ',"x, y"\n')
    row = readers.scan_csv_rownum(spark, str(tmp_path / "wide.csv"), "c0 int, c89 int, `a, b` string").first()
    assert (row.source_row_number, row.c0, row.c89, row["a, b"]) == (1, 0, 89, "x, y")
