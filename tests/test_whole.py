"""Queries do the whole job whatever the table's size: streams in several batches, documents of bounded size."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelyard.queries import flows, scans


@pytest.fixture
def events(spark, tmp_path):
    """A writer of an events table in 3 files, and the folder of what queries write."""

    def write(rows):
        df = spark.createDataFrame(rows, "user_id long, at string, event_id long, event_type string, value double")
        df.select("user_id", F.col("at").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value").repartition(3, "event_id").write.parquet(str(tmp_path / "d" / "events.parquet"))
        return str(tmp_path / "d")

    return write


@pytest.fixture
def folder(monkeypatch, tmp_path):
    def use(module):
        monkeypatch.setattr(module, "scratch", lambda s, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
        return tmp_path

    return use


@pytest.mark.parametrize("name", ["stream_finalization", "stream_late_guard", "stream_dedup"])
def test_streams_take_several_files_and_batches(spark, events, folder, name):
    where = folder(flows)
    d = events([(i % 7, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}:00", i, ("view", "click", "error")[i % 3], 1.0 * i) for i in range(400)])
    rows = getattr(flows, name)(spark, d).count()
    commits = [p for p in Path(where).glob("progress-*/commits/*") if not p.name.startswith(".")]
    assert rows and len(commits) > 2
    assert len(list(Path(where).glob("stream-*/part-*"))) > 3


def test_finalization_waits_across_batches(spark, events, folder):
    folder(flows)
    d = events([(1, "2024-01-01 00:00:00", 1, "view", 1.0), (1, "2024-01-20 00:00:00", 2, "click", 1.0), (2, "2024-01-02 00:00:00", 3, "view", 1.0), (2, "2024-01-12 00:00:00", 4, "error", 1.0), (2, "2024-01-30 00:00:00", 5, "view", 1.0)])
    got = [(r.target, str(r.first_seen), str(r.final_at), r.digest) for r in flows.stream_finalization(spark, d).collect()]
    assert got == [("user1", "2024-01-01 00:00:00", "2024-01-20 00:00:00", "a")]


@pytest.mark.parametrize("most", [1, 7, 20_000])
def test_json_documents_are_bounded(spark, events, folder, monkeypatch, most):
    where = folder(scans)
    monkeypatch.setattr(scans, "DOCUMENT_ROWS", most, raising=False)
    # A hot user, copies of one id, and a row without a user.
    rows = [(1 if i % 3 else i, "2024-01-01 00:00:00", i, "view", 1.0 * i) for i in range(90)] + [(5, "2024-01-01 00:00:00", 7, "view", 1.0)] * 30 + [(None, "2024-01-01 00:00:00", 99, "view", 1.0)]
    got = sorted((r.file_id or -1, r.event_id, r.value, r.file_id_matches) for r in scans.scan_json_histories(spark, events(rows)).collect())
    assert got == sorted((u or -1, i, v, True) for u, _, i, _, v in rows)
    sizes = [len(json.loads(line)["history"]) for p in Path(where).glob("histories-*/**/*.json") for line in p.read_text().splitlines()]
    assert sum(sizes) == len(rows) and max(sizes) <= most

    spark.createDataFrame([(i, f"c{i}", i % 2) for i in range(40)], "c_custkey long, c_name string, c_nationkey int").write.parquet(str(where / "d" / "customer.parquet"))
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(str(where / "d" / "nation.parquet"))
    got = sorted((r.id, r.name, r.team, r.team_name) for r in scans.scan_json_entities(spark, str(where / "d")).collect())
    assert got == [(i, f"c{i}", i % 2, "AB"[i % 2]) for i in range(40)]
    sizes = [len(json.loads(line)["elements"]) for p in Path(where).glob("entities-*/**/*.json") for line in p.read_text().splitlines()]
    assert sum(sizes) == 40 and max(sizes) <= most


def test_orders_of_any_status_take_a_customer_out(spark, tmp_path):
    from panelyard.queries import aggregates

    spark.range(1, 5).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "O"), (2, "F"), (3, "P")], "o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r[0] for r in aggregates.except_universe(spark, str(tmp_path)).collect()] == [4]


def test_a_sum_on_the_edge_of_a_band_is_in_the_upper_one(spark, events):
    """10 / 20 is a rate of 0.5 and 1 + 3 a score of 4, whatever the doubles 1.4 + 0.4 and 0.7 + 0.6 lack of their sums."""
    from panelyard.queries import players

    d = events([(2, "2024-01-01 00:00:00", 1, "click", 14.0), (2, "2024-01-01 01:00:00", 2, "purchase", 4.0), (6, "2024-01-18 00:00:00", 3, "click", 7.0), (6, "2024-01-19 00:00:00", 4, "click", 6.0)])
    game = spark.createDataFrame([(1, 42, 1.0, "2001-01-20 00:00:00")], "o_orderkey long, o_custkey long, o_totalprice double, at string")
    game.select("o_orderkey", "o_custkey", "o_totalprice", F.col("at").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    got = {(r.kind, r.band): r.n for r in players.band_labels(spark, d).collect()}
    assert got["rate_tier", "0.50-<0.75"] == 6 and ("rate_tier", "0.25-<0.50") not in got
    assert got["raw_score", "4-<5"] == 1 and ("raw_score", "3-<4") not in got
