"""Publishing by one rename, digests of files, captures, coherence of snapshots, diffs of runs and state that leaves a stream."""

import datetime as dt
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelyard.operators import diff, quality
from panelyard.plans import decision_plans
from panelyard.sources import captures, files, readers, sinks
from panelyard.streaming import monitors


def test_a_failed_run_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.sink_immutable_parquet({"good": spark.range(5), "bad": bad}, path)
    assert not Path(path).exists() and sinks.unfinished(spark, path) == []
    # A driver that died has left its stage; it is found and removed, and what is published stays.
    (tmp_path / ".out.stage-dead" / "good").mkdir(parents=True)
    sinks.sink_immutable_parquet({"good": spark.range(5)}, path)
    assert [Path(p).name for p in sinks.recover(spark, path)] == [".out.stage-dead"]
    assert sinks.read_published(spark, path, "good").count() == 5 and sinks.recover(spark, path) == []


def test_the_second_of_two_runs_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    real = sinks.manifest_table

    def slow(s, at):
        Path(path).mkdir(exist_ok=True)  # another run ends first
        (Path(path) / "theirs").touch()
        return real(s, at)

    monkeypatch.setattr(sinks, "manifest_table", slow)
    with pytest.raises(FileExistsError):
        sinks.sink_immutable_parquet({"t": spark.range(2)}, path)
    assert [p.name for p in Path(path).iterdir()] == ["theirs"] and sinks.unfinished(spark, path) == []


def test_manifests_name_every_change(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.sink_immutable_parquet({"t": spark.range(9).withColumn("k", F.col("id") % 3).repartition("k")}, path, {"x": 1}, {"t": ["k"]})
    want = spark.read.json(f"{path}/_manifest")
    assert {r.file.split("/")[1] for r in want.collect()} == {"k=0", "k=1", "k=2"} and {r.table_rows for r in want.collect()} == {9}
    parts = {i: next((tmp_path / f"out/t/k={i}").glob("*.parquet")) for i in range(3)}
    for r in want.collect():
        body = (tmp_path / "out" / r.file).read_bytes()
        assert (r.bytes, r.sha256) == (len(body), hashlib.sha256(body).hexdigest())
    parts[0].write_bytes(parts[0].read_bytes()[:-1] + b"?")
    parts[1].unlink()
    (tmp_path / "out/t/k=2/more.parquet").write_bytes(b"x")
    got = {(r.file.split("/")[1], r.problem) for r in sinks.content_hash_verify(sinks.manifest_table(spark, f"{path}/t"), want).collect()}
    assert got == {("k=0", "changed"), ("k=1", "missing"), ("k=2", "unlisted")}


def test_digests_are_streamed(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 1000)
    body = bytes(range(256)) * 99
    (tmp_path / "f").write_bytes(body)

    class Chunks:
        largest = 0

        def __init__(self, source):
            self.source = source

        def read(self, n):
            Chunks.largest = max(Chunks.largest, n)
            return self.source.read(n)

    with (tmp_path / "f").open("rb") as f:
        assert files.streamed_digest(Chunks(f)) == (len(body), hashlib.sha256(body).hexdigest())
    assert Chunks.largest == 1000
    assert files.reachable("file:/tmp/x") and files.reachable("/tmp/x") and not files.reachable("viewfs://store/x")


def test_captures_round_trip(spark, tmp_path):
    at = dt.datetime(2024, 3, 9, 18, 30)
    rows = [(at, "0-0", json.dumps({"elements": [{"id": 1, "v": 2.5}, {"id": 2}]})), (at, "0-1", json.dumps({"elements": []})), (at + dt.timedelta(days=1), None, json.dumps({"elements": [{"id": 3, "v": 1.0}]}))]
    df = spark.createDataFrame(rows, "captured_at timestamp_ntz, part string, document string").repartition(2)
    path = str(tmp_path / "x")
    for _ in range(2):  # a job that runs again writes the same files
        captures.write_xz_snapshots(spark, df, path)
    names = sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.xz"))
    assert names == ["0-0/2024/03/09/1830.json.xz", "0-1/2024/03/09/1830.json.xz", "2024/03/10/1830.json.xz"]
    assert not (Path(path) / "_staging").exists()
    got = readers.scan_xz_snapshots(spark, path, "id long, v double")
    assert sorted((r.id, r.v, r.captured_at.day) for r in got.collect()) == [(1, 2.5, 9), (2, None, 9), (3, 1.0, 10)]


def test_coherence(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string"), spark.createDataFrame([(1,)], "k int")
    digest = lambda df: df.agg(sinks.content_digest(df.columns)).first()[0]
    stated = lambda rows: spark.createDataFrame(rows, "table string, snapshot string, digest string")
    state = lambda rows: {r.table: (r.digest_matches, r.snapshot_agrees) for r in quality.snapshot_coherence({"a": a, "b": b}, stated(rows)).collect()}
    assert state([("a", "1", digest(a)), ("b", "1", digest(b))]) == {"a": (True, True), "b": (True, True)}
    assert state([("a", "1", digest(a)), ("b", "2", digest(a))]) == {"a": (True, False), "b": (False, False)}
    assert state([("a", "1", digest(a)), ("c", "1", "x")]) == {"a": (True, True), "b": (False, False), "c": (False, True)}
    assert quality.dq_snapshot_coherence({"a": a, "b": b}, stated([("a", "1", digest(a)), ("b", None, digest(b))])).collect()[0].violations == 2


def test_changes_of_runs(spark):
    left = {"m": spark.createDataFrame([(1, 7, 5), (1, 8, 5), (2, 9, 4)], "q int, id int, price int"), "v": spark.createDataFrame([(1, "view", 0.5)], "q int, view string, gain double")}
    right = {"m": spark.createDataFrame([(1, 7, 6), (1, 9, None), (2, 9, 4)], "q int, id int, price int"), "v": spark.createDataFrame([(1, "view", None), (3, "view", 1.0)], "q int, view string, gain double")}
    sections = {"m": (["id"], ["price"]), "v": (["view"], ["gain"])}
    changes = diff.run_changes(left, right, ["q"], sections)
    assert sorted(map(tuple, changes.collect()), key=str) == sorted([(1, "m", "7", "price", "5", "6"), (1, "m", "8", "present", "yes", None), (1, "m", "9", "present", None, "yes"), (1, "v", "view", "gain", "0.5", None), (3, "v", "view", "present", None, "yes")], key=str)
    assert sorted(map(tuple, diff.run_flags(changes, ["q"], list(sections)).collect())) == [(1, 3, 1, True), (3, 0, 1, True)]
    assert diff.run_changes(left, left, ["q"], sections).count() == 0


def test_lineup_compare_pairs_the_same_class_first(spark):
    kinds = ["GK"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    squad = spark.createDataFrame([(1, i, k, "c", 5, float(i)) for i, k in enumerate(kinds)], "squad_id int, id int, class string, club string, price int, projection double")
    ids = "array<int>"
    chosen = spark.createDataFrame([(1, [0, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13], [1, 10, 11, 14], 2, 3)], f"squad_id int, starters {ids}, bench {ids}, captain int, vice int")
    best = spark.createDataFrame([(1, 99.0, [1, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14], 14, 3)], f"squad_id int, objective double, starters {ids}, captain int, vice int")
    got = decision_plans.lineup_compare(squad, chosen, best).collect()[0]
    assert (got.started, got.benched) == ([1, 10, 11, 14], [0, 2, 3, 7]) and [tuple(p) for p in got.changes] == [(1, 0), (10, 7), (11, 2), (14, 3)]
    assert (got.bench_added, got.bench_removed, got.captain_changed, got.vice_changed) == ([0, 2, 3, 7], [1, 10, 11, 14], True, False)
    total = sum([0, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]) + 2.0
    assert (got.chosen_objective, got.difference) == (total, 99.0 - total)
    unknown = squad.withColumn("projection", F.when(F.col("id") != 5, F.col("projection")))
    assert decision_plans.lineup_compare(unknown, chosen, best).collect()[0].difference is None


def test_finished_keys_leave_the_state(spark, tmp_path):
    """Many keys over many days: the state holds those of the last days only."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, monitors.ROCKSDB)
    schema = "target string, observed_at timestamp, ready boolean, digest string"
    sizes, finals = [], 0
    try:
        for day in range(6):
            start = dt.datetime(2024, 1, 1 + 2 * day)
            rows = [(f"k{day}-{i}", start + dt.timedelta(minutes=m), True, "d") for i in range(40) for m in ((0, 20) if i % 2 else (0,))]
            spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = monitors.stream_finalization(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), retention="1 day", delay="1 hour")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(max(int(p["stateOperators"][0]["numRowsTotal"]) for p in q.recentProgress[-1:]))
        finals = spark.read.parquet(str(tmp_path / "out")).count()
    finally:
        spark.conf.set(store, before)
    assert finals == 6 * 20
    # Without leaving, the last size would be six times the first.
    assert sizes[-1] <= 3 * sizes[0], sizes
