"""CSV records against the csv module: quotes, line breaks, long lines, ranges of a file."""

import csv
import io
import random

import pytest

from panelyard.sources import readers


def brute(data: bytes):
    csv.field_size_limit(10**7)
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r]
    return rows[0], rows[1:]


def check(spark, folder, data: bytes, columns, split=None):
    (folder / "a.csv").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.scan_csv_rownum(spark, str(folder / "a.csv"), ", ".join(f"`{c}` string" for c in columns)).orderBy("source_row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    names, rows = brute(data)
    want = [(i, *[(r[names.index(c)] if c in names and names.index(c) < len(r) else "") or None for c in columns]) for i, r in enumerate(rows, 1)]
    assert [(r.source_row_number, *[r[c] for c in columns]) for r in got] == want
    return got


def test_quotes_by_hand(spark, tmp_path):
    data = '﻿id,"a, b",c\n1, x ,"say ""hi"""\n\n2,"two\nlines, one ""cell""","y"\r\n3,5" pipe,it\\"s\n4,"",z\n5,"open "tail,q\n'.encode()
    got = check(spark, tmp_path, data, ["id", "a, b", "c", "absent"])
    assert got[1].raw_record == '2,"two\nlines, one ""cell""","y"' and got[0]["a, b"] == " x " and got[2]["c"] == 'it\\"s'


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("split", [None, 150])
def test_random_files(spark, tmp_path, seed, split):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", " ", ",", '"', "\n", "b", "é", ""]) for _ in range(rng.randrange(9)))
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["k", "v", "w"])
    for i in range(160):
        writer.writerow([i, cell(), cell()])
        if rng.random() < 0.1:
            out.write('7,un"quoted" here,x\n')
    check(spark, tmp_path, out.getvalue().encode(), ["w", "k", "v"], split)


def test_long_lines_and_cells(spark, tmp_path):
    n = 100_000
    data = (",".join(f"c{i}" for i in range(n)) + "\n" + ",".join(f'"{i},{i}"' for i in range(n)) + "\n" + ",".join(["x"] * (n - 1)) + ',"' + '""' * 300_000 + '"\n').encode()
    got = check(spark, tmp_path, data, ["c0", f"c{n - 1}"])
    assert got[0][f"c{n - 1}"] == "99999,99999" and len(got[1][f"c{n - 1}"]) == 300_000


def test_types_and_unclosed_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,x,s\n 5 ,1.5,a\nx,,b\n")
    rows = readers.scan_csv_rownum(spark, str(tmp_path / "t.csv"), "x double, n int").orderBy("source_row_number").collect()
    assert [(r.n, r.x) for r in rows] == [(5, 1.5), (None, None)]
    (tmp_path / "u.csv").write_text('n,s\n1,"never closed\n' + "more\n" * 30)
    assert readers.scan_csv_rownum(spark, str(tmp_path / "u.csv"), "n int").count() == 1
    with pytest.raises(Exception, match="too many lines"):
        readers.scan_csv_rownum(spark, str(tmp_path / "u.csv"), "n int, s string", max_lines=10).collect()
    (tmp_path / "empty.csv").write_text("")
    assert readers.scan_csv_rownum(spark, str(tmp_path / "empty.csv"), "n int").count() == 0
    (tmp_path / "head.csv").write_text("n,s")
    assert readers.scan_csv_rownum(spark, str(tmp_path / "head.csv"), "n int").count() == 0
