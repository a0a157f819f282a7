"""Typed scans of snapshots: JSON, CSV with row numbers, compressed captures, pruned Parquet, and snapshot choice."""

from __future__ import annotations

import csv
import io
import json
import lzma
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_json_entities(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, array: str, lookups: Sequence[tuple[str, str, str, dict[str, str]]] = ()) -> DataFrame:
    """Rows of a document's array, with names from its own lookup arrays.

    lookups: (array, id field of it, id column of the rows, {its field: new name}).
    """
    doc = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    doc = doc.withColumn("_file", F.col("_metadata.file_path"))
    rows = doc.select("_file", F.explode(array).alias("_r")).select("_file", "_r.*")
    for name, their_id, own_id, fields in lookups:
        dim = doc.select("_file", F.explode(name).alias("_d")).select("_file", F.col(f"_d.{their_id}").alias(own_id), *[F.col(f"_d.{f}").alias(n) for f, n in fields.items()])
        rows = rows.join(dim, ["_file", own_id], "left")
    return rows.drop("_file")


def scan_json_fixtures(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, lookups: Sequence[tuple[DataFrame, str, str, dict[str, str]]] = (), lines: bool = False) -> DataFrame:
    """Rows of a top-level array, or of one object per line. lookups: (table, its id, id column of the rows, {its column: new name})."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    for dim, their_id, own_id, fields in lookups:
        rows = rows.join(dim.select(F.col(their_id).alias(own_id), *[F.col(f).alias(n) for f, n in fields.items()]), own_id, "left")
    return rows


def scan_json_histories(spark: SparkSession, path: str, schema: StructType | str, array: str = "history", id_field: str = "element", file_id: str = r"([0-9]+)\.json$") -> DataFrame:
    """Rows of per-entity files <id>.json with the id of the file name; file_id_matches says that a row's own id agrees.

    file_id finds the id in a file's path, for other layouts than <id>.json.
    """
    doc = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    own = F.regexp_extract("_metadata.file_path", file_id, 1).try_cast("bigint")
    rows = doc.select(own.alias("file_id"), F.explode(array).alias("_r")).select("file_id", "_r.*")
    return rows.withColumn("file_id_matches", F.col("file_id").eqNullSafe(F.col(id_field)))


def quote_ends(line: str) -> tuple[bool, bool]:
    """Whether a line ends inside a quoted cell, if it begins outside one and if it begins inside one. One walk each, quote by quote."""

    def walk(inside: bool) -> bool:
        i, opening = 0, not inside
        while True:
            if inside:
                at = line.find('"', i)
                if at < 0:
                    return True
                if line.startswith('"', at + 1):  # two quotes in a quoted cell are one of its characters
                    i = at + 2
                    continue
                inside, i = False, at + 1
            elif opening and line.startswith('"', i):
                inside, i = True, i + 1
                continue
            at = line.find(",", i)
            if at < 0:
                return False
            i, opening = at + 1, True

    return (walk(False), walk(True)) if '"' in line else (False, True)


def _quote_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with effect: 0 leaves the state as it is, 1 turns it over, 2 ends outside, 3 ends inside, whatever it was."""
    effect = {(False, True): 0, (True, False): 1, (False, False): 2, (True, True): 3}
    for batch in batches:
        found = [effect[quote_ends(x.as_py() or "")] for x in batch.column("line")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "effect"])


def _csv_cells(wanted: Sequence[str]):
    """rows with cells, the wanted columns' texts found by the names in _header; empty cells are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        header, at = None, []
        for batch in batches:
            out = []
            for head, record in zip(batch.column("_header"), batch.column("raw_record"), strict=True):
                if head.as_py() != header:
                    header = head.as_py()
                    names = next(csv.reader(io.StringIO(header, newline="")), [])
                    at = [names.index(w) if w in names else -1 for w in wanted]
                cells = next(csv.reader(io.StringIO(record.as_py(), newline="")), [])
                out.append([cells[i] or None if 0 <= i < len(cells) else None for i in at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in CSV_COLUMNS], pa.array(out, pa.list_(pa.string()))], names=[*CSV_COLUMNS, "cells"])

    return run


CSV_COLUMNS = ("source_path", "source_row_number", "raw_record")


def csv_records(spark: SparkSession, path: str, max_lines: int = 100_000) -> DataFrame:
    """source_path, record (0 is the header) and raw_record of CSV files whose quoted cells may hold commas, quotes and line breaks.

    A line is a function of whether a quoted cell is open before it: it keeps that, turns it over or settles it. These
    functions are composed along a range of the file, and the ranges of a file then among themselves, so that no file is
    read in one task. Blank lines between records aren't records. A record of more than max_lines lines, such as after a
    quote that is never closed, is an error, as is one that does not fit a cell.
    """
    mark = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), mark.alias("line"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    known = lines.mapInArrow(_quote_effects, kinds + ", effect int")
    here = Window.partitionBy("source_path", "_block").orderBy("_at")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    # Before a line: the last settled state, if any, and how often it was turned over since.
    turns = known.withColumn("_turns", F.sum((F.col("effect") == 1).cast("bigint")).over(here))
    settled = F.when(F.col("effect") >= 2, F.struct((F.col("effect") == 3).alias("inside"), F.col("_turns").alias("turns")))
    local = turns.withColumns({"_n": F.row_number().over(here), "_set": F.last(settled, True).over(past), "_before": F.coalesce(F.lag("_turns").over(here), F.lit(0))})
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    # What a range does as a whole: its last settled state, and its turns since or, if none is settled, all of them.
    whole = turns.groupBy("source_path", "_block").agg(F.max_by(settled, F.when(F.col("effect") >= 2, F.col("_at"))).alias("s"), F.max("_turns").alias("t"))
    whole = whole.select("source_path", "_block", F.col("s.inside").alias("to"), odd(F.col("t") - F.coalesce("s.turns", F.lit(0))).cast("bigint").alias("turned"))
    blocks = Window.partitionBy("source_path").orderBy("_block")  # a row per range of a file
    whole = whole.withColumn("_all", F.sum("turned").over(blocks))
    fixed = F.when(F.col("to").isNotNull(), F.struct((F.col("to") != (F.col("turned") == 1)).alias("inside"), F.col("_all").alias("turns")))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    begun = whole.withColumns({"_f": F.last(fixed, True).over(before), "_t": F.coalesce(F.lag("_all").over(blocks), F.lit(0))})
    begun = begun.select("source_path", "_block", (F.coalesce("_f.inside", F.lit(False)) != odd(F.col("_t") - F.coalesce("_f.turns", F.lit(0)))).alias("_open"))
    state = local.join(begun, ["source_path", "_block"])
    inside = F.when(F.col("_set").isNotNull(), F.col("_set.inside") != odd(F.col("_before") - F.col("_set.turns"))).otherwise(F.col("_open") != odd(F.col("_before")))
    state = state.withColumn("_inside", inside)
    state = state.where(F.col("_inside") | (F.regexp_replace("line", "\r$", "") != ""))
    first = (~F.col("_inside")).cast("bigint")
    to_here = here.rowsBetween(Window.unboundedPreceding, 0)
    numbered = state.withColumns({"_own": F.sum(first).over(to_here), "_lines": F.col("_n") - F.coalesce(F.max(F.when(~F.col("_inside"), F.col("_n"))).over(to_here), F.lit(0))})
    counts = numbered.groupBy("source_path", "_block").agg(F.max("_own").alias("_size"))
    counts = counts.select("source_path", "_block", (F.sum("_size").over(blocks) - F.col("_size")).alias("_earlier"))
    numbered = numbered.join(counts, ["source_path", "_block"]).withColumn("record", F.col("_own") + F.col("_earlier") - 1)
    fits = F.when(F.col("_lines") > max_lines, F.raise_error(F.concat(F.lit("a record of too many lines in "), F.col("source_path"))).cast("string")).otherwise(F.col("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_n", fits.alias("line")))), lambda x: x["line"]), "\n")
    return numbered.groupBy("source_path", "record").agg(F.regexp_replace(text, "\r$", "").alias("raw_record"))


def scan_csv_rownum(spark: SparkSession, path: str, schema: StructType | str, max_lines: int = 100_000) -> DataFrame:
    """CSV rows under a header with source_path, source_row_number (1 is the first data row) and raw_record.

    A row's number is its record's place in the file; a byte order mark is dropped. Columns are found by the header's
    names, whatever their order and number; a column that the header lacks is null, as are empty cells. Cells keep their
    spaces; cells that aren't of a column's type are null. Records are those of csv_records().
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = csv_records(spark, path, max_lines)
    header = records.where("record = 0").select("source_path", F.col("raw_record").alias("_header"))
    rows = records.where("record > 0").withColumnRenamed("record", "source_row_number").join(header, "source_path").select(*CSV_COLUMNS, "_header")
    kinds = "source_path string, source_row_number bigint, raw_record string, cells array<string>"
    cells = rows.mapInArrow(_csv_cells([f.name for f in fields]), kinds)
    return cells.select(*CSV_COLUMNS, *[F.get("cells", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def scan_xz_snapshots(spark: SparkSession, path: str, schema: StructType | str, array: str = "elements") -> DataFrame:
    """Rows of xz-compressed JSON captures with captured_at, the instant in the path .../YYYY/MM/DD/HHMM.json.xz.

    One file is one capture of bounded size; the decoding is the one step that Spark has no function for.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in fields]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xz").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = json.loads(lzma.decompress(content))
                rows = rows[array] if isinstance(rows, dict) else rows
                yield pd.DataFrame([{"path": file, "row": json.dumps({n: r.get(n) for n in names})} for r in rows], columns=["path", "row"])

    rows = files.mapInPandas(decode, "path string, row string")
    parts = F.regexp_extract("path", r"(\d{4}/\d{2}/\d{2}/\d{4})\.json\.xz$", 1)
    return rows.select(F.to_timestamp(parts, "yyyy/MM/dd/HHmm").alias("captured_at"), F.from_json("row", fields).alias("_r")).select("captured_at", "_r.*")


def scan_parquet_pruned(spark: SparkSession, paths: Sequence[str], where: Column, columns: Sequence[str]) -> DataFrame:
    """The named columns of the rows that match; the filter and the columns reach the scan."""
    return spark.read.parquet(*paths).where(where).select(*columns)


def latest_snapshot(snapshots: DataFrame, by: Sequence[str], stamp: str, path: str) -> DataFrame:
    """The path with the greatest stamp in each group; stamps sort as text."""
    return snapshots.groupBy(*by).agg(F.max_by(path, stamp).alias(path), F.max(stamp).alias(stamp))


def asof_safe_snapshot(snapshots: DataFrame, targets: DataFrame, by: Sequence[str], stamp: str, instants: Sequence[str], deadline: str, complete: Sequence[str] = ()) -> DataFrame:
    """Each target's newest snapshot of which every instant lies before the deadline and every manifest is complete."""
    ready = F.lit(True)
    for c in complete:
        ready = ready & F.coalesce(F.col(c), F.lit(False))
    usable = snapshots.where(ready).withColumn("_latest", F.greatest(*instants)) if len(instants) > 1 else snapshots.where(ready).withColumn("_latest", F.col(instants[0]))
    known = F.lit(True)
    for c in instants:
        known = known & F.col(c).isNotNull()
    joined = targets.join(usable.where(known), list(by)).where(F.col("_latest") < F.col(deadline)).drop("_latest")
    rest = [c for c in joined.columns if c not in targets.columns and c != stamp]
    return joined.groupBy(*targets.columns).agg(F.max_by(F.struct(stamp, *rest), stamp).alias("_s")).select(*targets.columns, "_s.*")
