"""Documents as a Spark data source: a file for each row that is written, compressed where its name ends in .xz."""

from __future__ import annotations

import lzma
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from panelyard.sources.files import store

NAME = "named_documents"
SCHEMA = "name string, document string"


class DocumentWriter(DataSourceWriter):
    """A task writes each document under a name of its own and then gives it its final one.

    So a file is whole or isn't there, and tasks or jobs that run again write the same files; nothing passes through the driver.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = store(self.path)
        staging, made = posixpath.join(root, "_staging"), set()
        system.create_dir(staging)
        for row in rows:
            mine, at, body = posixpath.join(staging, uuid.uuid4().hex), posixpath.join(root, row.name), row.document.encode()
            with system.open_output_stream(mine, compression=None) as out:
                out.write(lzma.compress(body) if row.name.endswith(".xz") else body)
            if (folder := posixpath.dirname(at)) not in made:
                system.create_dir(folder)
                made.add(folder)
            system.move(mine, at)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = store(self.path)
        system.create_dir(root)
        staging = posixpath.join(root, "_staging")
        if system.get_file_info(staging).type.name == "Directory":
            system.delete_dir(staging)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(spark: SparkSession, documents: DataFrame, path: str) -> None:
    """Writes documents(name, document): a file for each row, under path."""
    spark.dataSource.register(Documents)
    documents.select("name", "document").write.format(NAME).mode("append").option("path", path).save()


def write_xz_snapshots(spark: SparkSession, captures: DataFrame, path: str) -> None:
    """Writes captures(captured_at, part, document) as .../YYYY/MM/DD/HHMM.json.xz, below the folder part if there is one."""
    name = F.concat(F.concat_ws("/", "part", F.date_format("captured_at", "yyyy/MM/dd/HHmm")), F.lit(".json.xz"))
    write_documents(spark, captures.select(name.alias("name"), "document"), path)
