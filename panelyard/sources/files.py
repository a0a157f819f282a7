"""Files that Spark has no format for, opened in tasks by their address: local and shared folders, HDFS and object stores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it. Addresses without a scheme are local paths."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def reachable(path: str) -> bool:
    """Whether tasks can open path by themselves; else only Spark's readers can."""
    try:
        store(path)
    except (OSError, ValueError):
        return False
    return True


def streamed_digest(source: BinaryIO) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read chunk by chunk."""
    h, n = hashlib.sha256(), 0
    while chunk := source.read(CHUNK):
        h.update(chunk)
        n += len(chunk)
    return n, h.hexdigest()


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            system, at = store(path)
            with system.open_input_stream(at) as source:
                out.append((path, *streamed_digest(source)))
        yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file under path; a task reads a file in chunks, whatever its size.

    Where tasks cannot open the store by themselves, Spark reads each file as one value, which has to be under 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if reachable(path):
        return files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(_digests, "path string, bytes bigint, sha256 string")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
