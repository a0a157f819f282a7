"""Write-once tables with manifests, published by one rename, and content identities."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.sources.files import file_digests


def canonical_json(columns: Sequence[str]) -> Column:
    """The columns as one JSON object in the order of their names, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def content_addressed_id(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(canonical_json(columns), 256)


def content_digest(columns: Sequence[str]) -> Column:
    """An aggregate: SHA-256 of how many rows there are and of the sum of 60 bits of each row's own digest.

    Rows may come in any order and from any number of files; repeated rows count. Sums are made before the shuffle.
    """
    return json_digest(canonical_json(columns))


def json_digest(rows: Column) -> Column:
    """content_digest() of rows whose canonical JSON is given."""
    own = F.conv(F.substring(F.sha2(rows, 256), 1, 15), 16, 10).cast("bigint")
    total = F.lit(0).cast("decimal(38,0)")
    for shift in (0, 20, 40):  # 20 bits at a time, so that the sums of billions of rows are longs
        part = F.sum(F.shiftright(own, shift).bitwiseAND(F.lit(2**20 - 1)))
        total = total + F.coalesce(part, F.lit(0).cast("bigint")).cast("decimal(20,0)") * F.lit(2**shift).cast("decimal(13,0)")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")), 256)


def content_id_of(payload: Mapping) -> str:
    """The same idea for a small driver-side record: SHA-256 of its sorted JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def manifest_table(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file under path, file beginning with path's last name; files are read in chunks by tasks."""
    name = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    return file_digests(spark, path).select(F.regexp_extract("path", rf"^(?:.*/)?({name}/.*)$", 1).alias("file"), "bytes", "sha256")


def content_hash_verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unlisted or changed: file, problem."""
    both = manifest.select("file", F.col("sha256").alias("_want")).join(found.select("file", F.col("sha256").alias("_got")), "file", "full")
    problem = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_got") != F.col("_want"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def unfinished(spark: SparkSession, path: str) -> list[str]:
    """Stages that earlier runs of a sink left beside path: those of runs that failed, and of any that still goes on."""
    target, system = _store(spark, path)
    parent = target.getParent()
    found = system.listStatus(parent) if system.exists(parent) else []
    return sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith(f".{target.getName()}.stage-"))


def recover(spark: SparkSession, path: str) -> list[str]:
    """Removes what failed runs left and returns their names. Nothing published is touched; no other run may be going on."""
    gone = unfinished(spark, path)
    for stage in gone:
        target, system = _store(spark, stage)
        system.delete(target, True)
    return gone


def sink_immutable_parquet(tables: Mapping[str, DataFrame], path: str, facts: Mapping | None = None, partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Writes tables and their manifest into a stage beside path and publishes them all by one rename; an existing path is refused.

    A run that fails, at whatever point, publishes nothing; its stage is removed, or by recover() where the driver died.
    Renames are atomic on HDFS and local file systems; of two runs that end together the second one fails.
    Returns the manifest's path.
    """
    spark = next(iter(tables.values())).sparkSession
    target, system = _store(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    stage = f"{target.getParent()}/.{target.getName()}.stage-{uuid.uuid4().hex}"
    try:
        manifest = None
        for name, df in tables.items():
            df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{stage}/{name}")
            rows = spark.read.parquet(f"{stage}/{name}").count()
            own = manifest_table(spark, f"{stage}/{name}").withColumns({"table": F.lit(name), "table_rows": F.lit(rows).cast("bigint"), "facts": F.lit(json.dumps(facts or {}, sort_keys=True, default=str))})
            manifest = own if manifest is None else manifest.unionByName(own)
        manifest.write.mode("errorifexists").json(f"{stage}/_manifest")
        jvm = spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(jvm.org.apache.hadoop.fs.Path(stage), target, none)
        except Exception as e:
            raise FileExistsError(path) if system.exists(target) else e
    except BaseException:
        staged, system = _store(spark, stage)
        system.delete(staged, True)
        raise
    return f"{path}/_manifest"


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that sink_immutable_parquet() finished; one without a manifest is refused."""
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/_SUCCESS")
    if not manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        raise FileNotFoundError(f"{path} has no manifest")
    return spark.read.parquet(f"{path}/{name}")
