"""What several operators share: the scratch folder all executors see, joins of hot keys, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than 1 / HOT_KEYS of a table's rows are dealt over several tasks; so there are at most HOT_KEYS of them.
HOT_KEYS, LEAST_HOT = 20_000, 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where none is set, as in tests.

    A session that runs tasks on other machines has to name one: they could not see a folder of ours.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: The paths that the tidied functions running in this thread have written, innermost last.
_OPEN = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if paths := getattr(_OPEN, "paths", None):
        paths[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.scratch)


def tidied(f):
    """f with its result written as a table; the other tables that it wrote are removed."""

    @wraps(f)
    def run(*args, **options) -> DataFrame:
        _OPEN.paths = [*getattr(_OPEN, "paths", []), []]
        result = None
        try:
            result = written(f(*args, **options), f.__name__)
        finally:
            *outer, own = _OPEN.paths
            _OPEN.paths = outer
            spark = SparkSession.getActiveSession()
            for path in own:
                if result is None or path != result.scratch:
                    drop_path(spark, path)
        if outer:
            outer[-1].append(result.scratch)
        return result

    return run


def keyed_join(rows: DataFrame, table: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """rows joined with table(key, n, ...), where n is how many rows have the key and total the sum of n.

    A hot key's rows are dealt by a hash of the column spread over so many tasks that none gets more than
    total / HOT_KEYS of them; only the hot keys, of which there cannot be more than HOT_KEYS, are broadcast.
    """
    limit = max(LEAST_HOT, total // HOT_KEYS)
    parts = F.ceil(F.col("n") / limit)
    hot = F.broadcast(table.where(F.col("n") > limit).select(key, parts.alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies, [key, "_part"]).drop("_part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star rounds. A node's neighbours are never gathered: each star is an
    aggregate, which Spark begins before the shuffle, and a join in which a hub's edges are dealt over many tasks.
    Rounds end when there are only stars: every node has one edge, to a smaller one that has none.
    Self loops and nulls are ignored, repeated edges count once, an empty table gives an empty table.
    """

    def put(df: DataFrame) -> tuple[DataFrame, int, int]:
        table = written(df, "stars")
        ends = table.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(table.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        rows, unsettled = ends.agg(F.sum("up"), F.count_if(F.col("up") + F.col("down") > 1)).first()
        return table, rows or 0, unsettled

    apart = edges.where(F.col("a") != F.col("b"))
    e, rows, unsettled = put(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not unsettled:
            break
        up = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = e.union(up).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = keyed_join(up, low.where("n > 0"), "a", "b", rows).select(F.col("b").alias("a"), F.col("m").alias("b"))  # as many as edges
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = keyed_join(large, low, "a", "b", rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = e
        e, rows, unsettled = put(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        dropped(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def lowest(members: DataFrame, value: str) -> DataFrame:
    """node, low for members(node, component, value): the smallest value of each node's component; big components are dealt over many tasks."""
    low = members.groupBy("component").agg(F.min(value).alias("low"), F.count(F.lit(1)).alias("n"))
    total = members.agg(F.count(F.lit(1))).first()[0]
    return keyed_join(members, low, "component", "node", total).select("node", "low")
