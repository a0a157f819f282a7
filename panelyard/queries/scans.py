"""Sources and sinks: what Spark writes from the driver's tables, read back by the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.queries.base import query, scratch, t
from panelyard.sources import captures, files, readers, sinks

#: The most rows of a document that is written to be read back.
DOCUMENT_ROWS = 20_000
FOLDERS = 64


def _documents(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """df with doc, the name of a document of its key: at most DOCUMENT_ROWS rows have the same key and doc.

    A key of more rows is dealt to half full buckets by row_id, and the rows of a bucket are numbered, so that equal
    ids can't fill a document either.
    """
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    buckets = F.when(F.col("_n") <= DOCUMENT_ROWS, 1).otherwise(F.ceil(2 * F.col("_n") / DOCUMENT_ROWS))
    dealt = df.join(n, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_bucket", F.pmod(F.xxhash64(row_id), buckets))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(row_id)) - 1
    return dealt.withColumn("doc", F.concat_ws("-", "_bucket", F.floor(place / DOCUMENT_ROWS))).drop("_key", "_n", "_bucket")


def _name(key: str) -> Column:
    """The file of a key's document doc: FOLDERS folders, however many keys there are."""
    return F.concat(F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("string"), F.lit("/"), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit("."), "doc", F.lit(".json"))


@query("SELECT c_custkey id, c_name AS name, c_nationkey team, n_name team_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def scan_json_entities(s, d):
    """Documents of a nation's customers, each with its own lookup array."""
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    docs = _documents(c, "n_nationkey", "c_custkey").groupBy("n_nationkey", "n_name", "doc").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team"))).alias("elements"))
    docs = docs.select("n_nationkey", "doc", F.to_json(F.struct("elements", F.array(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("teams"))).alias("document"))
    path = scratch(s, "entities")
    captures.write_documents(s, docs.select(_name("n_nationkey").alias("name"), "document"), path)
    schema = "elements array<struct<id: bigint, name: string, team: int>>, teams array<struct<id: int, name: string>>"
    return readers.scan_json_entities(s, path, schema, "elements", [("teams", "id", "team", {"name": "team_name"})])


@query("SELECT o_orderkey id, o_custkey customer, c_name AS customer_name, o_totalprice total FROM orders LEFT JOIN customer ON c_custkey = o_custkey", "total")
def scan_json_fixtures(s, d):
    path = scratch(s, "fixtures")
    t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total")).write.json(path)
    lookup = (t(s, d, "customer"), "c_custkey", "customer", {"c_name": "customer_name"})
    return readers.scan_json_fixtures(s, path, "id bigint, customer bigint, total double", [lookup], lines=True).select("id", "customer", "customer_name", "total")


@query("SELECT user_id file_id, event_id, value, TRUE AS file_id_matches FROM events", "value")
def scan_json_histories(s, d):
    """Files of a user's history rows, named by the user, in a fixed number of folders."""
    path = scratch(s, "histories")
    e = _documents(t(s, d, "events"), "user_id", "event_id").groupBy("user_id", "doc").agg(F.collect_list(F.struct(F.col("user_id").alias("element"), "event_id", "value")).alias("history"))
    captures.write_documents(s, e.select(_name("user_id").alias("name"), F.to_json(F.struct("history")).alias("document")), path)
    schema = "history array<struct<element: bigint, event_id: bigint, value: double>>"
    return readers.scan_json_histories(s, path, schema, file_id=r"/([0-9]+)\.[^/]*$").select("file_id", "event_id", "value", "file_id_matches")


#: So many ids in a row stand in one file.
CSV_IDS = 5000


@query(f"""SELECT c_custkey, c_acctbal, ' ' || c_name || ', "' || c_mktsegment || '"' || chr(10) || 'x' note, row_number() OVER (PARTITION BY c_custkey // {CSV_IDS} ORDER BY c_custkey) source_row_number FROM customer""", "c_acctbal")
def scan_csv_rownum(s, d):
    """Files in the order of their ids, with commas, quotes and line breaks in a cell; a row is numbered in its file."""
    path = scratch(s, "csv")
    note = F.concat(F.lit(" "), "c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx'))
    rows = t(s, d, "customer").select("c_acctbal", note.alias("note"), "c_custkey", F.floor(F.col("c_custkey") / CSV_IDS).alias("part"))
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").write.partitionBy("part").options(**keep).csv(path)
    found = readers.scan_csv_rownum(s, path, "c_custkey bigint, note string, c_acctbal double")
    return found.select("c_custkey", "c_acctbal", "note", "source_row_number")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_quantity > 40", "l_quantity")
def scan_parquet_pruned(s, d):
    where = (F.col("l_shipdate") >= F.expr("timestamp_ntz'2001-01-01 00:00:00'")) & (F.col("l_quantity") > 40)
    return readers.scan_parquet_pruned(s, [f"{d}/lineitem.parquet"], where, ["l_orderkey", "l_quantity"])


STAMP = "strftime(o_orderdate, '%Y%m%d') || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"


def _snapshots(s, d):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return t(s, d, "orders").select("o_custkey", stamp.alias("stamp"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("t1"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("t2"), (F.col("o_orderstatus") != "P").alias("complete"))


@query(f"SELECT o_custkey, arg_max(o_orderkey, {STAMP}) path, max({STAMP}) stamp FROM orders GROUP BY 1")
def latest_snapshot(s, d):
    return readers.latest_snapshot(_snapshots(s, d).select("o_custkey", "stamp", "path"), ["o_custkey"], "stamp", "path")


@query(f"SELECT o_custkey, TIMESTAMP '1999-01-01' + to_days(CAST(o_custkey % 300 AS INTEGER)) deadline, arg_max(o_orderkey, {STAMP}) path, max({STAMP}) stamp FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate + INTERVAL 1 DAY < TIMESTAMP '1999-01-01' + to_days(CAST(o_custkey % 300 AS INTEGER)) GROUP BY 1, 2")
def asof_safe_snapshot(s, d):
    snaps = _snapshots(s, d)
    want = snaps.select("o_custkey").distinct().withColumn("deadline", F.expr("timestamp_ntz'1999-01-01 00:00:00' + make_dt_interval(cast(o_custkey % 300 as int))"))
    found = readers.asof_safe_snapshot(snaps, want, ["o_custkey"], "stamp", ["t1", "t2"], "deadline", ["complete"])
    return found.select("o_custkey", "deadline", "path", "stamp")


@query("SELECT date_trunc('hour', ts) captured_at, event_id, value FROM events", "value")
def scan_xz_snapshots(s, d):
    """An hour's events as captures of bounded size, written by the tasks and read back."""
    path = scratch(s, "captures")
    e = t(s, d, "events").select("event_id", "value", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("captured_at"))
    docs = _documents(e, "captured_at", "event_id").groupBy("captured_at", "doc").agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "value")).alias("elements"))).alias("document"))
    captures.write_xz_snapshots(s, docs.select("captured_at", F.col("doc").alias("part"), "document"), path)
    found = readers.scan_xz_snapshots(s, path, "event_id bigint, value double")
    return found.select(F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "event_id", "value")


def _published(s, d) -> str:
    """Suppliers, a file for each nation, and orders, published together."""
    path = scratch(s, "published")
    sinks.sink_immutable_parquet({"supplier": t(s, d, "supplier").repartition("s_nationkey"), "orders": t(s, d, "orders")}, path, {"source": "driver tables"}, {"supplier": ["s_nationkey"]})
    return path


@query("SELECT 'supplier' AS \"table\", s_suppkey id, s_acctbal AS v, s_nationkey nation FROM supplier UNION ALL SELECT 'orders', o_orderkey, o_totalprice, NULL FROM orders", "v")
def sink_immutable_parquet(s, d):
    path = _published(s, d)
    a = sinks.read_published(s, path, "supplier").select(F.lit("supplier").alias("table"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").cast("int").alias("nation"))
    b = sinks.read_published(s, path, "orders").select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(None).cast("int").alias("nation"))
    return a.unionByName(b)


@query("SELECT s_nationkey nation, CASE s_nationkey % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' ELSE 'unlisted' END problem, count(DISTINCT s_nationkey) files FROM supplier WHERE s_nationkey % 5 IN (1, 2, 3) GROUP BY 1, 2")
def content_hash_verify(s, d):
    """Published files of which some nations' are then changed, removed or joined by one more."""
    path = _published(s, d)
    listed = s.read.json(f"{path}/_manifest")
    nation = F.regexp_extract("file", r"s_nationkey=(\d+)", 1).cast("int")
    for row in listed.where("table = 'supplier'").select("file", nation.alias("nation")).collect():  # a row per nation
        system, at = files.store(f"{path}/{row.file}")
        if row.nation % 5 == 1:
            with system.open_input_stream(at) as f:
                body = f.read()
            with system.open_output_stream(at) as f:
                f.write(body[:-1] + b"?")
        elif row.nation % 5 == 2:
            system.delete_file(at)
        elif row.nation % 5 == 3:
            system.copy_file(at, f"{at}.copy.parquet")
    found = sinks.manifest_table(s, f"{path}/orders").unionByName(sinks.manifest_table(s, f"{path}/supplier"))
    return sinks.content_hash_verify(found, listed).groupBy(nation.alias("nation"), "problem").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') id FROM customer""")
def content_addressed_id(s, d):
    return t(s, d, "customer").select("c_custkey", sinks.content_addressed_id(["c_name", "c_custkey", "c_mktsegment"]).alias("id"))


@query("SELECT s_nationkey nation, CAST(sum(strlen(s_name) + 1) AS BIGINT) bytes, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) sha256 FROM supplier GROUP BY 1")
def manifest_table(s, d):
    """Sizes and digests of text files, one for each nation, whose content SQL can tell."""
    path = scratch(s, "texts")
    rows = t(s, d, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_name", F.col("s_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    found = sinks.manifest_table(s, path)
    return found.select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("int").alias("nation"), "bytes", "sha256")
