"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import quality
from panelyard.llm.decontamination import benchmark_matches
from panelyard.llm.embedding_join import near_vectors
from panelyard.llm.filter_audit import audited
from panelyard.llm.html_text import extracted
from panelyard.llm.language import held_out, identified, train
from panelyard.llm.merkle import manifest
from panelyard.llm.minhash_join import similar_documents
from panelyard.llm.mixing import mixed_copies
from panelyard.llm.secrets import joined, secret_spans
from panelyard.llm.sharding import sharded
from panelyard.llm.token_counts import count_tokens
from panelyard.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(tokenizer))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"))
    model = train(docs.where(~test))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def as_law(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_law(sharded(table(spark, sf_dir, "documents"), n_shards=40, overhead=16))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    test = quality.held_out(F.col("doc_id"))
    model = quality.train(docs, labels.where(~test))
    return quality.scored(docs.select("doc_id", "text"), model, least=0.7).select("doc_id", test.alias("held_out"), "score", "predicted")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


SQL_1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) n_links, least(e.vec_id, coalesce(m, e.vec_id)) component_id, e.vec_id <= coalesce(m, e.vec_id) kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) m FROM r GROUP BY a) m ON m.a = e.vec_id
"""

SQL_3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL_9 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') h, CAST(strlen(coalesce(html, '')) AS BIGINT) n FROM pages),
f AS (SELECT h, min(page_id) f FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha256(p.h) payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN f <> page_id THEN f END refers_to, url, TRUE AS intact
FROM p LEFT JOIN f USING (h)
"""

SQL_12 = r"""
WITH RECURSIVE marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') w FROM documents),
f AS (SELECT d.doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END) AS mask, coalesce(good, 0) good, coalesce(toxic, 0) toxic FROM d LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, CAST(mask AS INTEGER) mask, count(*) n, sum(good) good, sum(toxic) toxic FROM f GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE length(o) < 5 AND NOT contains(o, l)),
steps AS (SELECT o, CAST(s AS INTEGER) step, o[s] l, CAST(list_sum(list_transform(string_split(o[1 : s], ''), lambda c: 1 << (ascii(c) - 65))) AS INTEGER) b, CAST(1 << (ascii(o[s]) - 65) AS INTEGER) f
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
t AS (SELECT part, o, step, l, sum(CASE WHEN mask & b = 0 THEN n ELSE 0 END) kept, sum(CASE WHEN mask & (b - f) = 0 AND mask & f > 0 THEN n ELSE 0 END) removed,
  sum(CASE WHEN mask & (b - f) > 0 AND mask & f > 0 THEN n ELSE 0 END) redundant, sum(CASE WHEN mask = f THEN n ELSE 0 END) unique_fails,
  sum(CASE WHEN mask & (b - f) = 0 AND mask & f > 0 THEN good ELSE 0 END) good_lost, sum(CASE WHEN mask & (b - f) = 0 AND mask & f > 0 THEN toxic ELSE 0 END) toxic_lost
  FROM cells, steps GROUP BY part, o, step, l)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed, CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails,
  CAST(good_lost AS BIGINT) good_lost, CAST(toxic_lost AS BIGINT) toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) shapley FROM t
"""

SQL_13 = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) t FROM range(256) r(i)),
d AS (SELECT doc_id, source, 'x' || source AS named, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
  strlen(text) || ':' || text AS body, strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda v: CAST(ascii(v) AS BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) % 5 = 0 AS tampered FROM documents, crc),
l AS (SELECT doc_id, coalesce(named, '') s, sha256(head || coalesce(body, '-')) leaf, CASE WHEN tampered THEN sha256(head || coalesce(low, '-')) ELSE sha256(head || coalesce(body, '-')) END AS used FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
tree(k, s, i, h) AS (SELECT 0, s, i, leaf FROM p UNION ALL SELECT any_value(k) + 1, s, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY s) n FROM tree) WHERE n > 1 GROUP BY s, i // 16),
height AS (SELECT s, max(k) top FROM tree GROUP BY s),
sub AS (SELECT s, h subroot, row_number() OVER (ORDER BY s) - 1 AS i FROM tree JOIN height USING (s) WHERE k = top),
upper(k, i, h) AS (SELECT 0, i, subroot FROM sub UNION ALL SELECT any_value(k) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () n FROM upper) WHERE n > 1 GROUP BY i // 16),
runs AS (SELECT k, s, i // 16 AS i, list(h ORDER BY i) r FROM tree JOIN height USING (s) WHERE k < top GROUP BY k, s, i // 16),
upper_runs AS (SELECT k, i // 16 AS i, list(h ORDER BY i) r FROM upper WHERE k < (SELECT max(k) FROM upper) GROUP BY k, i // 16),
fold(doc_id, s, i, k, h, proof, leaf) AS (SELECT doc_id, s, i, 0, used, '', leaf FROM p
  UNION ALL SELECT doc_id, f.s, f.i // 16, f.k + 1, sha256(array_to_string(r[: f.i % 16], '') || h || array_to_string(r[f.i % 16 + 2 :], '')), proof || array_to_string(r[: f.i % 16], '') || array_to_string(r[f.i % 16 + 2 :], ''), leaf
  FROM fold f JOIN runs u ON u.k = f.k AND u.s = f.s AND u.i = f.i // 16),
up(doc_id, s, i, k, h, proof, leaf, subroot) AS (SELECT doc_id, f.s, b.i, 0, h, proof, leaf, subroot FROM fold f JOIN height g ON g.s = f.s AND g.top = f.k JOIN sub b ON b.s = f.s
  UNION ALL SELECT doc_id, s, f.i // 16, f.k + 1, sha256(array_to_string(r[: f.i % 16], '') || h || array_to_string(r[f.i % 16 + 2 :], '')), proof || array_to_string(r[: f.i % 16], '') || array_to_string(r[f.i % 16 + 2 :], ''), leaf, subroot
  FROM up f JOIN upper_runs u ON u.k = f.k AND u.i = f.i // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) proof_sha256, h AS folded_root, h = root AS verified FROM up, (SELECT h AS root FROM upper WHERE k = (SELECT max(k) FROM upper)) WHERE k = (SELECT max(k) FROM upper)
"""


def queries() -> dict:
    return {
        "op1_embedding_neardup": op1_embedding_neardup,
        "op2_html": op2_html,
        "op3_decontamination": op3_decontamination,
        "op4_token_counts": op4_token_counts,
        "op5_language": op5_language,
        "op6_secrets": op6_secrets,
        "op7_mixing": op7_mixing,
        "op8_sharding": op8_sharding,
        "op9_warc": op9_warc,
        "op10_minhash": op10_minhash,
        "op11_quality": op11_quality,
        "op12_filter_audit": op12_filter_audit,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_neardup": SQL_1, "op3_decontamination": SQL_3, "op9_warc": SQL_9, "op12_filter_audit": SQL_12, "op13_merkle": SQL_13}
