"""Queries over the stored projections: graph generations and admission, embeddings, chunk digests, the fused trace."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import digests, embedding, evidence, fusion, graph, rewrite
from loreweave.plans.knowledge_queries import _EDGES_SQL, _graph_edges
from loreweave.plans.search_queries import _CHANNELS, _channels, table, titled
from loreweave.plans.serving_queries import _chunks
from loreweave.sources.snapshots import Change
from loreweave.sources.tables import scratch_folder, stored


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/loreweave-{label}-{uuid.uuid4().hex}"


def graph_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of a graph, each read by its number after all are written: without the finished orders, with
    those upserted, and without what open orders no longer hold."""
    orders = table(spark, sf_dir, "orders")
    without = lambda status: orders.join(orders.where(F.col("o_orderstatus") == status).select("o_custkey", "o_orderkey").distinct(), ["o_custkey", "o_orderkey"], "left_anti")
    late = graph.edges(1, "CONTAINS", orders.where("o_orderstatus = 'F'"), ("SOURCE_DOCUMENT", "o_custkey"), ("SOURCE_CHUNK", "o_orderkey"))
    kept = graph.store(spark, _folder(spark, "graph"))
    vertices = _graph_edges(spark, sf_dir).select(F.col("source_id").alias("entity_id")).distinct()
    kept.commit({"vertices": Change(vertices), "adjacency": Change(_graph_edges(spark, sf_dir, without("F")))})
    kept.commit({"adjacency": Change(late)})
    kept.retain({"adjacency": _graph_edges(spark, sf_dir, without("O"))})
    out = None
    for generation in (1, 2, 3):
        rows = kept.read(kept.snapshot(generation), "adjacency").groupBy("source_id", "relation_type").agg(F.count("*").alias("targets"), F.min("target_id").alias("first_target"), F.max("relation_id").alias("last_relation"))
        rows = rows.select(F.lit(generation).alias("generation"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_STATUS = f"""WITH e AS ({_EDGES_SQL}), l AS (SELECT relation_id, o_orderstatus AS st FROM ({_EDGES_SQL.split(" UNION ALL ")[2].replace("SELECT DISTINCT", "SELECT DISTINCT o_orderstatus,").replace(" AS relation_id,", " AS relation_id, o_orderstatus,", 1)})),
g AS (SELECT 1 AS generation, e.* FROM e WHERE relation_id NOT IN (SELECT relation_id FROM l WHERE st = 'F') UNION ALL SELECT 2, e.* FROM e
 UNION ALL SELECT 3, e.* FROM e WHERE relation_id NOT IN (SELECT relation_id FROM l WHERE st = 'O'))
SELECT generation, source_id, relation_type, count(*) AS targets, min(target_id) AS first_target, max(relation_id) AS last_relation FROM g GROUP BY ALL"""


_VERSION = "graph-identity-v1"


def graph_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks, customers as documents, parts as pages and nations as tags, reached over paths of two relations;
    provenance, relations and canonical rows are damaged in places."""
    orders, customers, parts, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "part", "nation"))
    i = F.col("n")

    def entities(rows: DataFrame, kind: str, key: str, authority_id) -> DataFrame:
        wire = kind.lower()
        rows = rows.select(F.col(key).cast("long").alias("n"), authority_id.alias("authority_id"))
        return rows.select(
            F.concat(F.lit(f"{kind}-"), i.cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.when(i % 41 == 0, "other").otherwise(F.concat(F.lit(f"{wire}:"), "authority_id")).alias("key"),
            F.when(i % 43 == 0, 2).otherwise(1).alias("workspace_id"), F.when(i % 37 == 0, "graph-identity-v0").otherwise(_VERSION).alias("projection_version"), F.when(i % 31 == 0, "TAG").otherwise(kind).alias("authority_kind"),
            "authority_id", (i % 29 != 0).alias("eligible"), F.when(i % 23 != 0, F.concat(F.lit("h"), i.cast("string"))).alias("content_hash"), F.lit(1).alias("revision"), "n",
        )

    document_of = F.concat(F.lit("document:"), F.col("o_custkey").cast("string"), F.lit(":chunk:"), F.col("o_orderkey").cast("string"))
    vertices = entities(orders, "SOURCE_CHUNK", "o_orderkey", F.when(F.col("o_orderkey") % 19 == 0, "chunk").otherwise(document_of))
    vertices = vertices.unionByName(entities(customers, "SOURCE_DOCUMENT", "c_custkey", F.concat(F.lit("document:"), F.col("c_custkey").cast("string"))))
    vertices = vertices.unionByName(entities(parts, "WIKI_PAGE", "p_partkey", F.concat(F.lit("k"), (F.col("p_partkey") - F.col("p_partkey") % 10).cast("string"))))
    vertices = vertices.unionByName(entities(nations, "TAG", "n_nationkey", F.col("n_name")))
    relations = spark.range(200).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("relation_id"), F.when(F.col("id") % 17 == 3, "MENTIONS").otherwise("LINKS_TO").alias("relation_type"),
        F.when(F.col("id") % 19 == 4, 2).otherwise(1).alias("workspace_id"), F.when(F.col("id") % 13 == 5, "graph-identity-v0").otherwise(_VERSION).alias("projection_version"),
    )
    path = F.array(*[F.concat(F.lit("r"), (i * m % 210).cast("string")) for m in (1, 7)])
    candidates = vertices.select(F.lit("seed").alias("seed_id"), "entity_id", (i % 2 + 1).cast("int").alias("depth"), path.alias("path"))
    own_documents = customers.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 7 != 0).alias("eligible"), F.concat(F.lit("h"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(F.col("c_custkey")).cast("string")).alias("sha256"))
    chunks = orders.where("o_orderkey % 13 <> 0").select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_no"), (F.col("o_orderkey") % 17 != 0).alias("eligible"),
        F.concat(F.lit("h"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey")).cast("string")).alias("content_hash"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("content"),
    )
    pages = parts.where("p_partkey % 10 = 0 and p_partkey % 70 <> 0").select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("knowledge_id"), F.when(F.col("p_partkey") % 30 == 0, 2).otherwise(1).alias("revision"), F.concat(F.lit("h"), (F.col("p_partkey") + F.col("p_partkey") % 20 / 10).cast("long").cast("string")).alias("content_hash"), F.col("p_name").alias("body")
    )
    out = graph.admission(candidates, vertices.drop("n"), relations, pages, own_documents, chunks, 1, _VERSION)
    return out.select("entity_id", "depth", "kind", "stable_id", "score", "rejection")


def _step_sql(m: int) -> str:
    r = f"(n * {m} % 210)"
    return f"CASE WHEN {r} >= 200 OR {r} % 17 = 3 THEN 'DISALLOWED_RELATION' WHEN {r} % 13 = 5 OR {r} % 19 = 4 THEN 'STALE_PROVENANCE' END"


_ADMISSION = f"""WITH v AS (
 SELECT 'SOURCE_CHUNK' AS t, o_orderkey AS n, o_custkey AS d, CASE WHEN o_orderkey % 19 = 0 THEN 'chunk' ELSE 'x' END AS a, o_orderpriority AS body FROM orders
 UNION ALL SELECT 'SOURCE_DOCUMENT', c_custkey, c_custkey, 'x', '' FROM customer UNION ALL SELECT 'WIKI_PAGE', p_partkey, p_partkey - p_partkey % 10, 'x', '' FROM part UNION ALL SELECT 'TAG', n_nationkey, 0, 'x', '' FROM nation),
doc AS (SELECT *, CASE WHEN n % 31 = 0 OR a = 'chunk' OR n % 23 = 0 THEN 'MALFORMED_PROVENANCE' WHEN d % 11 = 0 OR d NOT IN (SELECT c_custkey FROM customer) THEN 'AUTHORITY_MISSING' WHEN d % 7 = 0 THEN 'AUTHORITY_INELIGIBLE' END AS dr FROM v),
r AS (SELECT *, CASE WHEN n % 43 = 0 THEN 'WORKSPACE_MISMATCH' WHEN n % 29 = 0 THEN 'AUTHORITY_INELIGIBLE' WHEN n % 37 = 0 THEN 'STALE_PROVENANCE' WHEN {_step_sql(1)} IS NOT NULL THEN {_step_sql(1)} WHEN {_step_sql(7)} IS NOT NULL THEN {_step_sql(7)}
  WHEN t <> 'TAG' AND (n % 41 = 0 OR n % 31 = 0) THEN 'MALFORMED_PROVENANCE'
  WHEN t = 'TAG' THEN 'NON_EVIDENCE_ENTITY'
  WHEN t = 'WIKI_PAGE' THEN CASE WHEN n % 23 = 0 THEN 'MALFORMED_PROVENANCE' WHEN d = 0 OR d % 70 = 0 THEN 'AUTHORITY_MISSING' WHEN d % 30 = 0 OR n <> d + (d % 20) // 10 THEN 'AUTHORITY_STALE' END
  WHEN t = 'SOURCE_CHUNK' THEN CASE WHEN dr IS NOT NULL THEN dr WHEN n % 13 = 0 THEN 'AUTHORITY_MISSING' WHEN n % 17 = 0 THEN 'AUTHORITY_INELIGIBLE' WHEN n % 3 = 0 THEN 'AUTHORITY_STALE' WHEN n % 5 = 0 THEN 'AUTHORITY_INELIGIBLE' END
  ELSE CASE WHEN dr IS NOT NULL THEN dr WHEN d % 5 = 0 THEN 'AUTHORITY_STALE' ELSE 'NON_CITATION_AUTHORITY' END END AS rejection FROM doc)
SELECT t || '-' || n AS entity_id, CAST(n % 2 + 1 AS INTEGER) AS depth, CASE t WHEN 'WIKI_PAGE' THEN 'WIKI' WHEN 'SOURCE_CHUNK' THEN t END AS kind,
 CASE WHEN rejection IS NULL THEN CASE WHEN t = 'WIKI_PAGE' THEN 'k' || d ELSE CAST(n AS VARCHAR) END END AS stable_id, 1.0::DOUBLE / (n % 2 + 1) AS score, rejection FROM r"""


def graph_fused_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as graph vertices that stand for the pages of their nations: of those of one page the first counts."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("k"), F.col("s_nationkey").cast("string")).alias("page"))
    vertices = rows.select(
        F.col("n").cast("string").alias("entity_id"), F.lit("WIKI_PAGE").alias("entity_type"), F.concat(F.lit("wiki_page:"), "page").alias("key"), F.lit(1).alias("workspace_id"), F.lit(_VERSION).alias("projection_version"),
        F.lit("WIKI_PAGE").alias("authority_kind"), F.col("page").alias("authority_id"), F.lit(True).alias("eligible"), F.lit("h").alias("content_hash"), F.lit(1).alias("revision"),
    )
    candidates = rows.select(F.lit("seed").alias("seed_id"), F.col("n").cast("string").alias("entity_id"), (F.col("n") % 3 + 1).cast("int").alias("depth"), F.array(F.lit("r")).alias("path"))
    relations = spark.createDataFrame([("r", "LINKS_TO", 1, _VERSION)], "relation_id string, relation_type string, workspace_id int, projection_version string")
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("knowledge_id"), F.lit(1).alias("revision"), F.lit("h").alias("content_hash"), F.col("n_name").alias("body"))
    nothing = spark.createDataFrame([], "document_id long, eligible boolean, sha256 string"), spark.createDataFrame([], "chunk_id long, document_id long, chunk_no long, eligible boolean, content_hash string, content string")
    return graph.admission(candidates, vertices, relations, pages, *nothing, 1, _VERSION).select("entity_id", "stable_id", "rejection")


CONTRACT = embedding.Contract("local", "letters-v2", 3, "projection-v1")


def _letters(texts: Sequence[str]) -> list[list[float]]:
    """An embedder for tests: lengths and counts; a text that begins with a q is refused."""
    if any(t[:1] in ("q", "Q") for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


def embedding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of eligible texts against a projection in which some are missing, stale, of another model, failed, orphaned
    or written by a later generation; the plan, and the projection after its write."""
    i = F.col("doc_id")
    documents = table(spark, sf_dir, "documents").where("n_chars % 7 <> 0")
    authority = documents.select(F.lit("SOURCE_CHUNK").alias("kind"), i.cast("string").alias("stable_id"), X.sha256("text").alias("content_hash"), F.col("text").alias("content"))
    old = documents.where("doc_id % 5 <> 0").select(i.alias("doc_id"), X.sha256("text").alias("h"))
    old = old.unionByName(documents.where("doc_id % 13 = 0").select((i + 10**9).alias("doc_id"), F.lit("gone").alias("h")))
    stored = old.select(
        F.lit("SOURCE_CHUNK").alias("kind"), i.cast("string").alias("stable_id"), F.when(i % 7 == 0, "old").otherwise(F.col("h")).alias("content_hash"), F.lit("local").alias("provider"), F.when(i % 11 == 0, "letters-v1").otherwise("letters-v2").alias("model"),
        F.lit(3).alias("dimension"), F.lit("projection-v1").alias("projection_version"), F.when(i % 17 == 0, 9).otherwise(1).cast("long").alias("generation"), F.when(i % 19 == 0, "FAILED").otherwise("FRESH").alias("status"),
        F.lit(None).cast("string").alias("failure"), F.array(F.lit(0.0)).alias("embedding"),
    )
    kept = embedding.store(spark, _folder(spark, "embeddings"))
    kept.commit({"projections": Change(stored)})
    plan, _ = embedding.refresh(kept, lambda: authority, _letters, CONTRACT, 2)
    now = kept.read(kept.snapshot(), "projections").select("kind", "stable_id", F.col("content_hash").alias("projection_hash"), "model", "generation", "status", "failure", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))
    return plan.join(now, ["kind", "stable_id"], "left").drop("kind", "content_hash")


_EMBEDDING = """WITH a AS (SELECT doc_id AS i, text, sha256(text) AS h FROM documents WHERE n_chars % 7 <> 0),
s AS (SELECT i, CASE WHEN i % 7 = 0 THEN 'old' ELSE h END AS h FROM a WHERE i % 5 <> 0 UNION ALL SELECT i + 1000000000, CASE WHEN (i + 1000000000) % 7 = 0 THEN 'old' ELSE 'gone' END FROM a WHERE i % 13 = 0),
p AS (SELECT coalesce(a.i, s.i) AS i, text, a.h AS ha, s.h AS hs, CASE WHEN s.i IS NULL THEN 'MISSING' WHEN a.i IS NULL THEN 'ORPHAN' WHEN a.h <> s.h THEN 'CHANGED' WHEN s.i % 11 = 0 THEN 'CONTRACT' WHEN s.i % 19 = 0 THEN 'FAILED' ELSE 'CURRENT' END AS action
 FROM a FULL JOIN s ON a.i = s.i),
w AS (SELECT *, action IN ('MISSING', 'CHANGED', 'CONTRACT', 'FAILED') AND (action = 'MISSING' OR i % 17 <> 0) AS wrote, action = 'ORPHAN' AND i % 17 <> 0 AS gone, lower(substr(text, 1, 1)) = 'q' AS bad FROM p)
SELECT CAST(i AS VARCHAR) AS stable_id, action, CASE WHEN gone THEN NULL WHEN wrote THEN ha ELSE hs END AS projection_hash, CASE WHEN gone THEN NULL WHEN wrote THEN 'letters-v2' WHEN i % 11 = 0 THEN 'letters-v1' ELSE 'letters-v2' END AS model,
 CAST(CASE WHEN gone THEN NULL WHEN wrote THEN 2 WHEN i % 17 = 0 THEN 9 ELSE 1 END AS BIGINT) AS generation, CASE WHEN gone THEN NULL WHEN wrote THEN CASE WHEN bad THEN 'FAILED' ELSE 'FRESH' END WHEN i % 19 = 0 THEN 'FAILED' ELSE 'FRESH' END AS status,
 CASE WHEN wrote AND bad THEN 'ValueError' END AS failure, CASE WHEN gone THEN NULL WHEN wrote THEN CASE WHEN bad THEN NULL ELSE length(text) || ',' || (length(text) - length(replace(text, 'e', ''))) || ',1' END ELSE '0' END AS vector FROM w"""


def digest_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunk digests after a refresh: documents of one source have other texts, those of another are gone."""
    chunks = _chunks(spark, sf_dir).withColumn("document_id", F.concat("document_id", F.lit("-"), (F.col("chunk_id") % 21).cast("string"))).where("document_id is not null")
    kept = digests.DocumentDigests(spark, _folder(spark, "digests"))
    kept.refresh(chunks)
    first = titled(table(spark, sf_dir, "documents").where("source = 'src1'")).select(F.col("doc_id").alias("chunk_id"), F.col("title").alias("normalized_content"))
    changed = chunks.drop("normalized_content").join(first, "chunk_id").withColumn("content_hash", X.sha256("normalized_content"))
    kept.refresh(changed, chunks.where("document_id like 'src2-%'").select("document_id").distinct())
    return kept.fingerprints()


def _prefixed_sql(*parts: str) -> str:
    return " || ".join(f"strlen({p}) || ':' || {p} || ';'" for p in parts)


_DIGESTS = f"""WITH c AS (SELECT source || '-' || (doc_id % 21) AS document_id, doc_id, CASE WHEN source = 'src1' THEN split_part(text, chr(10), 1) ELSE text END AS t FROM documents WHERE source <> 'src2'),
d AS (SELECT document_id, doc_id, sha256({_prefixed_sql("CAST(doc_id AS VARCHAR)", "t", "sha256(t)")}) AS digest FROM c),
l AS (SELECT document_id, doc_id // {digests.CHUNKS} AS leaf, count(*) AS n, sha256(string_agg(digest, '' ORDER BY doc_id, digest)) AS d FROM d GROUP BY 1, 2)
SELECT document_id, CAST(sum(n) AS BIGINT) AS chunks, sha256(string_agg(d, '' ORDER BY leaf)) AS fingerprint FROM l GROUP BY 1"""


def fused_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of which some candidates are stale, gone or of another workspace, and some selected ones change
    before the answer is given."""
    i = F.col("stable_id").cast("long")
    rows = None
    for name, own in _channels(spark, sf_dir).items():
        rows = own if rows is None else rows.unionByName(own)
    candidates = rows.select("channel", "kind", "stable_id", F.col("rank").alias("ordinal"), F.when(i % 23 == 0, 2).otherwise(1).alias("workspace_id"), F.when((i % 11 == 0) & (F.col("channel") != "VECTOR"), F.lit("old")).otherwise(F.concat(F.lit("h"), "stable_id")).alias("content_hash"))
    candidates = stored(candidates, "candidates")  # some hundred rows that are read three times
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 17 <> 0")
    d = F.col("doc_id")
    authority = documents.select(F.lit("SOURCE_CHUNK").alias("kind"), d.alias("stable_id"), F.lit(1).alias("workspace_id"), F.concat(F.lit("h"), d.cast("string")).alias("content_hash"), (F.col("n_chars") % 7 != 0).alias("eligible"), F.when(d % 13 == 0, " ").otherwise(F.col("text")).alias("content"))
    now = authority.where("stable_id % 9 <> 0").withColumn("content_hash", F.when(F.col("stable_id") % 5 == 0, "newer").otherwise(F.col("content_hash"))).drop("content")
    out = evidence.fused_trace(candidates, authority, now, fusion.FUSION["fusion-rrf-v2-graph-damped"], 20, 9000)
    return out.select("stable_id", "lexical", "vector", "graph", "rejections", F.round("score", 9).alias("score"), "fused_rank", "modalities", "disposition", "reason", X.sha256("evidence").alias("evidence_hash"))


_TRACE = rf"""WITH RECURSIVE {_CHANNELS.removeprefix("WITH ")},
j AS (SELECT c, w, ch.doc_id AS i, rank AS ordinal, CASE WHEN ch.doc_id % 13 = 0 THEN ' ' ELSE text END AS content,
  CASE WHEN ch.doc_id % 23 = 0 THEN CASE WHEN d.doc_id IS NULL THEN 'AUTHORITY_MISSING' ELSE 'WORKSPACE_MISMATCH' END WHEN d.doc_id IS NULL THEN 'AUTHORITY_MISSING' WHEN n_chars % 7 = 0 THEN 'INELIGIBLE' WHEN ch.doc_id % 11 = 0 AND c <> 'VECTOR' THEN 'STALE_REVISION' END AS rej
  FROM ch LEFT JOIN (SELECT * FROM documents WHERE doc_id % 17 <> 0) d ON ch.doc_id = d.doc_id),
k AS (SELECT *, CASE WHEN rej IS NULL THEN row_number() OVER (PARTITION BY c, rej IS NULL ORDER BY ordinal) END AS kept FROM j),
m AS (SELECT i, CAST(max(CASE WHEN c = 'LEXICAL' THEN ordinal END) AS INTEGER) AS lexical, CAST(max(CASE WHEN c = 'VECTOR' THEN ordinal END) AS INTEGER) AS vector, CAST(max(CASE WHEN c = 'GRAPH' THEN ordinal END) AS INTEGER) AS graph,
  string_agg(c || ':' || rej, ',' ORDER BY c || ':' || rej) AS rejections, round(sum(w / (60 + kept)), 12) AS score, coalesce(string_agg(CASE WHEN kept IS NOT NULL THEN c END, ',' ORDER BY c), '') AS modalities,
  max(CASE WHEN kept IS NOT NULL THEN content END) AS content FROM k GROUP BY i),
f AS (SELECT *, CASE WHEN score IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY score IS NOT NULL ORDER BY score DESC, CAST(i AS VARCHAR)) AS INTEGER) END AS place, length(content) AS long, length(regexp_extract(content, '^\s*', 0)) AS lead FROM m),
s AS (SELECT 0 AS place, 0 AS n, CAST(0 AS BIGINT) AS used, false AS ended, '' AS fate, CAST(0 AS BIGINT) AS room
 UNION ALL SELECT f.place, CASE WHEN t.take THEN s.n + 1 ELSE s.n END, CASE WHEN t.take THEN s.used + least(f.long, 9000 - s.used) ELSE s.used END, s.ended OR s.n >= 20 OR s.used >= 9000 OR (t.take AND f.long > 9000 - s.used),
  CASE WHEN s.ended THEN 'NOT_REACHED' WHEN t.take THEN 'SELECTED' ELSE 'BUDGET_EXCLUDED' END, greatest(9000 - s.used, 0)
 FROM s JOIN f ON f.place = s.place + 1, LATERAL (SELECT NOT s.ended AND s.n < 20 AND s.used < 9000 AND least(f.long, 9000 - s.used) > f.lead AS take) t),
x AS (SELECT f.*, fate, room, CASE WHEN fate IS NULL THEN split_part(split_part(rejections, ',', 1), ':', 2) WHEN fate = 'SELECTED' THEN CASE WHEN i % 9 = 0 THEN 'AUTHORITY_MISSING' WHEN i % 5 = 0 THEN 'STALE_REVISION' END END AS reason FROM f LEFT JOIN s ON f.place = s.place)
SELECT CAST(i AS VARCHAR) AS stable_id, lexical, vector, graph, rejections, round(score, 9) AS score, place AS fused_rank, modalities, CASE WHEN reason IS NOT NULL THEN 'REJECTED' ELSE fate END AS disposition, reason,
 CASE WHEN reason IS NULL AND fate = 'SELECTED' THEN sha256(substr(content, 1, CAST(room AS INTEGER))) END AS evidence_hash FROM x"""


def rewrite_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first words as a query, some with a question's words or a technical one, and rewrites of them of
    every kind."""
    i = F.col("doc_id")
    words = F.trim(F.regexp_replace(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 100), r"[\x00-\x1F\x7F-\x9F]", " "))
    query = F.concat(F.when(i % 3 != 0, F.lit("Please ")).otherwise(F.lit("")), words, F.when(i % 4 == 0, F.lit(" ERR-1234")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", query.alias("query"), F.when(i % 5 == 0, "LEXICAL").when(i % 5 == 1, "FUSED").otherwise("HYBRID").alias("strategy"), (i % 11 != 0).alias("lexical_empty"), (i % 13 != 0).alias("evidence_there")
    )
    q = F.col("query")
    other = F.when(i % 8 == 1, q).when(i % 8 == 2, F.regexp_replace(q, " ", "  ")).when(i % 8 == 3, F.concat(q, F.lit(" busy_timeout "))).when(i % 8 == 4, F.lit("other words ERR-1234")).when(i % 8 == 5, F.concat(q, F.lit("\x07")))
    other = other.when(i % 8 == 6, F.repeat(F.lit("word "), 60)).when(i % 8 == 7, F.repeat(F.lit("a "), 65)).when(i % 16 == 0, F.lit("other words"))
    return rewrite.decisions(rows.withColumn("rewritten", other)).select("doc_id", "applicability", "status")


_REWRITES = r"""WITH q AS (SELECT doc_id AS i, trim(CASE WHEN doc_id % 3 <> 0 THEN 'Please ' ELSE '' END || trim(regexp_replace(substr(split_part(text, chr(10), 1), 1, 100), '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g')) || CASE WHEN doc_id % 4 = 0 THEN ' ERR-1234' ELSE '' END) AS q FROM documents),
w AS (SELECT i, q, trim(CASE i % 8 WHEN 1 THEN q WHEN 2 THEN replace(q, ' ', '  ') WHEN 3 THEN q || ' busy_timeout ' WHEN 4 THEN 'other words ERR-1234' WHEN 5 THEN q || chr(7) WHEN 6 THEN repeat('word ', 60) WHEN 7 THEN repeat('a ', 65) ELSE CASE WHEN i % 16 = 0 THEN 'other words' END END) AS r FROM q),
t AS (SELECT *, list_transform(regexp_extract_all(q, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS tq, list_transform(regexp_extract_all(r, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS tr,
  regexp_extract_all(q, '(?i)(?:[A-Z]{2,}-\d{3,}|[A-Z][A-Za-z0-9_$]*(?:Error|Exception)|[a-z][a-z0-9_]*_[a-z0-9_]+|[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+)') AS keep FROM w),
a AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'RETRIEVAL_SHAPE_UNSUPPORTED' WHEN len(tq) < 3 OR NOT (contains(lower(q), 'please') OR contains(lower(q), 'what is') OR contains(lower(q), 'how do')) THEN 'QUERY_SHAPE_UNSUPPORTED'
  WHEN i % 11 = 0 OR i % 13 = 0 THEN 'RETRIEVAL_SHAPE_UNSUPPORTED' ELSE 'LEXICAL_MISS_CROWD_OUT' END AS applicability FROM t)
SELECT i AS doc_id, applicability, CASE WHEN applicability <> 'LEXICAL_MISS_CROWD_OUT' THEN 'NO_OP_NOT_APPLICABLE' WHEN r IS NULL OR trim(r) = '' OR contains(r, chr(7)) THEN 'FALLBACK_PROVIDER_INVALID'
 WHEN length(r) > 256 OR len(tr) > 64 THEN 'FALLBACK_OUTPUT_OVER_LIMIT' WHEN lower(r) = lower(q) OR tq = tr THEN 'NO_OP_DUPLICATE' WHEN len(list_filter(keep, lambda x: NOT contains(r, x))) > 0 THEN 'FALLBACK_EXACT_TOKEN_LOSS' ELSE 'REWRITE_APPLIED' END AS status FROM a"""


QUERIES = {f.__name__: f for f in (graph_generations, graph_admission, graph_fused_duplicates, embedding_delta, digest_refresh, fused_trace, rewrite_decisions)}

ORACLE = {
    "graph_generations": _STATUS,
    "graph_admission": _ADMISSION,
    "graph_fused_duplicates": """SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, 'k' || s_nationkey AS stable_id,
 CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, CAST(s_suppkey AS VARCHAR)) > 1 THEN 'DUPLICATE_IDENTITY' END AS rejection FROM supplier""",
    "embedding_delta": _EMBEDDING,
    "digest_refresh": _DIGESTS,
    "fused_trace": _TRACE,
    "rewrite_decisions": _REWRITES,
}
