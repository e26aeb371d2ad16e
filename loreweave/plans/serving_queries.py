"""Queries over the serving joins and the proposal read models, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import digests, proposals, serving
from loreweave.plans.search_queries import _DOCS, QUERY, _bm25_sql, hits, table
from loreweave.sources.tables import files_of, scratch_folder, spread

VERSION = "projection-v1"


def _number(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of their source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_no"), F.col("text").alias("normalized_content"), X.sha256("text").alias("content_hash"),
        F.when(F.col("doc_id") % 4 != 0, F.lit("s")).alias("section"), F.lit(1).alias("page_no"), (F.col("n_chars") % 7 != 0).alias("eligible"),
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _number("source")
    rows = table(spark, sf_dir, "documents").select("source").distinct()
    return rows.select(F.col("source").alias("document_id"), F.when(n % 6 == 5, "SUPERSEDED").otherwise("PROCESSED").alias("status"), F.when(n % 7 == 6, "FAILED").otherwise("PROCESSED").alias("parse_status"), F.when(n % 8 != 7, F.col("source")).alias("sha256"))


_DIGESTS: dict[tuple, digests.DocumentDigests] = {}


def _digests(spark: SparkSession, sf_dir: str) -> digests.DocumentDigests:
    """The digests that the index keeps of the eligible chunks; the first query of a session that needs them writes them."""
    key = (spark.sparkContext.applicationId, files_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _DIGESTS:
        _DIGESTS[key] = digests.DocumentDigests(spark, f"{scratch_folder(spark)}/loreweave-digests-{uuid.uuid4().hex}")
        _DIGESTS[key].refresh(_chunks(spark, sf_dir).where("eligible"))
    return _DIGESTS[key]


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the index left it: some counts, digests, states and versions are behind."""
    now = _digests(spark, sf_dir).fingerprints()
    n = _number("document_id")
    return now.select(
        "document_id", F.when(n % 9 == 3, "INDEX_PENDING").otherwise("SYNCED").alias("sync_status"), F.when(n % 11 == 4, "projection-v0").otherwise(VERSION).alias("projection_version"),
        F.col("chunks").alias("eligible_count"), (F.col("chunks") - F.when(n % 10 == 2, 1).otherwise(0)).alias("indexed_count"),
        F.col("fingerprint").alias("canonical_fingerprint"), F.when(n % 8 == 1, F.lit("old")).otherwise(F.col("fingerprint")).alias("indexed_fingerprint"),
    )


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.fresh_documents(_sources(spark, sf_dir), _digests(spark, sf_dir).fingerprints(), _ledger(spark, sf_dir), VERSION)


_N = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"
_FRESH = f"""fresh AS (SELECT DISTINCT source AS document_id FROM documents WHERE n_chars % 7 <> 0 AND {_N} % 6 <> 5 AND {_N} % 7 <> 6 AND {_N} % 9 <> 3 AND {_N} % 11 <> 4 AND {_N} % 10 <> 2 AND {_N} % 8 <> 1)"""


def fresh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's copies of the chunks: some hashes, documents and sections are not what they were."""
    rows = _chunks(spark, sf_dir).withColumn("content_hash", F.when(F.col("chunk_id") % 11 == 0, "old").otherwise(F.col("content_hash")))
    return rows.withColumn("document_id", F.when(F.col("chunk_id") % 17 == 0, "src0").otherwise(F.col("document_id"))).withColumn("section", F.when(F.col("chunk_id") % 13 == 0, "").otherwise(F.col("section")))


def serving_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.served_sources(hits(spark, sf_dir), _indexed(spark, sf_dir), _chunks(spark, sf_dir), _fresh(spark, sf_dir))
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), "document_id")


_SERVING = f"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)}, {_FRESH}
SELECT h.doc_id, bm25, source AS document_id FROM hits h JOIN documents d ON h.doc_id = d.doc_id WHERE n_chars % 7 <> 0 AND d.doc_id % 11 <> 0 AND (d.doc_id % 17 <> 0 OR source = 'src0')
 AND (d.doc_id % 13 <> 0 OR d.doc_id % 4 = 0) AND source IN (SELECT document_id FROM fresh)"""


def serving_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as wiki pages with a ledger that is behind for some."""
    i = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select(i.alias("knowledge_id"), X.sha256("text").alias("content_hash"), (i % 3 + 1).cast("int").alias("revision"), F.when(i % 5 == 0, "ARCHIVED").otherwise("PUBLISHED").alias("status"))
    ledger = pages.select(
        "knowledge_id", F.when(F.col("knowledge_id") % 7 == 0, "FAILED").otherwise("SYNCED").alias("sync_status"), F.lit(VERSION).alias("projection_version"), F.col("content_hash").alias("canonical_hash"),
        F.when(F.col("knowledge_id") % 11 == 0, "old").otherwise(F.col("content_hash")).alias("indexed_hash"), F.when(F.col("knowledge_id") % 13 == 0, 9).otherwise(F.col("revision")).alias("canonical_revision"),
    )
    return serving.served_pages(hits(spark, sf_dir), pages, ledger, VERSION).withColumn("bm25", F.round("bm25", 6))


_SERVING_PAGES = f"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)} SELECT doc_id, bm25, CAST(doc_id % 3 + 1 AS INTEGER) AS revision FROM hits
WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0"""


def source_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a candidate, some of them damaged, against what is there now."""
    now = _digests(spark, sf_dir).fingerprints()
    rows = _chunks(spark, sf_dir).join(now, "document_id", "left")
    i = F.col("chunk_id")
    candidates = rows.select(
        F.when(i % 31 == 0, 2).otherwise(1).alias("workspace_id"), F.when(i % 29 == 0, F.lit("x")).otherwise(i.cast("string")).alias("stable_id"), F.when(i % 23 == 0, i + 10**9).otherwise(i).alias("chunk_id"),
        "document_id", F.when(i % 19 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(i % 17 == 0, 0).otherwise(F.col("chunks")).alias("eligible_count"), "fingerprint",
    )
    candidates = candidates.withColumn("stable_id", F.when(F.col("stable_id") != "x", F.col("chunk_id").cast("string")).otherwise(F.col("stable_id")))
    out = serving.revalidated_sources(candidates, _sources(spark, sf_dir).where("document_id <> 'src3'"), _chunks(spark, sf_dir), now, 1)
    return out.select("chunk_id", "rejection")


_REVALIDATION = f"""WITH e AS (SELECT source, count(*) AS n FROM documents WHERE n_chars % 7 <> 0 GROUP BY 1)
SELECT CASE WHEN doc_id % 23 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS chunk_id,
 CASE WHEN doc_id % 31 = 0 THEN 'WORKSPACE_MISMATCH' WHEN doc_id % 29 = 0 THEN 'IDENTITY_MISMATCH' WHEN d.source = 'src3' THEN 'AUTHORITY_MISSING' WHEN {_N.replace("source", "d.source")} % 6 = 5 OR {_N.replace("source", "d.source")} % 7 = 6 THEN 'INELIGIBLE'
  WHEN doc_id % 17 = 0 AND coalesce(n, -1) <> 0 THEN 'STALE_REVISION' WHEN doc_id % 23 = 0 THEN 'AUTHORITY_MISSING' WHEN n_chars % 7 = 0 THEN 'INELIGIBLE' WHEN doc_id % 19 = 0 THEN 'STALE_REVISION' END AS rejection
FROM documents d LEFT JOIN e ON d.source = e.source"""


def projection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return serving.listed(rows, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def analysis_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.analysis_targets(_sources(spark, sf_dir), _chunks(spark, sf_dir).where("chunk_id % 50 = 0")).select("document_id")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.paged(table(spark, sf_dir, "documents").where("lang = 'fr'"), ["doc_id"], 1, 20)[1]


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("knowledge_id"), F.array("o_custkey", F.col("o_custkey") + 1, F.lit(-1).cast("long")).alias("sources"))
    return serving.derived_from(pages, table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("document_id")))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.tagged_with(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("knowledge_id"), F.array("p_brand", F.upper("p_brand"), F.lit(" ")).alias("tags")))


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("proposal_id"), F.when(key % 4 != 0, F.col("o_custkey")).alias("document_id"), (key % 2500).alias("candidate_id"),
        F.when(key % 3 == 0, "REVIEW").when(key % 3 == 1, "APPROVED").otherwise("REJECTED").alias("status"), F.array("o_orderpriority").alias("tags"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "howto").otherwise(F.col("p_brand")).alias("candidate_type"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < 0, "DELETED").otherwise("PROCESSED").alias("status"))


_PROPOSALS = """pr AS (SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS document_id, o_orderkey % 2500 AS candidate_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status, o_orderpriority AS tag FROM orders),
dc AS (SELECT c_custkey AS document_id, CASE WHEN c_acctbal < 0 THEN 'DELETED' ELSE 'PROCESSED' END AS status FROM customer WHERE c_custkey % 10 <> 9),
ca AS (SELECT p_partkey AS candidate_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'howto' ELSE p_brand END AS candidate_type FROM part),
ev AS (SELECT DISTINCT l_orderkey AS proposal_id, l_partkey AS chunk_id FROM lineitem WHERE l_linenumber > 1), ch AS (SELECT p_partkey AS chunk_id, p_size AS document_id, p_partkey % 100 AS chunk_no FROM part WHERE p_partkey % 20 <> 7)"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    evidence = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_partkey").alias("chunk_id")).distinct()
    chunks = table(spark, sf_dir, "part").where("p_partkey % 20 <> 7").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").alias("document_id"), (F.col("p_partkey") % 100).alias("chunk_no"))
    return evidence, chunks


def proposal_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.overview(_proposals(spark, sf_dir), _customers(spark, sf_dir), _candidates(spark, sf_dir)).select("proposal_id", "document_id", "document_status", "title", "candidate_type")


def proposal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.page_of(_proposals(spark, sf_dir).where("status = 'REVIEW'"), 2, 25).select("proposal_id", "document_id")


def proposal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.evidence_chunks(*_evidence(spark, sf_dir)).select("proposal_id", "chunk_id", "ordinal")


def proposal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.evidence_documents(*_evidence(spark, sf_dir))


def proposal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.consistency(_proposals(spark, sf_dir), _customers(spark, sf_dir), _candidates(spark, sf_dir), *_evidence(spark, sf_dir))


_CONSISTENCY = f"""WITH {_PROPOSALS} SELECT 'missing_documents' AS "check", count(*) AS violations FROM pr WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM dc)
UNION ALL SELECT 'missing_candidates', count(*) FROM pr WHERE candidate_id NOT IN (SELECT candidate_id FROM ca)
UNION ALL SELECT 'without_evidence', count(*) FROM pr WHERE proposal_id NOT IN (SELECT proposal_id FROM ev)
UNION ALL SELECT 'missing_chunks', count(*) FROM ev WHERE chunk_id NOT IN (SELECT chunk_id FROM ch)"""


def proposal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("proposal_id"), F.array(F.upper("o_orderstatus"), F.lit(" New  Tag ")).alias("tags"))
    return proposals.retagged(_proposals(spark, sf_dir), changes).select("proposal_id", "outcome", F.array_join("tags", "|").alias("tags"))


_TAGS = f"""WITH {_PROPOSALS} SELECT proposal_id, CASE WHEN proposal_id % 5 <> 0 THEN 'UNCHANGED' WHEN status = 'REVIEW' THEN 'UPDATED' ELSE 'NOT_IN_REVIEW' END AS outcome,
 CASE WHEN proposal_id % 5 = 0 AND status = 'REVIEW' THEN array_to_string(list_sort([lower(o_orderstatus), 'new tag']), '|') ELSE tag END AS tags FROM pr JOIN orders ON proposal_id = o_orderkey"""


def _draft_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as proposals of every action, candidate type and requested page type, with data of every kind, and their
    lines as evidence."""
    key = F.col("o_orderkey")
    types = lambda by, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    title = F.when(key % 2 == 0, F.concat(F.lit('"title":"Order '), key.cast("string"), F.lit('  of  "quoted'), F.lit('",'))).otherwise("")
    title = F.replace(title, F.lit('"quoted'), F.lit("quoted"))
    sections = F.when(key % 11 == 1, F.lit(',"sections":[{"heading":"One","content":" first  "},{"heading":"ONE","content":"x"}]')).when(key % 3 == 0, F.lit(',"sections":[{"heading":"One","content":" first\\nline "},{"heading":"Two","content":"second"}]')).otherwise("")
    kind = F.coalesce(F.concat(F.lit(',"pageType":"'), types(F.floor(key / 5), None, "HOWTO", "DECISION", "REFERENCE", "CONCEPT", "MEMO"), F.lit('"')), F.lit(""))
    data = F.concat(F.lit("{"), title, F.lit('"tags":["B"," a "],"aliases":["b","A"],"wikilinks":[{"targetTitle":"Z"},{"targetTitle":"Y","label":"y"}]'), sections, kind, F.lit("}"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")  # a draft takes long for the bytes of its order
    proposals_ = orders.select(
        key.alias("proposal_id"), F.when(key % 10 != 3, "APPROVED").otherwise("REVIEW").alias("status"), types(key, "CREATE", "MERGE", "CREATE", "LINK_ONLY").alias("action"),
        types(key, "CONCEPT", "FACT", "PROCEDURE", "DECISION", "REFERENCE", None).alias("candidate_type"), F.concat(F.lit("Candidate "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(key % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("About "), "o_orderpriority")).alias("summary"), F.when(key % 17 != 0, data).otherwise("{").alias("data"), F.when(key % 4 == 0, F.col("o_custkey")).alias("document_id"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_linenumber").alias("chunk_no"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("page_no"),
        F.col("l_partkey").alias("document_id"), F.concat(F.lit(" "), "l_linestatus", F.lit("\n"), "l_returnflag", F.lit(" ")).alias("excerpt"),
    )
    return proposals_, lines


def proposal_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = proposals.drafted(*_draft_inputs(spark, sf_dir))
    return out.select("proposal_id", "page_type", "path", F.array_join("tags", "|").alias("tags"), X.sha256("markdown").alias("markdown_hash"), "refusal")


_NL = "chr(10)"
_DRAFTS = f"""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 10 <> 3 THEN 'APPROVED' ELSE 'REVIEW' END AS status, ['CREATE', 'MERGE', 'CREATE', 'LINK_ONLY'][o_orderkey % 4 + 1] AS action,
  ['CONCEPT', 'FACT', 'PROCEDURE', 'DECISION', 'REFERENCE', NULL][o_orderkey % 6 + 1] AS ct, CASE WHEN o_orderkey % 17 <> 0 THEN [NULL, 'HOWTO', 'DECISION', 'REFERENCE', 'CONCEPT', 'MEMO'][o_orderkey // 5 % 6 + 1] END AS rt,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 17 <> 0 THEN 'Order ' || o_orderkey || ' of quoted' ELSE 'Candidate ' || o_custkey END AS title, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'About ' || o_orderpriority END AS summary FROM orders),
a AS (SELECT * FROM (VALUES {", ".join(f"('{kind}', '{t}')" for kind, own in proposals.ALLOWED_TYPES.items() for t in own)}) AS x(act, art)),
m AS (SELECT p.*, CASE WHEN rt = 'MEMO' OR ct IS NULL AND rt IS NULL THEN 'UNSUPPORTED_CANDIDATE_MAPPING' WHEN ct IS NULL THEN NULL WHEN rt IS NULL AND ct IN ('FACT', 'PROCEDURE') THEN 'AMBIGUOUS_CANDIDATE_MAPPING'
  WHEN rt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE act = ct AND art = rt) THEN 'UNSUPPORTED_CANDIDATE_MAPPING' END AS mapping FROM p),
r AS (SELECT *, CASE WHEN status <> 'APPROVED' THEN 'PROPOSAL_NOT_APPROVED' WHEN action = 'LINK_ONLY' THEN 'UNSUPPORTED_ACTION' WHEN k % 17 = 0 THEN 'INVALID_NORMALIZED_DATA' WHEN mapping IS NOT NULL THEN mapping
  WHEN summary = '' OR k % 11 = 1 THEN 'INVALID_NORMALIZED_DATA' WHEN k NOT IN (SELECT l_orderkey FROM lineitem) OR k IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) THEN 'INVALID_EVIDENCE' END AS refusal, coalesce(rt, ct) AS t FROM m),
e AS (SELECT l_orderkey AS k, string_agg('- sourceChunkId: ' || (l_orderkey * 10 + l_linenumber) || ', chunkNo: ' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN ', pageNo: ' || l_linenumber ELSE '' END || {_NL} || '  > ' || l_linestatus || {_NL} || '  > ' || l_returnflag || {_NL}, '' ORDER BY l_linenumber) AS shown,
  string_agg('  - ' || (l_orderkey * 10 + l_linenumber) || {_NL}, '' ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1),
d AS (SELECT k, string_agg('  - ' || l_partkey || {_NL}, '' ORDER BY l_partkey) AS documents FROM (SELECT DISTINCT l_orderkey AS k, l_partkey FROM lineitem) GROUP BY 1)
SELECT r.k AS proposal_id, CASE WHEN refusal IS NULL THEN t END AS page_type,
 CASE WHEN refusal IS NULL THEN 'vault/' || CASE t {" ".join(f"WHEN '{t}' THEN '{folder}'" for t, folder in X.PAGE_FOLDERS.items())} END || '/' || replace(lower(title), ' ', '-') || '.md' END AS path, CASE WHEN refusal IS NULL THEN 'a|b' END AS tags,
 CASE WHEN refusal IS NULL THEN sha256('---' || {_NL} || 'title: "' || title || '"' || {_NL} || 'pageType: "' || t || '"' || {_NL} || 'summary: "' || summary || '"' || {_NL} || 'tags:' || {_NL} || '  - "a"' || {_NL} || '  - "b"' || {_NL} || 'aliases:' || {_NL} || '  - "A"' || {_NL} || '  - "b"' || {_NL}
  || 'sourceDocumentIds:' || {_NL} || CASE WHEN r.k % 4 = 0 THEN '  - ' || c || {_NL} ELSE documents END || 'sourceChunkIds:' || {_NL} || ids || '---' || {_NL} || {_NL} || '# ' || title || {_NL} || {_NL}
  || CASE WHEN r.k % 3 = 0 THEN '## One' || {_NL} || {_NL} || 'first' || {_NL} || 'line' || {_NL} || {_NL} || '## Two' || {_NL} || {_NL} || 'second' || {_NL} || {_NL} ELSE '## Summary' || {_NL} || {_NL} || summary || {_NL} || {_NL} END
  || '## Related Links' || {_NL} || {_NL} || '- [[Y|y]]' || {_NL} || '- [[Z|Z]]' || {_NL} || {_NL} || '## Evidence' || {_NL} || {_NL} || shown) END AS markdown_hash, refusal
FROM r LEFT JOIN e ON r.k = e.k LEFT JOIN d ON r.k = d.k"""


def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pages = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 4).cast("int").alias("revision"))
    operations = table(spark, sf_dir, "orders").select(
        key.alias("operation_id"), F.col("o_custkey").cast("string").alias("path"), F.when(key % 2 == 0, "CREATE").otherwise("MERGE").alias("action"), (key % 5).cast("int").alias("revision"), (key % 7 == 0).alias("committed")
    )
    return proposals.published(pages, operations).select("operation_id", "outcome", F.col("new_revision").cast("int").alias("new_revision"))


_PUBLISH = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS p, o_orderkey % 2 = 0 AS creates, o_orderkey % 5 AS r, o_orderkey % 7 = 0 AS done, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 = 0 ORDER BY o_orderkey) AS n FROM orders),
j AS (SELECT o.*, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS live FROM o LEFT JOIN customer ON p = c_custkey),
k AS (SELECT *, CASE WHEN done THEN 'REPEATED' WHEN n > 1 THEN 'CONFLICT' WHEN creates AND live IS NOT NULL THEN 'ALREADY_EXISTS' WHEN NOT creates AND live IS NULL THEN 'NOT_FOUND' WHEN NOT creates AND live <> r - 1 THEN 'CONFLICT' ELSE 'PUBLISHED' END AS outcome FROM j)
SELECT id AS operation_id, outcome, CAST(CASE WHEN outcome = 'PUBLISHED' THEN coalesce(live, 0) + 1 END AS INTEGER) AS new_revision FROM k"""


def citation_currentness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's answer cites itself as a chunk and a page, some in an older state or an older form."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", X.sha256("text").alias("h"))
    source = F.concat(F.lit('{"kind":"SOURCE","id":"'), i.cast("string"), F.lit('","hash":"'), F.when(i % 5 == 0, "old").otherwise(F.col("h")), F.lit('"}'))
    wiki = F.concat(F.lit('{"kind":"WIKI","id":"k'), i.cast("string"), F.lit('","path":"p'), i.cast("string"), F.lit('","revision":'), F.when(i % 7 == 0, 2).otherwise(1).cast("string"), F.lit("}"))
    given = F.when(i % 11 == 0, F.lit('["E1"]')).when(i % 3 == 0, F.concat(F.lit("["), wiki, F.lit("]"))).when(i % 3 == 1, F.concat(F.lit("["), source, F.lit("]"))).otherwise(F.concat(F.lit("["), source, F.lit(","), wiki, F.lit("]")))
    chunks = rows.select(i.alias("chunk_id"), F.col("h").alias("content_hash"))
    pages = rows.select(F.concat(F.lit("p"), i.cast("string")).alias("path"), F.concat(F.lit("k"), i.cast("string")).alias("knowledge_id"), F.lit(1).alias("revision"))
    return proposals.citation_status(rows.select(i.alias("answer_id"), given.alias("citations")), chunks, pages)


_CURRENTNESS = """SELECT doc_id AS answer_id, CASE WHEN doc_id % 11 = 0 THEN 'LEGACY_FORMAT' WHEN doc_id % 3 = 0 THEN 'NO_SOURCE' WHEN doc_id % 5 = 0 OR doc_id % 3 = 2 AND doc_id % 7 = 0 THEN 'STALE' ELSE 'CURRENT' END AS citation_status FROM documents"""


def latest_ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("item_id"), F.col("event_type").alias("status"), (F.col("event_id") % 100).alias("job_id"))
    jobs = table(spark, sf_dir, "events").where("event_id < 100").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 3 == 0, "RUNNING").when(F.col("event_id") % 3 == 1, "QUEUED").otherwise("DONE").alias("job_status"))
    return proposals.latest_items(events, jobs, ("RUNNING", "QUEUED"))


def embedding_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.snapshot_token(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


def target_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" wiki:"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 50 == 1, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    page, title = proposals.target_reference(given)
    pick = lambda by, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    kind, refusal = proposals.page_type(pick(F.col("p_partkey"), "CONCEPT", "FACT", "PROCEDURE", "OTHER", None), pick(F.col("p_size"), None, "HOWTO", "CONCEPT"))
    path = F.when(F.col("p_partkey") % 4 == 0, F.lit("vault/concepts/../x.md")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("vault/howtos/"), "p_brand", F.lit(".md"))).otherwise(F.lit("vault/other/x.md"))
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page_id"), title.alias("title"), proposals.valid_path(path).alias("path_valid"), kind.alias("page_type"), refusal.alias("type_refusal"))


QUERIES = {
    f.__name__: f
    for f in (
        fresh_documents, serving_search, serving_pages, source_revalidation, projection_listing, analysis_targets, page_totals, page_sources, page_tags, proposal_overview, proposal_page, proposal_evidence,
        proposal_documents, proposal_consistency, proposal_tags, proposal_drafts, publish_outcomes, citation_currentness, latest_ingest_items, embedding_snapshot, target_references,
    )
}

ORACLE = {
    "fresh_documents": f"WITH {_FRESH} SELECT document_id FROM fresh",
    "serving_search": _SERVING,
    "serving_pages": _SERVING_PAGES,
    "source_revalidation": _REVALIDATION,
    "projection_listing": "SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS identity_valid FROM documents",
    "analysis_targets": f"SELECT DISTINCT source AS document_id FROM documents WHERE doc_id % 50 = 0 AND {_N} % 7 <> 6 AND {_N} % 8 <> 7",
    "page_totals": "SELECT 1 AS page, 20 AS size, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents WHERE lang = 'fr'",
    "page_sources": "SELECT DISTINCT o_orderkey AS knowledge_id, c_custkey AS document_id FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey + 1) WHERE c_custkey % 3 <> 0",
    "page_tags": "SELECT p_partkey AS knowledge_id, lower(p_brand) AS tag FROM part",
    "proposal_overview": f"WITH {_PROPOSALS} SELECT proposal_id, pr.document_id, dc.status AS document_status, title, candidate_type FROM pr LEFT JOIN dc ON pr.document_id = dc.document_id LEFT JOIN ca ON pr.candidate_id = ca.candidate_id",
    "proposal_page": f"WITH {_PROPOSALS} SELECT proposal_id, document_id FROM pr WHERE status = 'REVIEW' ORDER BY proposal_id DESC LIMIT 25 OFFSET 50",
    "proposal_evidence": f"WITH {_PROPOSALS} SELECT proposal_id, chunk_id, CAST(row_number() OVER (PARTITION BY proposal_id ORDER BY document_id, chunk_no, chunk_id) AS INTEGER) AS ordinal FROM ev JOIN ch USING (chunk_id)",
    "proposal_documents": f"WITH {_PROPOSALS} SELECT DISTINCT proposal_id, document_id FROM ev JOIN ch USING (chunk_id)",
    "proposal_consistency": _CONSISTENCY,
    "proposal_tags": _TAGS,
    "proposal_drafts": _DRAFTS,
    "publish_outcomes": _PUBLISH,
    "citation_currentness": _CURRENTNESS,
    "latest_ingest_items": "WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 100 % 3 <> 2 AND event_id % 100 IN (SELECT event_id FROM events WHERE event_id < 100)) SELECT user_id AS document_id, event_id AS item_id, event_type AS status FROM x WHERE n = 1",
    "embedding_snapshot": f"SELECT digest AS token FROM ({digests.ordered_sql('SELECT vec_id || chr(31) || label AS key, vec_id || chr(31) || label AS value FROM embeddings')})",
    "target_references": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS page_id, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 50 <> 1 THEN regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') END AS title, p_partkey % 4 = 1 AS path_valid, CASE WHEN refusal IS NULL THEN coalesce(rt, ct) END AS page_type, refusal AS type_refusal FROM (SELECT *, CASE WHEN ct IS NULL THEN CASE WHEN rt IS NULL THEN 'UNSUPPORTED_CANDIDATE_MAPPING' END WHEN ct = 'OTHER' THEN 'UNSUPPORTED_CANDIDATE_MAPPING' WHEN rt IS NULL THEN CASE WHEN ct <> 'CONCEPT' THEN 'AMBIGUOUS_CANDIDATE_MAPPING' END WHEN ct = 'PROCEDURE' AND rt <> 'HOWTO' OR ct <> 'PROCEDURE' AND rt <> 'CONCEPT' THEN 'UNSUPPORTED_CANDIDATE_MAPPING' END AS refusal FROM (SELECT *, ['CONCEPT', 'FACT', 'PROCEDURE', 'OTHER', NULL][p_partkey % 5 + 1] AS ct, [NULL, 'HOWTO', 'CONCEPT'][p_size % 3 + 1] AS rt FROM part))",
}
