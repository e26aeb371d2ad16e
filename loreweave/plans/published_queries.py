"""Queries over published files, repairs, prompts and the last joins of the serving and graph read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import evidence, graph, ingest, lexical, prompts, proposals, published, serving, vector
from loreweave.plans.knowledge_queries import _entity_sql, _prefixed
from loreweave.plans.search_queries import _DOCS, QUERY, _bm25_sql, hits, table
from loreweave.plans.serving_queries import page_sources, page_tags
from loreweave.sources.tables import spread

_TYPES = ("HOWTO", "CONCEPT", "DECISION")


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as published pages, and their files, of which some are missing, damaged or cannot be read."""
    i, n = F.col("p_partkey"), F.col("n")
    parts = spread(table(spark, sf_dir, "part")).withColumn("title", F.concat(F.lit("Part "), i.cast("string"))).withColumn("type", F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (i % 3 + 1).cast("int")))
    sections = F.array(F.struct(F.lit("Facts").alias("heading"), F.concat(F.lit(" "), "p_type", F.lit(' "quoted" ')).alias("content")))
    links = F.array(F.struct(F.concat(F.lit("Part "), (i + 1).cast("string")).alias("target"), F.lit("next").alias("label")), F.struct(F.when(i % 23 == 0, "a/b").otherwise("Zeta  One").alias("target"), F.lit("z").alias("label")))
    own = F.array(F.struct(i.alias("chunk_id"), F.lit(1).alias("chunk_no"), F.lit(None).cast("int").alias("page_no"), F.concat("p_name", F.lit("\n"), "p_brand").alias("excerpt")))
    tags = F.array(F.concat(F.lit(" "), "p_brand"), F.when(i % 19 == 0, "a\nb").otherwise('say "hi" \\ there'))
    text = published.page_file(
        F.concat(F.lit("k"), i.cast("string")), F.col("title"), F.col("type"), tags, F.array().cast("array<string>"), F.array(i, F.lit(7).cast("long")), F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T00:00:00Z"),
        i * 2, i * 3, F.lit(1), published.body(F.col("title"), sections, links, own),
    )
    rows = parts.select(i.alias("n"), F.concat(F.lit("k"), i.cast("string")).alias("knowledge_id"), "title", F.col("type").alias("page_type"), text.alias("text")).withColumn("path", X.wiki_path(F.col("page_type"), "title"))
    damaged = F.col("text")
    for by, what, with_ in ((11, 'status: "PUBLISHED"', 'status: "DRAFT"'), (13, "tags:\n", "tags: x\n"), (17, "---\n\n", "--\n\n"), (29, "\n# Part", "\n# Pert")):
        damaged = F.when(n % by == 0, F.replace(damaged, F.lit(what), F.lit(with_))).otherwise(damaged)
    raw = F.encode(damaged, "UTF-8")
    rows = rows.withColumn("bytes", F.when(n % 31 == 0, F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw))
    pages = rows.select("knowledge_id", "title", "page_type", F.when(n % 41 == 0, "vault/howtos/other.md").otherwise(F.col("path")).alias("markdown_path"), F.when(n % 7 == 0, "old").otherwise(F.sha2("bytes", 256)).alias("content_hash"))
    files = rows.where("n % 5 <> 0").select(F.col("path").alias("source_path"), F.when(n % 43 == 0, 1 << 21).otherwise(F.length("bytes")).cast("long").alias("length"), F.when(n % 37 != 0, F.col("bytes")).alias("content"))
    return pages, files


def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read back from their files: what they are worth, and the tags, sources and links of those that are sound."""
    rows = published.checked(*_files(spark, sf_dir)).withColumn("r", published.relations("markdown"))
    sound = lambda c: F.when(F.col("content_status") == "VALID", c)
    return rows.select(
        "knowledge_id", "content_status", "reason", sound(F.array_join("r.tags", "|")).alias("tags"), sound(F.array_join(F.transform("r.sources", lambda s: s.cast("string")), "|")).alias("sources"),
        sound(F.array_join("r.links", "|")).alias("links"), sound(F.col("r.error")).alias("error"), X.sha256("body").alias("body_hash"),
    )


_N = "chr(10)"
_FILES = rf"""WITH p AS (SELECT p_partkey AS n, p_name, p_brand, p_type, CASE WHEN p_partkey % 41 = 0 THEN 'PATH_NOT_CANONICAL' WHEN p_partkey % 5 = 0 THEN 'FILE_MISSING' WHEN p_partkey % 43 = 0 THEN 'TOO_LARGE' WHEN p_partkey % 37 = 0 THEN 'UNREADABLE'
  WHEN p_partkey % 7 = 0 THEN 'HASH_DIFFERS' WHEN p_partkey % 31 = 0 THEN 'NOT_UTF8' WHEN p_partkey % 17 = 0 THEN 'NO_FRONTMATTER' WHEN p_partkey % 11 = 0 THEN 'METADATA_DIFFERS' WHEN p_partkey % 29 = 0 THEN 'TITLE_DIFFERS' END AS reason FROM part),
e AS (SELECT *, reason IS NULL AS ok, CASE WHEN n % 13 = 0 THEN 'MALFORMED_LIST' WHEN n % 19 = 0 THEN 'MALFORMED_TAG' WHEN n % 23 = 0 THEN 'MALFORMED_LINK' END AS err FROM p)
SELECT 'k' || n AS knowledge_id, CASE WHEN ok THEN 'VALID' WHEN reason = 'UNREADABLE' THEN 'UNREADABLE' ELSE 'INVALID' END AS content_status, reason,
 CASE WHEN ok THEN CASE WHEN err IS NULL THEN array_to_string(list_sort([lower(trim(p_brand)), 'say "hi" \ there']), '|') ELSE '' END END AS tags,
 CASE WHEN ok THEN CASE WHEN err IS NULL THEN array_to_string(list_sort(list_distinct([n, 7])), '|') ELSE '' END END AS sources,
 CASE WHEN ok THEN CASE WHEN err IS NULL THEN 'part ' || (n + 1) || '|zeta one' ELSE '' END END AS links, CASE WHEN ok THEN err END AS error,
 CASE WHEN ok THEN sha256('# Part ' || n || {_N} || {_N} || '## Facts' || {_N} || {_N} || trim(p_type) || ' "quoted"' || {_N} || {_N} || '## Related Links' || {_N} || {_N} || '- [[Part ' || (n + 1) || '|next]]' || {_N} || '- [[' || CASE WHEN n % 23 = 0 THEN 'a/b' ELSE 'Zeta  One' END || '|z]]' || {_N} || {_N}
  || '## Evidence' || {_N} || {_N} || '- sourceChunkId: ' || n || ', chunkNo: 1' || {_N} || '  > ' || p_name || {_N} || '  > ' || p_brand || {_N}) END AS body_hash FROM e"""


def repair_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with findings of every kind, some without a readable file, a proposal, its draft or its evidence."""
    i = F.col("p_partkey")
    codes = ("CANONICAL_CONTENT_INVALID", *published.REFUSALS)
    parts = table(spark, sf_dir, "part")
    findings = parts.select(F.concat(F.lit("k"), i.cast("string")).alias("knowledge_id"), F.element_at(F.array(*[F.lit(c) for c in codes]), (i % 7 % 6 + 1).cast("int")).alias("code"), F.col("p_type").alias("detail"))
    pages = parts.where("p_partkey % 11 <> 0").select(F.concat(F.lit("k"), i.cast("string")).alias("knowledge_id"), X.sha256("p_name").alias("content_hash"), F.when(i % 3 != 0, i).alias("proposal_id"), (i % 13 != 0).alias("readable"))
    proposals = parts.where("p_partkey % 17 <> 0").select(i.alias("proposal_id"), F.when(i % 5 == 0, "IGNORE").when(i % 2 == 0, "CREATE").otherwise("MERGE").alias("action"), (i % 19 != 0).alias("draftable"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("proposal_id"), F.col("l_orderkey").alias("chunk_id"))
    out = published.repairs(findings, pages, proposals, lines, 1)
    return out.select("knowledge_id", "code", "refusal", "plan_key", F.size("evidence_chunks").alias("evidence_chunks"))


_REPAIRS = f"""WITH f AS (SELECT p_partkey AS n, ['CANONICAL_CONTENT_INVALID', {", ".join(f"'{c}'" for c in published.REFUSALS)}][p_partkey % 7 % 6 + 1] AS code, p_type, p_name FROM part),
e AS (SELECT l_partkey AS n, count(DISTINCT l_orderkey) AS chunks FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
r AS (SELECT f.*, chunks, CASE code {" ".join(f"WHEN '{c}' THEN '{r}'" for c, r in published.REFUSALS.items())} ELSE CASE WHEN f.n % 11 = 0 THEN 'NO_RESOLVABLE_LINEAGE' WHEN f.n % 13 = 0 THEN 'TARGET_NOT_READABLE'
  WHEN f.n % 3 = 0 OR f.n % 17 = 0 OR f.n % 5 = 0 OR f.n % 19 = 0 OR chunks IS NULL THEN 'NO_RESOLVABLE_LINEAGE' END END AS refusal FROM f LEFT JOIN e ON f.n = e.n)
SELECT 'k' || n AS knowledge_id, code, refusal, CASE WHEN refusal IS NULL THEN sha256('vault-repair:v1:1:k' || n || ':' || code || ':' || sha256(p_name) || ':' || p_type) END AS plan_key, CASE WHEN refusal IS NULL THEN CAST(chunks AS INTEGER) END AS evidence_chunks FROM r"""


def wiki_page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), i.cast("string")).alias("knowledge_id"), "p_name", F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (i % 3 + 1).cast("int")).alias("page_type"), F.when(i % 4 == 0, "ARCHIVED").otherwise("PUBLISHED").alias("status"))
    rows, totals = serving.wiki_list(pages, "CONCEPT", 2, 30)
    counted = totals.first()  # one row
    return rows.select("knowledge_id", "p_name", F.lit(counted["total"]).cast("long").alias("total"), F.lit(counted["pages"]).cast("long").alias("pages"))


TEMPLATE = "<!-- prompt-version: analysis-v3 -->\nRead {{ document.metadata }} with care.\n\n{{evidence}}\n-- end of {{document.metadata}}\n"


def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prompts.template(TEMPLATE)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("?"))).alias("meta"), "text")
    rows = rows.withColumn("prompt", made.rendered({"document.metadata": F.col("meta"), "evidence": F.col("text")}))
    return rows.select("doc_id", F.lit(made.identifier).alias("prompt_id"), X.sha256("prompt").alias("prompt_hash"), prompts.prompt_digest(made, F.col("prompt")).alias("digest"))


_PROMPT = f"'Read ' || source || '/' || coalesce(lang, '?') || ' with care.' || {_N} || {_N} || text || {_N} || '-- end of ' || source || '/' || coalesce(lang, '?') || {_N}"
_PROMPTS = f"""WITH p AS (SELECT doc_id, {_PROMPT} AS prompt FROM documents)
SELECT doc_id, 'document-analysis@analysis-v3' AS prompt_id, sha256(prompt) AS prompt_hash, sha256({_prefixed("'document-analysis@analysis-v3'", "prompt")}) AS digest FROM p"""


def wiki_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a wiki candidate, some damaged, against the pages that are there; and what a later handoff keeps."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", X.sha256("text").alias("h"))
    stable = F.when(i % 29 == 0, " ").otherwise(F.concat(F.lit("k"), i.cast("string")))
    candidates = rows.select("doc_id", stable.alias("stable_id"), F.when(i % 31 == 0, 2).otherwise(1).alias("workspace_id"), F.when(i % 19 == 0, "old").otherwise(F.col("h")).alias("content_hash"), F.when(i % 17 == 0, 2).otherwise(1).alias("revision"))
    authority = rows.where("doc_id % 7 <> 0").select(F.concat(F.lit("k"), i.cast("string")).alias("stable_id"), F.col("h").alias("content_hash"), F.lit(1).alias("revision"), (i % 11 != 0).alias("eligible"))
    judged = evidence.revalidated(candidates, authority, 1).select("doc_id", "stable_id", F.col("content_hash"), "rejection")
    later = authority.where("stable_id not like '%5'").withColumn("content_hash", F.when(F.col("stable_id").endswith("3"), "newer").otherwise(F.col("content_hash")))
    handed = evidence.handoff(judged.where("rejection is null"), later).select("doc_id", F.lit(True).alias("handed_on"))
    return judged.join(handed, "doc_id", "left").select("doc_id", "rejection", F.coalesce("handed_on", F.lit(False)).alias("handed_on"))


_WIKI_REVALIDATION = """WITH r AS (SELECT doc_id AS i, CASE WHEN doc_id % 31 = 0 THEN 'WORKSPACE_MISMATCH' WHEN doc_id % 29 = 0 THEN 'IDENTITY_MISMATCH' WHEN doc_id % 7 = 0 THEN 'AUTHORITY_MISSING' WHEN doc_id % 11 = 0 THEN 'INELIGIBLE' WHEN doc_id % 19 = 0 OR doc_id % 17 = 0 THEN 'STALE_REVISION' END AS rejection FROM documents)
SELECT i AS doc_id, rejection, rejection IS NULL AND i % 10 NOT IN (3, 5) AS handed_on FROM r"""


def graph_page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to the documents they derive from and to their tags."""
    out = graph.edges(1, "DERIVED_FROM", page_sources(spark, sf_dir), ("WIKI_PAGE", "knowledge_id"), ("SOURCE_DOCUMENT", "document_id"))
    return out.unionByName(graph.edges(1, "TAGGED_WITH", page_tags(spark, sf_dir), ("WIKI_PAGE", "knowledge_id"), ("TAG", "tag")))


def _page_edges_sql(relation: str, kind: str, key: str, source: str) -> str:
    rid = f"'gr1_' || sha256({_prefixed(chr(39) + 'graph-identity-v1' + chr(39), chr(39) + 'relation' + chr(39), chr(39) + '1' + chr(39), 's', chr(39) + relation + chr(39), 't')})"
    return f"SELECT {rid} AS relation_id, '{relation}' AS relation_type, s AS source_id, t AS target_id FROM (SELECT DISTINCT {_entity_sql('WIKI_PAGE', 'knowledge_id')} AS s, {_entity_sql(kind, key)} AS t FROM ({source}))"


_SOURCES = "SELECT DISTINCT o_orderkey AS knowledge_id, c_custkey AS document_id FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey + 1) WHERE c_custkey % 3 <> 0"


def match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits in the index's own order; documents were put in from the last to the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (-F.col("doc_id")).alias("row_id"))
    scored = hits(spark, sf_dir).withColumn("bm25", F.round("bm25", 2))
    return lexical.match_order(scored, rows, "row_id").limit(25).select("doc_id", "bm25")


def projection_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as projections of every state and contract, against the contract of a query's vector."""
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        i.alias("kind"), F.lit(1).alias("generation"), F.when(i % 3 == 0, "BUILDING").when(i % 5 == 0, F.lit(None)).otherwise("READY").alias("status"), F.lit("local").alias("provider"),
        F.when(i % 7 == 0, "m1").otherwise("m2").alias("model"), F.when(i % 11 == 0, F.lit(None)).otherwise(8).alias("dimension"),
    )
    return vector.drift(rows, {"provider": "local", "model": "m2", "dimension": 8})


def analysis_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis of every document that asks about its own chunk, some of another form."""
    i = F.col("doc_id")
    evidence_id = F.when(i % 8 == 2, i + 1).otherwise(i).cast("string")
    text = F.when(i % 8 == 5, F.lit("{")).otherwise(F.concat(
        F.lit('{"title":'), F.when(i % 8 == 4, F.lit("7")).when(i % 8 == 7, F.lit('" "')).otherwise(F.concat(F.lit('"About '), "source", F.lit('"'))),
        F.lit(',"pageType":"'), F.when(i % 8 == 1, "MEMO").otherwise("HOWTO"), F.lit('","action":"MERGE","summary":"","tags":'), F.when(i % 8 == 6, "[1]").otherwise('["a"]'),
        F.lit(',"evidence":['), evidence_id, F.lit("]"), F.when(i % 8 == 3, ',"more":1').otherwise(""), F.lit("}"),
    ))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.array("doc_id").alias("asked"))
    found, reason = proposals.analysis("text", "asked")
    return rows.select("doc_id", found["title"].alias("title"), F.element_at(found["evidence"], 1).alias("evidence"), reason.alias("reason"))


def rebuild_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return proposals.rebuild_counts(table(spark, sf_dir, "events").select((i % 40).alias("job_id"), F.when(i % 5 == 0, "INELIGIBLE").when(i % 7 == 0, "FAILED").otherwise("FRESH").alias("outcome")))


def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors, some with components that are missing or not finite, or without any."""
    i = F.col("vec_id")
    given = F.col("embedding").cast("array<double>")
    damaged = F.when(i % 7 == 0, F.concat(given, F.array(F.lit(float("nan"))))).when(i % 11 == 0, F.concat(given, F.array(F.lit(None).cast("double")))).when(i % 13 == 0, F.array().cast("array<double>")).when(i % 17 == 0, F.array(F.lit(float("inf")))).otherwise(given)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", proposals.decoded_vector(damaged).alias("v"))
    return rows.select("vec_id", F.size("v").alias("components"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("length"))


def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads with names that repeat, are taken or are none, against those of one source as live documents."""
    i = F.col("doc_id")
    name = F.when(i % 41 == 0, "  ").when(i % 43 == 0, "a/..").otherwise(F.concat(F.lit("in\\f"), (i % 60).cast("string"), F.lit(".txt")))
    uploads = table(spark, sf_dir, "documents").select(i.alias("upload_id"), name.alias("file_name"), F.when(i % 47 != 0, F.encode("text", "UTF-8")).alias("content"))
    ids = table(spark, sf_dir, "documents").select((i % 60).alias("id")).distinct()
    used = ids.where("id % 3 = 0").select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("stored_name"))
    used = used.unionByName(ids.where("id % 5 = 0").select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("-1.txt")).alias("stored_name")))
    live = table(spark, sf_dir, "documents").where("source = 'src1'").select(i.alias("document_id"), X.sha256("text").alias("sha256"), F.when(i % 4 == 0, "DELETED").otherwise("PENDING").alias("status"))
    return ingest.landed(uploads, used, live).select("upload_id", "outcome", "reason", "stored_name", "file_size", "duplicate_of")


_UPLOADS = """WITH u AS (SELECT doc_id AS i, doc_id % 60 AS f, text, CASE WHEN doc_id % 47 = 0 THEN 'EMPTY' WHEN doc_id % 41 = 0 THEN 'BLANK_NAME' WHEN doc_id % 43 = 0 THEN 'INVALID_NAME' END AS reason FROM documents),
l AS (SELECT text, min(doc_id) AS live FROM documents WHERE source = 'src1' AND doc_id % 4 <> 0 GROUP BY 1),
g AS (SELECT i, f, u.text, live, row_number() OVER (PARTITION BY f ORDER BY i) AS turn, min(i) OVER (PARTITION BY u.text) AS first_upload FROM u LEFT JOIN l ON u.text = l.text WHERE reason IS NULL),
s AS (SELECT *, list_filter(range(0, turn + 3), lambda x: NOT (x = 0 AND f % 3 = 0 OR x = 1 AND f % 5 = 0))[turn] AS slot FROM g)
SELECT i AS upload_id, CASE WHEN live IS NOT NULL OR first_upload < i THEN 'DUPLICATE' ELSE 'STORED' END AS outcome, NULL AS reason, 'f' || f || CASE WHEN slot = 0 THEN '' ELSE '-' || slot END || '.txt' AS stored_name, CAST(strlen(text) AS BIGINT) AS file_size, live AS duplicate_of FROM s
UNION ALL SELECT i, 'REJECTED', reason, NULL, CASE WHEN reason = 'EMPTY' THEN 0 ELSE CAST(strlen(text) AS BIGINT) END, NULL FROM u WHERE reason IS NOT NULL"""


QUERIES = {f.__name__: f for f in (published_files, repair_plans, wiki_page_list, analysis_prompts, wiki_revalidation, graph_page_edges, match_order, projection_drift, analysis_contract, rebuild_totals, vector_codec, upload_outcomes)}

ORACLE = {
    "published_files": _FILES,
    "upload_outcomes": _UPLOADS,
    "analysis_contract": """WITH r AS (SELECT doc_id, source, CASE doc_id % 8 WHEN 1 THEN 'VALUE' WHEN 2 THEN 'EVIDENCE' WHEN 3 THEN 'FIELDS' WHEN 4 THEN 'TYPE' WHEN 5 THEN 'NOT_JSON' WHEN 6 THEN 'TYPE' WHEN 7 THEN 'VALUE' END AS reason FROM documents)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'About ' || source END AS title, CASE WHEN reason IS NULL THEN doc_id END AS evidence, reason FROM r""",
    "rebuild_totals": """SELECT event_id % 40 AS job_id, count(*) AS total, count(*) FILTER (event_id % 5 = 0) AS skipped, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS fresh, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 = 0) AS failed FROM events GROUP BY 1""",
    "vector_codec": """SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0 OR vec_id % 17 = 0 THEN NULL ELSE CAST(len(embedding) AS INTEGER) END AS components,
 CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0 OR vec_id % 17 = 0 THEN NULL ELSE round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))), 4) END AS length FROM embeddings""",
    "repair_plans": _REPAIRS,
    "wiki_page_list": """WITH p AS (SELECT 'k' || p_partkey AS knowledge_id, p_name FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 = 1)
SELECT knowledge_id, p_name, (SELECT count(*) FROM p) AS total, (SELECT CAST(ceil(count(*) / 30.0) AS BIGINT) FROM p) AS pages FROM p ORDER BY knowledge_id LIMIT 30 OFFSET 60""",
    "analysis_prompts": _PROMPTS,
    "wiki_revalidation": _WIKI_REVALIDATION,
    "graph_page_edges": f"{_page_edges_sql('DERIVED_FROM', 'SOURCE_DOCUMENT', 'document_id', _SOURCES)} UNION ALL {_page_edges_sql('TAGGED_WITH', 'TAG', 'tag', 'SELECT p_partkey AS knowledge_id, lower(p_brand) AS tag FROM part')}",
    "match_order": f"WITH {_bm25_sql(_DOCS, {'text': 1.0}, QUERY)} SELECT doc_id, round(bm25, 2) AS bm25 FROM hits ORDER BY round(bm25, 2), doc_id DESC LIMIT 25",
    "projection_drift": """SELECT s_suppkey AS kind, 1 AS generation, CASE WHEN s_suppkey % 3 = 0 THEN 'NOT_READY/BUILDING' WHEN s_suppkey % 5 = 0 THEN 'NOT_READY/NOT_BUILT' ELSE 'METADATA_DRIFT' END AS reason
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0""",
}
