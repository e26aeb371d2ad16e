"""Queries over the ingest, chunk, graph, wiki and lifecycle operators, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import chunks, digests, fusion, graph, ingest, lifecycle, wiki
from loreweave.plans.search_queries import _CHANNELS, _channels, table
from loreweave.sources.snapshots import Change, SnapshotStore
from loreweave.sources.tables import files_of, scratch_folder


def _inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of an inbox."""
    path = F.concat(F.lit("inbox/"), "source", F.lit("/"), (F.col("doc_id") % 997).cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang", "text", "n_chars", path.alias("source_path"), X.sha256("text").alias("sha256"))


def inbox_registration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.register(_inbox(spark, sf_dir).drop("text")).select("document_id", "status", "duplicate_of")


_REGISTERED = "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents"


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_clusters(ingest.register(_inbox(spark, sf_dir).drop("text")))


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.versions(_inbox(spark, sf_dir).select("document_id", "source_path"))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = _inbox(spark, sf_dir).select("document_id", "source_path")
    files = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("inbox/"), "source", F.lit("/"), (F.col("doc_id") % 997).cast("string"), F.lit(".txt")).alias("source_path")).distinct()
    return ingest.missing_files(inbox, files)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered documents with a parse status; labels stand for the index ledger and the last job item."""
    rows = ingest.register(_inbox(spark, sf_dir).drop("text"))
    parse = F.when(F.col("n_chars") < 100, "NEED_OCR").when(F.col("n_chars") % 17 == 0, "FAILED").when(F.col("n_chars") % 19 == 0, F.lit(None)).otherwise("PROCESSED")
    return rows.withColumn("parse_status", parse)


_PARSED = """SELECT doc_id AS document_id, n_chars, text, CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'DUPLICATE' ELSE 'PENDING' END AS status,
  CASE WHEN n_chars < 100 THEN 'NEED_OCR' WHEN n_chars % 17 = 0 THEN 'FAILED' WHEN n_chars % 19 = 0 THEN NULL ELSE 'PROCESSED' END AS parse_status FROM documents"""


def eligible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.eligible(_parsed(spark, sf_dir)).select("document_id", "n_chars")


def usability_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "SYNCED").when(F.col("toxic") == 1, "INELIGIBLE").otherwise("INDEX_PENDING").alias("sync_status"), (F.col("toxic") == 0).alias("fresh")
    )
    rows = _parsed(spark, sf_dir).join(ledger, "document_id", "left")
    rows = rows.withColumn("active_ingest", F.col("n_chars") % 23 == 0).withColumn("latest_ingest", F.when(F.col("n_chars") % 2 == 0, "FAILED"))
    return rows.select("document_id", ingest.usability().alias("usability"))


def inbox_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).withColumn("file_size", F.col("n_chars"))
    return ingest.inbox_page(rows, "fileSize", page=1, size=50, parse_status="PROCESSED").select("document_id", "source_path", "file_size", "status")


def _noisy() -> Column:
    return F.concat(F.lit("﻿"), F.col("text"), F.lit(" \t\r\n\r\n\r\n\rEnd­​."), F.lit("\x07\x85 \t"))


_NOISY_SQL = "chr(65279) || text || ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || 'End' || chr(173) || chr(8203) || '.' || chr(7) || chr(133) || ' ' || chr(9)"


def normalized_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _noisy().alias("raw")).select("doc_id", X.normalized("raw").alias("text"))
    return rows.select("doc_id", X.sha256("text").alias("hash"), F.length("text").alias("length"))


_NORMALIZED = rf"""WITH a AS (SELECT doc_id, nfc_normalize(replace(replace({_NOISY_SQL}, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(left(x, 1) || replace(substr(x, 2), chr(65279), ''), '[' || chr(173) || chr(8203) || chr(8288) || ']', '', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x, '[\x00-\x08\x0B\x0D-\x1F\x7F-\x{{9F}}]', '', 'g') AS x FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[\t ]+(\n|\f|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM c)
SELECT doc_id, sha256(x) AS hash, CAST(length(x) AS INTEGER) AS length FROM d"""


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, cut = X.truncated("text", 1600)
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.length("text")).alias("tokens"), X.sha256(head).alias("head_hash"), cut.alias("cut"))


def preview_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.previews("text")).alias("slice_no", "slice"))
    return rows.select("doc_id", "slice_no", X.sha256("slice").alias("hash"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as its paragraphs."""
    content = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return chunks.blocks(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id", "content")


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("doc_id", "block_no", "page_no", "kind", X.sha256("text").alias("hash"))


_BLOCKS = r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM s),
b AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS block_no, text FROM t WHERE text <> '')"""


def _paged() -> Column:
    """Every fourth line ends a page; pages of a document share a header, and those of even ids a footer."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 4).cast("int")), lambda i: F.array_join(F.slice(lines, i * 4 + 1, 4), "\n"))
    marked = F.transform(pages, lambda p, i: F.concat(F.lit(" \nReport\n"), p, F.when(F.col("doc_id") % 2 == 0, F.lit("\nconfidential\n\t")).otherwise(F.concat(F.lit("\np. "), i.cast("string")))))
    return F.array_join(marked, "\f")


def page_edges_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _paged().alias("paged"))
    clean = X.normalized("paged", compose=False, edges=True)
    return rows.select("doc_id", X.sha256(clean).alias("hash"), F.length(clean).alias("length"))


_EDGES_REMOVED = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
p AS (SELECT doc_id, n, CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'confidential' || chr(10) || chr(9) ELSE chr(10) || 'p. ' || n END AS tail, ' ' || chr(10) || 'Report' || chr(10) || array_to_string(x[n * 4 + 1 : n * 4 + 4], chr(10)) || tail AS page
  FROM (SELECT doc_id, x, unnest(range((len(x) - 1) // 4 + 1)) AS n FROM l)),
c AS (SELECT doc_id, n, regexp_replace(regexp_replace(page, '[\x00-\x08\x0B\x0D-\x1F\x7F-\x{9F}' || chr(173) || chr(8203) || chr(8288) || ']', '', 'g'), '[\t ]+(\n|$)', '\1', 'g') AS page FROM p),
s AS (SELECT doc_id, n, unnest(string_split(page, chr(10))) AS line, unnest(range(len(string_split(page, chr(10))))) AS i FROM c),
e AS (SELECT doc_id, n, min(i) AS a, max(i) AS b FROM s WHERE regexp_matches(line, '\S') GROUP BY ALL),
h AS (SELECT s.doc_id, line FROM s JOIN e ON s.doc_id = e.doc_id AND s.n = e.n AND i = a GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT s.doc_id, line FROM s JOIN e ON s.doc_id = e.doc_id AND s.n = e.n AND i = b GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT s.* FROM s LEFT JOIN e ON s.doc_id = e.doc_id AND s.n = e.n LEFT JOIN h ON s.doc_id = h.doc_id AND s.line = h.line LEFT JOIN f ON s.doc_id = f.doc_id AND s.line = f.line
  WHERE NOT (coalesce(i = a, false) AND h.line IS NOT NULL) AND NOT (coalesce(i = b, false) AND f.line IS NOT NULL)),
g AS (SELECT doc_id, n, string_agg(line, chr(10) ORDER BY i) AS page FROM k GROUP BY ALL),
w AS (SELECT doc_id, regexp_replace(string_agg(page, chr(12) ORDER BY n), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM g GROUP BY doc_id)
SELECT doc_id, sha256(x) AS hash, CAST(length(x) AS INTEGER) AS length FROM w"""


def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.replace(F.col("text"), F.lit("\n"), F.lit("\f"))
    return chunks.edge_lines(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id", "content")


def chunk_policy_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_paragraphs(spark, sf_dir)).select("doc_id", "chunk_no", "page_no", "heading_path", "content_hash")


_CHUNKS = f"""WITH RECURSIVE {_BLOCKS[5:]},
c AS (SELECT doc_id, block_no, text, 1 AS chunk_no, length(text) AS units FROM b WHERE block_no = 1
 UNION ALL SELECT b.doc_id, b.block_no, b.text, CASE WHEN c.units + 2 + length(b.text) > 3000 THEN c.chunk_no + 1 ELSE c.chunk_no END,
 CASE WHEN c.units + 2 + length(b.text) > 3000 THEN length(b.text) ELSE c.units + 2 + length(b.text) END FROM c JOIN b ON b.doc_id = c.doc_id AND b.block_no = c.block_no + 1)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, 1 AS page_no, CAST(NULL AS VARCHAR) AS heading_path, sha256(string_agg(text, chr(10) || chr(10) ORDER BY block_no)) AS content_hash FROM c GROUP BY doc_id, chunk_no"""


def chunk_policy_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading-anchored chunks; short lines become headings."""
    content = F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), r"(?m)^(.{1,20})$", "## $1")
    own = chunks.blocks(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id", "content")
    return chunks.chunk(own, "chunk-policy-v2-heading-anchored").select("doc_id", "chunk_no", "heading_path", "content_hash")


_HEADED = r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(CASE WHEN length(raw) BETWEEN 1 AND 20 THEN '## ' || raw ELSE raw END, '^\s+|\s+$', '', 'g') AS text FROM s),
h AS (SELECT *, regexp_matches(text, '^[\t ]{0,3}#{1,6}[\t ]+.+$') AS head, trim(regexp_extract(text, '^[\t ]{0,3}(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$', 2)) AS title FROM t WHERE text <> ''),
b AS (SELECT doc_id, text, head, title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_no FROM h),
c AS (SELECT doc_id, block_no, text, 1 AS chunk_no, length(text) AS units, head AS fresh, CASE WHEN head THEN title END AS title FROM b WHERE block_no = 1
 UNION ALL SELECT b.doc_id, b.block_no, b.text, CASE WHEN b.head OR NOT fresh AND units + 2 + length(b.text) > 3000 THEN chunk_no + 1 ELSE chunk_no END,
 CASE WHEN b.head OR NOT fresh AND units + 2 + length(b.text) > 3000 THEN length(b.text) ELSE units + 2 + length(b.text) END, b.head, CASE WHEN b.head THEN b.title ELSE c.title END FROM c JOIN b ON b.doc_id = c.doc_id AND b.block_no = c.block_no + 1)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, nullif(max(title), '') AS heading_path, sha256(string_agg(text, chr(10) || chr(10) ORDER BY block_no)) AS content_hash FROM c GROUP BY doc_id, chunk_no"""


def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_no"), "role", "text", X.sha256("text").alias("content_hash")).distinct()
    return lifecycle.document_fingerprint(rows, fields=("chunk_no", "role", "text", "content_hash"))


_FINGERPRINT = """WITH r AS (SELECT DISTINCT conv_id, turn, role, text, sha256(text) AS h FROM conversations),
p AS (SELECT conv_id, turn, strlen(CAST(turn AS VARCHAR)) || ':' || turn || ';' || strlen(role) || ':' || role || ';' || strlen(text) || ':' || text || ';' || strlen(h) || ':' || h || ';' AS row FROM r)
SELECT conv_id AS document_id, CAST(count(*) AS BIGINT) AS chunks, sha256(string_agg(row, '' ORDER BY turn, row)) AS fingerprint FROM p GROUP BY conv_id"""


def stale_policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("turn") % 7 == 3, "chunk-policy-v0").otherwise("chunk-policy-v1-current")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), version.alias("version"))
    return rows.where("version <> 'chunk-policy-v1-current'").select("document_id").distinct()


def _entities(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    keys = {"WORKSPACE": ("region", "r_regionkey"), "TAG": ("nation", "n_nationkey"), "SOURCE_DOCUMENT": ("customer", "c_custkey"), "SOURCE_CHUNK": ("orders", "o_orderkey")}
    return {kind: (table(spark, sf_dir, name), key) for kind, (name, key) in keys.items()}


def _graph_edges(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Regions contain nations, customers are linked from nations, orders (all, or these) are their chunks."""
    nation, customer = (table(spark, sf_dir, t) for t in ("nation", "customer"))
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    out = graph.edges(1, "CONTAINS", nation, ("WORKSPACE", "n_regionkey"), ("TAG", "n_nationkey"))
    out = out.unionByName(graph.edges(1, "LINKS_TO", customer, ("TAG", "c_nationkey"), ("SOURCE_DOCUMENT", "c_custkey")))
    return out.unionByName(graph.edges(1, "CONTAINS", orders, ("SOURCE_DOCUMENT", "o_custkey"), ("SOURCE_CHUNK", "o_orderkey")))


def _prefixed(*parts: str) -> str:
    return " || ".join(f"strlen({p}) || ':' || {p} || ';'" for p in parts)


def _entity_sql(kind: str, key: str) -> str:
    return f"'ge1_' || sha256({_prefixed(chr(39) + 'graph-identity-v1' + chr(39), chr(39) + 'entity' + chr(39), chr(39) + '1' + chr(39), chr(39) + kind + chr(39), f'CAST({key} AS VARCHAR)')})"


def _edge_sql(relation: str, source: tuple[str, str], target: tuple[str, str], name: str) -> str:
    rid = f"'gr1_' || sha256({_prefixed(chr(39) + 'graph-identity-v1' + chr(39), chr(39) + 'relation' + chr(39), chr(39) + '1' + chr(39), 's', chr(39) + relation + chr(39), 't')})"
    return f"SELECT {rid} AS relation_id, '{relation}' AS relation_type, s AS source_id, t AS target_id FROM (SELECT DISTINCT {_entity_sql(*source)} AS s, {_entity_sql(*target)} AS t FROM {name})"


_VERTICES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT {_entity_sql(kind, key)} AS entity_id, '{kind}' AS entity_type, CAST({key} AS VARCHAR) AS key FROM {name}"
    for kind, name, key in (("WORKSPACE", "region", "r_regionkey"), ("TAG", "nation", "n_nationkey"), ("SOURCE_DOCUMENT", "customer", "c_custkey"), ("SOURCE_CHUNK", "orders", "o_orderkey"))
)
_EDGES_SQL = " UNION ALL ".join(
    (
        _edge_sql("CONTAINS", ("WORKSPACE", "n_regionkey"), ("TAG", "n_nationkey"), "nation"),
        _edge_sql("LINKS_TO", ("TAG", "c_nationkey"), ("SOURCE_DOCUMENT", "c_custkey"), "customer"),
        _edge_sql("CONTAINS", ("SOURCE_DOCUMENT", "o_custkey"), ("SOURCE_CHUNK", "o_orderkey"), "orders"),
    )
)


def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(1, **_entities(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_edges(spark, sf_dir)


def graph_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the vertices of only those customers who owe nothing."""
    entities = _entities(spark, sf_dir)
    entities["SOURCE_DOCUMENT"] = (entities["SOURCE_DOCUMENT"][0].where("c_acctbal >= 0"), "c_custkey")
    return graph.defects(graph.vertices(1, **entities), _graph_edges(spark, sf_dir))


def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _channels(spark, sf_dir)
    return graph.seeds(fusion.fuse([c["LEXICAL"], c["VECTOR"]], digits=9))


_SEEDS = f"""{_CHANNELS}, f AS (SELECT CAST(doc_id AS VARCHAR) AS stable_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ch WHERE c <> 'GRAPH' GROUP BY doc_id)
SELECT stable_id FROM (SELECT * FROM f ORDER BY score DESC, stable_id LIMIT 16) ORDER BY stable_id"""


def _region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(1, WORKSPACE=(table(spark, sf_dir, "region").where("r_regionkey in (0, 3)"), "r_regionkey"))


_GRAPHS: dict[tuple, SnapshotStore] = {}


def graph_store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The stored graph of these tables; the first query of a session that needs it writes it."""
    key = (spark.sparkContext.applicationId, *(files_of(spark, f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "orders")))
    if key not in _GRAPHS:
        _GRAPHS[key] = graph.store(spark, f"{scratch_folder(spark)}/loreweave-graph-{uuid.uuid4().hex}")
        _GRAPHS[key].commit({"vertices": Change(graph.vertices(1, **_entities(spark, sf_dir))), "adjacency": Change(_graph_edges(spark, sf_dir))})
    return _GRAPHS[key]


def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = graph_store(spark, sf_dir)
    return graph.reachable(kept.read(kept.snapshot(), "adjacency"), _region_ids(spark, sf_dir), 3)


_REACHABLE = f"""WITH RECURSIVE e AS ({_EDGES_SQL}), r AS (SELECT DISTINCT {_entity_sql("WORKSPACE", "r_regionkey")} AS entity_id, 0 AS depth FROM region WHERE r_regionkey IN (0, 3)
 UNION SELECT target_id, depth + 1 FROM r JOIN e ON source_id = entity_id WHERE depth < 3)
SELECT entity_id, min(depth) AS depth FROM r GROUP BY entity_id"""


def graph_bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = [r["entity_id"] for r in _region_ids(spark, sf_dir).collect()]  # two seeds
    kept = graph_store(spark, sf_dir)
    pinned = kept.snapshot()
    found = graph.traverse_pinned(kept, pinned, starts)
    rows = spark.createDataFrame(found.candidates, "seed_id string, entity_id string, depth int, path array<string>")
    return graph.admitted(rows, kept.read(pinned, "vertices", keys=[c[1] for c in found.candidates])).select("seed_id", "entity_id", "depth", F.size("path").alias("steps"), "entity_type", "rejection")


_BFS = f"""WITH e AS ({_EDGES_SQL}), v AS ({_VERTICES_SQL}), s AS (SELECT DISTINCT {_entity_sql("WORKSPACE", "r_regionkey")} AS id FROM region WHERE r_regionkey IN (0, 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY relation_type, target_id, relation_id) AS turn FROM e),
h1 AS (SELECT id AS seed, target_id, row_number() OVER (ORDER BY id, turn) AS pos FROM o JOIN s ON source_id = id WHERE turn <= 8),
f1 AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM (SELECT DISTINCT ON (target_id) * FROM h1 WHERE target_id NOT IN (SELECT id FROM s) ORDER BY target_id, pos)),
l1 AS (SELECT least(32 - (SELECT count(*) FROM s), 16) AS room, least((SELECT coalesce(min(pos), 999) FROM f1 WHERE n = least(32 - (SELECT count(*) FROM s), 16) + 1), 16 + 1) AS stop),
c1 AS (SELECT f1.* FROM f1, l1 WHERE n <= room AND pos < stop),
u AS (SELECT least(16, 32 - (SELECT count(*) FROM h1, l1 WHERE pos <= least(stop, 16))) AS left_edges, least(32 - (SELECT count(*) FROM s), 16) - (SELECT count(*) FROM c1) AS room, (SELECT stop <= 16 FROM l1) AS ended),
h2 AS (SELECT seed, o.target_id, row_number() OVER (ORDER BY n, turn) AS pos FROM o JOIN c1 ON source_id = c1.target_id WHERE turn <= 8),
f2 AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM (SELECT DISTINCT ON (target_id) * FROM h2 WHERE target_id NOT IN (SELECT id FROM s) AND target_id NOT IN (SELECT target_id FROM c1) ORDER BY target_id, pos)),
c2 AS (SELECT f2.* FROM f2, u WHERE n <= room AND pos <= left_edges AND NOT ended),
c AS (SELECT seed, target_id, 1 AS depth FROM c1 UNION ALL SELECT seed, target_id, 2 FROM c2)
SELECT seed AS seed_id, target_id AS entity_id, depth, depth AS steps, entity_type, CASE entity_type WHEN 'TAG' THEN 'NON_EVIDENCE_ENTITY' WHEN 'SOURCE_DOCUMENT' THEN 'NON_CITATION_AUTHORITY' END AS rejection FROM c LEFT JOIN v ON target_id = entity_id"""


_ROW = _prefixed("relation_id", "relation_type", "source_id", "target_id")
_GRAPH_DIGEST = f"SELECT digest AS fingerprint FROM ({digests.ordered_sql(f'SELECT relation_id AS key, sha256({_ROW}) AS value FROM ({_EDGES_SQL})')})"


def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fingerprint(_graph_edges(spark, sf_dir), "relation_id", "relation_type", "source_id", "target_id")


def _type() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in ("en", "CONCEPT", "fr", "HOWTO", "de", "PERSON", "es", "DECISION")]), F.col("lang"))


_TYPE_SQL = "CASE lang WHEN 'en' THEN 'CONCEPT' WHEN 'fr' THEN 'HOWTO' WHEN 'de' THEN 'PERSON' WHEN 'es' THEN 'DECISION' END"


def title_slug_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(title).alias("stem"), X.wiki_path(_type(), title).alias("path"))


_SLUG = rf"""WITH t AS (SELECT doc_id, {_TYPE_SQL} AS type, regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g')), '\s+', '-', 'g') AS a FROM documents),
u AS (SELECT doc_id, type, regexp_replace(regexp_replace(regexp_replace(a, '[^\p{{L}}\p{{N}}\-_]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM t),
v AS (SELECT doc_id, type, nullif(regexp_replace(substr(b, 1, 200), '-+$', ''), '') AS stem FROM u)
SELECT doc_id, stem, 'vault/' || CASE type WHEN 'CONCEPT' THEN 'concepts' WHEN 'HOWTO' THEN 'howtos' WHEN 'PERSON' THEN 'people' WHEN 'DECISION' THEN 'decisions' END || '/' || stem || '.md' AS path FROM v"""


def wikilink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("See [["), "p_name", F.lit("|this]], [["), "p_brand", F.lit("]] and [[ "), "p_name", F.lit("  ]].")).alias("body")
    rows = table(spark, sf_dir, "part").select("p_partkey", body)
    return rows.select("p_partkey", F.posexplode(X.wikilinks("body")).alias("ord", "target"))


def tag_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.split(F.concat_ws(",", "p_name", F.upper("p_brand"), "p_type", F.lit("  ")), "[ ,]")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tags(own), "|").alias("tags"))


def _wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as wiki pages: the title and link targets; some repeat an id, are damaged or name a proposal."""
    own = [F.concat(F.lit("page "), n.cast("string")) for n in (F.col("page_id") - F.col("page_id") % 4, F.col("page_id") * 3)]
    links = F.array_distinct(F.concat(F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda t: F.lower(t)), F.array(*own)))
    knowledge = F.concat(F.lit("k"), F.when(F.col("page_id") % 50 == 0, F.col("page_id") + 1).otherwise(F.col("page_id")).cast("string"))
    title = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Page  "), F.col("page_id").cast("string"))).otherwise(F.regexp_extract("html", r"<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select(
        "page_id", knowledge.alias("knowledge_id"), title.alias("title"), links.alias("targets"),
        F.when(F.col("page_id") % 7 == 0, "INVALID").when(F.col("page_id") % 11 == 0, "UNREADABLE").otherwise("VALID").alias("content_status"), F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("proposal_id"),
    )


def vault_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("proposal_id"))
    return wiki.lint(_wiki_pages(spark, sf_dir), proposals)


_PAGES_SQL = r"""p AS (SELECT page_id, 'k' || CASE WHEN page_id % 50 = 0 THEN page_id + 1 ELSE page_id END AS knowledge_id,
  lower(trim(regexp_replace(CASE WHEN page_id % 4 = 0 THEN 'Page  ' || page_id ELSE regexp_extract(html, '<title>([^<]*)', 1) END, '\s+', ' ', 'g'))) AS title_key,
  list_distinct(list_concat(list_transform(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda t: lower(t)), ['page ' || (page_id - page_id % 4), 'page ' || (page_id * 3)])) AS targets, CASE WHEN page_id % 7 = 0 THEN 'INVALID' WHEN page_id % 11 = 0 THEN 'UNREADABLE' ELSE 'VALID' END AS content_status, CASE WHEN page_id % 3 = 0 THEN page_id END AS proposal_id FROM pages),
l AS (SELECT knowledge_id, page_id, title_key, target FROM (SELECT knowledge_id, page_id, title_key, unnest(targets) AS target FROM p WHERE content_status = 'VALID') WHERE target <> title_key)"""
_LINT = f"""WITH {_PAGES_SQL}
SELECT knowledge_id, 'DUPLICATE_IDENTITY' AS code, 'ERROR' AS severity, 'duplicate knowledgeId in workspace' AS detail FROM p WHERE knowledge_id IN (SELECT knowledge_id FROM p GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT knowledge_id, 'CANONICAL_CONTENT_INVALID', 'ERROR', 'content does not match its metadata' FROM p WHERE content_status = 'INVALID'
UNION ALL SELECT knowledge_id, 'CANONICAL_CONTENT_UNREADABLE', 'ERROR', 'content could not be read' FROM p WHERE content_status = 'UNREADABLE'
UNION ALL SELECT knowledge_id, 'BROKEN_INTERNAL_LINK', 'ERROR', 'wikilink target not published: ' || target FROM l WHERE target NOT IN (SELECT title_key FROM p)
UNION ALL SELECT knowledge_id, 'ORPHAN_PAGE', 'WARNING', 'no inbound reference from other published pages' FROM p WHERE title_key NOT IN (SELECT target FROM l)
UNION ALL SELECT knowledge_id, 'DANGLING_PROVENANCE', 'WARNING', 'referenced proposal is missing from the workspace' FROM p WHERE proposal_id IS NOT NULL AND proposal_id NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.links_to(_wiki_pages(spark, sf_dir), "page_id", "title", "targets")


_LINKS = f"""WITH {_PAGES_SQL}, u AS (SELECT title_key, min(page_id) AS target_page FROM p GROUP BY 1 HAVING count(*) = 1),
a AS (SELECT page_id AS source_page, unnest(targets) AS target FROM p)
SELECT DISTINCT source_page, target_page FROM a JOIN u ON target = title_key WHERE source_page <> target_page"""


def wiki_target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as draft titles, against pages named by the parts of other sizes."""
    parts = table(spark, sf_dir, "part")
    pages = parts.where("p_size % 2 = 0").select(F.col("p_type").alias("title"), F.substring("p_brand", 1, 7).alias("page_type"), F.col("p_partkey").cast("string").alias("knowledge_id"))
    drafts = parts.select("p_partkey", F.upper("p_type").alias("target_title"), F.substring("p_brand", 1, 7).alias("page_type"), F.when(F.col("p_partkey") % 3 == 0, "CREATE").otherwise("MERGE").alias("action"))
    return wiki.resolve_target(drafts, pages).select("p_partkey", "resolution")


_RESOLVE = """WITH g AS (SELECT lower(p_type) AS k, count(*) AS n, min(substr(p_brand, 1, 7)) AS t FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN n IS NULL THEN 'CREATE' ELSE 'ALREADY_EXISTS' END
  WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN t <> substr(p_brand, 1, 7) THEN 'TYPE_MISMATCH' ELSE 'MERGE' END AS resolution
FROM part LEFT JOIN g ON lower(p_type) = k"""


def tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    analyses = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").alias("analysed_at"))
    candidates = orders.select(F.col("o_orderkey").alias("analysis_id"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    documents = customers.select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("1995-06-01").cast("timestamp")).otherwise(F.lit("1990-01-01").cast("timestamp")).alias("updated_at"))
    return wiki.tag_suggestions(candidates, analyses, documents).select("document_id", F.array_join("tags", "|").alias("tags"), "freshness")


_SUGGEST = """WITH l AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), o AS (SELECT o.* FROM orders o JOIN l ON o.o_orderkey = l.k AND o.o_custkey = l.o_custkey),
d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1995-06-01' ELSE TIMESTAMP '1990-01-01' END AS u FROM customer)
SELECT c_custkey AS document_id, coalesce(array_to_string(list_sort([lower(o_orderpriority), lower(o_orderstatus)]), '|'), '') AS tags,
  CASE WHEN o_orderdate IS NULL THEN 'NO_ANALYSIS' WHEN u > o_orderdate THEN 'DOCUMENT_CHANGED_AFTER_ANALYSIS' ELSE 'CURRENT' END AS freshness FROM d LEFT JOIN o ON c_custkey = o_custkey"""


def latest_proposal_per_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("proposal_id"), F.col("event_type").alias("status"))
    return wiki.latest_per_key(rows, "candidate_id", "proposal_id")


def reviewable_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("document_id"))
    documents = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < 0, "DELETED").otherwise("PROCESSED").alias("status"))
    return wiki.reviewable(proposals, documents).select("proposal_id", "document_id")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return lifecycle.job_progress(table(spark, sf_dir, "events"), "user_id", "event_type", {"succeeded": kind == "purchase", "failed": kind == "error", "skipped": kind == "view"})


def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an index that misses, holds stale and keeps orphaned rows."""
    documents = table(spark, sf_dir, "documents").select("doc_id", X.sha256("text").alias("hash"))
    stale = F.when(F.col("doc_id") % 13 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash")
    projection = documents.where("doc_id % 11 <> 0").select("doc_id", stale).unionByName(table(spark, sf_dir, "labels").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("gone").alias("hash")))
    return lifecycle.index_health(documents, projection, "doc_id", ("hash",))


_HEALTH = """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 1000000000, 'gone' FROM labels),
s AS (SELECT count(p.doc_id) AS indexed, count(*) FILTER (WHERE p.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AND h <> sha256(text)) AS stale,
 count(*) FILTER (WHERE d.doc_id IS NULL) AS orphan, CAST(0 AS BIGINT) AS failed FROM documents d FULL JOIN p ON d.doc_id = p.doc_id)
SELECT *, CASE WHEN failed > 0 THEN 'DEGRADED' WHEN missing + stale + orphan > 0 THEN 'REBUILD_REQUIRED' ELSE 'HEALTHY' END AS status FROM s"""


def dangling_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    identities = table(spark, sf_dir, "documents").select("doc_id", "source")
    return lifecycle.dangling(identities, table(spark, sf_dir, "labels"), "doc_id")


def diagnostic_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.col("event_type"), F.lit("\n password: p"), F.col("user_id").cast("string"), F.lit(", file /var/log/u"), F.col("user_id").cast("string"), F.lit("/x.txt in /tmp sk-abcdefgh"), F.col("event_id").cast("string"),
        F.when(F.col("event_id") % 10 == 0, " SELECT a FROM b").otherwise(" done"),
    )
    return table(spark, sf_dir, "events").select("event_id", X.redacted(raw, "failed").alias("message"))


_REDACTION = r"""WITH r AS (SELECT event_id, event_type || chr(10) || ' password: p' || user_id || ', file /var/log/u' || user_id || '/x.txt in /tmp sk-abcdefgh' || event_id || CASE WHEN event_id % 10 = 0 THEN ' SELECT a FROM b' ELSE ' done' END AS m FROM events),
a AS (SELECT event_id, trim(regexp_replace(m, '[\r\n\t]+', ' ', 'g')) AS m FROM r),
b AS (SELECT event_id, regexp_replace(m, '(?i)(api[-_ ]?key|authorization|token|secret|password)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+', '\1=[REDACTED]', 'g') AS m FROM a),
c AS (SELECT event_id, regexp_replace(m, '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g') AS m FROM b),
d AS (SELECT event_id, regexp_replace(m, '(^|[\s:=("''])/(?:[A-Za-z0-9._@-]+/)+[A-Za-z0-9._@-]*', '\1[REDACTED]', 'g') AS m FROM c),
e AS (SELECT event_id, regexp_replace(m, '(^|[\s:=("''])/(?:Users|home|var|tmp|private|opt|usr|etc|srv)($|[\s/.,:;)"])', '\1[REDACTED]\2', 'g') AS m FROM d)
SELECT event_id, CASE WHEN regexp_matches(m, '(?i)\bSELECT\s+.+\bFROM\b|\bexception\b') THEN 'failed' ELSE substr(m, 1, 500) END AS message FROM e"""


QUERIES = {
    f.__name__: f
    for f in (
        inbox_registration_status, duplicate_clusters, document_versions, missing_files, eligible_documents, usability_state, inbox_listing_page, normalized_text_hash,
        text_measures, preview_slices, paragraph_blocks, repeated_edge_lines, page_edges_removed, chunk_policy_v1, chunk_policy_v2, document_fingerprint, stale_policy_documents,
        graph_vertices, graph_edges, graph_defects, graph_seeds, graph_reachability, graph_bounded_bfs, graph_fingerprint, title_slug_path, wikilink_targets,
        tag_normalization, vault_lint, page_links, wiki_target_resolution, tag_suggestions, latest_proposal_per_candidate, reviewable_proposals, job_progress,
        index_health, dangling_identities, diagnostic_redaction,
    )
}

_PATH = "'inbox/' || source || '/' || (doc_id % 997) || '.txt'"
ORACLE = {
    "page_edges_removed": _EDGES_REMOVED,
    "inbox_registration_status": f"SELECT document_id, CASE WHEN first_id < document_id THEN 'DUPLICATE' ELSE 'PENDING' END AS status, CASE WHEN first_id < document_id THEN first_id END AS duplicate_of FROM ({_REGISTERED})",
    "duplicate_clusters": f"SELECT first_id AS canonical_id, CAST(count(*) AS BIGINT) AS copies, min(document_id) AS promoted_id FROM ({_REGISTERED}) WHERE first_id < document_id GROUP BY 1",
    "document_versions": f"SELECT doc_id AS document_id, {_PATH} AS source_path, lag(doc_id) OVER w AS parent_version, lead(doc_id) OVER w IS NOT NULL AS superseded FROM documents WINDOW w AS (PARTITION BY {_PATH} ORDER BY doc_id)",
    "missing_files": f"SELECT {_PATH} AS source_path, doc_id AS document_id, 'DELETED' AS status FROM documents WHERE {_PATH} NOT IN (SELECT {_PATH} FROM documents WHERE doc_id % 5 <> 0)",
    "eligible_documents": f"SELECT document_id, n_chars FROM ({_PARSED}) WHERE parse_status = 'PROCESSED' AND status NOT IN ('DELETED', 'SUPERSEDED', 'DUPLICATE')",
    "usability_state": f"""SELECT document_id, CASE WHEN status = 'DUPLICATE' THEN 'DUPLICATE' WHEN n_chars % 23 = 0 THEN 'PROCESSING'
 WHEN parse_status IS NULL THEN CASE WHEN n_chars % 2 = 0 THEN 'FAILED' ELSE 'NOT_PROCESSED' END WHEN parse_status = 'NEED_OCR' THEN parse_status WHEN parse_status <> 'PROCESSED' THEN 'FAILED'
 WHEN l.doc_id IS NULL THEN 'INDEX_PENDING' WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'READY_TO_USE' ELSE 'INDEX_STALE' END WHEN toxic = 1 THEN 'NOT_SEARCHABLE' ELSE 'INDEX_PENDING' END AS usability
 FROM ({_PARSED}) p LEFT JOIN labels l ON p.document_id = l.doc_id""",
    "inbox_listing_page": f"SELECT document_id, {_PATH.replace('doc_id', 'document_id')} AS source_path, p.n_chars AS file_size, status FROM ({_PARSED}) p JOIN documents d ON d.doc_id = p.document_id WHERE parse_status = 'PROCESSED' ORDER BY p.n_chars DESC, document_id DESC LIMIT 50 OFFSET 50",
    "normalized_text_hash": _NORMALIZED,
    "text_measures": "SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS tokens, sha256(substr(text, 1, 1600)) AS head_hash, length(text) > 1600 AS cut FROM documents",
    "preview_slices": "SELECT doc_id, CAST(i AS INTEGER) AS slice_no, sha256(substr(text, i * 2000 + 1, 2000)) AS hash FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2000) AS BIGINT))) AS i FROM documents)",
    "paragraph_blocks": f"{_BLOCKS} SELECT doc_id, block_no, 1 AS page_no, 'PARAGRAPH' AS kind, sha256(text) AS hash FROM b",
    "repeated_edge_lines": r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE len(string_split(text, chr(10))) >= 2),
g AS (SELECT doc_id, line, count(*) AS pages FROM s WHERE trim(regexp_replace(line, '\s', ' ', 'g')) <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, e AS edge, line, CAST(pages AS BIGINT) AS pages FROM g, (VALUES ('header'), ('footer')) v(e)""",
    "chunk_policy_v1": _CHUNKS,
    "document_fingerprint": _FINGERPRINT,
    "chunk_policy_v2": _HEADED,
    "stale_policy_documents": "SELECT DISTINCT conv_id AS document_id FROM conversations WHERE turn % 7 = 3",
    "graph_vertices": _VERTICES_SQL,
    "graph_edges": _EDGES_SQL,
    "graph_defects": f"""WITH e AS ({_EDGES_SQL}), v AS (SELECT entity_id FROM ({_VERTICES_SQL}) WHERE entity_type <> 'SOURCE_DOCUMENT' OR key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0))
SELECT DISTINCT 'ORPHAN_RELATION' AS defect, relation_id AS id FROM e WHERE source_id NOT IN (SELECT entity_id FROM v) OR target_id NOT IN (SELECT entity_id FROM v)""",
    "graph_seeds": _SEEDS,
    "graph_reachability": _REACHABLE,
    "graph_fingerprint": _GRAPH_DIGEST,
    "graph_bounded_bfs": _BFS,
    "title_slug_path": _SLUG,
    "wikilink_targets": r"""WITH b AS (SELECT p_partkey, list_distinct([lower(trim(p_name)), lower(trim(p_brand))]) AS d, lower(trim(p_name)) AS a, lower(trim(p_brand)) AS c FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS ord, CASE WHEN i = 0 THEN a ELSE c END AS target FROM (SELECT *, unnest(range(len(d))) AS i FROM b)""",
    "tag_normalization": r"""WITH t AS (SELECT p_partkey, string_split_regex(p_name || ',' || upper(p_brand) || ',' || p_type || ',  ', '[ ,]') AS x FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(x, lambda s: lower(trim(s))), lambda s: s <> '' AND length(s) <= 80)))[1:50], '|') AS tags FROM t""",
    "vault_lint": _LINT,
    "page_links": _LINKS,
    "wiki_target_resolution": _RESOLVE,
    "tag_suggestions": _SUGGEST,
    "latest_proposal_per_candidate": "SELECT user_id AS candidate_id, max(event_id) AS proposal_id, arg_max(event_type, event_id) AS status FROM events WHERE event_type <> 'click' GROUP BY 1",
    "reviewable_proposals": """SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 4 <> 0
WHERE o_orderkey % 4 = 0 OR (c_custkey IS NOT NULL AND c_custkey % 10 <> 9 AND c_acctbal >= 0)""",
    "job_progress": "SELECT user_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS skipped FROM events GROUP BY 1",
    "index_health": _HEALTH,
    "dangling_identities": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "diagnostic_redaction": _REDACTION,
}
