"""Queries over the search, fusion and evidence operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import evidence, fusion, lexical, vector
from loreweave.sources.tables import files_of

QUERY, WIKI_QUERY = "by from", "the and"
QUESTION = "the order of ERR-1234 by from and"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer splits than there are cores (one small file, one row group) are spread first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "conversations", "pages") and rows.rdd.getNumPartitions() < min(cores, 64):
        return rows.repartition(cores)
    return rows


def _tokens_sql(column: str) -> str:
    return rf"list_transform(regexp_extract_all({column}, '[\p{{L}}\p{{Nd}}\p{{M}}]+'), lambda t: strip_accents(lower(t)))"


def _bm25_sql(source: str, columns: dict[str, float], query: str) -> str:
    """CTEs that end in ``hits(doc_id, bm25)``."""
    terms = [X.folded_term(t) for t in lexical.query_terms(query)]
    distinct = list(dict.fromkeys(terms))
    lists = ", ".join(f"{_tokens_sql(c)} AS t_{c}" for c in columns)
    length = " + ".join(f"len(t_{c})" for c in columns)
    count = lambda c, t: f"len(list_filter(t_{c}, lambda x: x = '{t}'))"
    plain = ", ".join(" + ".join(count(c, t) for c in columns) + f" AS n{i}" for i, t in enumerate(distinct))
    weighted = ", ".join(" + ".join(f"{w} * {count(c, t)}" for c, w in columns.items()) + f" AS f{i}" for i, t in enumerate(distinct))
    frequencies = ", ".join(f"sum(CASE WHEN n{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(distinct)))
    score = " + ".join(
        f"(CASE WHEN ln((N - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - df{i} + 0.5) / (df{i} + 0.5)) END) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len))"
        for i in (distinct.index(t) for t in terms)
    )
    held = " AND ".join(f"n{i} > 0" for i in range(len(distinct)))
    return f"""src AS ({source}), tok AS (SELECT doc_id, {lists} FROM src),
cnt AS (SELECT doc_id, CAST({length} AS DOUBLE) AS len, {plain}, {weighted} FROM tok),
st AS (SELECT count(*) AS N, avg(len) AS avg_len, {frequencies} FROM cnt),
hits AS (SELECT doc_id, round(-({score}), 6) AS bm25 FROM cnt, st WHERE {held})"""


_DOCS = "SELECT doc_id, text FROM documents"
_TITLED_SQL = "SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents"


def titled(documents: DataFrame) -> DataFrame:
    """Documents as pages: the first line is the title."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return documents.select("doc_id", title.alias("title"), F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("body"))


_INDEXES: dict[tuple, lexical.FtsIndex] = {}


def index(spark: SparkSession, sf_dir: str, corpus: str) -> lexical.FtsIndex:
    """The stored index of a corpus of these tables; the first query of a session that needs it writes it."""
    name = "conversations" if corpus == "turns" else "documents"
    key = (spark.sparkContext.applicationId, files_of(spark, f"{sf_dir}/{name}.parquet"), corpus)
    if key not in _INDEXES:
        documents = table(spark, sf_dir, name)
        if corpus == "turns":
            documents = documents.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
        _INDEXES[key] = lexical.FtsIndex.over(titled(documents), "doc_id", ["title", "body"]) if corpus == "pages" else lexical.FtsIndex.over(documents, "doc_id", ["text"])
    return _INDEXES[key]


def hits(spark: SparkSession, sf_dir: str, corpus: str = "documents", query: str = QUERY) -> DataFrame:
    return index(spark, sf_dir, corpus).search(query, [8.0, 1.0] if corpus == "pages" else None)


def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(table(spark, sf_dir, "documents"), "text")


def bm25_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).withColumn("bm25", F.round("bm25", 6))


def bm25_wiki_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "pages").withColumn("bm25", F.round("bm25", 6))


def fts_replace_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index after writes: documents of one source are replaced by their first lines, those of another deleted."""
    documents = table(spark, sf_dir, "documents")
    own = lexical.FtsIndex.over(documents, "doc_id", ["text"])
    own.upsert(titled(documents.where("source = 'src1'")).select("doc_id", F.col("title").alias("text")), "doc_id")
    own.delete(documents.where("source = 'src2'"), "doc_id")
    return own.search(QUERY).withColumn("bm25", F.round("bm25", 6))


def search_source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(hits(spark, sf_dir), 20)


_SOURCE_PAGE = f"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)},
r AS (SELECT *, CAST(row_number() OVER (ORDER BY bm25, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM hits)
SELECT doc_id, bm25, rank, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM r WHERE rank <= 20"""


def search_all_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corpora: conversation turns as wiki pages, documents as sources; equal ranks interleave by kind."""
    wiki = lexical.ranked(hits(spark, sf_dir, "turns", WIKI_QUERY), 20).withColumn("kind", F.lit("WIKI"))
    source = lexical.ranked(hits(spark, sf_dir, query=WIKI_QUERY), 20).withColumn("kind", F.lit("SOURCE_CHUNK"))
    both = wiki.unionByName(source).select("kind", "doc_id", "rank", "score")
    return both.orderBy(F.desc("score"), "kind", F.col("doc_id").cast("string")).limit(20)


def _ranked_cte(name: str, kind: str, n: int) -> str:
    return f"{name} AS (SELECT '{kind}' AS kind, doc_id, CAST(row_number() OVER (ORDER BY bm25, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM hits_{name} ORDER BY bm25, CAST(doc_id AS VARCHAR) LIMIT {n})"


_ALL = f"""WITH hits_w AS (WITH {_bm25_sql("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations", {"text": 1.0}, WIKI_QUERY)} SELECT * FROM hits),
hits_s AS (WITH {_bm25_sql(_DOCS, {"text": 1.0}, WIKI_QUERY)} SELECT * FROM hits), {_ranked_cte("w", "WIKI", 20)}, {_ranked_cte("s", "SOURCE_CHUNK", 20)},
b AS (SELECT * FROM w UNION ALL SELECT * FROM s)
SELECT kind, doc_id, rank, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM b ORDER BY score DESC, kind, CAST(doc_id AS VARCHAR) LIMIT 20"""


def scoped_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lexical.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")
    return own.select("doc_id", F.size("terms").alias("n_terms"), F.element_at("terms", 1).alias("first_term"))


def scoped_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's first line as a query within the document of its id."""
    own = lexical.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 200).alias("query"))
    return lexical.fallback(asked.join(own, "doc_id"), "query", "terms").select("doc_id", "query", "fallback")


_FALLBACK = r"""WITH a AS (SELECT item_id AS doc_id, substr(split_part(text, chr(10), 1), 1, 200) AS query FROM benchmark),
t AS (SELECT doc_id, query, nfc_normalize(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS q FROM a),
w AS (SELECT t.*, list_transform(regexp_extract_all(q, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS asked,
  regexp_extract_all(q, '(?i)(?:[A-Z]{2,}-\d{3,}|[A-Z][A-Za-z0-9_$]*(?:Error|Exception)|[a-z][a-z0-9_]*_[a-z0-9_]+|[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+)') AS found,
  list_transform(regexp_extract_all(d.text, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS held FROM t JOIN documents d USING (doc_id)),
k AS (SELECT *, list_filter(asked, lambda x, i: list_position(asked, x) = i AND list_contains(held, x)) AS kept,
  array_to_string(list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i)[1:4], ' ') AS technical FROM w),
c AS (SELECT *, CASE WHEN len(kept) > 1 AND len(list_filter(kept, lambda x: length(x) >= 2)) > 0 OR len(kept) = 1 AND length(kept[1]) >= 4 AND regexp_matches(kept[1], '[A-Za-z0-9]') THEN array_to_string(kept, ' ') ELSE '' END AS shorter FROM k),
o AS (SELECT *, list_transform(regexp_extract_all(technical, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS own1, list_transform(regexp_extract_all(shorter, '[\p{L}\p{Nd}\p{M}]+'), lambda x: lower(x)) AS own2 FROM c),
r AS (SELECT *, len(own1) > 0 AND technical <> q AND len(own1) < len(asked) AND len(list_filter(own1, lambda x: len(list_filter(own1, lambda y: y = x)) > len(list_filter(asked, lambda y: y = x)))) = 0 AS ok1,
  len(own2) > 0 AND shorter <> q AND len(own2) < len(asked) AND len(list_filter(own2, lambda x: len(list_filter(own2, lambda y: y = x)) > len(list_filter(asked, lambda y: y = x)))) = 0 AS ok2 FROM o)
SELECT doc_id, query, CASE WHEN ok1 THEN technical WHEN ok2 THEN shorter END AS fallback FROM r"""


def snippet_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lexical.snippet("text", QUERY).alias("snippet"))


_WORDS = r"(?i)(^|[^\p{L}\p{Nd}\p{M}\x01])(" + "|".join(sorted({s.lower() for s in lexical.query_segments(QUERY)}, key=len, reverse=True)) + r")($|[^\p{L}\p{Nd}\p{M}])"
_MARK = rf"'{_WORDS}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'"
_ESCAPED = """replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_SNIPPETS = f"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, {_MARK}), {_MARK}) AS marked FROM documents),
w AS (SELECT *, length(text) AS n, CASE WHEN length(text) > 280 AND strpos(marked, chr(1)) > 0 THEN greatest(0, least((strpos(marked, chr(1)) + strpos(marked, chr(2)) - 3) // 2 - 140, length(text) - 280)) ELSE 0 END AS a FROM m),
q AS (SELECT doc_id, n, a, least(n, a + 280) AS b, string_split(translate(marked, chr(1) || chr(2), chr(3) || chr(3)), chr(3)) AS pieces FROM w),
p AS (SELECT doc_id, n, a, b, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM q),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM p),
x AS (SELECT doc_id, n, a, b, i, i % 2 = 0 AND c >= a AND c + length(piece) <= b AS hit, substr(piece, CAST(greatest(a - c, 0) + 1 AS INTEGER), CAST(greatest(least(c + length(piece), b) - greatest(c, a), 0) AS INTEGER)) AS x FROM o)
SELECT doc_id, CASE WHEN max(a) > 0 THEN '…' ELSE '' END || string_agg(CASE WHEN hit THEN '<mark>' || {_ESCAPED} || '</mark>' ELSE {_ESCAPED} END, '' ORDER BY i) || CASE WHEN max(b) < max(n) THEN '…' ELSE '' END AS snippet FROM x GROUP BY doc_id"""


def _projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label") % 2 == 0, "WIKI").otherwise("SOURCE_CHUNK")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stable_id"), kind.alias("kind"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.nearest(_projections(spark, sf_dir), _query_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


def knn_filtered_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.nearest(_projections(spark, sf_dir), _query_vector(spark, sf_dir), 20, kinds=("WIKI",), offset=5)
    return found.withColumn("score", F.round("score", 6))


def knn_document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    scope = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("document_id")).distinct().where("document_id in ('src1', 'src2', 'src3')")
    own = vector.in_documents(_projections(spark, sf_dir), chunks, scope)
    return vector.nearest(own, _query_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


def _knn_sql(where: str = "true", tail: str = "LIMIT 20") -> str:
    return f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id AS stable_id, CASE WHEN label % 2 = 0 THEN 'WIKI' ELSE 'SOURCE_CHUNK' END AS kind,
      round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS distance FROM embeddings, q)
SELECT stable_id, kind, distance, round(greatest(0, least(1, 1 - distance / 2)), 6) AS score FROM d WHERE {where}
ORDER BY distance, kind, CAST(stable_id AS VARCHAR) {tail}"""


_SCOPE = "stable_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source IN (SELECT source FROM documents WHERE lang = 'en'))"


def _channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    found = lexical.ranked(hits(spark, sf_dir), 50)
    near = vector.nearest(_projections(spark, sf_dir).withColumn("kind", F.lit("SOURCE_CHUNK")), _query_vector(spark, sf_dir), 50)
    best = documents.where("source = 'src1'").orderBy(F.desc("n_chars"), "doc_id").limit(16)
    kind = F.lit("SOURCE_CHUNK").alias("kind")
    return {
        "LEXICAL": fusion.channel(found.select(kind, F.col("doc_id").alias("stable_id"), "score"), "LEXICAL"),
        "VECTOR": fusion.channel(near.select(kind, "stable_id", "score"), "VECTOR"),
        "GRAPH": fusion.listed(best.select(kind, F.col("doc_id").alias("stable_id"), (-F.col("n_chars") * 1000000 + F.col("doc_id")).alias("ord")), "GRAPH"),
    }


def rrf_two_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _channels(spark, sf_dir)
    return fusion.fuse([c["LEXICAL"], c["VECTOR"]], 50, digits=9)


def rrf_weighted_three_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(list(_channels(spark, sf_dir).values()), 50, fusion.FUSION["fusion-rrf-v2-graph-damped"], digits=9)


_CHANNELS = f"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)},
lx AS (SELECT doc_id, row_number() OVER (ORDER BY bm25, CAST(doc_id AS VARCHAR)) AS rank FROM hits ORDER BY bm25, CAST(doc_id AS VARCHAR) LIMIT 50),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
vd AS (SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS distance FROM embeddings, q),
vx AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, CAST(vec_id AS VARCHAR)) AS rank FROM vd ORDER BY distance, CAST(vec_id AS VARCHAR) LIMIT 50),
gx AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 16),
ch AS (SELECT 'LEXICAL' AS c, 1.0::DOUBLE AS w, * FROM lx UNION ALL SELECT 'VECTOR', 1.0::DOUBLE, * FROM vx UNION ALL SELECT 'GRAPH', 0.75::DOUBLE, * FROM gx)"""


def _fused_sql(where: str) -> str:
    return f"""{_CHANNELS}
SELECT 'SOURCE_CHUNK' AS kind, CAST(doc_id AS VARCHAR) AS stable_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(DISTINCT c, ',' ORDER BY c) AS signals
FROM ch WHERE {where} GROUP BY doc_id ORDER BY score DESC, kind, stable_id LIMIT 50"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 hits as evidence items."""
    documents = table(spark, sf_dir, "documents")
    found = lexical.ranked(hits(spark, sf_dir), 200)
    own = titled(documents).join(F.broadcast(found), "doc_id")  # at most 200 rows
    return own.select(F.col("doc_id").alias("stable_id"), "rank", "title", F.col("body").alias("content"))


def rerank_exact_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.rerank(_items(spark, sf_dir), QUESTION)
    return out.select("stable_id", "rank", "rerank_score", "reranked")


_RERANK_WORDS = "['the', 'order', 'of', 'err-1234', 'by', 'from', 'and']"
_RERANK = rf"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)},
rk AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY bm25, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM hits ORDER BY bm25, CAST(doc_id AS VARCHAR) LIMIT 200),
it AS (SELECT doc_id, rank, title, body FROM rk JOIN ({_TITLED_SQL}) USING (doc_id)),
tk AS (SELECT doc_id, rank, list_distinct(list_transform(regexp_extract_all(title || '  ' || body, '[\p{{L}}\p{{Nd}}\-]+'), lambda t: lower(t))) AS own,
       list_distinct(list_transform(regexp_extract_all(title, '[\p{{L}}\p{{Nd}}\-]+'), lambda t: lower(t))) AS own_title FROM it),
sc AS (SELECT doc_id, rank, round(4.0::DOUBLE * (CASE WHEN list_contains(own, 'err-1234') THEN 1 ELSE 0 END) + 2.0::DOUBLE * len(list_intersect({_RERANK_WORDS}, own_title))
       + len(list_intersect({_RERANK_WORDS}, own))::DOUBLE / 7, 9) AS rerank_score FROM tk)
SELECT doc_id AS stable_id, rank, rerank_score, CAST(row_number() OVER (ORDER BY rerank_score DESC, rank) AS INTEGER) AS reranked FROM sc"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a bundle whose items are its turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("turn").alias("stable_id"), F.col("text").alias("content"))


def budgeted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.budgeted(_turns(spark, sf_dir), 4, 900, group=("conv_id",))
    return out.select("conv_id", "stable_id", "ordinal", F.col("used").cast("long").alias("used"), "truncated", X.sha256("evidence").alias("evidence_hash"))


_BUDGET = r"""WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, text FROM conversations),
o AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS ordinal, CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, substr(text, 1, CAST(greatest(900 - used, 0) AS INTEGER)) AS evidence, length(text) > 900 - used AS truncated FROM o)
SELECT conv_id, turn AS stable_id, ordinal, used, truncated, sha256(evidence) AS evidence_hash FROM c a
WHERE used < 900 AND ordinal <= 4 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.ordinal <= a.ordinal AND trim(b.evidence) = '')"""


def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.packed(_turns(spark, sf_dir), 6, 300, 1000, group=("conv_id",))
    return out.select("conv_id", "stable_id", "citation_id", "truncated", X.sha256("block").alias("block_hash"))


_PACKING = r"""WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, text FROM conversations),
o AS (SELECT *, row_number() OVER w AS ordinal, coalesce(sum(least(length(text), 300)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, least(300, 1000 - used) AS room FROM o WHERE used < 1000 AND ordinal <= 6),
b AS (SELECT *, substr(text, 1, CAST(room AS INTEGER)) AS block FROM c)
SELECT conv_id, turn AS stable_id, 'E' || ordinal AS citation_id, length(text) > room AS truncated, sha256(block) AS block_hash FROM b x
WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.conv_id = x.conv_id AND y.ordinal <= x.ordinal AND trim(y.block) = '')"""


def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is an answer that cites its own number and, in long texts, the first block twice or an unknown one."""
    known = evidence.packed(_turns(spark, sf_dir), 6, 300, 1000, group=("conv_id",)).select("conv_id", "citation_id")
    own = F.concat(F.lit("E"), (F.col("turn") + 1).cast("string"))
    cited = F.when(F.length("text") % 3 == 0, F.array(own)).when(F.length("text") % 3 == 1, F.array(F.lit("E1"), own)).otherwise(F.array().cast("array<string>"))
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", cited.alias("citation_ids"), (F.length("text") % 5 == 0).alias("insufficient"))
    out = evidence.citations(answers, known, ("conv_id",))
    return out.select("conv_id", "turn", "citation_status")


_CITATIONS = rf"""WITH known AS (SELECT conv_id, list(citation_id) AS ids FROM ({_PACKING}) GROUP BY conv_id),
a AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN ['E' || (turn + 1)] WHEN length(text) % 3 = 1 THEN ['E1', 'E' || (turn + 1)] ELSE CAST([] AS VARCHAR[]) END AS cited, length(text) % 5 = 0 AS insufficient FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT insufficient AND len(cited) = 0 THEN 'MISSING' WHEN len(list_distinct(cited)) < len(cited) THEN 'REPEATED'
  WHEN len(list_filter(cited, lambda c: NOT list_contains(coalesce(ids, CAST([] AS VARCHAR[])), c))) > 0 THEN 'UNKNOWN' ELSE 'VALID' END AS citation_status
FROM a LEFT JOIN known USING (conv_id)"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits per language against the documents that are labelled good."""
    documents = table(spark, sf_dir, "documents")
    found = hits(spark, sf_dir).withColumn("bm25", F.round("bm25", 6))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("bm25", F.col("doc_id").cast("string")))
    ranked = found.join(documents.select("doc_id", F.col("source").alias("query_id")), "doc_id").select("query_id", F.col("doc_id").alias("stable_id"), rank.alias("rank"))
    good = table(spark, sf_dir, "labels").where("quality = 1").join(documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("stable_id"))
    out = fusion.quality(ranked, good, 10)
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "mrr")])


_METRICS = f"""WITH {_bm25_sql(_DOCS, {"text": 1.0}, QUERY)},
rk AS (SELECT source AS query_id, h.doc_id, row_number() OVER (PARTITION BY source ORDER BY bm25, CAST(h.doc_id AS VARCHAR)) AS rank FROM hits h JOIN documents d ON h.doc_id = d.doc_id),
good AS (SELECT source AS query_id, l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1),
n AS (SELECT query_id, count(*) AS relevant FROM good GROUP BY query_id),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM rk JOIN good USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(coalesce(hits, 0)::DOUBLE / relevant, 9) AS recall, round(coalesce(hits, 0)::DOUBLE / 10, 9) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 9) AS mrr FROM n LEFT JOIN h USING (query_id)"""


QUERIES = {
    f.__name__: f
    for f in (
        token_postings, bm25_source, bm25_wiki_weighted, fts_replace_delete, search_source_page, search_all_interleaved, scoped_vocabulary, scoped_fallback, snippet_highlight,
        knn_exact, knn_filtered_kind, knn_document_scope, rrf_two_channel, rrf_weighted_three_channel, rerank_exact_anchor, budgeted_evidence, context_packing,
        citation_validation, retrieval_metrics,
    )
}

ORACLE = {
    "token_postings": f"""WITH p AS (SELECT doc_id, unnest({_tokens_sql("text")}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT term, CAST(count(*) AS BIGINT) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM c GROUP BY term""",
    "bm25_source": f"WITH {_bm25_sql(_DOCS, {'text': 1.0}, QUERY)} SELECT doc_id, bm25 FROM hits",
    "bm25_wiki_weighted": f"WITH {_bm25_sql(_TITLED_SQL, {'title': 8.0, 'body': 1.0}, QUERY)} SELECT doc_id, bm25 FROM hits",
    "fts_replace_delete": f"""WITH {_bm25_sql("SELECT doc_id, CASE WHEN source = 'src1' THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE source <> 'src2'", {"text": 1.0}, QUERY)} SELECT doc_id, bm25 FROM hits""",
    "search_source_page": _SOURCE_PAGE,
    "snippet_highlight": _SNIPPETS,
    "scoped_fallback": _FALLBACK,
    "search_all_interleaved": _ALL,
    "scoped_vocabulary": r"WITH t AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}\p{M}]+'), lambda t: lower(t)))) AS terms FROM documents) SELECT doc_id, CAST(len(terms) AS INTEGER) AS n_terms, terms[1] AS first_term FROM t",
    "knn_exact": _knn_sql(),
    "knn_filtered_kind": _knn_sql("kind = 'WIKI'", "LIMIT 20 OFFSET 5"),
    "knn_document_scope": _knn_sql(_SCOPE),
    "rrf_two_channel": _fused_sql("c <> 'GRAPH'"),
    "rrf_weighted_three_channel": _fused_sql("true"),
    "rerank_exact_anchor": _RERANK,
    "budgeted_evidence": _BUDGET,
    "context_packing": _PACKING,
    "citation_validation": _CITATIONS,
    "retrieval_metrics": _METRICS,
}
