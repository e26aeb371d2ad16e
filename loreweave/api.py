"""The calls of a knowledge base's users: search, retrieve, inspect, locate and ask, over tables given by name.

Tables: ``chunks`` (chunk_id, document_id, content, content_hash, eligible), ``pages`` (knowledge_id, title, body,
content_hash, page_type, revision), and, for vectors, ``projections`` (stable_id, kind, embedding). With ``gate``, only
documents whose index is known to be current are served.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.operators import digests, evidence, fusion, lexical, proposals, rewrite, serving, vector

# Retrieval modes by corpus and strategy.
MODES = {
    "WIKI_ONLY": ("WIKI", "LEXICAL"),
    "SOURCE_ONLY": ("SOURCE", "LEXICAL"),
    "HYBRID_FTS": ("ALL", "LEXICAL"),
    "SEMANTIC_WIKI": ("WIKI", "SEMANTIC"),
    "SEMANTIC_SOURCE": ("SOURCE", "SEMANTIC"),
    "HYBRID_VECTOR": ("ALL", "HYBRID"),
    "HYBRID_GRAPH": ("ALL", "FUSED"),
}
WORKSPACE = 1


@dataclass(frozen=True)
class Gate:
    """What tells whether a source's index rows may be served: documents (document_id, status, parse_status), the index's
    ledger, and the stored digests of chunks."""

    documents: DataFrame
    ledger: DataFrame
    digests: digests.DocumentDigests
    projection_version: str


@dataclass(frozen=True)
class Page:
    """One page of hits (``kind, stable_id, rank, score``), how many there are in all, and the query that found them: a
    shorter one where the one asked found nothing in its document."""

    items: DataFrame
    total: int
    query: str


@dataclass(frozen=True)
class Retrieval:
    """Evidence, every candidate with what became of it, and why a channel gave nothing."""

    evidence: DataFrame
    trace: DataFrame
    degraded: dict[str, str]


@dataclass
class KnowledgeBase:
    chunks: DataFrame
    pages: DataFrame
    projections: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    fusion_policy: str = "fusion-rrf-v2-graph-damped"
    gate: Gate | None = None
    indexes: dict[str, lexical.FtsIndex] = field(default_factory=dict)

    def index(self, corpus: str) -> lexical.FtsIndex:
        """The stored index of WIKI or SOURCE; written once, at the first search, unless one is given."""
        if corpus not in self.indexes:
            table, key, columns = (self.pages, "knowledge_id", ["title", "body"]) if corpus == "WIKI" else (self.chunks.where("eligible"), "chunk_id", ["content"])
            self.indexes[corpus] = lexical.FtsIndex.over(table, key, columns)
        return self.indexes[corpus]

    def _wiki_hits(self, query: str, page_type: str | None) -> DataFrame:
        pages = self.pages if page_type is None else self.pages.where(F.col("page_type") == page_type)
        return self.index("WIKI").search(query, [8.0, 1.0]).join(pages.select(F.col("knowledge_id").alias("doc_id")), "doc_id", "left_semi")

    def _source_hits(self, query: str, document_id: object | None) -> DataFrame:
        """Hits on eligible chunks, of documents that the gate lets through. It looks at those that hits name alone."""
        own = self.chunks.where("eligible").select(F.col("chunk_id").alias("doc_id"), "document_id")
        own = own if document_id is None else own.where(F.col("document_id") == document_id)
        hits = self.index("SOURCE").search(query).join(own, "doc_id")
        if self.gate is None:
            return hits.drop("document_id")
        kept = self.gate.digests.store
        named = hits.select("document_id").distinct()
        now = digests.of_documents(kept.read(kept.snapshot(), "digests").join(named, "document_id", "left_semi"))
        fresh = serving.fresh_documents(self.gate.documents, now, self.gate.ledger, self.gate.projection_version)
        return hits.join(fresh, "document_id", "left_semi").drop("document_id")

    def search(self, query: str, corpus: str = "ALL", page_type: str | None = None, document_id: object | None = None, page: int = 0, size: int = 20) -> Page:
        """One page of hits of one corpus or both; equal ranks interleave by kind, then by id as text. A blank query has
        none. Where a query finds nothing in the one document it is asked of, a shorter one is tried."""
        if not 0 < size <= 200 or page < 0 or corpus not in ("WIKI", "SOURCE", "ALL"):
            raise ValueError("unknown corpus or page")
        if document_id is not None and corpus != "SOURCE" or page_type is not None and corpus == "SOURCE":
            raise ValueError("this filter does not apply to this corpus")
        spark = self.chunks.sparkSession
        query = unicodedata.normalize("NFC", (query or "").strip())
        if not query:
            return Page(spark.createDataFrame([], "kind string, stable_id string, rank int, score double"), 0, query)
        lexical.query_terms(query)  # a query that is not allowed is refused before anything is read
        parts, total = {}, 0
        if corpus != "SOURCE":
            parts["WIKI"] = self._wiki_hits(query, page_type)
        if corpus != "WIKI":
            parts["SOURCE_CHUNK"] = self._source_hits(query, document_id)
        totals = {kind: hits.count() for kind, hits in parts.items()}
        if not sum(totals.values()) and document_id is not None:
            held = lexical.vocabulary(self.chunks.where("eligible").where(F.col("document_id") == document_id), "chunk_id", "content").select(F.explode("terms").alias("t"))
            asked = lexical.query_tokens(query)
            shorter = lexical.fallback_query(query, {r["t"] for r in held.where(F.col("t").isin(asked)).distinct().collect()})  # at most the query's terms
            if shorter is not None:
                query = shorter
                parts["SOURCE_CHUNK"] = self._source_hits(query, document_id)
                totals["SOURCE_CHUNK"] = parts["SOURCE_CHUNK"].count()
        total, both = sum(totals.values()), None
        for kind, hits in parts.items():
            own = lexical.ranked(hits, (page + 1) * size).select(F.lit(kind).alias("kind"), F.col("doc_id").cast("string").alias("stable_id"), "rank", "score")
            both = own if both is None else both.unionByName(own)
        return Page(both.orderBy(F.desc("score"), "kind", "stable_id").offset(page * size).limit(size), total, query)

    def _canonical(self) -> DataFrame:
        """``kind, stable_id, workspace_id, title, content, content_hash, eligible`` of everything that can be evidence."""
        source = self.chunks.select(F.lit("SOURCE_CHUNK").alias("kind"), F.col("chunk_id").cast("string").alias("stable_id"), F.lit(None).cast("string").alias("title"), "content", "content_hash", "eligible")
        wiki = self.pages.select(F.lit("WIKI").alias("kind"), F.col("knowledge_id").cast("string").alias("stable_id"), "title", F.col("body").alias("content"), "content_hash", F.lit(True).alias("eligible"))
        return source.unionByName(wiki).withColumn("workspace_id", F.lit(WORKSPACE))

    def _named(self, candidates: DataFrame) -> DataFrame:
        """The canonical rows of some candidates; their ids, a few hundred at most, reach the scans as literals."""
        ids = [(r["kind"], r["stable_id"]) for r in candidates.select("kind", "stable_id").distinct().collect()]
        wanted = lambda kind: [i for k, i in ids if k == kind]
        chunks = self.chunks.where(F.col("chunk_id").cast("string").isin(wanted("SOURCE_CHUNK")))
        pages = self.pages.where(F.col("knowledge_id").cast("string").isin(wanted("WIKI")))
        return KnowledgeBase(chunks, pages)._canonical()

    def candidates(self, query: str, mode: str, limit: int, graph: DataFrame | None = None, document_id: object | None = None) -> tuple[DataFrame, dict[str, str]]:
        """``channel, kind, stable_id, ordinal`` of a mode's channels, and why a channel is missing."""
        corpus, strategy = MODES[mode]
        corpus = corpus if document_id is None else "SOURCE"
        found, degraded = [], {}
        if strategy != "SEMANTIC":
            own = fusion.channel(self.search(query, corpus, document_id=document_id, size=limit).items, "LEXICAL")
            found.append(own)
        if strategy != "LEXICAL":
            if self.projections is None or self.embed is None:
                if strategy == "SEMANTIC":
                    raise ValueError("vectors are not available")
                degraded["VECTOR"] = "UNAVAILABLE"
            else:
                try:
                    asked = self.embed(query)
                except Exception as failure:  # noqa: BLE001 - an embedder is a caller's code; the other channels answer
                    if strategy == "SEMANTIC":
                        raise
                    degraded["VECTOR"] = type(failure).__name__
                else:
                    kinds = {"WIKI": ("WIKI",), "SOURCE": ("SOURCE_CHUNK",), "ALL": None}[corpus]
                    legal = self._canonical().where("eligible")
                    near = vector.candidates(self.projections, legal.select("stable_id"), asked, limit, kinds)
                    if document_id is not None:
                        scope = self.chunks.where(F.col("document_id") == document_id).select(F.col("chunk_id").cast("string").alias("stable_id"))
                        near = near.withColumn("stable_id", F.col("stable_id").cast("string")).join(scope, "stable_id", "left_semi")
                    found.append(fusion.channel(near, "VECTOR"))
        if strategy == "FUSED":
            if graph is None:
                degraded["GRAPH"] = "NOT_READY"
            else:
                found.append(fusion.listed(graph, "GRAPH"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.withColumnRenamed("rank", "ordinal"), degraded

    def retrieve(self, query: str, mode: str = "HYBRID_FTS", max_items: int = 8, max_characters: int = 12000, graph: DataFrame | None = None, rerank: str | Callable[[list[str]], list[str]] = "rerank-policy-v1-exact-anchor", document_id: object | None = None) -> Retrieval:
        """Evidence of a mode: candidates that canonical rows back, fused, cut to the budget and re-ranked.

        The trace keeps what was refused, with its places and reasons. ``rerank`` is a policy's name, or a caller's
        function of the evidence's ids; an order that drops or adds any is not taken.
        """
        limit = min(200, 4 * max_items)
        found, degraded = self.candidates(query, mode, limit, graph, document_id)
        found = found.sparkSession.createDataFrame(found.collect(), found.schema)  # three times ``limit`` rows at most, found once
        policy = fusion.FUSION[self.fusion_policy if MODES[mode][1] == "FUSED" else "fusion-rrf-v1"]
        canonical = self._named(found)
        hashes = canonical.select("kind", "stable_id", "content_hash")
        candidates = found.join(hashes, ["kind", "stable_id"], "left").withColumn("workspace_id", F.lit(WORKSPACE))
        trace = evidence.fused_trace(candidates, canonical, canonical.drop("content", "title"), policy, max_items, max_characters)
        items = trace.where("disposition = 'SELECTED'").select("kind", "stable_id", "score", F.col("modalities").alias("signals"), F.col("fused_rank").alias("rank"), F.col("evidence").alias("content"))
        items = items.join(canonical.select("kind", "stable_id", "title", "content_hash"), ["kind", "stable_id"])
        if callable(rerank):
            order = [r["stable_id"] for r in items.orderBy("rank").select("stable_id").collect()]  # at most ``max_items``
            try:
                proposed = rerank(list(order))
            except Exception:  # noqa: BLE001 - a second stage is a caller's code; the fused order answers
                proposed = None
            order = proposals.reranked_or_baseline(order, proposed)
            places = F.array(*[F.lit(i) for i in order]).cast("array<string>")
            items = items.withColumn("reranked", F.array_position(places, F.col("stable_id")).cast("int"))
        else:
            items = fusion.rerank(items, query, rerank)
        items = items.drop("rank").withColumnRenamed("reranked", "rank")
        return Retrieval(items.orderBy("rank"), trace, degraded)

    def inspect(self, query: str, mode: str = "HYBRID_FTS", max_items: int = 8, max_characters: int = 12000, graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Every candidate with its places, rejections and disposition; and what each channel gave."""
        found = self.retrieve(query, mode, max_items, max_characters, graph)
        return found.trace.orderBy(F.asc_nulls_last("fused_rank"), "kind", "stable_id"), evidence.outcomes(found.trace)

    def rewritten(self, query: str, client: Callable[[str, list[str]], str | None], mode: str = "HYBRID_VECTOR", max_items: int = 8, max_characters: int = 12000) -> tuple[DataFrame, str]:
        """Evidence of a query and, where its words alone found nothing, of one rewrite of it, in turns; and the status
        of the rewrite."""
        first = self.retrieve(query, mode, max_items, max_characters)
        strategy = MODES[mode][1]
        lexical_empty = first.trace.where("lexical is not null").isEmpty()
        status, other = rewrite.attempt(self.chunks.sparkSession, query, strategy, lexical_empty, not first.evidence.isEmpty(), client)
        if status != "REWRITE_APPLIED":
            return first.evidence, status
        second = self.retrieve(other, mode, max_items, max_characters)
        return rewrite.merged(first.evidence, second.evidence, max_items, max_characters), status

    def locate(self, chunk_id: object) -> DataFrame:
        """A chunk's document and a preview, if its content is what it was."""
        own = self.chunks.where(F.col("chunk_id") == chunk_id)
        return own.select("chunk_id", "document_id", F.substring("content", 1, 1600).alias("preview"), (F.sha2("content", 256) == F.col("content_hash")).alias("fresh"))

    def ask(self, question: str, answer: Callable[[str, list[dict]], dict], mode: str = "HYBRID_FTS", compact: Callable[[list[dict]], list[dict]] | None = None, max_context: int = 16000) -> dict:
        """ANSWERED, INSUFFICIENT_EVIDENCE or FAILED; the bounded context (32 blocks at most) goes to ``answer``. A
        compaction that breaks its rules is not taken."""
        given = self.retrieve(question, mode).evidence
        blocks = [r.asDict() for r in evidence.packed(given, max_items=32, total=max_context).select("citation_id", "kind", "stable_id", "block").collect()]
        if compact is not None:
            blocks = proposals.compacted(blocks, compact, max_context)
        if not blocks:
            return {"status": "INSUFFICIENT_EVIDENCE", "citations": []}
        given = answer(question, blocks)
        cited, known = list(given.get("citations", ())), {b["citation_id"] for b in blocks}
        insufficient = bool(given.get("insufficient"))
        if len(set(cited)) != len(cited) or not set(cited) <= known or not cited and not insufficient:
            return {"status": "FAILED", "citations": []}
        return {"status": "INSUFFICIENT_EVIDENCE" if insufficient else "ANSWERED", "answer": given.get("answer"), "citations": cited}
