"""What may be served: joins of indexed rows with canonical rows and ledgers, the serving gate, listings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import ingest


def fresh_documents(documents: DataFrame, now: DataFrame, ledger: DataFrame, projection_version: str) -> DataFrame:
    """``document_id`` of the documents whose index rows may be served, of those that ``now`` names.

    A document is fresh where it is eligible and its ledger row is SYNCED under this version, and where the ledger's
    counts and digests, those of the canonical and those of the indexed chunks, are what ``now`` has: ``document_id,
    chunks, fingerprint`` of the eligible chunks, from their stored digests (``digests.DocumentDigests``). No text is
    read; give the fingerprints of the documents that hits name.
    """
    synced = ledger.where((F.col("sync_status") == "SYNCED") & (F.col("projection_version") == projection_version))
    rows = ingest.eligible(documents).select("document_id").join(synced, "document_id").join(now, "document_id")
    same = [F.col(c) == F.col("chunks") for c in ("eligible_count", "indexed_count")] + [F.col(c) == F.col("fingerprint") for c in ("canonical_fingerprint", "indexed_fingerprint")]
    for test in same:
        rows = rows.where(test)
    return rows.select("document_id")


def same_place(left: str, right: str, *columns: str) -> Column:
    """Equality of places under two aliases, for which a missing and an empty section, heading or page are the same."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(f"{left}.{c}").cast("string"), F.lit("")) == F.coalesce(F.col(f"{right}.{c}").cast("string"), F.lit("")))
    return out


def served_sources(hits: DataFrame, indexed: DataFrame, chunks: DataFrame, fresh: DataFrame, workspace: int | None = None) -> DataFrame:
    """Hits on source chunks that may be shown: the indexed row and the canonical chunk agree on document, hash and
    place, and the document is fresh. ``hits`` are few; they are joined first."""
    own = hits.join(indexed.select("chunk_id", "document_id", "content_hash", *[c for c in ("section", "heading_path", "page_no") if c in indexed.columns]), hits["doc_id"] == indexed["chunk_id"]).alias("i")
    canonical = chunks.where("eligible").alias("c")
    canonical = canonical if workspace is None else canonical.where(F.col("workspace_id") == workspace)
    agree = (F.col("i.chunk_id") == F.col("c.chunk_id")) & (F.col("i.document_id") == F.col("c.document_id")) & (F.col("i.content_hash") == F.col("c.content_hash"))
    places = [c for c in ("section", "heading_path", "page_no") if c in indexed.columns and c in chunks.columns]
    return own.join(canonical, agree & same_place("i", "c", *places)).select("i.doc_id", "i.bm25", "i.document_id").join(fresh, "document_id", "left_semi")


def served_pages(hits: DataFrame, pages: DataFrame, ledger: DataFrame, projection_version: str) -> DataFrame:
    """Hits on wiki pages that may be shown: published, and SYNCED under this version with the page's hash and revision."""
    live = pages.where("status = 'PUBLISHED'").select("knowledge_id", "content_hash", "revision")
    synced = ledger.where((F.col("sync_status") == "SYNCED") & (F.col("projection_version") == projection_version))
    synced = synced.select("knowledge_id", F.col("canonical_hash").alias("content_hash"), F.col("indexed_hash"), F.col("canonical_revision").alias("revision"))
    live = live.join(synced.where("content_hash = indexed_hash").drop("indexed_hash"), ["knowledge_id", "content_hash", "revision"])
    return hits.join(live, hits["doc_id"] == live["knowledge_id"]).select("doc_id", "bm25", "revision")


def listed(indexed: DataFrame, identities: DataFrame, *key: str) -> DataFrame:
    """Every indexed row and whether its identity is there."""
    known = identities.select(*key).distinct().withColumn("identity_valid", F.lit(True))
    return indexed.join(known, list(key), "left").withColumn("identity_valid", F.coalesce("identity_valid", F.lit(False)))


def analysis_targets(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that can be analysed: parsed, with a hash and at least one chunk."""
    return documents.where("parse_status = 'PROCESSED' AND sha256 IS NOT NULL").join(chunks.select("document_id"), "document_id", "left_semi")


def paged(rows: DataFrame, order: list[Column | str], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One page of rows, and one row of ``page, size, total, pages``."""
    if not 0 < size <= 200 or page < 0:
        raise ValueError("unknown page")
    total = rows.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(size).alias("size"), "total", F.ceil(F.col("total") / size).alias("pages"))
    return rows.orderBy(*order).offset(page * size).limit(size), total


def wiki_list(pages: DataFrame, page_type: str | None, page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One page of the published pages, of one type or all, by id, and the totals."""
    if page_type is not None and page_type not in X.PAGE_FOLDERS:
        raise ValueError("unknown page type")
    rows = pages.where("status = 'PUBLISHED'")
    return paged(rows if page_type is None else rows.where(F.col("page_type") == page_type), ["knowledge_id"], page, size)


def revalidated_sources(candidates: DataFrame, documents: DataFrame, chunks: DataFrame, now: DataFrame, workspace: int) -> DataFrame:
    """Every source candidate with ``rejection``: null where canonical rows still back it, else the first test that fails.

    Candidates: ``workspace_id, stable_id, chunk_id, document_id, content_hash, eligible_count, fingerprint``. The tests,
    in order: workspace, identity, the document and its eligibility, the document's eligible chunks as they were, the
    chunk, its eligibility and its hash. ``now`` is as in ``fresh_documents``; left joins with the bounded candidates.
    """
    now = now.select("document_id", F.col("chunks").alias("now_count"), F.col("fingerprint").alias("now_fingerprint"))
    alive = documents.select("document_id", F.lit(True).alias("document_there"), ((F.col("parse_status") == "PROCESSED") & ~F.col("status").isin(*ingest.DEAD)).alias("document_eligible"))
    own = chunks.select("chunk_id", "document_id", F.lit(True).alias("chunk_there"), F.col("eligible").alias("chunk_eligible"), F.col("content_hash").alias("chunk_hash"))
    rows = candidates.join(alive, "document_id", "left").join(now, "document_id", "left").join(own, ["chunk_id", "document_id"], "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("workspace_id") != workspace, "WORKSPACE_MISMATCH")
        .when(~F.col("stable_id").eqNullSafe(F.col("chunk_id").cast("string")), "IDENTITY_MISMATCH")
        .when(no("document_there"), "AUTHORITY_MISSING")
        .when(no("document_eligible"), "INELIGIBLE")
        .when(F.col("content_hash").isNull() | ~F.col("eligible_count").eqNullSafe(F.col("now_count")) | ~F.col("fingerprint").eqNullSafe(F.col("now_fingerprint")), "STALE_REVISION")
        .when(no("chunk_there"), "AUTHORITY_MISSING")
        .when(no("chunk_eligible"), "INELIGIBLE")
        .when(~F.col("content_hash").eqNullSafe(F.col("chunk_hash")), "STALE_REVISION")
    )
    return rows.withColumn("rejection", reason).select(*candidates.columns, "rejection")


def derived_from(pages: DataFrame, documents: DataFrame, sources: str = "sources") -> DataFrame:
    """``knowledge_id, document_id`` for every source that a page names and that is there."""
    asked = pages.select("knowledge_id", F.explode(sources).alias("document_id")).distinct()
    return asked.join(documents.select("document_id"), "document_id", "left_semi").select("knowledge_id", "document_id")


def tagged_with(pages: DataFrame, tags: str = "tags") -> DataFrame:
    """``knowledge_id, tag`` in normal form."""
    return pages.select("knowledge_id", F.explode(X.tags(tags)).alias("tag")).distinct()
