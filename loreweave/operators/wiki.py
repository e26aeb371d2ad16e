"""The wiki workflow: proposals, drafts, published pages, lint, tag suggestions and rendered files."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions import text as X

# Allowed status changes, and the order of lint codes.
TRANSITIONS = {("DRAFT", "REVIEW"), ("DRAFT", "REJECTED"), ("REVIEW", "APPROVED"), ("REVIEW", "REJECTED")}
LINT_CODES = ("DUPLICATE_IDENTITY", "CANONICAL_CONTENT_INVALID", "CANONICAL_CONTENT_UNREADABLE", "BROKEN_INTERNAL_LINK", "ORPHAN_PAGE", "DANGLING_PROVENANCE")


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order: one aggregation with partial results, without a sort of the groups."""
    latest = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("row"))
    return latest.select(key, "row.*")


def reviewable(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposals whose document is alive, or who have none."""
    alive = documents.select("document_id", F.col("status").alias("document_status"))
    rows = proposals.join(alive, "document_id", "left")
    return rows.where(F.col("document_id").isNull() | F.col("document_status").isNotNull() & ~F.col("document_status").isin("DELETED", "SUPERSEDED"))


def current_status(transitions: DataFrame, key: str, order: str) -> DataFrame:
    """``key, status`` after a stream of (from, to) events: an event counts if it is allowed and fits the status so far.

    The fold over a key's events runs on their array; the lifecycle allows three steps at most.
    """
    events = transitions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "from_status", "to_status"))).alias("events"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(TRANSITIONS)])
    step = lambda s, e: F.when((e["from_status"] == s) & F.array_contains(allowed, F.concat(s, F.lit(">"), e["to_status"])), e["to_status"]).otherwise(s)
    return events.select(key, F.aggregate("events", F.lit("DRAFT"), step).alias("status"))


def lint(pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """``knowledge_id, code, severity, detail``.

    Pages: ``page_id, knowledge_id, title, targets`` (normalised link targets), ``content_status`` (VALID, INVALID or
    UNREADABLE, see ``published.checked``), ``proposal_id``. A page whose content is not valid is skipped for links, but
    still checked for inbound links and provenance.
    """
    rows = pages.withColumn("title_key", X.title_key("title"))
    find = lambda df, code, severity, detail: df.select("knowledge_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))
    twice = rows.groupBy("knowledge_id").count().where("count > 1").select("knowledge_id")
    out = find(rows.join(twice, "knowledge_id", "left_semi"), "DUPLICATE_IDENTITY", "ERROR", F.lit("duplicate knowledgeId in workspace"))
    out = out.unionByName(find(rows.where("content_status = 'INVALID'"), "CANONICAL_CONTENT_INVALID", "ERROR", F.lit("content does not match its metadata")))
    out = out.unionByName(find(rows.where("content_status = 'UNREADABLE'"), "CANONICAL_CONTENT_UNREADABLE", "ERROR", F.lit("content could not be read")))
    titles = rows.select("title_key").distinct()
    links = rows.where("content_status = 'VALID'").select("page_id", "knowledge_id", "title_key", F.explode("targets").alias("target")).where("target <> title_key")
    broken = links.join(titles.withColumnRenamed("title_key", "target"), "target", "left_anti")
    out = out.unionByName(find(broken, "BROKEN_INTERNAL_LINK", "ERROR", F.concat(F.lit("wikilink target not published: "), F.col("target"))))
    orphans = rows.join(links.select(F.col("target").alias("title_key")).distinct(), "title_key", "left_anti")
    out = out.unionByName(find(orphans, "ORPHAN_PAGE", "WARNING", F.lit("no inbound reference from other published pages")))
    dangling = rows.where("proposal_id is not null").join(proposals.select("proposal_id"), "proposal_id", "left_anti")
    return out.unionByName(find(dangling, "DANGLING_PROVENANCE", "WARNING", F.lit("referenced proposal is missing from the workspace")))


def lint_order() -> list[Column]:
    """Findings by the place of their code, then by page and detail."""
    return [F.array_position(F.array(*[F.lit(c) for c in LINT_CODES]), F.col("code")), F.col("knowledge_id"), F.col("detail")]


def resolve_target(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """Drafts with ``resolution``: CREATE needs a free title, MERGE exactly one page of the draft's type."""
    known = pages.groupBy(X.title_key("title").alias("title_key")).agg(F.count("*").alias("n"), F.min("page_type").alias("known_type"), F.min("knowledge_id").alias("target_id"))
    rows = drafts.withColumn("title_key", X.title_key("target_title")).join(known, "title_key", "left")
    n = F.coalesce("n", F.lit(0))
    create = F.when(n == 0, "CREATE").otherwise("ALREADY_EXISTS")
    merge = F.when(n == 0, "NOT_FOUND").when(n > 1, "AMBIGUOUS").when(F.col("known_type") != F.col("page_type"), "TYPE_MISMATCH").otherwise("MERGE")
    return rows.withColumn("resolution", F.when(F.col("action") == "CREATE", create).otherwise(merge)).drop("n", "known_type", "title_key")


def draft_validity(drafts: DataFrame) -> Column:
    """Why a draft may not be published, from the columns of its left joins; null if it may."""
    return (
        F.when(~F.coalesce(F.col("proposal_status") == "APPROVED", F.lit(False)), "PROPOSAL_NOT_APPROVED")
        .when(~F.coalesce("evidence_current", F.lit(False)), "EVIDENCE_STALE")
        .when(F.col("base_hash").isNotNull() & ~F.col("base_hash").eqNullSafe(F.col("page_hash")), "BASE_CHANGED")
    )


def tag_suggestions(candidates: DataFrame, analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """``document_id, tags, freshness``: tags of a document's latest analysis and whether the document changed since."""
    latest = latest_per_key(analyses.select("document_id", "analysis_id", "analysed_at"), "document_id", "analysis_id")
    own = latest.join(candidates.select("analysis_id", F.explode("tags").alias("tag")), "analysis_id", "left")
    own = own.groupBy("document_id", "analysed_at").agg(X.tags(F.collect_set("tag")).alias("tags"))
    rows = documents.select("document_id", "updated_at").join(own, "document_id", "left")
    freshness = F.when(F.col("analysed_at").isNull(), "NO_ANALYSIS").when(F.col("updated_at") > F.col("analysed_at"), "DOCUMENT_CHANGED_AFTER_ANALYSIS").otherwise("CURRENT")
    return rows.select("document_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), freshness.alias("freshness"))


def diff(before: str, after: str, path: str = "page.md", cells: int = 4_000_000) -> Column:
    """A unified diff; texts whose line counts multiply to more than ``cells`` are shown as removed and added whole."""

    @F.arrow_udf(T.StringType())
    def render(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            old, new = (x or "").split("\n"), (y or "").split("\n")
            if len(old) * len(new) > cells:
                lines = [f"--- {path}", f"+++ {path}", *(f"-{s}" for s in old), *(f"+{s}" for s in new)]
            else:
                lines = list(difflib.unified_diff(old, new, path, path, lineterm=""))
            out.append("\n".join(lines))
        return pa.array(out, pa.string())

    return render(F.col(before), F.col(after))


def proposal_key(question: Column, answer: Column, cited: Column) -> Column:
    """The identity of a proposal made from an answer: the same answer gives the same proposal."""
    return X.sha256(X.length_prefixed(question, answer, F.array_join(F.array_sort(cited), ",")))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Idempotent ingress: the first row of a key counts."""
    once = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(once)).where("turn = 1").drop("turn")
