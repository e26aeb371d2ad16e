"""Proposals, drafts and publishing as tables: read models, checks, drafts, ledgers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.operators import digests
from loreweave.operators import published as published_files
from loreweave.sources.tables import spread

# The page types, and those that a candidate's type allows.
PAGE_TYPES = tuple(X.PAGE_FOLDERS)
ALLOWED_TYPES = {
    "CONCEPT": ("CONCEPT", "TECHNOLOGY", "PROJECT", "PERSON", "ORGANIZATION"),
    "FACT": ("CONCEPT", "TECHNOLOGY", "PROJECT", "PERSON", "ORGANIZATION", "REFERENCE"),
    "PROCEDURE": ("HOWTO", "TROUBLESHOOTING"),
    "DECISION": ("DECISION",),
    "REFERENCE": ("REFERENCE", "TECHNOLOGY"),
}


def overview(proposals: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every proposal with its document's status and its candidate's title and type, where they are there."""
    named = documents.select("document_id", F.col("status").alias("document_status"))
    return proposals.join(named, "document_id", "left").join(candidates.select("candidate_id", "title", "candidate_type"), "candidate_id", "left")


def page_of(proposals: DataFrame, page: int, size: int) -> DataFrame:
    """One page of proposals, the newest first."""
    return proposals.orderBy(F.desc("proposal_id")).offset(page * size).limit(size)


def evidence_chunks(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that a proposal rests on, numbered in the order of their document."""
    rows = evidence.join(chunks, "chunk_id").select("proposal_id", "chunk_id", "document_id", "chunk_no")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("proposal_id").orderBy("document_id", "chunk_no", "chunk_id")))


def evidence_documents(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    return evidence.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("proposal_id", "document_id").distinct()


def consistency(proposals: DataFrame, documents: DataFrame, candidates: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of four counts of what a save must not hold: proposals without their document or candidate, without
    evidence, and evidence without its chunk."""
    missing = lambda rows, other, key: rows.where(F.col(key).isNotNull()).join(other.select(key), key, "left_anti").agg(F.count("*").alias("n"))
    parts = {
        "missing_documents": missing(proposals, documents, "document_id"), "missing_candidates": missing(proposals, candidates, "candidate_id"),
        "without_evidence": missing(proposals, evidence, "proposal_id"), "missing_chunks": missing(evidence, chunks, "chunk_id"),
    }
    rows = None
    for name, counted in parts.items():
        own = counted.select(F.lit(name).alias("check"), F.col("n").alias("violations"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def retagged(proposals: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposals with new tags where they are in REVIEW, and what became of each change."""
    rows = proposals.join(changes.select("proposal_id", F.col("tags").alias("new_tags")), "proposal_id", "left")
    open_ = F.col("status") == "REVIEW"
    asked = F.col("new_tags").isNotNull()
    outcome = F.when(asked & open_, "UPDATED").when(asked, "NOT_IN_REVIEW").otherwise("UNCHANGED")
    return rows.withColumn("outcome", outcome).withColumn("tags", F.when(asked & open_, X.tags("new_tags")).otherwise(F.col("tags"))).drop("new_tags")


def page_type(candidate_type: Column, requested: Column) -> tuple[Column, Column]:
    """The page type of a candidate, and why it has none: the type that was asked for, if the candidate's type allows
    it, else the one that the candidate's type names. Null types are types that were not given."""
    known = F.array(*[F.lit(t) for t in PAGE_TYPES])
    allowed = F.element_at(F.create_map(*[x for kind, own in ALLOWED_TYPES.items() for x in (F.lit(kind), F.array(*[F.lit(t) for t in own]))]), candidate_type)
    refusal = (
        F.when(requested.isNotNull() & ~F.array_contains(known, requested), "UNSUPPORTED_CANDIDATE_MAPPING")
        .when(candidate_type.isNull() & requested.isNull(), "UNSUPPORTED_CANDIDATE_MAPPING")
        .when(candidate_type.isNull(), F.lit(None))
        .when(allowed.isNull(), "UNSUPPORTED_CANDIDATE_MAPPING")
        .when(requested.isNull() & candidate_type.isin("FACT", "PROCEDURE"), "AMBIGUOUS_CANDIDATE_MAPPING")
        .when(requested.isNotNull() & ~F.array_contains(allowed, requested), "UNSUPPORTED_CANDIDATE_MAPPING")
    )
    return F.when(refusal.isNull(), F.coalesce(requested, candidate_type)), refusal


def target_reference(c: Column | str) -> tuple[Column, Column]:
    """What a target names: a page's id after ``wiki:``, or a title in the form in which titles are compared."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    named = c.rlike(r"(?i)^wiki:\S+$")
    return F.when(named, F.substring(c, 6, 1 << 20)), F.when(~named & ~X.is_blank(c), X.title_key(c))


def valid_path(c: Column | str) -> Column:
    """Whether a logical path is ``vault/<folder>/<stem>.md`` of a known folder, without dots, backslashes and controls."""
    c = F.col(c) if isinstance(c, str) else c
    folders = "|".join(X.PAGE_FOLDERS.values())
    return F.coalesce(c.rlike(rf"^vault/(?:{folders})/[^/\\\\\x00-\x1f\x7f]+\.md$") & ~c.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.lit(False))


#: The agreed form of a proposal's data.
DATA = "struct<pageType:string,title:string,summary:string,tags:array<string>,aliases:array<string>,sections:array<struct<heading:string,content:string>>,wikilinks:array<struct<targetTitle:string,label:string>>,_corrupt:string>"


def drafted(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals as drafts: ``proposal_id, title, page_type, path, action, tags, markdown``, or ``refusal``.

    Proposals: ``proposal_id, status, action, candidate_type, title, summary, data`` (JSON), ``document_id``; evidence:
    ``proposal_id, chunk_id, chunk_no, page_no, document_id, excerpt``, bounded for a proposal. Only an approved
    proposal that creates or merges is drafted. What its data gives goes before its candidate's title and summary;
    without sections the summary is one.
    """
    # What several columns name is a column of an earlier step, the JSON is parsed where it can matter, and pages are written
    # after the join, for those alone that are drafts; who is refused before takes nothing along.
    inline = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = proposals.withColumn("unfit", F.when(F.col("status") != "APPROVED", "PROPOSAL_NOT_APPROVED").when(~F.col("action").isin("CREATE", "MERGE"), "UNSUPPORTED_ACTION"))
    rows = rows.withColumn("d", F.when(F.col("unfit").isNull(), F.from_json("data", DATA, {"columnNameOfCorruptRecord": "_corrupt"})))
    rows = rows.withColumn("draft_title", inline(F.coalesce("d.title", "title"))).withColumn("draft_summary", inline(F.coalesce("d.summary", "summary")))
    kind, mapping = page_type(F.col("candidate_type"), F.col("d.pageType"))
    given = F.col("d.sections")
    bad_sections = (F.size(given) == 0) | F.exists(given, lambda s: X.is_blank(s["heading"]) | X.is_blank(s["content"])) | (F.size(F.array_distinct(F.transform(given, lambda s: F.lower(inline(s["heading"]))))) < F.size(given))
    early = (
        F.when(F.col("unfit").isNotNull(), F.col("unfit")).when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "INVALID_NORMALIZED_DATA").when(mapping.isNotNull(), mapping)
        .when((F.coalesce("draft_title", F.lit("")) == "") | (F.coalesce("draft_summary", F.lit("")) == "") | (given.isNotNull() & F.coalesce(bad_sections, F.lit(False))), "INVALID_NORMALIZED_DATA")
    )
    rows = rows.withColumn("early", early).withColumn("kind", kind)
    kept = lambda c: F.when(F.col("early").isNull(), c)
    none = F.array().cast("array<string>")
    rows = rows.select(
        "proposal_id", "document_id", "action", "early", kept(F.col("draft_title")).alias("draft_title"), kept(F.col("draft_summary")).alias("draft_summary"), kept(F.col("kind")).alias("page_type"),
        kept(F.col("d.aliases")).alias("aliases"), kept(given).alias("sections"), kept(F.col("d.wikilinks")).alias("links"), kept(X.joined_tags(F.coalesce("d.tags", none))).alias("joined_tags"),
    )
    rows = rows.withColumn("draft_tags", X.split_tags("joined_tags")).withColumn("path", X.wiki_path(F.col("page_type"), "draft_title")).drop("joined_tags")
    own = spread(evidence, "proposal_id").groupBy("proposal_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "chunk_no", "page_no", "excerpt", F.col("document_id").alias("origin")))).alias("evidence"))
    ids = F.col("evidence")["chunk_id"]
    rows = rows.join(own, "proposal_id", "left")
    late = F.when(F.col("evidence").isNull() | F.get(ids, F.lit(0)).isNull() | (F.size(F.array_distinct(ids)) < F.size(ids)), "INVALID_EVIDENCE").when(F.col("path").isNull(), "PATH_CONTRACT_MISMATCH")
    rows = rows.withColumn("refusal", F.coalesce("early", late))
    aliases = F.transform(F.transform(F.coalesce("aliases", none), inline), lambda a: F.struct(F.lower(a).alias("key"), a.alias("alias")))
    aliases = F.sort_array(F.array_distinct(aliases))["alias"]
    whole = F.array(F.struct(F.lit("Summary").alias("heading"), F.col("draft_summary").alias("content")))
    sections = F.when(F.col("sections").isNotNull(), F.transform("sections", lambda s: F.struct(inline(s["heading"]).alias("heading"), s["content"].alias("content")))).otherwise(whole)
    links = F.transform(F.coalesce("links", F.array().cast("array<struct<targetTitle:string,label:string>>")), lambda x: F.struct(inline(x["targetTitle"]).alias("target"), inline(F.coalesce(x["label"], x["targetTitle"])).alias("label")))
    links = F.sort_array(F.array_distinct(links))
    documents = F.when(F.col("document_id").isNotNull(), F.array("document_id")).otherwise(F.sort_array(F.array_except(F.col("evidence")["origin"], F.array(F.lit(None)))))
    text = published_files.body(F.col("draft_title"), sections, links, F.col("evidence"))
    markdown = published_files.draft_file(F.col("draft_title"), F.col("page_type"), F.col("draft_summary"), F.col("draft_tags"), aliases, documents, ids, text)
    kept = lambda c: F.when(F.col("refusal").isNull(), c)
    return rows.select(
        "proposal_id", kept(F.col("draft_title")).alias("title"), kept(F.col("page_type")).alias("page_type"), kept(F.col("path")).alias("path"), "action",
        kept(F.col("draft_tags")).alias("tags"), kept(markdown).alias("markdown"), "refusal",
    )


def published(pages: DataFrame, operations: DataFrame) -> DataFrame:
    """What a batch of publish operations does to pages: ``operation_id, outcome, revision``.

    CREATE wants no page of that path; MERGE wants the page at one revision below its own. Of several operations on
    one path in a batch the first counts and the others conflict; one whose id is committed is a repeat.
    """
    live = pages.select("path", F.col("revision").alias("live_revision"))
    turn = F.row_number().over(Window.partitionBy("path").orderBy("operation_id"))
    rows = operations.withColumn("turn", F.when(~F.col("committed"), turn)).join(live, "path", "left")
    first = F.row_number().over(Window.partitionBy("path", "committed").orderBy("operation_id")) == 1
    outcome = (
        F.when(F.col("committed"), "REPEATED")
        .when(~first, "CONFLICT")
        .when((F.col("action") == "CREATE") & F.col("live_revision").isNotNull(), "ALREADY_EXISTS")
        .when((F.col("action") == "MERGE") & F.col("live_revision").isNull(), "NOT_FOUND")
        .when((F.col("action") == "MERGE") & (F.col("live_revision") != F.col("revision") - 1), "CONFLICT")
        .otherwise("PUBLISHED")
    )
    return rows.withColumn("outcome", outcome).select("operation_id", "path", "outcome", F.when(outcome == "PUBLISHED", F.coalesce(F.col("live_revision"), F.lit(0)) + 1).alias("new_revision"))


def citation_status(answers: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``answer_id, status``: whether what a kept answer cites is what is there now.

    Citations are JSON: a list of ``{kind, id, hash, path, revision}``. Anything else is LEGACY_FORMAT. A source
    citation is current where its chunk has that hash, a wiki citation where the page of that path has that id and
    revision; an answer without a source citation is NO_SOURCE.
    """
    shape = "array<struct<kind:string,id:string,hash:string,path:string,revision:int>>"
    rows = answers.select("answer_id", F.from_json("citations", shape).alias("own"))
    legacy = rows.select("answer_id", (F.col("own").isNull() | F.exists("own", lambda c: c["kind"].isNull() | c["id"].isNull())).alias("legacy"), "own")
    cited = legacy.where("not legacy").select("answer_id", F.explode("own").alias("c")).select("answer_id", "c.*")
    there = cited.join(chunks.select(F.col("chunk_id").cast("string").alias("id"), F.col("content_hash").alias("now_hash")), "id", "left")
    there = there.join(pages.select("path", F.col("knowledge_id").alias("now_id"), F.col("revision").alias("now_revision")), "path", "left")
    current = F.when(F.col("kind") == "SOURCE", F.col("hash").eqNullSafe(F.col("now_hash"))).otherwise(F.col("id").eqNullSafe(F.col("now_id")) & F.col("revision").eqNullSafe(F.col("now_revision")))
    judged = there.groupBy("answer_id").agg(F.min(current.cast("int")).alias("all_current"), F.max((F.col("kind") == "SOURCE").cast("int")).alias("has_source"))
    status = F.when(F.col("legacy"), "LEGACY_FORMAT").when(F.coalesce("has_source", F.lit(0)) == 0, "NO_SOURCE").when(F.col("all_current") == 1, "CURRENT").otherwise("STALE")
    return legacy.join(judged, "answer_id", "left").select("answer_id", status.alias("citation_status"))


def latest_items(items: DataFrame, jobs: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """``document_id, item_id, status``: the newest item of each document whose job is in one of these states."""
    rows = items.join(jobs.where(F.col("job_status").isin(*states)).select("job_id"), "job_id", "left_semi")
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("item_id"))) == 1
    return rows.withColumn("newest", newest).where("newest").select("document_id", "item_id", "status")


def rebuild_counts(items: DataFrame, job: str = "job_id") -> DataFrame:
    """Per rebuild job: what there was in ``total``, what was ``skipped`` as ineligible, and ``fresh`` and ``failed`` of the
    rest, from items of ``outcome`` FRESH, FAILED or INELIGIBLE."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return items.groupBy(job).agg(F.count("*").alias("total"), count("INELIGIBLE").alias("skipped"), count("FRESH").alias("fresh"), count("FAILED").alias("failed"))


def snapshot_token(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of embedding rows in order: fields parted by U+001F, rows by U+001E, as a tree over ranges of rows."""
    line = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])
    return digests.ordered(rows.select(line.alias("key"), line.alias("value"))).select(F.col("digest").alias("token"))


def decoded_vector(c: Column | str) -> Column:
    """A vector's components as doubles; null where any is missing or not finite, or where there are over 8192."""
    c = (F.col(c) if isinstance(c, str) else c).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine & F.size(c).between(1, 8192), c)


def reranked_or_baseline(baseline: list[str], proposed: list[str] | None) -> list[str]:
    """The order a second stage gives, if it holds exactly the baseline's identities; else the baseline."""
    return list(proposed) if proposed is not None and sorted(proposed) == sorted(baseline) else list(baseline)


def compacted(blocks: list[dict], policy, limit: int) -> list[dict]:
    """What a compaction policy makes of context blocks, if it keeps ids and order, adds nothing and stays within the
    limit; else the blocks as they are."""
    try:
        made = policy([dict(b) for b in blocks])
        order = {b["citation_id"]: i for i, b in enumerate(blocks)}
        places = [order[m["citation_id"]] for m in made]
        fine = places == sorted(set(places)) and all(m["block"] in blocks[i]["block"] for m, i in zip(made, places, strict=True)) and sum(len(m["block"]) for m in made) <= limit
    except Exception:  # a policy is a caller's code: whatever it raises, the baseline answers
        fine = False
    return made if fine else blocks


#: The agreed form of an analysis, and the actions that it may name.
ANALYSIS = "struct<title:string,pageType:string,action:string,summary:string,tags:array<string>,evidence:array<long>>"
ACTIONS = ("CREATE", "MERGE", "LINK_ONLY", "IGNORE", "REVIEW")


def analysis(text: str, asked: str) -> tuple[Column, Column]:
    """An analysis in the agreed JSON form, as a struct, and why a text is none: NOT_JSON, other FIELDS than the agreed
    ones, a field of another TYPE, a blank title or an unknown page type or action (VALUE), or EVIDENCE that is none of
    the chunks that were asked about (an array column)."""
    given = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(given, f"$.{name}", "variant"))
    fields = sorted(f.split(":")[0] for f in ANALYSIS[len("struct<") : -1].split(",") )
    wrong_type = F.lit(False)
    for name in ("title", "pageType", "action", "summary"):
        wrong_type = wrong_type | (kind(name) != "STRING")
    wrong_type = wrong_type | ~kind("tags").isin("ARRAY<STRING>", "ARRAY<VOID>") | ~kind("evidence").isin("ARRAY<BIGINT>", "ARRAY<VOID>")
    found = F.from_json(text, ANALYSIS)
    blank = X.is_blank(found["title"]) | ~found["pageType"].isin(*PAGE_TYPES) | ~found["action"].isin(*ACTIONS)
    keys = F.json_object_keys(text)
    reason = (
        F.when(given.isNull() | keys.isNull(), "NOT_JSON").when(F.array_join(F.array_sort(keys), ",") != ",".join(fields), "FIELDS").when(F.coalesce(wrong_type, F.lit(True)), "TYPE")
        .when(blank, "VALUE").when(F.size(F.array_except(found["evidence"], F.col(asked))) > 0, "EVIDENCE")
    )
    return F.when(reason.isNull(), found), reason
