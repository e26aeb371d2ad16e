"""Published wiki files: rendered, read back, checked against their pages and parsed for what they relate to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.sources.tables import spread

# The layout of drafts and published files, the bounds of a parse, and the largest file that is read.
OPENING, CLOSING = "---\n", "\n---\n"
MOST_RELATIONS, LONGEST_NAME = 2000, 200
MAX_PAGE_BYTES = 1 << 20


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def _scalar(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\n"))


def _let(value: Column, within: Callable[[Column], Column]) -> Column:
    """What ``within`` makes of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), within), 1)


def _list(name: str, items: Column) -> Column:
    """``items`` are texts as they are to stand there."""
    listed = lambda own: F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(own, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))
    return _let(items, lambda own: F.when(F.size(own) > 0, listed(own)).otherwise(F.lit(f"{name}: []\n")))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def body(title: Column, sections: Column, links: Column, evidence: Column) -> Column:
    """A page's text: its title, sections (``heading, content``), links (``target, label``) and evidence (``chunk_id,
    chunk_no, page_no, excerpt``)."""
    own = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), _stripped(s["content"]), F.lit("\n\n"))), "")
    listed = lambda own: F.array_join(F.transform(own, lambda x: F.concat(F.lit("- [["), x["target"], F.lit("|"), x["label"], F.lit("]]\n"))), "")
    related = _let(links, lambda own: F.when(F.size(own) > 0, F.concat(F.lit("## Related Links\n\n"), listed(own), F.lit("\n"))).otherwise(""))

    def shown(e: Column) -> Column:
        page = F.coalesce(F.concat(F.lit(", pageNo: "), e["page_no"].cast("string")), F.lit(""))
        lines = F.concat(F.lit("  > "), F.regexp_replace(_stripped(e["excerpt"]), r"\R", "\n  > "), F.lit("\n"))
        return F.concat(F.lit("- sourceChunkId: "), e["chunk_id"].cast("string"), F.lit(", chunkNo: "), e["chunk_no"].cast("string"), page, F.lit("\n"), lines)

    return F.concat(F.lit("# "), title, F.lit("\n\n"), own, related, F.lit("## Evidence\n\n"), F.array_join(F.transform(evidence, shown), ""))


def _numbers(items: Column) -> Column:
    return F.transform(items, lambda x: x.cast("string"))


def draft_file(title: Column, page_type: Column, summary: Column, tags: Column, aliases: Column, documents: Column, chunks: Column, text: Column) -> Column:
    """A draft's markdown: frontmatter and ``body``."""
    head = [_scalar("title", quoted(title)), _scalar("pageType", quoted(page_type)), _scalar("summary", quoted(summary))]
    head += [_list("tags", F.transform(tags, quoted)), _list("aliases", F.transform(aliases, quoted)), _list("sourceDocumentIds", _numbers(documents)), _list("sourceChunkIds", _numbers(chunks))]
    return F.concat(F.lit(OPENING), *head, F.lit("---\n\n"), text)


def page_file(knowledge_id: Column, title: Column, page_type: Column, tags: Column, aliases: Column, documents: Column, created: Column, updated: Column, proposal_id: Column, draft_id: Column, revision: Column, text: Column) -> Column:
    """A published page's markdown: frontmatter and ``body``."""
    head = [_scalar("id", quoted(knowledge_id)), _scalar("title", quoted(title)), _scalar("type", quoted(page_type)), _scalar("status", F.lit('"PUBLISHED"'))]
    head += [_list("aliases", F.transform(aliases, quoted)), _list("tags", F.transform(tags, quoted)), _list("sources", F.transform(documents, lambda d: quoted(F.concat(F.lit("document:"), d.cast("string")))))]
    head += [_scalar("created_at", quoted(created)), _scalar("updated_at", quoted(updated))]
    head += [_scalar(name, c.cast("string")) for name, c in (("proposal_id", proposal_id), ("draft_id", draft_id), ("revision", revision))]
    return F.concat(F.lit(OPENING), *head, F.lit("---\n\n"), text)


def files(spark: SparkSession, root: str) -> DataFrame:
    """``source_path, length, content`` of every file below a vault; a file that cannot be read has no content.

    The listing opens no file. Contents are read apart, and there what cannot be read is left out.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    read = read.where(F.col("length") <= MAX_PAGE_BYTES).select("path", "content")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rows = listing.join(read, "path", "left")
    return rows.select(F.concat(F.lit(f"{base}/"), F.regexp_replace("path", rf"^.*?/{base}/", "")).alias("source_path"), "length", "content")


def checked(pages: DataFrame, files_: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """Pages with ``content_status`` (VALID, INVALID, UNREADABLE), the ``reason``, and the file's ``markdown`` and
    ``body`` where it is valid.

    Pages: ``knowledge_id, title, page_type, markdown_path, content_hash``. A file backs its page if it lies at the
    path of the page's type and title, has the page's digest, is whole UTF-8, names the page's id, title, type and
    status in its frontmatter and its title in its heading, and has a body. The first test that fails is the reason.
    """
    own = files_.select(F.col("source_path").alias("markdown_path"), F.lit(True).alias("file_there"), "length", "content")
    rows = spread(pages, "markdown_path").join(own, "markdown_path", "left").withColumn("file_text", F.col("content").cast("string"))
    rows = rows.withColumn("markdown", X.nfc("file_text"))
    text = F.col("file_text")
    end = F.locate("\n---\n\n", text)
    head = F.substring(text, F.lit(1), end)
    names = lambda name, value: F.contains(head, F.concat(F.lit(f"\n{name}: "), quoted(value), F.lit("\n")))
    agrees = names("id", F.col("knowledge_id")) & names("title", F.col("title")) & names("type", F.col("page_type")) & names("status", F.lit("PUBLISHED"))
    reason = (
        F.when(~F.col("markdown_path").eqNullSafe(X.wiki_path(F.col("page_type"), "title")), "PATH_NOT_CANONICAL")
        .when(F.col("file_there").isNull(), "FILE_MISSING")
        .when(F.col("length") > max_bytes, "TOO_LARGE")
        .when(F.col("content").isNull(), "UNREADABLE")
        .when(~F.sha2("content", 256).eqNullSafe(F.col("content_hash")), "HASH_DIFFERS")
        .when(~F.is_valid_utf8(text), "NOT_UTF8")
        .when(~F.startswith(text, F.lit(OPENING)) | (end == 0), "NO_FRONTMATTER")
        .when(~F.coalesce(agrees, F.lit(False)), "METADATA_DIFFERS")
        .when(~F.contains(text, F.concat(F.lit("\n# "), F.col("title"), F.lit("\n"))), "TITLE_DIFFERS")
        .when(F.length(text) <= end + 5, "NO_BODY")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "VALID").when(F.col("reason") == "UNREADABLE", "UNREADABLE").otherwise("INVALID")
    fine = F.col("reason").isNull()
    searchable = F.substring(F.col("markdown"), F.locate("\n---\n\n", F.col("markdown")) + 6, F.length("markdown"))
    return rows.select(*pages.columns, status.alias("content_status"), "reason", F.when(fine, F.col("markdown")).alias("markdown"), F.when(fine, searchable).alias("body"))


def relations(markdown: str) -> Column:
    """What a composed file relates to, from its column: a struct of ``tags``, ``sources`` (ids) and ``links`` (titles as
    links compare them), each distinct and in order, and ``error``, the first rule that is broken; then the lists
    are empty.

    Lists of the frontmatter are ``name:`` with quoted items of their own lines, or ``name: []``, once; a tag is one
    line of at most 200 characters, a source is ``document:<id>``; a link's target has at most 200 characters and none
    of ``#``, ``/`` and ``\\``. There are 2,000 of each at most.
    """
    text = F.col(markdown)
    end = F.locate(CLOSING, text, 5)
    head, rest = F.substring(text, F.lit(5), end - 5), F.substring(text, end + 5, F.length(text))
    broken = ~F.coalesce(F.startswith(text, F.lit(OPENING)) & (end > 0), F.lit(False))

    def listed(lines: Column, name: str) -> Column:
        """A struct of the decoded items and whether the list is badly formed."""
        inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
        fine = lambda x: (F.length(x) >= 2) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & ~F.contains(F.regexp_replace(inner(x), r'\\[\\"n]', ""), F.lit("\\"))
        plain = lambda x: F.array_join(F.transform(F.split(inner(x), r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))), "\\")
        none = F.array().cast("array<string>")

        def found(places: Column) -> Column:
            at = F.try_element_at(places, F.lit(1))
            line = F.get(lines, at)
            after = F.when(line == f"{name}:", F.slice(lines, at + 2, F.size(lines))).otherwise(none)
            return F.struct(at.isNotNull().alias("there"), (F.size(places) > 1).alias("twice"), line.alias("line"), after.alias("after"))

        def counted(x: Column) -> Column:
            first_other = F.array_position(F.transform(x["after"], lambda y: F.startswith(y, F.lit("  - "))), False).cast("int")
            return F.struct(x.alias("x"), F.when(first_other > 0, first_other - 1).otherwise(F.size(x["after"])).alias("count"))

        def cut(c: Column) -> Column:
            x = c["x"]
            items = F.when(x["there"], F.transform(F.slice(x["after"], F.lit(1), c["count"]), lambda y: F.substring(y, 5, 1 << 20))).otherwise(none)
            wrong = x["twice"] | (x["there"] & ~x["line"].isin(f"{name}:", f"{name}: []")) | F.coalesce(F.get(x["after"], c["count"]).rlike(r"^\s"), F.lit(False))
            return F.struct(items.alias("items"), wrong.alias("wrong"))

        places = F.filter(F.transform(lines, lambda line, i: F.when(F.startswith(line, F.lit(f"{name}:")), i)), lambda i: i.isNotNull())
        own = _let(_let(_let(places, found), counted), cut)
        return _let(own, lambda x: F.struct(F.transform(x["items"], plain).alias("items"), (x["wrong"] | F.exists(x["items"], lambda y: ~fine(y))).alias("wrong"), F.size(x["items"]).alias("n")))

    lists = _let(F.split(head, "\n"), lambda lines: F.struct(listed(lines, "tags").alias("tags"), listed(lines, "sources").alias("sources")))
    tag_of = lambda t: F.lower(_stripped(t))
    bad_tag = lambda t: (t == "") | (F.length(t) > LONGEST_NAME) | t.rlike(r"\R")
    found = F.regexp_extract_all(rest, F.lit(X.WIKILINK), F.lit(1))
    targets = F.transform(found, lambda t: F.substring_index(t, "|", 1))
    bad_link = lambda t: X.is_blank(t) | (F.length(t) > LONGEST_NAME) | t.rlike(r"[#/\\]")
    bad_source = lambda s: ~s.rlike(r"\Adocument:[1-9][0-9]{0,18}\z") | F.try_to_number(F.substring(s, 10, 19), F.lit("9" * 19)).isNull() | (F.substring(s, 10, 19).cast("decimal(20,0)") > F.lit(2**63 - 1))

    own = _let(lists, lambda x: F.struct(x["tags"].alias("tags"), x["sources"].alias("sources"), targets.alias("targets")))
    wrong = lambda x: (
        F.when(broken, "NO_FRONTMATTER")
        .when(x["tags"]["wrong"] | x["sources"]["wrong"], "MALFORMED_LIST")
        .when(F.greatest(x["tags"]["n"], x["sources"]["n"], F.size(x["targets"])) > MOST_RELATIONS, "TOO_MANY")
        .when(F.exists(x["tags"]["items"], lambda t: bad_tag(tag_of(t))), "MALFORMED_TAG")
        .when(F.exists(x["sources"]["items"], bad_source), "MALFORMED_SOURCE")
        .when(F.exists(x["targets"], bad_link), "MALFORMED_LINK")
    )
    none = F.array().cast("array<string>")
    judged = _let(own, lambda x: F.struct(x.alias("x"), wrong(x).alias("error")))
    return _let(judged, lambda c: F.struct(
        F.when(c["error"].isNull(), F.array_sort(F.array_distinct(F.transform(c["x"]["tags"]["items"], tag_of)))).otherwise(none).alias("tags"),
        F.when(c["error"].isNull(), F.array_sort(F.array_distinct(F.transform(c["x"]["sources"]["items"], lambda s: F.substring(s, 10, 19).try_cast("long"))))).otherwise(F.array().cast("array<long>")).alias("sources"),
        F.when(c["error"].isNull(), F.array_sort(F.array_distinct(F.transform(c["x"]["targets"], X.composed_title_key)))).otherwise(none).alias("links"),
        c["error"].alias("error"),
    ))


# Why a finding is not repaired.
REFUSALS = {
    "BROKEN_INTERNAL_LINK": "AMBIGUOUS_TARGET", "ORPHAN_PAGE": "SEMANTIC_JUDGMENT_REQUIRED", "CANONICAL_CONTENT_UNREADABLE": "TARGET_NOT_READABLE",
    "DUPLICATE_IDENTITY": "AMBIGUOUS_IDENTITY", "DANGLING_PROVENANCE": "NO_RESOLVABLE_LINEAGE",
}


def repairs(findings: DataFrame, pages: DataFrame, proposals: DataFrame, evidence: DataFrame, workspace: int) -> DataFrame:
    """Lint findings with ``refusal``, null where the page can be rebuilt from its proposal, and then ``plan_key``, one for
    the same damage of the same content.

    findings: ``knowledge_id, code, detail``; pages: ``knowledge_id, content_hash, proposal_id, readable``; proposals:
    ``proposal_id, action, draftable`` (whether its data still makes a draft); evidence: ``proposal_id, chunk_id``. Only
    invalid content is repaired, of a page whose file can be read and whose proposal made it, with evidence.
    """
    made = proposals.where(F.col("action").isin("CREATE", "MERGE") & F.col("draftable")).select("proposal_id", F.lit(True).alias("made"))
    backed = evidence.groupBy("proposal_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("evidence_chunks"))  # the evidence of one proposal
    rows = findings.join(pages.select("knowledge_id", "content_hash", "proposal_id", "readable", F.lit(True).alias("page_there")), "knowledge_id", "left")
    rows = rows.join(made, "proposal_id", "left").join(backed, "proposal_id", "left")
    fixed = F.element_at(F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair]), F.col("code"))
    refusal = F.when(F.col("code") != "CANONICAL_CONTENT_INVALID", fixed).when(F.col("page_there").isNull(), "NO_RESOLVABLE_LINEAGE").when(~F.coalesce("readable", F.lit(False)), "TARGET_NOT_READABLE")
    refusal = refusal.when(F.col("made").isNull() | F.col("evidence_chunks").isNull(), "NO_RESOLVABLE_LINEAGE")
    key = X.sha256(F.concat_ws(":", F.lit(f"vault-repair:v1:{workspace}"), "knowledge_id", "code", "content_hash", "detail"))
    return rows.select("knowledge_id", "code", "detail", refusal.alias("refusal"), F.when(refusal.isNull(), key).alias("plan_key"), F.when(refusal.isNull(), F.col("evidence_chunks")).alias("evidence_chunks"))
