"""Source documents: registration, versions, eligibility, extraction state and usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import text as X

# Statuses, and the file kinds that have a parser.
DEAD = ("DELETED", "SUPERSEDED", "DUPLICATE")
SUPPORTED = ("pdf", "doc", "docx", "html", "htm", "md", "markdown", "txt")
INBOX_SORT = {"createdAt": "created_at", "fileName": "file_name", "fileSize": "file_size", "status": "status"}


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def safe_file_name(name: Column | str) -> Column:
    """The last part of a path; null for none, dots alone or a zero character."""
    last = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(~last.isin("", ".", "..") & ~last.contains("\x00"), last)


def supported(name: Column | str) -> Column:
    return extension(name).isin(*SUPPORTED)


def register(documents: DataFrame, by: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """Each row with ``status`` PENDING, or DUPLICATE and ``duplicate_of``, the least live id of the same content.

    The least id of a content is one partial aggregation; rows are joined with it, so that a content of any number
    of copies is never gathered in one task.
    """
    live = documents if "status" not in documents.columns else documents.where(~F.col("status").isin(*DEAD))
    first = live.groupBy(*by).agg(F.min("document_id").alias("first_id"))
    out = documents.drop("status").join(first, list(by), "left")
    copy = F.coalesce(F.col("first_id") < F.col("document_id"), F.lit(False))
    return out.withColumn("status", F.when(copy, "DUPLICATE").otherwise("PENDING")).withColumn("duplicate_of", F.when(copy, F.col("first_id"))).drop("first_id")


def _slots(name: Column) -> tuple[Column, Column]:
    """A file name without its extension, and the extension with its point."""
    end = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(end)), end


def landed(uploads: DataFrame, stored_names: DataFrame, documents: DataFrame) -> DataFrame:
    """What becomes of a batch of uploads (``upload_id, file_name, content``): ``upload_id, outcome, reason, stored_name,
    sha256, file_size, duplicate_of``.

    An upload without content or a usable name is REJECTED, and the others go on. Names in use (``stored_names``:
    ``stored_name``) are not taken again: a file gets the first free of ``name.ext``, ``name-1.ext`` and so on, earlier
    uploads first. A content that a live document has (``documents``: ``document_id, sha256, status``), or an earlier
    upload of the batch, is a DUPLICATE, of that document where there is one; all others are STORED.
    """
    name = safe_file_name(F.trim("file_name"))
    rows = uploads.select("upload_id", name.alias("name"), F.col("file_name"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("file_size"))
    blank = F.coalesce(F.trim("file_name"), F.lit("")) == ""
    reason = F.when(F.col("file_size") == 0, "EMPTY").when(blank, "BLANK_NAME").when(F.coalesce(F.trim("name"), F.lit("")) == "", "INVALID_NAME")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn("base", _slots(F.col("name"))[0]).withColumn("end", _slots(F.col("name"))[1])

    used = stored_names.select("stored_name").withColumn("least", F.lit(0)).unionByName(good.select(F.col("name").alias("stored_name"), F.lit(1).alias("least"))).distinct()
    base, end = _slots(F.col("stored_name"))
    numbered = F.regexp_extract(base, r"(?s)^(.+)-([1-9][0-9]{0,8})$", 2)
    taken = used.where("least = 0").select(base.alias("base"), end.alias("end"), F.lit(0).alias("n"))
    taken = taken.unionByName(used.where(numbered != "").select(F.regexp_extract(base, r"(?s)^(.+)-([1-9][0-9]{0,8})$", 1).alias("base"), end.alias("end"), numbered.cast("int").alias("n")))
    taken = taken.groupBy("base", "end").agg(F.collect_set("n").alias("taken"))  # the files of one name
    turn = F.row_number().over(Window.partitionBy("base", "end").orderBy("upload_id"))
    good = good.withColumn("turn", turn).join(taken, ["base", "end"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(0), F.col("turn") + F.size("taken")), "taken")
    slot = F.element_at(free, F.col("turn"))
    good = good.withColumn("stored_name", F.when(slot == 0, F.col("name")).otherwise(F.concat("base", F.lit("-"), slot.cast("string"), "end")))

    live = documents.where(~F.col("status").isin(*DEAD)).groupBy(F.col("sha256").alias("live_sha")).agg(F.min("document_id").alias("duplicate_of"))
    first = good.groupBy(F.col("sha256").alias("own_sha")).agg(F.min("upload_id").alias("first_upload"))
    good = good.join(live, F.col("sha256") == F.col("live_sha"), "left").join(first, F.col("sha256") == F.col("own_sha"))
    outcome = F.when(F.col("duplicate_of").isNotNull() | (F.col("first_upload") < F.col("upload_id")), "DUPLICATE").otherwise("STORED")
    done = good.select("upload_id", outcome.alias("outcome"), "reason", "stored_name", "sha256", "file_size", "duplicate_of")
    refused = rows.where("reason is not null").select("upload_id", F.lit("REJECTED").alias("outcome"), "reason", F.lit(None).cast("string").alias("stored_name"), "sha256", "file_size")
    return done.unionByName(refused, allowMissingColumns=True)


def versions(documents: DataFrame) -> DataFrame:
    """Rows of one path as versions: the parent, and whether a later one supersedes it."""
    order = Window.partitionBy("source_path").orderBy("document_id")
    out = documents.withColumn("parent_version", F.lag("document_id").over(order))
    return out.withColumn("superseded", F.lead("document_id").over(order).isNotNull())


def missing_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file is gone; they become DELETED."""
    return documents.join(files.select("source_path"), "source_path", "left_anti").withColumn("status", F.lit("DELETED"))


def duplicate_clusters(registered: DataFrame) -> DataFrame:
    """Per canonical document: its copies, and the one that takes over when it is deleted."""
    own = registered.where("duplicate_of is not null")
    return own.groupBy(F.col("duplicate_of").alias("canonical_id")).agg(F.count("*").alias("copies"), F.min("document_id").alias("promoted_id"))


def promote(registered: DataFrame, deleted_id: int, files: DataFrame | None = None) -> DataFrame:
    """The rows after a canonical document is deleted: the least copy whose file is there (``files``: ``source_path``) is
    PENDING, or the least copy where no file is, and the rest point at it."""
    copies = registered.where(F.col("duplicate_of") == deleted_id)
    if files is not None:
        copies = copies.join(files.select("source_path", F.lit(True).alias("there")).distinct(), "source_path", "left")
    there = F.col("there") if files is not None else F.lit(None).cast("boolean")
    heir = copies.agg(F.coalesce(F.min(F.when(there, F.col("document_id"))), F.min("document_id")).alias("heir"))
    rows = registered.join(F.broadcast(heir), F.lit(True), "left")  # one row
    mine = F.col("duplicate_of") == deleted_id
    status = F.when(F.col("document_id") == deleted_id, "DELETED").when(mine & (F.col("document_id") == F.col("heir")), "PENDING").otherwise(F.col("status"))
    points = F.when(mine & (F.col("document_id") == F.col("heir")), F.lit(None)).when(mine, F.col("heir")).otherwise(F.col("duplicate_of"))
    return rows.withColumn("new_status", status).withColumn("new_duplicate_of", points).drop("heir", "status", "duplicate_of").withColumnsRenamed({"new_status": "status", "new_duplicate_of": "duplicate_of"})


def eligible(documents: DataFrame) -> DataFrame:
    return documents.where((F.col("parse_status") == "PROCESSED") & ~F.col("status").isin(*DEAD))


def chunk_eligible() -> Column:
    """A chunk that may be evidence: valid numbers, composed content that is not blank and has the digest it claims."""
    fine = (F.col("chunk_id") > 0) & (F.col("chunk_no") > 0) & (F.col("page_no").isNull() | (F.col("page_no") > 0))
    composed = X.nfc("normalized_content") == F.col("normalized_content")
    return fine & ~X.is_blank("normalized_content") & composed & (F.sha2("normalized_content", 256) == F.col("content_hash"))


def extraction_state(text: Column, name: Column, pages: Column, failed: Column) -> Column:
    """PROCESSED, or why not; a PDF with pages and under 50 visible characters needs OCR."""
    scanned = (extension(name) == "pdf") & (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 50) & (pages > 0)
    return F.when(~supported(name), "UNSUPPORTED").when(failed, "FAILED").when(scanned, "NEED_OCR").otherwise("PROCESSED")


def usability() -> Column:
    """The state of a document for its reader, from its own row, its latest job item and its index ledger."""
    parse = F.col("parse_status")
    return (
        F.when(F.col("status") == "DUPLICATE", "DUPLICATE")
        .when(F.col("active_ingest"), "PROCESSING")
        .when(X.is_blank(parse), F.when(F.col("latest_ingest") == "FAILED", "FAILED").otherwise("NOT_PROCESSED"))
        .when(parse.isin("NEED_OCR", "UNSUPPORTED"), parse)
        .when(parse != "PROCESSED", "FAILED")
        .when(F.col("sync_status").isNull() | (F.col("sync_status") == "INDEX_PENDING"), "INDEX_PENDING")
        .when(F.col("sync_status") == "INELIGIBLE", "NOT_SEARCHABLE")
        .when(F.col("sync_status") == "SYNCED", F.when(F.col("fresh"), "READY_TO_USE").otherwise("INDEX_STALE"))
        .otherwise("INDEX_PENDING")
    )


def inbox_page(documents: DataFrame, sort: str = "createdAt", ascending: bool = False, page: int = 0, size: int = 20, **wanted: str) -> DataFrame:
    """One page of the live inbox; ``wanted`` may fix status, parse_status or extension."""
    if sort not in INBOX_SORT or not 0 < size <= 200 or page < 0:
        raise ValueError("unknown sort or page")
    rows = documents.where(F.col("source_path").startswith("inbox/") & ~F.col("status").isin("DELETED", "SUPERSEDED", "ARCHIVED"))
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    key = F.col(INBOX_SORT[sort])
    return rows.orderBy(key.asc() if ascending else key.desc(), F.col("document_id").desc()).offset(page * size).limit(size)
