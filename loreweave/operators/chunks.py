"""Blocks and chunks: page and paragraph segmentation, repeated page edges, and the two chunking policies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.sources.tables import small_batches

# A blank line between blocks, and a heading that is a whole block.
_BOUNDARY = r"(?:\r\n|\r|\n)[\t ]*(?:\r\n|\r|\n)+"
_HEADING = r"^[\t ]{0,3}(#{1,6})[\t ]+(.+?)[\t ]*#*[\t ]*$"
#: UTF-16 units that a chunk aims at.
TARGET = 3000
#: Characters of chunks that are kept as Python's before they go back to Arrow.
_HELD = 1 << 20


def pages(content: Column | str) -> Column:
    return F.split(content, "\f")


def blocks(docs: DataFrame, doc_id: str, content: str) -> DataFrame:
    """``doc_id, block_no, page_no, kind, level, title, text``: the paragraphs of each page in order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(pages(content)).alias("page", "page_text"))
    rows = rows.select("doc_id", "page", F.posexplode(F.split("page_text", _BOUNDARY)).alias("at", "raw"))
    rows = rows.withColumn("text", F.regexp_replace("raw", r"^[\s&&[^\f]]+|[\s&&[^\f]]+$", "")).where("text <> ''")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at"))  # the blocks of one document
    level = F.length(F.regexp_extract("text", _HEADING, 1))
    return rows.select(
        "doc_id", number.alias("block_no"), (F.col("page") + 1).alias("page_no"),
        F.when(level > 0, "HEADING").otherwise("PARAGRAPH").alias("kind"), level.alias("level"),
        F.when(level > 0, F.trim(F.regexp_extract("text", _HEADING, 2))).alias("title"), "text",
    )


def edge_lines(docs: DataFrame, doc_id: str, content: str, minimum: int = 2) -> DataFrame:
    """``doc_id, edge, line, pages``: first and last lines that ``minimum`` pages of a document share."""
    shown = F.filter(F.transform(pages(content), lambda p: F.filter(F.split(p, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s", " ")) != "")), lambda p: F.size(p) > 0)
    rows = docs.where(F.size(pages(content)) >= minimum).select(F.col(doc_id).alias("doc_id"), F.explode(shown).alias("lines"))
    edge = F.explode(F.array(F.struct(F.lit("header").alias("edge"), F.element_at("lines", 1).alias("line")), F.struct(F.lit("footer").alias("edge"), F.element_at("lines", -1).alias("line"))))
    rows = rows.select("doc_id", edge.alias("e")).select("doc_id", "e.*")
    return rows.groupBy("doc_id", "edge", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= minimum)


def _starts(page: np.ndarray, kind: list[str], units: np.ndarray, anchored: bool, target: int) -> list[int]:
    """The places of the blocks that begin a chunk.

    Segments are cut before headings and new pages and, if anchored, around what is neither heading nor paragraph. In
    a segment the next chunk begins at the first block with which the text from the last beginning, joined by blank
    lines, has more than ``target`` units; a paragraph is never cut. Anchored, a heading keeps its first paragraph.
    """
    heads = np.array([k == "HEADING" for k in kind])
    alone = np.array([anchored and k not in ("HEADING", "PARAGRAPH") for k in kind])
    marks = heads | alone | np.concatenate(([True], page[1:] != page[:-1])) | np.concatenate(([False], alone[:-1]))
    upto = np.concatenate(([0], np.cumsum(units + 2)))  # units of the blocks before a place, with a blank line each
    segments, starts = np.append(np.flatnonzero(marks), len(kind)).tolist(), []
    for begin, end in zip(segments, segments[1:], strict=False):
        while begin < end:
            starts.append(begin)
            first_too_many = int(np.searchsorted(upto, target + 2 + upto[begin], side="right")) - 1
            begin = max(first_too_many, begin + 1 + int(anchored and heads[begin]))
    return starts


def _paths(level: np.ndarray, titles: list[str | None], at: list[int]) -> list[list[str]]:
    """The titles that hold at each of the places, outermost first: the last heading of a level counts unless one of a
    higher level came after it."""
    place, above, out = np.arange(len(level)), np.full(len(at), -1), [[] for _ in at]
    for own in range(1, int(level.max(initial=0)) + 1):
        last = np.maximum.accumulate(np.where(level == own, place, -1))[at]
        for i in np.flatnonzero(last > above):
            if title := (titles[last[i]] or "").strip():
                out[i].append(title)
        above = np.maximum(above, last)
    return out


def _chunks(own: list[dict], anchored: bool, target: int) -> list[dict]:
    """The chunks of one document's blocks. What is blank is kept as evidence of the next chunk, or of the last."""
    if not own:
        return []
    texts = [b["text"] for b in own]
    starts = _starts(np.array([b["page_no"] for b in own]), [b["kind"] for b in own], np.array([len(t.encode("utf-16-le")) // 2 for t in texts]), anchored, target)
    paths = _paths(np.array([b["level"] for b in own]), [b["title"] for b in own], starts)
    joined = ["\n\n".join(texts[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)], strict=True)]
    shown = [i for i, text in enumerate(joined) if text.strip()]
    if not shown:
        return []
    owner = [shown[min(k, len(shown) - 1)] for k in np.searchsorted(shown, np.arange(len(joined)))]
    out = []
    for i in shown:
        content = "\n\n".join(text for text, o in zip(joined, owner, strict=True) if o == i) if len(shown) < len(joined) else joined[i]
        out.append({"page_no": own[starts[i]]["page_no"], "section": paths[i][-1] if paths[i] else None, "heading_path": " > ".join(paths[i]) or None, "content": content, "own": joined[i]})
    return out


_CHUNK = "array<struct<chunk_no: int, page_no: int, section: string, heading_path: string, content: string, normalized_content: string>>"


def chunk(blocks_: DataFrame, policy: str = "chunk-policy-v1-current", target: int = TARGET) -> DataFrame:
    """``doc_id, chunk_no, page_no, section, heading_path, content, normalized_content, content_hash``.

    A document's blocks come together in an array, on which an Arrow function marks where chunks begin.
    """
    policies = {"chunk-policy-v1-current": False, "chunk-policy-v2-heading-anchored": True}
    anchored = policies[policy]

    kinds = [("chunk_no", pa.int32()), ("page_no", pa.int32()), *((n, pa.string()) for n in ("section", "heading_path", "content", "normalized_content"))]
    kind = pa.list_(pa.struct(kinds))

    @F.arrow_udf(_CHUNK)
    def cut(own: pa.Array) -> pa.Array:
        parts, out, held = [], [], 0
        for rows in own:  # one document at a time becomes Python's; what is cut goes back to Arrow soon
            found = _chunks(rows.as_py() or [], anchored, target)
            out.append([{"chunk_no": i + 1, "page_no": c["page_no"], "section": c["section"], "heading_path": c["heading_path"], "content": c["content"], "normalized_content": c["own"]} for i, c in enumerate(found)])
            held += sum(len(c["content"]) for c in found)
            if held > _HELD:
                parts.append(pa.array(out, kind))
                out, held = [], 0
        return pa.concat_arrays([*parts, pa.array(out, kind)])

    own = F.array_sort(F.collect_list(F.struct("block_no", "page_no", "kind", "level", "title", "text")))
    small_batches(blocks_.sparkSession)
    rows = blocks_.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.explode(cut("own")).alias("c"))
    return rows.select("doc_id", "c.*").withColumn("content_hash", F.sha2("normalized_content", 256)).withColumn("chunk_policy_version", F.lit(policy))
