"""Repeated word spans: windows of k words as edges of a de Bruijn graph, compacted into paths by Spark joins.

0. Copies of a whole text are known by its digest; only the one with the smallest id goes on, and the others lose
   all words if they have a window.
1. Anchors. Every window of k words is represented by the least hash of its k - a + 1 runs of a words, so equal
   windows have equal anchors. Anchors that start in one document only cannot belong to a repeated window;
   the others are found by one aggregation over about a quarter of the positions.
2. Edges. Windows with a shared anchor give an edge each: a 96-bit identity, its coordinates (document, position),
   and the edges before and after it. An edge is repeated where it has two documents; the smallest is its source,
   one of its places there is kept, and an edge that has one neighbour only on either side in all documents does
   not branch there.
3. Compaction. The repeated edges are joined with their coordinates. Where a document steps from one to the next
   position, both have the same source, and neither branches between them, the steps are one path (gaps and
   islands over the document's coordinates).
4. Verification and removal. The words of every path are read at its source's coordinates, once for all documents
   that run along it, and joined with these documents. Where the words at a document's own coordinates are the
   same, word by word, they are removed; where they are not, the path does not count.

All decisions are made on the documents as given, not on what is left of them.

Defined results: a null text has no words; a text under k words has no window; a null id takes no part and
loses nothing; of rows that share an id each loses its own words, and none because of another row of that id;
repeated rows are returned as often as they occur; an empty table gives an empty result. Extra columns are
kept by ``remove_repeats``; its own columns have names that begin with ``loreweave_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm import shared

WINDOW_WORDS = 13
ANCHOR_WORDS = 7
#: Words whose hashes a Python worker keeps at most.
_KNOWN_WORDS = 500_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _runs(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of n words."""
    count = len(words) - n + 1
    h = words[:count].copy()
    for i in range(1, n):
        h *= factor
        h += words[i : i + count]
    return _mixed(h)


def _anchors(words: np.ndarray, k: int, a: int) -> np.ndarray:
    """The anchor of every window of k words: the least hash of the runs of a words in it."""
    runs = _runs(words, a, _M1)
    count = len(words) - k + 1
    least = runs[:count].copy()
    for i in range(1, k - a + 1):
        np.minimum(least, runs[i : i + count], out=least)
    return least


def _hashed(words: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchor_rows(k: int, a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in shared.table_of(batches):
            found, owners = [], []
            for digest, text in zip(batch.column(0).to_pylist(), shared.as_bytes(batch.column(1)), strict=True):
                words = text.split()
                if len(words) >= k:
                    own = np.unique(_anchors(_hashed(words, known), k, a))
                    found.append(own)
                    owners.append(np.full(len(own), digest, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(found)), pa.array(np.concatenate(owners))], ["anchor", "digest"])

    return run


_EDGE = "hi long, lo int, doc long, slot long, prev int, next int"


def _row_key() -> Column:
    """32 bits that tell the rows of one id apart."""
    return F.shiftright(shared.text_digest(), 32).cast("int")


def _edge_rows(k: int, a: int):
    """Windows whose anchor is shared, by place, with the low half of the window before and after (0: none such).

    A slot is the key of a row and the position in its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in shared.table_of(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, key, text, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.as_bytes(batch.column(2)), batch.column(3), strict=True):
                words = _hashed(text.split(), known)
                if len(words) < k:
                    continue
                wanted = np.sort(anchors.values.to_numpy().view(np.uint64))
                own = _anchors(words, k, a)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                keep = wanted[at] == own
                if not keep.any():
                    continue
                hi, lo = _runs(words, k, _M1), _runs(words, k, _M2).astype(np.uint32).view(np.int32)
                linked = np.where(keep, lo, np.int32(0))
                pos = np.flatnonzero(keep)
                prev = np.concatenate((np.zeros(1, np.int32), linked[:-1]))[pos]
                after = np.concatenate((linked[1:], np.zeros(1, np.int32)))[pos]
                for column, x in zip(columns, (hi[pos], lo[pos], np.full(len(pos), doc, np.int64), (key << 32) + pos, prev, after), strict=True):
                    column.append(x)
            if columns[0]:
                whole = [np.concatenate(c) for c in columns]
                yield pa.RecordBatch.from_arrays([_longs(whole[0]), *map(pa.array, whole[1:])], [c.split()[0] for c in _EDGE.split(", ")])

    return run


def repeated_spans(documents: DataFrame, k: int = WINDOW_WORDS, a: int = ANCHOR_WORDS) -> DataFrame:
    """``doc, slot, windows, source_doc, source_slot``: where a document runs along a path that has a smaller source.

    A row says that ``windows`` windows in a row of the document, from its slot on, are one compacted path, which
    begins at ``source_slot`` of its source.
    """
    shared.small_batches(documents.sparkSession)
    keyed = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_digest().alias("digest"), "text")
    anchors = shared.written(keyed.select("digest", "text").mapInArrow(_anchor_rows(k, a), "anchor long, digest long"), "anchors")
    common = anchors.groupBy("anchor").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("anchor")
    common = shared.written(common, "common-anchors")  # a table, so that the join can be split where one anchor is very common
    wanted = anchors.join(common, "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))  # an array no longer than its text
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    wanted = shared.written(wanted.join(first, "digest").select(F.col("digest").alias("loreweave_digest"), "doc", "anchors"), "shared-anchors")
    shared.discard(anchors)

    mine = (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("loreweave_digest"))
    members = keyed.join(wanted.hint("shuffle_hash"), mine).select("doc_id", _row_key().cast("long"), "text", "anchors")
    edges = shared.written(members.mapInArrow(_edge_rows(k, a), _EDGE), "edges")
    nodes = edges.groupBy("hi", "lo").agg(
        F.min("doc").alias("source_doc"),
        F.max("doc").alias("most"),
        F.min_by("slot", "doc").alias("source_slot"),  # one of the source's places where it has several
        *[f(c).alias(f"{c}_{n}") for c in ("prev", "next") for n, f in (("min", F.min), ("max", F.max))],
    )
    only = lambda c: F.when(F.col(f"{c}_min") == F.col(f"{c}_max"), F.col(f"{c}_min")).alias(f"only_{c}")
    nodes = nodes.where("source_doc <> most").select("hi", "lo", "source_doc", "source_slot", only("prev"), only("next"))
    nodes = shared.written(nodes, "repeated-edges")

    places = edges.select("hi", "lo", "doc", "slot").join(nodes, ["hi", "lo"]).where("source_doc < doc").drop("hi")
    along = Window.partitionBy("doc", F.shiftright("slot", 32)).orderBy("slot")  # the positions of one document
    before = lambda c: F.lag(c).over(along)
    step = (before("slot") == F.col("slot") - 1) & (before("source_doc") == F.col("source_doc"))
    step = step & (before("only_next") == F.col("lo")) & (F.col("only_prev") == before("lo"))
    paths = places.withColumn("start", F.when(~F.coalesce(step, F.lit(False)), F.col("slot")))
    paths = paths.withColumn("start", F.max("start").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first_step = F.col("slot") == F.col("start")
    spans = paths.groupBy("doc", "start").agg(F.count("*").cast("int").alias("windows"), *[F.max(F.when(first_step, F.col(c))).alias(c) for c in ("source_doc", "source_slot")])
    spans = shared.written(spans.withColumnRenamed("start", "slot"), "paths")
    for table in (edges, nodes, wanted, common):
        shared.discard(table)
    return spans


def _position(slot: str) -> Column:
    return F.shiftright(F.shiftleft(slot, 32), 32).cast("int")


def with_source_words(spans: DataFrame, documents: DataFrame, k: int = WINDOW_WORDS) -> DataFrame:
    """``doc, key, spans``: per row of a document, ``(start, windows, words)`` with the words that its source has there."""
    slices = spans.select("source_doc", "source_slot", "windows").distinct()
    wanted = slices.groupBy("source_doc", F.shiftright("source_slot", 32).cast("int").alias("source_key")).agg(
        F.collect_list(F.struct("source_slot", _position("source_slot").alias("start"), "windows")).alias("slices")
    )  # no more than the source has words
    rows = documents.select(F.col("doc_id").cast("long").alias("source_doc"), _row_key().alias("source_key"), "text")

    @F.arrow_udf("array<string>")
    def words_at(text: pa.Array, slices: pa.Array) -> pa.Array:
        out = []
        for data, own in zip(shared.as_bytes(text), slices.to_pylist(), strict=True):
            words = data.split()
            out.append([b" ".join(words[s["start"] : s["start"] + s["windows"] + k - 1]) for s in own])
        return pa.array(out, pa.list_(pa.binary())).cast(pa.list_(pa.string()))

    read = rows.join(wanted.hint("shuffle_hash"), ["source_doc", "source_key"])
    read = read.select("source_doc", "source_key", F.arrays_zip("slices", words_at("text", "slices").alias("words")).alias("s"))
    read = read.dropDuplicates(["source_doc", "source_key"]).select("source_doc", F.explode("s").alias("s"))  # repeated rows are read once
    read = shared.written(read.select("source_doc", "s.slices.source_slot", "s.slices.windows", "s.words"), "source-words")
    joined = spans.join(read, ["source_doc", "source_slot", "windows"])
    return joined.groupBy("doc", F.shiftright("slot", 32).cast("int").alias("key")).agg(F.collect_list(F.struct(_position("slot").alias("start"), "windows", "words")).alias("spans"))


def exact_copies(documents: DataFrame) -> DataFrame:
    """``doc, key`` of the rows whose whole text also is that of a smaller id."""
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), _row_key().alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("identity"))
    first = rows.groupBy("identity").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").drop("last")
    first = shared.written(first, "first-copies")  # a table, so that the join can be split where one text has very many copies
    return rows.join(first, "identity").where("doc <> first").select("doc", "key").distinct()


def _covered(words: list[bytes], spans: list[dict], k: int) -> np.ndarray:
    """A mask of the words to remove: those of the spans whose words are the source's."""
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        at, end = s["start"], s["start"] + s["windows"] + k - 1
        if words[at:end] == s["words"].encode().split(b" "):
            steps[at] += 1
            steps[end] -= 1
    return np.cumsum(steps[:-1]) > 0


_KEPT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha256", T.StringType())])


def remove_repeats(documents: DataFrame, k: int = WINDOW_WORDS, a: int = ANCHOR_WORDS) -> DataFrame:
    """Every column of ``documents``, and ``loreweave_kept`` (kept words joined by one blank; null where nothing was
    removed), ``loreweave_words``, ``loreweave_removed`` and ``loreweave_sha256`` (of the kept words so joined)."""
    spans = repeated_spans(documents, k, a)
    found = with_source_words(spans, documents, k)
    found = found.unionByName(exact_copies(documents), allowMissingColumns=True).withColumn("loreweave_hit", F.lit(True))
    found = shared.written(found.select(F.col("doc").alias("loreweave_doc"), F.col("key").alias("loreweave_key"), "loreweave_hit", F.col("spans").alias("loreweave_spans")), "spans")
    known = documents.join(found.hint("shuffle_hash"), (documents["doc_id"] == found["loreweave_doc"]) & (_row_key() == found["loreweave_key"]), "left")

    @F.arrow_udf(_KEPT)
    def clean(text: pa.Array, hit: pa.Array, spans: pa.Array) -> pa.Array:
        kept, counts, removed, digests = [], [], [], []
        for data, touched, own in zip(shared.as_bytes(text), hit.to_pylist(), spans.to_pylist(), strict=True):
            words = data.split()
            counts.append(len(words))
            left = words
            if touched and own is None and len(words) >= k:  # a copy of a whole text
                left = []
            elif own:
                gone = _covered(words, own, k).tolist()
                left = [w for w, x in zip(words, gone, strict=True) if not x]
            joined = b" ".join(left)
            removed.append(len(words) - len(left))
            kept.append(joined if removed[-1] else None)
            digests.append(hashlib.sha256(joined).hexdigest())
        columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.StructArray.from_arrays(columns, [f.name for f in _KEPT])

    out = known.withColumn("loreweave_clean", clean(F.col("text"), F.col("loreweave_hit"), F.col("loreweave_spans")))
    return out.select(
        *[documents[c] for c in documents.columns],
        F.col("loreweave_clean.kept").alias("loreweave_kept"),
        F.col("loreweave_clean.n_words").alias("loreweave_words"),
        F.col("loreweave_clean.n_removed").alias("loreweave_removed"),
        F.col("loreweave_clean.sha256").alias("loreweave_sha256"),
    )
