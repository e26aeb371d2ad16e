"""Packing token sequences by lexical retrieval: each window is filled with its seed's nearest unused texts.

Texts are tokenized whole; an end id closes each document. Full windows are cut from the front of a long
document. What is left of every document is put in order by its lexical signature: its rarest terms in the order of
the vocabulary, whose ids follow the frequency of the merges that made them. Spark deals that order out by range,
so remainders that share their rarest terms lie side by side, and one term, or one text, that very many have is
split like any other run. Each partition is read as a row of shards of ``shard_texts`` remainders. A shard is an inverted index of
BM25 impacts; the document frequencies and the average length behind them are counted over all remainders, and the
vocabulary bounds them. A window's seed is looked up once, by all of its terms; its unused neighbours fill the
window, best first, and the one that does not fit is cut: its rest is the next seed. Where the seed has no
neighbour left, the next unused remainder goes on as a seed of the same window. A shard leaves one window with
padding, its last. Neighbours in another shard are not found.

Defined results: a null or empty text is its end id alone; a null id is packed like any other; repeated rows
are packed as often as they occur; ties go to the smaller place in the shard, which follows signature and id; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared

WINDOW = 2048
END_ID = 1
#: Remainders in a shard, and shards in a partition.
SHARD_TEXTS, PARTITION_SHARDS = 1024, 8
#: Terms of a signature: the largest ids.
SIGNATURE = 3
DENSE = 16
#: Neighbours that are put in order at first; more follow where they do not fill a window.
NEIGHBOURS = 64
K1, B = 1.2, 0.75
#: Words, numbers, runs of other characters and white space, as byte-level vocabularies split them.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file whose merges are ranked as their tokens are numbered."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    values = {c: b for b, c in enumerate(shared.byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(values[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m] for m in made]
    if order != sorted(order):
        raise ValueError("the merges of this file are not ranked as their tokens are numbered")
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, own: tiktoken.Encoding) -> np.ndarray:
    """The ids of a whole text; the strings of special tokens are those tokens, as the library has it."""
    if any(s in text for s in own.special_tokens_set):
        return np.asarray(own.encode(text, allowed_special="all"), dtype=np.uint32)
    return own.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


_PIECE = "kind int, doc_id long, start long, length long, doc_tokens long, sequence_id long, n_ids long, ids binary, signature array<int>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
    columns = zip(*rows, strict=True) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "doc_id", "start", "length", "doc_tokens", "sequence_id", "n_ids", "ids", "signature"])


def _cut(path: str, window: int, end_id: int):
    """Full windows (kind 0), remainders (kind 1), and at last how many remainders hold each id (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequency, made = encoding(path), np.zeros(1, np.int64), 0
        first = (TaskContext.get().partitionId() + (1 << 30)) << 32
        for batch in shared.table_of(batches):
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", own), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    rows.append((0, doc, at, window, len(ids), first + made, window, ids[at : at + window].tobytes(), None))
                    made += 1
                if whole < len(ids):
                    rest = ids[whole:]
                    seen = np.unique(rest)
                    if seen[-1] >= len(frequency):
                        frequency = np.append(frequency, np.zeros(int(seen[-1]) + 1 - len(frequency), np.int64))
                    frequency[seen] += 1
                    rows.append((1, doc, whole, len(rest), len(ids), None, len(rest), rest.tobytes(), seen[: -SIGNATURE - 1 : -1].tolist()))
                size += len(ids)
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)
        if frequency.any():
            yield _batch([(2, None, None, None, None, None, None, frequency.astype("<i8").tobytes(), None)])

    return run


class Index:
    """Postings of one shard: per term, the texts that hold it and its BM25 impact there."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        terms, owners, impacts, self.bounds = [], [], [], [0]
        for i, ids in enumerate(texts):
            term, tf = np.unique(ids, return_counts=True)
            terms.append(term.astype(np.int64))
            owners.append(np.full(len(term), i, dtype=np.int32))
            impacts.append((idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))
            self.bounds.append(self.bounds[-1] + len(term))
        listed, self.terms = np.unique(np.concatenate(terms), return_inverse=True)  # the shard's own numbers of its terms
        order = np.argsort(self.terms, kind="stable")
        self.owners, self.impacts = np.concatenate(owners)[order], np.concatenate(impacts)[order]
        held = np.bincount(self.terms, minlength=len(listed))
        self.places = np.concatenate(([0], np.cumsum(held)))
        self.size = len(texts)
        # the postings of terms that one text in ``DENSE`` holds are also kept as rows over all texts, which add up faster
        common = np.flatnonzero(held * DENSE >= self.size)
        self.row = np.full(len(listed), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.size), dtype=np.float32)
        at = self.row[self.terms[order]]
        self.rows[at[at >= 0], self.owners[at >= 0]] = self.impacts[at >= 0]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused texts that share a term with the seed, best first, by all of its terms; ties by place."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        scores = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float32)
        rare = terms[row < 0]
        if len(rare):
            at = [slice(a, b) for a, b in zip(self.places[rare].tolist(), self.places[rare + 1].tolist(), strict=True)]
            scores = scores + np.bincount(np.concatenate([self.owners[s] for s in at]), weights=np.concatenate([self.impacts[s] for s in at]), minlength=self.size)
        scores[used] = 0
        given, n, total = 0, NEIGHBOURS, int(np.count_nonzero(scores))
        while given < total:
            least = -np.partition(-scores, n - 1)[n - 1] if n < total else 0.0
            best = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores)  # all that tie with the last one
            best = best[np.lexsort((best, -scores[best]))][given:]
            yield from best.tolist()
            given, n = given + len(best), 4 * n


def fill(texts: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (text, from, to); every window but the last is full."""
    used = np.zeros(len(texts), dtype=bool)
    rest: tuple[int, int] | None = None  # a text that was cut, and where
    turn = 0
    while True:
        pieces, room = [], window
        while room > 0:
            if rest is None:
                while turn < len(texts) and used[turn]:
                    turn += 1
                if turn == len(texts):
                    break
                rest = (turn, 0)
                used[turn] = True
            seed, begin = rest
            end = min(len(texts[seed]), begin + room)
            pieces.append((seed, begin, end))
            room -= end - begin
            rest = (seed, end) if end < len(texts[seed]) else None
            if room == 0:
                break
            for other in index.neighbours(seed, used):
                used[other] = True
                take = min(room, len(texts[other]))
                pieces.append((other, 0, take))
                room -= take
                if room == 0:
                    rest = (other, take) if take < len(texts[other]) else None
                    break
        if not pieces:
            return
        yield pieces


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(idf: np.ndarray, mean: float, window: int, shard_texts: int):
    """Read a partition, which is in order, as a row of shards and pack each."""
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def packed(rows: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        texts = [np.frombuffer(r[3], dtype="<u4") for r in rows]
        out, number = [], first
        for pieces in fill(texts, Index(texts, idf, mean), window):
            offset = 0
            for i, a, b in pieces:
                ids = texts[i][a:b].tobytes()
                out.append((rows[i][0], rows[i][1] + a, b - a, zlib.crc32(ids), rows[i][2], number, offset, ids))
                offset += b - a
            number += 1
        kinds = (pa.int64(),) * 7 + (pa.binary(),)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, number = [], TaskContext.get().partitionId() << 32
        for batch in shared.table_of(batches):
            rows += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            while len(rows) >= shard_texts:
                done, number = packed(rows[:shard_texts], number)
                yield done
                rows = rows[shard_texts:]
        if rows:
            yield packed(rows, number)[0]

    return run


def statistics(pieces: DataFrame, vocabulary: int) -> tuple[int, float, np.ndarray]:
    """Over all remainders: their number, average length, and what BM25 makes of the document frequency of each id."""
    counts = pieces.where("kind = 2").select("ids").mapInArrow(_sum_frequencies, "term int, n long")
    frequency = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row an id of the vocabulary
    total = pieces.where("kind = 1").agg(F.count("*").alias("n"), F.avg("n_ids").alias("mean")).first()
    df = np.zeros(max(vocabulary, *frequency, 0) + 1)
    df[list(frequency)] = list(frequency.values())
    return total["n"], total["mean"] or 1.0, np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))


def pack(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (four bytes an id)."""
    shared.small_batches(documents.sparkSession)
    pieces = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, window, end_id), _PIECE)
    pieces = shared.written(pieces, "pieces")
    n, mean, idf = statistics(pieces, max(encoding(path).n_vocab, end_id))
    rests = pieces.where("kind = 1").select("doc_id", "start", "doc_tokens", "ids", "signature")
    order = ["signature", "doc_id", "start", "doc_tokens"]
    partitions = max(1, -(-n // (PARTITION_SHARDS * shard_texts)))
    rests = rests.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    packed = rests.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(idf, mean, window, shard_texts), _PACKED)
    full = pieces.where("kind = 0").select("doc_id", "start", "length", _crc("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids")
    return full.unionByName(packed)


def _crc(column: str):
    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(x, dtype="<u4").tobytes()) for x in ids.to_pylist()], pa.int64())

    return crc(F.col(column))


def _sum_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in shared.table_of(batches):
        for x in batch.column(0).to_pylist():
            own = np.frombuffer(x, dtype="<i8")
            if len(own) > len(total):
                total = np.append(total, np.zeros(len(own) - len(total), np.int64))
            total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "n"])
