"""Near-duplicate groups: 64-bit SimHash fingerprints linked within a Hamming radius through BK-trees.

A fingerprint takes a bit where over half of a text's shingle hashes have it. Distinct fingerprints are
sharded by the bits they agree on: the 64 bits are cut into radius + 1 bands, and two fingerprints within the
radius agree on one band at least, so each shard is searched on its own. A shard with more than
``shard_rows`` fingerprints is sharded again over its remaining bits in the same way, until shards are small;
no pair within the radius is lost on the way. A task holds the BK-tree of one shard at a time: the children of
a node are keyed by their Hamming distance to it, and a search follows only the edges whose key lies within the
radius of the distance to the node. Each shard gives a spanning forest of its links, never all pairs, and the
forests are joined by connected components.

Defined results: a null text is empty; a text without words has the fingerprint zero, which is linked like any
other; one of one or two words is a single shingle; equal fingerprints are one group whatever their number; a
null id has a fingerprint and the group of its fingerprint, but cannot be a group's id (the group id is null
where all ids are); repeated rows are returned as often as they occur; an empty table gives an empty result.
Extra columns are ignored by ``groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm import components, shared

RADIUS = 3
SHINGLE_WORDS = 3
SHARD_ROWS = 1024
_SEED = 42
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text, unsigned; words are split at ASCII white space and A-Z is lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = iter((xxhash.xxh64_intdigest(b" ".join(words), _SEED),))
        count = 1
    else:
        count = len(words) - shingle_words + 1
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)), repeat(_SEED))
    h = np.fromiter(hashes, dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, _SLICE):
        ones += np.unpackbits(h[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    found = np.fromiter(map(fingerprint, shared.as_bytes(text)), dtype=np.uint64, count=len(text))
    return pa.array(found.view(np.int64), pa.int64())


class BKTree:
    """Fingerprints by Hamming distance; a node is [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            node, children = open_nodes.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            open_nodes.extend(child for key, child in children.items() if distance - radius <= key <= distance + radius)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while distance := (node[0] ^ value).bit_count():
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = [value, {}]
                return
            node = child


def spanning_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius that join the groups of ``values``; none that closes a circle."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values:
        if value in parent:
            continue
        parent[value] = value
        for near in tree.near(value, radius):
            a, b = root(value), root(near)
            if a != b:
                parent[a] = b
                yield value, near
        tree.add(value)


def _split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` with, in turn, each of ``parts`` runs of the bits that it leaves free."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(masks: set[int], parts: int) -> tuple[Column, set[int]]:
    """An array of each mask's children, by column ``mask``: (radius + 1) ** level of them in all."""
    split = {m: _split_mask(m, parts) for m in sorted(masks)}
    arrays = [x for m, c in split.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(v)) for v in c]))]
    return F.element_at(F.create_map(*arrays), F.col("mask")), {c for own in split.values() for c in own}


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, a, b = None, [], [], []

        def close() -> None:
            if len(members) > 1:
                for x, y in spanning_links(members, radius):
                    a.append(x)
                    b.append(y)

        for batch in shared.table_of(batches):
            keys = batch.column(0).to_pylist()
            values = batch.column(1).to_numpy().view(np.uint64).tolist()
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    close()
                    key, members = k, []
                members.append(v)
            if len(a) > 10000:
                yield _edges(a, b)
                a, b = [], []
        close()
        yield _edges(a, b)

    return run


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, dtype=np.uint64).view(np.int64), pa.int64()) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def links(fingerprints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between the distinct values of column ``fp`` that connect all groups within the radius."""
    rows = fingerprints.select("fp").distinct().withColumn("mask", F.lit(0).cast("long"))
    masks, found = {0}, []
    while True:
        children, masks = _children(masks, radius + 1)
        rows = rows.select("fp", F.explode(children).alias("mask"))
        rows = rows.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        free = 64 - min(bin(m).count("1") for m in masks)
        if 2**free <= shard_rows:  # a shard of distinct values cannot be larger
            large = None
        else:
            large = shared.written(sizes.where(F.col("n") > shard_rows).select("shard"), "large-shards")
        small = rows.join(large, "shard", "left_anti") if large is not None else rows
        small = small.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
        found.append(shared.written(small.mapInArrow(_search(radius), "a long, b long").where("a <> b"), "simhash-links"))
        if large is None or large.isEmpty():
            break
        rows = shared.written(rows.join(large, "shard", "left_semi").select("fp", "mask"), "large-members")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _grouped(documents: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``fp``, ``root`` (a fingerprint of the group) and ``component_id``."""
    shared.small_batches(documents.sparkSession)
    prints = shared.written(documents.select("doc_id", shared.text_digest().alias("digest"), _fingerprints(F.col("text")).alias("fp")), "fingerprints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components.connected(links(own, radius, shard_rows))
    rooted = own.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shared.written(rooted.join(least, "root").select(F.col("fp").alias("named_fp"), "root", "component_id"), "fingerprint-groups")
    return prints.join(named, prints["fp"] == named["named_fp"], "left").drop("named_fp")


def groups(documents: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links lead to."""
    out = _grouped(documents, radius, shard_rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_copies(documents: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents with one of each group: a row with the smallest id (of texts that share it, the one of the
    smallest digest). Rows without an id are kept."""
    kept = _grouped(documents, radius, shard_rows).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
    kept = kept.select(F.col("one.doc_id").alias("loreweave_doc"), F.col("one.digest").alias("loreweave_digest"))
    turn, digest = "loreweave_turn", "loreweave_digest"
    rows = documents.where("doc_id is not null").withColumn(digest, shared.text_digest())
    rows = rows.join(kept, (rows["doc_id"] == kept["loreweave_doc"]) & (rows[digest] == kept[digest]), "left_semi")
    order = Window.partitionBy("doc_id", digest).orderBy("doc_id")
    named = rows.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn, digest)
    return named.unionByName(documents.where("doc_id is null"))
