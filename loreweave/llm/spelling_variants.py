"""Spelling variants: words one edit apart, found through forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Where two words of
L and L or L + 1 code points are near, their first difference lies at one place p of the shorter (0 to L), and all
before and after it agrees: with p in the right half the left half matches exactly, with p in the left half the
right half does. So the words are dealt out by the half that has to match: one row for each half and each length
that a word can be asked about. A shard holds the words of one half; its minimal acyclic automaton (of the words as
they are, or spelled backwards where the right half is the one that matches) is walked along that half and is
completed with one error. The automaton numbers its words without gaps in their order (each node counts the words
behind it), and counts and best neighbours are kept by that number. A pair that both directions find counts where its
first difference lies, so that none counts twice and no pair leaves its task: a shard gives one row per word.

A half that over ``shard_words`` words share is no shard: its places are cut in two, the words are dealt out again
by all that lies before and after those places, and so on until shards are small. Nothing is lost on the way, and one
place alone can hold only as many words as there are code points for it, and for the one after it in the longer words.

Defined results: a null text has no words; a null id is empty in the rule that drops code points; repeated rows count
as often as they occur; an empty table or one without frequent words gives an empty result; a very long text is read
match by match; extra columns are ignored. Of forms with the same count the one of the smallest code points is taken.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
SHARD_WORDS = 1 << 14
#: Words that a task counts before it hands them on, and the length from which a text is read match by match.
_HELD, _LONG = 1 << 17, 1 << 20


def vocabulary(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 0) -> DataFrame:
    """``word`` and ``n``, how often it occurs in all texts: runs of Latin letters in which only A-Z is lower-cased.

    With ``drop_every``, runs lose one code point where it divides the CRC-32 of ``<doc_id>:<run>``: typing errors
    that are the same in each run of the text.
    """
    shared.small_batches(documents.sparkSession)
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def words(text: str) -> Iterator[str]:
        return run.findall(text) if len(text) < _LONG else (m[0] for m in run.finditer(text))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in shared.table_of(batches):
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, shared.as_bytes(batch.column(1)), strict=True):
                own = Counter(words(text.lower().decode()))
                if drop_every:
                    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), salt)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                        found[word] += n
                else:
                    found.update(own)
                if len(found) > _HELD:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)

    counts = documents.select(F.col("doc_id").cast("string"), "text").mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


class _Node:
    __slots__ = ("edges", "final", "words", "before")

    def __init__(self) -> None:
        self.edges: dict[str, _Node] = {}
        self.final = False

    def number(self) -> None:
        """Count the words behind the node and, for each transition, those that come before it."""
        self.words, self.before = int(self.final), {}
        for c, child in self.edges.items():
            self.before[c] = self.words
            self.words += child.words

    def find(self, rest: str) -> int:
        """The number of ``rest`` among the words behind the node; -1 if it is none of them."""
        node, number = self, 0
        for c in rest:
            child = node.edges.get(c)
            if child is None:
                return -1
            number += node.before[c]
            node = child
        return number if node.final else -1


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them."""

    def __init__(self, words: list[str]) -> None:
        known: dict[tuple, _Node] = {}
        self.root = _Node()
        path, last = [self.root], ""

        def close(depth: int) -> None:
            """Replace the nodes of the last word below ``depth`` by equal ones that are known."""
            while len(path) > depth + 1:
                node = path.pop()
                key = (node.final, "".join(node.edges), *map(id, node.edges.values()))
                equal = known.get(key)
                if equal is None:
                    node.number()
                    equal = known[key] = node
                path[-1].edges[last[len(path) - 1]] = equal

        for word in words:
            same = len(os.path.commonprefix((word, last)))
            close(same)
            for c in word[same:]:
                node = path[-1].edges[c] = _Node()
                path.append(node)
            path[-1].final = True
            last = word
        close(0)
        self.root.number()
        self.nodes = len(known) + 1

    def near(self, word: str, matched: int) -> Iterator[int]:
        """Numbers of the words that differ from ``word`` (one of the automaton's) by one replaced or inserted code
        point after the first ``matched``."""
        node, number = self.root, 0
        for at in range(len(word) + 1):
            own = word[at : at + 1]
            if at >= matched and len(node.edges) > (own in node.edges):
                rest = word[at:]
                for c, child in node.edges.items():
                    if c == own:
                        continue
                    if own and (found := child.find(rest[1:])) >= 0:
                        yield number + node.before[c] + found
                    if (found := child.find(rest)) >= 0:
                        yield number + node.before[c] + found
            if own:
                number += node.before[own]
                node = node.edges[own]


def shard_variants(words: dict[str, int], base: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
    """``(word, near words, count of the best, best)`` of one shard: of words of ``base`` and ``base + 1`` code points
    that agree on the first ``lo`` and on all after the first ``hi`` of ``base``; pairs whose first difference lies
    from ``lo`` to ``hi`` - 1 count."""
    backward = lo < base // 2
    step, matched = (-1, max(base - hi, 0)) if backward else (1, lo)
    spelled = sorted(word[::step] for word in words)
    automaton = Automaton(spelled)
    counts, best = [0] * len(spelled), [None] * len(spelled)

    def meet(i: int, word: str) -> None:
        counts[i] += 1
        rank = (-words[word], word)
        if best[i] is None or rank < best[i]:
            best[i] = rank

    for i, key in enumerate(spelled):
        if len(key) != base:
            continue
        word = key[::step]
        for j in automaton.near(key, matched):
            other = spelled[j][::step]
            if word[:hi] == other[:hi]:  # they differ first in the other direction's half
                continue
            meet(i, other)
            if len(other) == base:
                continue  # met again when its own turn comes
            meet(j, word)
    for key, count, rank in zip(spelled, counts, best, strict=True):
        if count:
            yield key[::step], count, -rank[0], rank[1]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, members, out = None, {}, []

    def close() -> None:
        if len(members) > 1 and min(map(len, members)) == key[0]:
            out.extend(shard_variants(members, *key[:3]))

    for batch in shared.table_of(batches):
        for *own, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                close()
                key, members = own, {}
            members[word] = n
        if len(out) > 10_000:
            yield _rows(out)
            out.clear()
    close()
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, row, strict=True)) for row in out], schema=_FOUND)


_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_SHARD = ["base", "lo", "hi", "half"]


def _dealt(rows: DataFrame, places: Column) -> DataFrame:
    """A row of ``word``, ``n`` and a shard for each of the ``places``, an array of (base, lo, hi)."""
    rows = rows.select("word", "n", F.explode(places).alias("at")).select("word", "n", "at.*")
    half = F.concat(F.left("word", F.col("lo")), F.right("word", F.greatest(F.col("base") - F.col("hi"), F.lit(0))))
    return rows.withColumn("half", half)


def _places(base: Column, *cuts: Column) -> list[Column]:
    return [F.struct(base.alias("base"), a.alias("lo"), b.alias("hi")) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (a struct of the negative count and the word) of all words that have near
    words; ``words`` has distinct values of ``word`` and their ``n``."""
    length = F.length("word")
    bases = [length, length - 1]
    halves = [place for base in bases for place in _places(base, F.lit(0), F.floor(base / 2).cast("int"), base + 1)]
    rows, found = _dealt(words.where(length > 0), F.array(*halves)), []
    while True:
        sizes = rows.groupBy(_SHARD).agg(F.count("*").alias("size"))
        large = shared.written(sizes.where((F.col("size") > shard_words) & (F.col("hi") - F.col("lo") > 1)).select(_SHARD), "large-halves")
        ended = large.isEmpty()
        small = (rows if ended else rows.join(large, _SHARD, "left_anti")).select(*_SHARD, "word", "n")
        small = small.repartition(*_SHARD).sortWithinPartitions(*_SHARD)
        found.append(shared.written(small.mapInArrow(_search, "word string, near long, best_n long, best string"), "near-words"))
        if ended:
            break
        rows = rows.join(large, _SHARD, "left_semi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = shared.written(_dealt(rows, F.array(*_places(F.col("base"), F.col("lo"), middle, F.col("hi")))), "halves-cut-again")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms, by doubling: counts grow along a chain, so that none
    is a circle and a few rounds do."""
    chains = shared.written(forms.select("word", F.col("form").alias("root")), "form-chains")
    while True:
        on = chains.select(F.col("word").alias("at"), F.col("root").alias("further"))
        longer = chains.join(on, chains["root"] == on["at"], "left")
        longer = shared.written(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "form-chains")
        if longer.where("moved").isEmpty():
            return chains
        chains = longer.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for each of the ``words`` (``word``, ``n``): its
    form is the near word of the largest count if that is at least ``factor`` times its own."""
    words = shared.written(words.select("word", "n"), "words")
    found = words.join(near_words(words, shard_words), "word", "left")
    usual = -F.col("best.less") >= factor * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(usual, F.col("best.best")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"),
    )
    found = shared.written(found, "word-forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
