"""Full-text search: postings, BM25, match expressions, scoped fallback and snippets."""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions import text as X
from loreweave.sources import snapshots
from loreweave.sources.tables import scratch_folder

MAX_QUERY_CHARACTERS, MAX_QUERY_TERMS = 256, 64
RRF_K = 60
_DOCUMENTS_AT_ONCE = 256


# The index's classes of characters (``text.HAN``, ``text.WORD``), for queries and snippets on the driver and in tasks.
_SEARCHABLE = r"[\p{L}\p{Nd}\p{M}]"
_SEGMENT = regex.compile(rf"[\p{{Han}}&&{_SEARCHABLE}]+|[{_SEARCHABLE}--\p{{Han}}]+", regex.V1)
_WORD, _HAN = regex.compile(_SEARCHABLE, regex.V1), regex.compile(r"\p{Han}")


def _is_word(ch: str) -> bool:
    return _WORD.match(ch) is not None


def _is_han(ch: str) -> bool:
    return _HAN.match(ch) is not None


def query_segments(query: str) -> list[str]:
    """Runs of searchable characters of a query, Han apart; the driver's twin of ``text.segments``."""
    return _SEGMENT.findall(unicodedata.normalize("NFC", query))


def query_tokens(query: str) -> list[str]:
    out: list[str] = []
    for s in query_segments(query):
        if _is_han(s[0]):
            out += [s[i : i + 2] for i in range(len(s) - 1)] or [s]
        else:
            out.append(s.lower())
    return out


def query_terms(query: str) -> list[str]:
    """The terms that all must match, repeats included; a ValueError where the query is not allowed."""
    query = unicodedata.normalize("NFC", query.strip())
    if not query or len(query) > MAX_QUERY_CHARACTERS or any(unicodedata.category(c) == "Cc" for c in query):
        raise ValueError("the query is blank, too long or holds control characters")
    terms = query_tokens(query)
    if not 1 <= len(terms) <= MAX_QUERY_TERMS:
        raise ValueError("the query has no searchable term or too many")
    return terms


def match_expression(query: str) -> str:
    return " AND ".join(f'"{t}"' for t in query_terms(query))


@dataclass(frozen=True)
class Bm25:
    """BM25 as the index computes it: k1 1.2, b 0.75; weights scale the term frequency of a column."""

    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6


def postings(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """``doc_id, term, tf, doc_len``: the inverted index of a column as a plain table."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), X.index_tokens(column).alias("tokens"))
    rows = rows.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return rows.groupBy("doc_id", "term", "doc_len").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, column: str) -> DataFrame:
    """``term, documents, occurrences``: of every term, in one shuffle of partial counts."""
    own = docs.select(X.index_tokens(column).alias("tokens"))
    marked = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))), F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))))
    rows = own.select(F.explode(marked).alias("t")).select("t.*")
    return rows.groupBy("term").agg(F.sum(F.col("first").cast("long")).alias("documents"), F.sum(1 - F.col("first").cast("long")).alias("occurrences"))


def bm25(docs: DataFrame, doc_id: str, columns: dict[str, float], query: str, params: Bm25 = Bm25()) -> DataFrame:
    """``doc_id, bm25`` over a table that is searched once, through an index that is stored for it; see ``FtsIndex``."""
    return FtsIndex.over(docs, doc_id, list(columns)).search(query, list(columns.values()), params)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and lists of tokens, one a column, as ``doc_id, len, term`` and the term's number in each column; a
    row without a term holds the length alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, _DOCUMENTS_AT_ONCE):
            ids, *lists = batch.slice(at, _DOCUMENTS_AT_ONCE).columns
            parts = []
            for i, tokens in enumerate(lists):
                row, term = pc.list_parent_indices(tokens), pc.list_flatten(tokens).cast(pa.string())
                parts.append(pa.table([row, term, *[pa.array(np.full(len(term), int(i == j), np.int32)) for j in range(len(lists))]], ["row", "term", *[f"tf{j}" for j in range(len(lists))]]))
            counts = pa.concat_tables(parts).group_by(["row", "term"]).aggregate([(f"tf{j}", "sum") for j in range(len(lists))])
            lengths = sum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False) for tokens in lists).astype(np.int32)
            row = np.concatenate([np.arange(len(ids)), counts["row"].to_numpy()])
            term = pa.concat_arrays([pa.nulls(len(ids), pa.string()), counts["term"].combine_chunks()])
            own = [np.concatenate([np.full(len(ids), int(j == 0)), counts[f"tf{j}_sum"].to_numpy()]).astype(np.int32) for j in range(len(lists))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(lengths[row]), term, *map(pa.array, own)], ["doc_id", "len", "term", *[f"tf{j}" for j in range(len(lists))]])


class FtsIndex:
    """A stored full-text index: postings by bucket of their term, document lengths, and generations of both.

    A generation holds the rows of one write; it is there once its manifest is published, whole, under a number that
    no other writer has. The latest generation of a document counts, so that a write replaces its documents whole and
    a deletion is a generation without postings. A search reads the buckets of its terms, of every generation; the
    number and mean length of documents are kept with the generation. A rebuild writes one generation in place of
    those before it, whose files stay for running readers until ``vacuum``. Buckets are sized by the rows of each
    write unless their number is given. Document ids are distinct.
    """

    #: Documents for each bucket of terms, and bytes of text for each task that sorts and writes postings.
    DOCUMENTS, TASK_BYTES = 50_000, 16 << 20

    def __init__(self, spark: SparkSession, path: str, columns: list[str], buckets: int | None = None) -> None:
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), columns, buckets

    @classmethod
    def over(cls, docs: DataFrame, doc_id: str, columns: list[str], buckets: int | None = None) -> FtsIndex:
        index = cls(docs.sparkSession, f"{scratch_folder(docs.sparkSession)}/loreweave-fts-{uuid.uuid4().hex}", columns, buckets)
        index.upsert(docs, doc_id)
        return index

    def _manifests(self) -> dict[int, dict]:
        """The generations that count."""
        names = [n for n in snapshots.names_in(self.spark, f"{self.path}/generations") if n.endswith(".json")]
        found = {int(n.removesuffix(".json")): json.loads(snapshots.text_of(self.spark, f"{self.path}/generations/{n}")) for n in names}
        gone = {g for m in found.values() for g in m["replaces"]}
        return {g: m for g, m in sorted(found.items()) if g not in gone}

    def generations(self) -> list[int]:
        return list(self._manifests())

    def _publish(self, manifest: dict, number: int | None = None) -> int:
        """Under the next free number, or under this one; a StaleSnapshot where another writer has it."""
        names = snapshots.names_in(self.spark, f"{self.path}/generations")
        at = number or max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0) + 1
        while not snapshots.publish(self.spark, f"{self.path}/generations/{at:012d}.json", json.dumps(manifest)):
            if number:
                raise snapshots.StaleSnapshot("another write came in between")
            at += 1
        return at

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def _written(self, docs: DataFrame, doc_id: str) -> dict:
        """Write the rows of a generation and return its manifest. Texts are cut into terms once, and counted before they
        are shuffled: a document's length is the row of a term that no text has."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        ids = docs.where(F.col(doc_id).isNotNull())
        size = ids.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"b{i}") for i, c in enumerate(self.columns)]).first()
        buckets = self.buckets or max(16, -(-size["rows"] // self.DOCUMENTS))
        shares = max(8, -(-size["rows"] // (2 * self.DOCUMENTS)))
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-sum(size[f"b{i}"] for i in range(len(self.columns))) // self.TASK_BYTES))
        rows = ids.select(F.col(doc_id).alias("doc_id"), *[X.index_tokens(c).alias(f"t{i}") for i, c in enumerate(self.columns)])
        kind = rows.schema["doc_id"].dataType.simpleString()
        fields = "".join(f", tf{i} int" for i in range(len(self.columns)))
        terms = rows.mapInArrow(_counted, f"doc_id {kind}, len int, term string{fields}")
        # one shuffle, by bucket and a share of the documents (lengths: a part of all shares); what arrives is sorted alone, by as many tasks as the texts need
        own = F.col("term").isNotNull()
        part = F.pmod(F.xxhash64("doc_id"), F.when(own, shares).otherwise(shares * buckets))
        terms = terms.withColumn("bucket", F.when(own, self._bucket(F.col("term"), buckets)).otherwise(-1)).withColumn("part", part)
        postings = terms.repartition(tasks, "bucket", "part").drop("part")
        postings.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        lengths = self.spark.read.schema(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, len int, tf0 int").parquet(f"{at}/postings/bucket=-1") if "bucket=-1" in snapshots.names_in(self.spark, f"{at}/postings") else None
        totals = {"rows": 0, "ids": 0, "most": 1, "total": 0}
        if lengths is not None:
            totals = lengths.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.max("tf0").alias("most"), F.sum("len").alias("total")).first()
        if totals["rows"] != totals["ids"] or totals["most"] > 1:
            raise ValueError("repeated document ids")
        return {"folder": folder, "buckets": buckets, "rows": totals["rows"], "total": totals["total"], "key": rows.schema["doc_id"].dataType.simpleString(), "deletes": False, "replaces": []}

    def upsert(self, docs: DataFrame, doc_id: str) -> int:
        """Index the documents of a table, in place of what the index has of them; returns the generation."""
        return self._publish(self._written(docs, doc_id))

    def delete(self, ids: DataFrame, doc_id: str) -> int:
        """Take the documents with these ids out of the index."""
        folder = uuid.uuid4().hex
        gone = ids.select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("int").alias("len")).distinct()
        gone.write.parquet(f"{self.path}/data/{folder}/postings/bucket=-1")
        return self._publish({"folder": folder, "buckets": 0, "rows": 0, "total": 0, "key": gone.schema["doc_id"].dataType.simpleString(), "deletes": True, "replaces": []})

    def rebuild(self, docs: DataFrame, doc_id: str) -> int:
        """Index a whole table anew, in place of all generations; a StaleSnapshot if a write came in between."""
        before = self.generations()
        return self._publish({**self._written(docs, doc_id), "replaces": before}, max(before, default=0) + 1)

    def vacuum(self) -> None:
        """Drop the files that no generation names. Run it when readers and writers of older ones are done."""
        named = {m["folder"] for m in self._manifests().values()}
        for folder in snapshots.names_in(self.spark, f"{self.path}/data"):
            if folder not in named:
                snapshots.remove(self.spark, f"{self.path}/data/{folder}")

    def lengths(self, manifests: dict[int, dict] | None = None) -> DataFrame:
        """``doc_id, len, generation`` of the documents that count."""
        found = manifests or self._manifests()
        parts = [self.spark.read.schema(f"doc_id {m['key']}, len int").parquet(f"{self.path}/data/{m['folder']}/postings/bucket=-1").withColumn("generation", F.lit(g)) for g, m in found.items() if m["rows"] or m["deletes"]]
        if not parts:
            return self.spark.createDataFrame([], "doc_id long, len int, generation int")
        if len(parts) == 1:
            return parts[0].where("len is not null")
        rows = reduce(DataFrame.unionByName, parts)
        latest = rows.groupBy("doc_id").agg(F.max("generation").alias("generation"), F.max_by("len", "generation").alias("len"))
        return latest.where("len is not null").select("doc_id", "len", "generation")

    def postings(self, terms: list[str], manifests: dict[int, dict] | None = None) -> DataFrame:
        """The rows of these terms, from their buckets alone, of the documents that count."""
        found = manifests or self._manifests()
        counts = sorted({m["buckets"] for m in found.values() if not m["deletes"]})
        asked = self.spark.range(1).select(*[F.array_distinct(F.array(*[self._bucket(F.lit(t), n) for t in terms])).alias(str(n)) for n in counts]).first() if counts else {}
        fields = "".join(f", tf{i} int" for i in range(len(self.columns)))
        parts = []
        for g, m in found.items():
            if m["deletes"]:
                continue
            folder = f"{self.path}/data/{m['folder']}/postings"
            there = set(snapshots.names_in(self.spark, folder))
            paths = [f"{folder}/bucket={b}" for b in asked[str(m["buckets"])] if f"bucket={b}" in there]
            rows = self.spark.read.schema(f"term string, doc_id {m['key']}, len int{fields}").parquet(*paths) if paths else self.spark.createDataFrame([], f"term string, doc_id {m['key']}, len int{fields}")
            parts.append(rows.where(F.col("term").isin(terms)).withColumn("generation", F.lit(g)))
        if not parts:
            key = next((m["key"] for m in found.values()), "long")
            return self.spark.createDataFrame([], f"term string, doc_id {key}, len int{fields}, generation int")
        rows = reduce(DataFrame.unionByName, parts)
        return rows if len(found) == 1 else rows.join(self.lengths(found).select("doc_id", "generation"), ["doc_id", "generation"])

    def search(self, query: str, weights: list[float] | None = None, params: Bm25 = Bm25()) -> DataFrame:
        """``doc_id, bm25``: documents that hold every term of the query, the more negative the better."""
        query_terms(query)  # its bounds
        # cut and folded by the same functions that cut and fold the texts
        asked = self.spark.range(1).select(X.composed_index_tokens(F.lit(unicodedata.normalize("NFC", query.strip()))).alias("t")).first()["t"]
        distinct, weights = list(dict.fromkeys(asked)), weights or [1.0] * len(self.columns)
        found = self._manifests()
        if len(found) == 1:
            only = next(iter(found.values()))
            totals = {"rows": only["rows"], "avg_len": only["total"] / max(1, only["rows"])}
        else:
            totals = self.lengths(found).agg(F.count("*").alias("rows"), F.avg("len").alias("avg_len")).first() if found else {"rows": 0, "avg_len": 0.0}
        own = self.postings(distinct, found)
        df = {r["term"]: r["n"] for r in own.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term of the query
        if len(df) < len(distinct):
            return own.where("false").select("doc_id", F.lit(0.0).alias("bm25"))
        f = sum((F.col(f"tf{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
        by_term = own.groupBy("doc_id", "len").agg(*[F.max(F.when(F.col("term") == t, f)).alias(f"f{i}") for i, t in enumerate(distinct)])
        hits = by_term.where(" AND ".join(f"f{i} is not null" for i in range(len(distinct))))
        score = F.lit(0.0)
        for t in asked:
            i, n = distinct.index(t), totals["rows"]
            idf = max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0.0) or params.least_idf
            score = score + F.lit(idf) * (F.col(f"f{i}") * (params.k1 + 1)) / (F.col(f"f{i}") + params.k1 * (1 - params.b + params.b * F.col("len") / F.lit(totals["avg_len"] or 1.0)))
        return hits.select("doc_id", (-score).alias("bm25"))


def ranked(hits: DataFrame, limit: int, digits: int = 6) -> DataFrame:
    """The best ``limit`` hits: by rounded score, then by id as text; and their reciprocal-rank score."""
    best = hits.withColumn("bm25", F.round("bm25", digits)).orderBy("bm25", F.col("doc_id").cast("string")).limit(limit)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy("bm25", F.col("doc_id").cast("string")))  # over at most ``limit`` rows
    return best.withColumn("rank", rank).withColumn("score", F.round(1 / (RRF_K + F.col("rank")), 9))


def match_order(hits: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Hits in the index's own order: by score, then by the place at which a document was put in (``doc_id, row_id``)."""
    return hits.join(rows.select("doc_id", row_id), "doc_id").orderBy("bm25", row_id)


def vocabulary(docs: DataFrame, doc_id: str, column: str) -> DataFrame:
    """``doc_id, terms``: the distinct tokens of each document."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(F.array_distinct(X.tokens(column))).alias("terms"))


def _reduces(query: str, candidate: str) -> bool:
    """Whether the terms of a candidate are some, but not all, of the query's, repeats counted."""
    own = Counter(query_tokens(candidate))
    return bool(own) and candidate != query and own < Counter(query_tokens(query))


def fallback_query(query: str, terms: set[str]) -> str | None:
    """A shorter query for one document that the whole query missed; None where there is none.

    The first that reduces the query: its technical words, four at most; else its terms that the document holds,
    if they are two or more, or a single distinctive one.
    """
    query = unicodedata.normalize("NFC", (query or "").strip())
    technical = list({w.lower(): w for w in reversed(re.findall(X.FALLBACK_ANCHOR.replace("(?iu)", "(?i)"), query))}.values())[:-5:-1]
    kept = [t for t in dict.fromkeys(query_tokens(query)) if t in terms]
    worth = max(map(len, kept), default=0) >= 2 if len(kept) > 1 else any(len(t) >= 4 and re.search("[A-Za-z0-9]", t) for t in kept)
    return next((c for c in (" ".join(technical), " ".join(kept) if worth else "") if _reduces(query, c)), None)


def fallback(rows: DataFrame, query: str, terms: str, alias: str = "fallback") -> DataFrame:
    """``fallback_query`` of a query column within a column of the document's terms, as column functions."""
    occurs = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))

    def reduces(candidate: Column, asked: Column, whole: Column) -> Column:
        own = X.composed_tokens(candidate)
        return (F.size(own) > 0) & (candidate != whole) & (F.size(own) < F.size(asked)) & F.forall(own, lambda t: occurs(own, t) <= occurs(asked, t))

    own = rows.withColumn("loreweave_query", X.nfc(F.regexp_replace(F.coalesce(F.col(query), F.lit("")), r"^\s+|\s+$", "")))
    own = own.withColumn("loreweave_asked", X.composed_tokens(F.col("loreweave_query"))).withColumn("loreweave_technical", F.array_join(X.anchors("loreweave_query"), " "))
    own = own.withColumn("loreweave_kept", F.array_intersect("loreweave_asked", F.coalesce(F.col(terms), F.array().cast("array<string>"))))
    kept = F.col("loreweave_kept")
    worth = F.when(F.size(kept) > 1, F.exists(kept, lambda t: F.length(t) >= 2)).otherwise(F.exists(kept, lambda t: (F.length(t) >= 4) & t.rlike("[A-Za-z0-9]")))
    whole, asked, technical, left = F.col("loreweave_query"), F.col("loreweave_asked"), F.col("loreweave_technical"), F.array_join(kept, " ")
    shorter = F.when(reduces(technical, asked, whole), technical).when(worth & reduces(left, asked, whole), left)
    return own.withColumn(alias, shorter).drop("loreweave_query", "loreweave_asked", "loreweave_technical", "loreweave_kept")


def snippet_text(text: str, query: str, width: int = 280) -> str:
    """An excerpt around the first hit, escaped, with hits marked."""
    words = sorted({s.lower() for s in query_segments(query)}, key=len, reverse=True)
    spans: list[tuple[int, int]] = []
    if words and text:
        for m in re.finditer("|".join(map(re.escape, words)), text, re.I):
            a, b = m.span()
            whole = _is_han(text[a]) or (a == 0 or not _is_word(text[a - 1]) or _is_han(text[a - 1])) and (b == len(text) or not _is_word(text[b]) or _is_han(text[b]))
            if whole:
                spans.append((a, b))
    begin = 0
    if len(text) > width and spans:
        begin = max(0, min((spans[0][0] + spans[0][1]) // 2 - width // 2, len(text) - width))
    end = min(len(text), begin + width)
    out, at = ["…" if begin else ""], begin
    for a, b in spans:
        if a < at or b > end:
            continue
        out += [html.escape(text[at:a]), "<mark>", html.escape(text[a:b]), "</mark>"]
        at = b
    out += [html.escape(text[at:end]), "…" if end < len(text) else ""]
    return "".join(out)


def snippet(column: Column | str, query: str, width: int = 280) -> Column:
    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else snippet_text(t, query, width) for t in text.to_pylist()], pa.string())

    return cut(F.col(column) if isinstance(column, str) else column)
