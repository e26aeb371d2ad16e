"""Token counts kept up to date by signed changes: additive totals by source, language and tokenizer version.

A change inserts a document's count, deletes it, or revises it. A batch of changes is summed by key into signed
deltas before anything is written. The deltas go to a folder of their own; the batch counts once its entry is in the
log: a small file that appears whole, under the next number, and only if no other writer's has that number; then the
log is read again, and the entry takes the number after, unless the batch's name is in it by now. A batch whose name
is there already changes nothing. A writer that dies leaves a folder or a nameless file that nobody reads; a file in
the log that cannot be read counts as a number that is taken. Totals are the sum of the deltas that count, so batches
may arrive in any order.

``compact`` writes their sum, and the names of all batches so far as a table, as an entry that stands for all before
it, and takes those out of the log: a commit reads the entries since the last fold and looks its name up in the table.
It runs by itself every ``FOLD_AFTER`` batches.

Defined results: null sources, languages and tokenizers are keys of their own; a null text counts no tokens;
repeated changes in one batch count as often as they occur; keys whose document and token totals are both zero
are left out; an empty batch commits and adds nothing. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources import snapshots

#: Entries of the log after which it is folded.
FOLD_AFTER = 64
KEY = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def word_count(text: str = "text") -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spelled_count(text: str = "text") -> Column:
    """Words, as above, that hold a letter or a digit."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D\p{L}\p{N}]*[\p{L}\p{N}][^\x20\x09-\x0D]*")), F.lit(0)).cast("long")


def piece_count(text: str = "text") -> Column:
    """Runs of letters, single digits, and runs of other characters but white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+")), F.lit(0)).cast("long")


def inserted(rows: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return _signed(rows, F.lit(1), tokens, tokenizer)


def deleted(rows: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return _signed(rows, F.lit(-1), -tokens, tokenizer)


def revised(rows: DataFrame, before: Column, after: Column, tokenizer: str) -> DataFrame:
    """The count of documents that are there already changes; the number of documents does not."""
    return _signed(rows, F.lit(0), after - before, tokenizer)


def _signed(rows: DataFrame, documents: Column, tokens: Column, tokenizer: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in snapshots.names_in(self.spark, f"{self.path}/log") if n.endswith(".json")]

    def _live(self) -> tuple[list[dict], int]:
        """The last fold and the entries after it, and the largest number that is taken."""
        while True:
            numbers, entries = self._numbers(), []
            try:
                for number in numbers:
                    try:
                        entries.append({"number": number, **json.loads(snapshots.text_of(self.spark, f"{self.path}/log/{number:012d}.json"))})
                    except ValueError:
                        continue  # a file without an entry
            except Py4JJavaError:
                if self._numbers() == numbers:
                    raise
                continue  # a fold took entries away meanwhile
            fold = max((e["number"] for e in entries if e["names"]), default=-1)
            return [e for e in entries if e["number"] >= fold], max(numbers, default=-1)

    def committed(self) -> list[str]:
        """Names of the entries that count: the last fold and the batches since."""
        return sorted(e["batch"] for e in self._live()[0])

    def _known(self, batch: str, live: list[dict]) -> bool:
        if any(e["batch"] == batch for e in live):
            return True
        folded = next((e["names"] for e in live if e["names"]), None)
        return folded is not None and not self.spark.read.schema("batch string").parquet(f"{self.path}/{folded}").where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no change, where its name is in the log."""
        live, taken = self._live()
        if self._known(batch, live):
            return False
        folder = self._written(changes)
        while not self._entered(taken + 1, batch, folder):
            live, taken = self._live()
            if self._known(batch, live):
                snapshots.remove(self.spark, f"{self.path}/{folder}")
                return False
        if len(live) >= FOLD_AFTER:
            self.compact()
        return True

    def _written(self, changes: DataFrame) -> str:
        folder = f"deltas-{uuid.uuid4().hex}"
        self._deltas(changes).write.parquet(f"{self.path}/{folder}")
        return folder

    def _entered(self, number: int, batch: str, folder: str, names: str | None = None) -> bool:
        """Put an entry into the log under this number; False where another writer was first."""
        return snapshots.publish(self.spark, f"{self.path}/log/{number:012d}.json", json.dumps({"batch": batch, "folder": folder, "names": names}))

    @staticmethod
    def _deltas(changes: DataFrame) -> DataFrame:
        return changes.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def compact(self) -> bool:
        """Fold the log, if no batch comes in between. Folders of deltas stay for readers."""
        live, taken = self._live()
        if len(live) < 2:
            return False
        names = self.spark.createDataFrame([(e["batch"],) for e in live if not e["names"]], "batch string")
        for e in live:
            if e["names"]:
                names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{e['names']}"))
        listed = f"names-{uuid.uuid4().hex}"
        names.write.parquet(f"{self.path}/{listed}")
        if not self._entered(taken + 1, f"fold-{uuid.uuid4().hex}", self._written(self._read([e["folder"] for e in live])), listed):
            return False
        for number in self._numbers():
            if number <= taken:
                snapshots.remove(self.spark, f"{self.path}/log/{number:012d}.json")
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over the batches that count."""
        folders = [e["folder"] for e in self._live()[0]]
        rows = self._read(folders) if folders else self.spark.createDataFrame([], _DELTA)
        return self._deltas(rows).where("documents <> 0 or tokens <> 0")
