"""Conversation repair: each distinct signature of roles and faults is solved once, and its edits are replayed.

The rows of a conversation, by turn (nulls first; ties by role and text), become a compact string of one letter a
row: its role's initial (s, u, a or x for any other), a capital if the row is truncated, ``-`` if it has to go (it is
blank or repeats an earlier row of the conversation). The cheapest edits depend on that signature alone: Keep costs
0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant row 3, and a truncated row that stays
adds 3; the roles that result must be an optional system row and then one or more pairs of user and assistant, or
nothing at all. Distinct signatures are solved by recursion over (rows left, roles so far) with a table of solved
cases, filled from the end so that no text is too long for it; of equally cheap edits those whose initials are least
are taken. Solutions are joined back by signature and replayed along the rows.

Rows are put in order by ranges of (conversation, turn, role, text), so that a conversation of any length spreads over
tasks, and get a position. Signatures are strung together from pieces of at most 65,536 positions. What a task holds
whole is one conversation's signature and edits, a letter a row, as the result does; texts are streamed.

Defined results: a null role or text is a space; a null conversation id is a conversation of its own; null turns come
first, count no gap and no distinct turn; rows that are equal in all columns are repeats of the first; an empty table
gives an empty result; very long texts pass one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")
_PIECE_BITS = 16

_BLANK = r"^[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def ordered(conversations: DataFrame) -> DataFrame:
    """``pos``, ``conv_id``, ``turn``, ``role``, ``text``: the rows in order, and the position of each in all."""
    shared.small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return shared.written(rows.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"), "conversation-rows")


def _letter(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("x")


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``roles`` (a letter a row), ``signature``, ``gaps``, ``blank``, ``duplicate``, ``truncated`` and
    ``illegal`` of each conversation of ``ordered`` rows."""
    marks = rows.select(
        "pos", "conv_id", "turn", "role", F.md5("text").alias("digest"), F.length("text").alias("long"), _letter(F.col("role")).alias("letter"),
        F.regexp_like("text", F.lit(_BLANK)).alias("blank"), (~F.regexp_like("text", F.lit(_ENDED))).alias("cut"),
    )
    marks = shared.written(marks, "conversation-marks")
    first = marks.groupBy("conv_id", "role", "digest", "long").agg(F.min("pos").alias("first_pos")).select("first_pos")
    marks = marks.join(first, marks["pos"] == first["first_pos"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first_pos").isNull(), "duplicate").when(F.col("cut"), "truncated")
    marks = marks.select("pos", "conv_id", "letter", fault.alias("fault"))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter"))

    def strung(column: str, by: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, column))), lambda x: x[column]), "")

    pieces = marks.withColumn("mark", mark).groupBy("conv_id", F.expr(f"shiftright(pos, {_PIECE_BITS})").alias("piece")).agg(
        strung("letter", "pos").alias("roles"), strung("mark", "pos").alias("signature"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    whole = pieces.groupBy("conv_id").agg(
        strung("roles", "piece").alias("roles"), strung("signature", "piece").alias("signature"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    turns = turns.groupBy(F.col("conv_id").alias("own")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    legal = sum(((F.length("roles") - F.length(F.replace("roles", F.lit(pair), F.lit("")))) / 2).cast("long") for pair in ("su", "ua", "au"))
    out = whole.join(turns, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return out.select(
        "conv_id", "roles", "signature", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.length("roles").cast("long") - 1 - legal).alias("illegal"),
    )


#: Roles so far: none, a system row, an odd and an even number of others; what a user or assistant row leads to.
_NONE, _SYSTEM, _USER, _PAIR = range(4)
_NEXT = {_NONE: _USER, _SYSTEM: _USER, _USER: _PAIR, _PAIR: _USER}
_D, _I, _K, _R = b"DIKR"
_KEPT = {(_NONE, "s"): _SYSTEM, (_NONE, "u"): _USER, (_SYSTEM, "u"): _USER, (_PAIR, "u"): _USER, (_USER, "a"): _PAIR}


def solve(signature: str) -> tuple[int, str]:
    """The least cost of a signature and the initials of its edits, the least of those that cost as little.

    The table has the first edit of the cheapest end of a repair by rows left and roles so far. An edit and the roles
    so far decide what follows, so that the costs of the next row and one initial for each case are enough.
    """
    never, cases = 1 << 60, range(4)
    cost = [0 if case in (_NONE, _PAIR) else never for case in cases]
    first = bytearray(4 * len(signature) + 4)

    def settle(ways: list[tuple[int, int]], at: int) -> list[int]:
        for _ in cases:  # rows that are inserted one after the other: no more than two pay
            ways = [min(ways[case], (ways[_NEXT[case]][0] + INSERT, _I)) for case in cases]
        first[at : at + 4] = bytes(edit for _, edit in ways)
        return [c for c, _ in ways]

    cost = settle([(c, 0) for c in cost], 0)
    for k, mark in enumerate(reversed(signature), 1):
        ways = [(cost[case] + DELETE, _D) for case in cases]
        if mark != "-":
            stays = TRUNCATED if mark.isupper() else 0
            for case in cases:
                ways[case] = min(ways[case], (cost[_NEXT[case]] + stays + REROLE, _R))
                if (case, mark.lower()) in _KEPT:
                    ways[case] = min(ways[case], (cost[_KEPT[case, mark.lower()]] + stays, _K))
        cost = settle(ways, 4 * k)
    left, case, audit = len(signature), _NONE, bytearray()
    while edit := first[4 * left + case]:
        audit.append(edit)
        if edit == _K:
            case = _KEPT[case, signature[-left].lower()]
        elif edit != _D:
            case = _NEXT[case]
        left -= edit != _I
    return cost[_NONE], audit.decode()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.table_of(batches):
        for signature in batch.column(0).to_pylist():
            cost, audit = solve(signature)
            yield pa.RecordBatch.from_pydict({"signature": [signature], "cost": pa.array([cost], pa.int64()), "audit": [audit]})


def audits(rows: DataFrame) -> DataFrame:
    """The columns of ``signatures`` with the ``cost`` and the ``audit``, the initials of the edits in order."""
    signed = shared.written(signatures(rows), "signatures")
    distinct = signed.select("signature").distinct().repartition("signature")
    solutions = shared.written(distinct.mapInArrow(_solved, "signature string, cost long, audit string"), "solutions")
    return signed.join(solutions, "signature")


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the repaired conversation, from the edits and its rows ``(role, text)``."""
    place = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        system = edit == "K" and role[:1] == "s"
        yield edit, role if edit == "K" else ROLES[place % 2], text
        place += not system


_REPAIRED = pa.schema([("conv_id", pa.string()), ("number", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, first one with its audit, then its own in order; its edits take all of these."""
    entries = (
        entry
        for batch in shared.table_of(batches)
        for entry in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "pos", "audit", "role", "text")), strict=True)
    )
    out, size = [], 0
    for conv_id, _, audit, _, _ in entries:
        own = ((role, text) for _, _, _, role, text in entries)
        for number, (edit, role, text) in enumerate(replay(audit, own)):
            out.append((conv_id, number, edit, role, text))
            size += len(text)
            if len(out) >= shared.BATCH_ROWS or size > shared.BATCH_BYTES:
                yield _repaired(out)
                out, size = [], 0
    yield _repaired(out)


def _repaired(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(_REPAIRED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED, strict=True)], schema=_REPAIRED)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv_id`` (as text), ``number``, ``edit``, ``role``, ``text``: the rows of the repaired conversations, from
    ``ordered`` rows and their ``audits``. Those of a conversation follow each other in one partition."""
    none = F.lit(None).cast("string")
    heads = solved.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", none.alias("role"), none.alias("text"))
    stream = heads.unionByName(rows.select("conv_id", "pos", none.alias("audit"), "role", "text"))
    stream = stream.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return stream.mapInArrow(_replayed, "conv_id string, number long, edit string, role string, text string")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` of the repaired rows as ``role:text``, joined by newlines, in the order of
    ``repaired``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, digest = [], [], None
        for batch in shared.table_of(batches):
            for conv_id, number, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "number", "role", "text")), strict=True):
                if number == 0:
                    if digest:
                        hashes.append(digest.hexdigest())
                    digest = hashlib.sha256()
                    ids.append(conv_id)
                digest.update(f"{chr(10) if number else ''}{role}:{text}".encode())
            if len(hashes) > shared.BATCH_ROWS:
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids[: len(hashes)], pa.string()), "sha256": hashes})
                ids, hashes = ids[len(hashes) :], []
        if digest:
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.string()), "sha256": pa.array(hashes, pa.string())})

    return repaired_rows.mapInArrow(run, "conv_id string, sha256 string")
