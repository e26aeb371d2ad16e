import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from loreweave.llm import conversation_repair as C
from loreweave.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, pos long, audit string, cost string"
WS = " \t\n\x0b\f\r"


def slow_solve(marks):
    """The cheapest audit by trying all edits; no more than two rows are inserted in a row."""
    legal = re.compile("(s?(ua)+)?")

    @cache
    def prefix(roles):
        return any(legal.fullmatch(roles + more) for more in ("", "a", "ua"))

    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if not prefix(roles) or best and cost > best[0]:
            return
        if i == len(marks) and legal.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserts + 1)
        if i < len(marks):
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if marks[i] != "-":
                stays = 3 if marks[i].isupper() else 0
                go(i + 1, roles + marks[i].lower(), cost + stays, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + stays + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def slow_rows(table):
    """The contract's rows, one conversation after the other."""
    out, conversations = {}, {}
    for conv, turn, role, text in table:
        rows = conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [] if fault == 0 else [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, seen, n = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else None
            seen.add((role, text))
            marks += letter if fault is None else letter.upper() if fault == "truncated" else "-"
            if fault:
                n[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(f"{a[1][:1]}{b[1][:1]}" not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = slow_solve(marks)
        kept, left = [], iter(rows)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                others = sum(r[:1] != "s" for r, _ in kept)
                kept.append((role if edit == "K" else ("user", "assistant")[others % 2], text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha)
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def asked(spark, rows, folder):
    spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return result(queries.op13_conversation_repair(spark, str(folder)))


def chats(seed, conversations):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "  \n", "", None, "what?  ", "end.\u2028", "dot. ", "Füße.", "a.b!c?"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"]), rng.choice(texts) if rng.random() < 0.5 else f"words {rng.random()}."))
    return rows


def test_solutions_are_the_cheapest_and_least():
    rng = random.Random(4)
    signatures = ["".join(s) for n in range(4) for s in itertools.product("suaxSUAX-", repeat=n)]
    for signature in rng.sample(signatures, 300) + ["ua" * 4, "su-a-uA", "aaaaa", "s" * 5, "uuuua", "SuaUAx"]:
        assert C.solve(signature) == slow_solve(signature), signature


def test_very_long_signatures():
    cost, audit = C.solve("s" + "ua" * 100_000 + "-" + "U")
    assert cost == 8 and audit == "K" * 200_001 + "DD"


def test_query_equals_brute_force(spark, tmp_path):
    rows = chats(1, 120) + [(None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b."), (500, 3, "user", "x" * 300_000 + "."), (500, 4, "assistant", "y. " * 100_000)]
    rows += rows[:40] + [(501, t, "user" if t % 2 else "assistant", "same text.") for t in range(30)][:6]
    assert asked(spark, rows, tmp_path) == slow_rows(rows)


def test_pieces_are_strung_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "_PIECE_BITS", 1)
    rows = chats(2, 40)
    assert asked(spark, rows, tmp_path) == slow_rows(rows)


def test_conversations_without_rows_and_empty_table(spark, tmp_path):
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = asked(spark, [(c, 0, "user", "Hello.") for c in dropped], tmp_path / "a")
    empty = hashlib.sha256(b"").hexdigest()
    assert dropped and got == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in dropped}
    assert asked(spark, [], tmp_path / "b") == {}


def test_a_large_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", 0, "", "") for t in range(20_000)] + [(1, 7, "assistant", "Turn 7.", 0, "", "")] * 500
    solved = C.audits(C.ordered(spark.createDataFrame(rows, SCHEMA)))
    row = solved.first()
    assert (row["duplicate"], row["cost"], row["gaps"], row["audit"]) == (500, 2000, 0, "K" * 8 + "D" * 500 + "K" * 19_992)
