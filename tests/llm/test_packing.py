import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import EDGES, empty, frame, prose
from tokenizers import Tokenizer

from loreweave.llm import bm25_packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def check(pieces, docs, tokenizer, window, end_id=1):
    """Each id in exactly one piece, sequences gapless and within the window; returns the padding."""
    ids = defaultdict(list)
    for doc, text in docs:
        ids[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id])
    rows, sequences = pieces.collect(), defaultdict(list)
    for r in rows:
        own = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(own) == r["length"] > 0 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == own.tolist() for x in ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, wanted in ids.items():
        assert sum(map(len, wanted)) == sum(r["length"] for r in rows if r["doc_id"] == doc)
        if len(wanted) == 1:
            mine = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
            assert [a for a, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))]
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= window
    return len(sequences) * window - sum(r["length"] for r in rows)


def test_every_token_once(spark, tokenizer):
    docs = EDGES + [(100 + i, prose(i, 20 + 37 * i % 900)) for i in range(40)] + [(200, "a <|endoftext|> b"), (201, "tabs\t\tand\n\n\nlines  ")]
    pieces = P.pack(frame(spark, docs), PATH)
    assert check(pieces, docs, tokenizer, P.WINDOW) < P.WINDOW


def test_small_windows_and_shards(spark, tokenizer):
    docs = [(i, prose(i % 7, 3 + 11 * i % 60)) for i in range(120)]
    pieces = P.pack(frame(spark, docs), PATH, window=64, shard_texts=30)
    assert check(pieces, docs, tokenizer, 64) < 64 * 12
    assert P.pack(empty(spark), PATH).count() == 0


def test_a_seed_takes_its_lexical_neighbours():
    texts = [np.asarray(x, dtype=np.uint32) for x in ([5, 6, 7], [1, 2, 3], [5, 6, 8], [1, 2, 4], [5, 9, 10])]
    index = P.Index(texts, np.ones(16), 3.0)
    used = np.zeros(5, dtype=bool)
    used[0] = True
    assert list(index.neighbours(0, used)) == [2, 4]
    assert [i for i, _, _ in next(iter(P.fill(texts, index, 9)))] == [0, 2, 4]


def _score(texts, idf, mean, seed, other):
    tf = {t: np.count_nonzero(texts[other] == t) for t in set(texts[seed].tolist()) & set(texts[other].tolist())}
    return sum(idf[t] * n * (P.K1 + 1) / (n + P.K1 * (1 - P.B + P.B * len(texts[other]) / mean)) for t, n in tf.items())


def test_all_terms_of_a_seed_are_looked_up():
    """The best neighbour shares 30 terms with the seed, others only its 12 rarest; scores equal brute force as texts are used up."""
    rng = np.random.default_rng(5)
    texts = [np.arange(1, 43), np.arange(13, 43), *(np.asarray([i, 50 + i]) for i in range(1, 13)), *(rng.integers(1, 80, 20) for _ in range(60))]
    texts = [x.astype(np.uint32) for x in texts]
    idf = np.where(np.arange(100) < 13, 2.0, 1.5)
    mean = float(np.mean([len(x) for x in texts]))
    index, used = P.Index(texts, idf, mean), np.zeros(len(texts), dtype=bool)
    for seed in range(len(texts)):
        used[seed] = True
        near = list(index.neighbours(seed, used))
        want = {o: _score(texts, idf, mean, seed, o) for o in range(len(texts)) if not used[o]}
        want = {o: x for o, x in want.items() if x > 0}
        assert set(near) == set(want)
        assert np.allclose([want[o] for o in near], sorted(want.values(), reverse=True), rtol=1e-4)
        if seed == 0:
            assert near[0] == 1


def test_ties_go_by_place_beyond_the_first_neighbours():
    texts = [np.asarray([3, 4], dtype=np.uint32) for _ in range(5 * P.NEIGHBOURS)]
    used = np.zeros(len(texts), dtype=bool)
    used[7] = True
    assert list(P.Index(texts, np.ones(8), 2.0).neighbours(7, used)) == [i for i in range(len(texts)) if i != 7]


def test_a_window_is_filled_by_its_seed():
    """Brute force over random texts: every window is its seed's unused neighbours in order of their BM25 scores."""
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 60, rng.integers(3, 25)).astype(np.uint32) for _ in range(90)]
    idf, mean, used, rest = np.linspace(1, 3, 64), float(np.mean([len(x) for x in texts])), set(), None
    for pieces in P.fill(texts, P.Index(texts, idf, mean), 100):
        room, want = 100, []
        while room:
            if rest is None:
                seed = next((i for i in range(len(texts)) if i not in used), None)
                if seed is None:
                    break
                used.add(seed)
                rest = (seed, 0)
            seed, begin = rest
            ranked = sorted((-np.float32(_score(texts, idf, mean, seed, o)), o) for o in range(len(texts)) if o not in used)
            for o, a in [(seed, begin), *((o, 0) for x, o in ranked if x < 0)]:
                used.add(o)
                b, rest = min(len(texts[o]), a + room), None
                want.append((o, a, b))
                room -= b - a
                if not room:
                    rest = (o, b) if b < len(texts[o]) else None
                    break
        assert pieces == want
    assert len(used) == len(texts)


def test_related_texts_share_a_shard(spark):
    topics = ["zebra", "granite", "violin", "comet", "orchard", "harbour"]
    docs = [(i, f"note {i} on the {topics[i % 6]} " + f"{topics[i % 6]} " * 12) for i in range(120)]
    rows = P.pack(frame(spark, docs), PATH, window=4096, shard_texts=20).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r["doc_id"] % 6].add(r["sequence_id"])
    assert len({s for x in shards.values() for s in x}) > 1 and sum(map(len, shards.values())) <= 7, shards


def test_one_text_of_many_rows_is_dealt_out(spark):
    rows = P.pack(frame(spark, [(i, "the same text") for i in range(600)]), PATH, window=64, shard_texts=10).collect()
    partitions = {r["sequence_id"] >> 32 for r in rows}
    assert len(rows) >= 600 and len(partitions) > 3
