import random
from collections import Counter

import xxhash
from helpers import EDGES, empty, frame, prose

from loreweave.llm import simhash_bktree as S


def slow_print(text):
    """Bit by bit, with plain integers."""
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(docs, radius=3):
    rows, least, root = slow_links(docs, radius)
    return Counter((doc, f"{rows[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(docs))


def slow_survivors(docs, radius=3):
    """The smallest id of each group."""
    return sorted(slow_links(docs, radius)[1].values())


def slow_links(docs, radius):
    prints = [slow_print(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return prints, least, root


def result(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def variants():
    docs = []
    for i in range(30):
        words = prose(i, 300).split()
        docs.append((100 + 10 * i, " ".join(words)))
        for j in range(1, 4):
            words = list(words)
            words[(37 * j) % 300] = f"changed{j}"
            docs.append((100 + 10 * i + j, " ".join(words)))
    return docs


def test_groups_equal_brute_force(spark):
    docs = EDGES[:7] + EDGES[9:] + variants()
    want = slow_groups(docs)
    assert any(c is not None and c != d for d, _, c in want if d and d >= 100)
    assert result(S.groups(frame(spark, docs))) == want


def test_small_shards_lose_nothing(spark):
    docs = variants()
    assert result(S.groups(frame(spark, docs), shard_rows=4)) == slow_groups(docs)


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = list(dict.fromkeys(base + [v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in base for _ in range(3)]))
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.near(v, 3)) == sorted(x for x in values if (x ^ v).bit_count() <= 3)


def test_long_texts_and_empty_table(spark):
    assert f"{slow_print(EDGES[7][1]):016x}" == S.groups(frame(spark, [EDGES[7]])).first()["fingerprint"]
    assert S.groups(empty(spark)).count() == 0


def test_drop_copies_keeps_one_of_each_group(spark):
    docs = variants() + [(5, "x y z"), (6, "x y z"), (6, "x y z"), (None, "x y z"), (7, "x y z"), (7, "something else that has no copy"), (8, "two texts of one id"), (8, "and each a group of its own")]
    kept = S.drop_copies(frame(spark, docs))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == slow_survivors(docs)
    assert kept.where("doc_id is null").count() == 1
    assert kept.columns == frame(spark, docs).columns
