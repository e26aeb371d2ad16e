import random
import re
import zlib
from collections import Counter

import pytest
from helpers import EDGES, empty, frame

from loreweave.llm import queries
from loreweave.llm import spelling_variants as S


def slow_words(docs, min_length=7, min_count=2, drop_every=0):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words, factor=10):
    near, forms = {}, {}
    for w, n in words.items():
        near[w] = [x for x in words if abs(len(x) - len(w)) < 2 and one_apart(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return out


def result(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typed(seed, letters, size, length):
    rng = random.Random(seed)
    words = {}
    for _ in range(size):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(*length)))
        for _ in range(rng.randint(1, 4)):
            words[word] = rng.choice([1, 2, 3, 30, 30, 400, 5000])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :] or "a", word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
    return words


@pytest.mark.parametrize("letters, shard_words", [("ab", 3), ("ab", 1 << 14), ("abcdÿßÀ", 2), ("abcdÿßÀ", 1 << 14)])
def test_variants_equal_brute_force(spark, letters, shard_words):
    words = typed(len(letters), letters, 120, (1, 9))
    found = S.variants(spark.createDataFrame(list(words.items()), "word string, n long"), shard_words=shard_words)
    want = slow_variants(words)
    assert any(root not in (w, form) for w, form, root, *_ in want)
    assert result(found) == want


def test_automaton_is_minimal_and_numbers_words_in_order():
    words = sorted({a + b + c for a in ("re", "un", "") for b in ("load", "lock", "pack") for c in ("", "s", "ed", "ing")})
    automaton = S.Automaton(words)
    assert [automaton.root.find(w) for w in words] == list(range(len(words)))
    assert automaton.root.find("loads!") == automaton.root.find("loa") == -1
    ends = {w[i:] for w in words for i in range(len(w) + 1)}
    classes = {frozenset(e for e in ends if prefix + e in set(words)) for prefix in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert automaton.nodes == len(classes)
    assert not list(automaton.near("packs", 3))
    assert [words[j] for j in automaton.near("pack", 2)] == ["packs"]


def test_words_of_texts(spark):
    docs = EDGES + [(20, "Überaus ÜBERAUS überaus Straßen straßen STRASSEN a×÷bcdefg a×÷bcdefg"), (21, "colouring " * 40 + "coloring colouring1colouring")]
    want = slow_words(docs, drop_every=3)
    got = S.vocabulary(frame(spark, docs), drop_every=3)
    assert {(r["word"], r["n"]) for r in got.collect()} == set(want.items()) and want
    assert result(S.variants(got)) == slow_variants(want)
    assert result(S.variants(S.vocabulary(empty(spark)))) == set()


def test_query_equals_brute_force_on_a_small_table(spark, tmp_path):
    rng = random.Random(2)
    stems = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(stems, weights=range(1, 61), k=400))) for i in range(60)] + [(None, None), (3, "")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(queries.op11_spelling_variants(spark, str(tmp_path)))
    assert got == slow_variants(slow_words(docs, drop_every=31))
    assert any(form for _, form, *_ in got)
