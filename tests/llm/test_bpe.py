import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from helpers import EDGES, empty, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm import bpe_transducer as B

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json",)]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    own = Tokenizer.from_file(request.param)
    own.no_truncation()
    own.no_padding()
    return own, B.codec(request.param), request.param


def agree(both, text):
    library, own, _ = both
    ids = library.encode(text, add_special_tokens=False).ids
    got, decoded = (" ".join(x) for x in zip(*own.stream(text))) if ids else ("", "")
    assert [int(x) for x in got.split()] == ids, text
    assert decoded == library.decode(ids, skip_special_tokens=False), text


TEXTS = [
    "", " ", "Hello, World!", "it's we're I'll  don't", "café café ÅÅ", "全文搜尋 系統SpringBoot與jOOQ", "🙂👩‍👩‍👧 ok", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ", "a b c\x1cd\x1de\x85f",
    "<|startoftext|>hi<|endoftext|>", "x<|endoftext|>y <|nothing|>", "12345 3.14 1,000", "​zero﻿width", "ﬁ ﬂ ½ ²", "\r\n\t", "ÀÉÎ́", "a" * 3000, "ab" * 2000, "!?" * 1500, "الع של", "á" * 700,
    ":\U0003d000 a\U0003d000b 1\U0001246f!", "\u1c89\ua7cb\U00010d50 \ua7ce\u0558x \u208f2",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(both, text):
    agree(both, text)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text_equals_the_library(text):
    library = Tokenizer.from_file(PATHS[0])
    library.no_truncation()
    agree((library, B.codec(PATHS[0]), PATHS[0]), text)


def test_marks_are_composed_as_the_library_composes_them(both):
    """Sequences of marks, also of those that newer tables put in another order."""
    rng = random.Random(8)
    marks = [chr(c) for block in ((0x300, 0x370), (0x591, 0x5C0), (0x1DC0, 0x1E00), (0x20D0, 0x20F1), (0x3099, 0x309B)) for c in range(*block)]
    for _ in range(1500):
        agree(both, "".join(rng.choice("aéΣ カ가\n") + "".join(rng.choices(marks, k=rng.randrange(7))) for _ in range(4)))
    agree(both, "a\u1df5\u1dfa")


def test_one_long_word_needs_little_memory(both):
    """Its tokens leave in small groups, are not kept, and are the library's."""
    _, own, _ = both
    fresh, text = B.TextCodec(own.vocabulary), "abcdefghij" * 30_000
    list(fresh.stream(text[:100]))
    tracemalloc.start()
    count = sum(len(ids.split()) for ids, _ in fresh.stream(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 30_000 and peak < 12_000_000 and len(fresh) <= 2
    agree(both, "abcdefghij" * 3000 + "語" * 2000 + " x" * 9000 + "слово " * 2000)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_the_state_of_a_word_is_bounded(both, chunk):
    """Tokens leave while the word is read, whatever it is fed by; what is kept does not grow."""
    _, own, _ = both
    v = own.vocabulary
    encoder, out, widest, word = B.WordEncoder(v.merges, v.lookahead), [], 0, "abracadabra" * 2000
    for at in range(0, len(word), chunk):
        out += encoder.feed(word[at : at + chunk])
        widest = max(widest, len(encoder.text))
        assert at < 3000 or sum(map(len, out)) > at - encoder.limit - chunk
    out += encoder.finish()
    assert "".join(out) == word and out == list(B.encode_word([word], v.merges, v.lookahead))
    assert widest <= encoder.limit + v.merges.longest + chunk


def test_every_word_goes_through_the_encoder(both, monkeypatch):
    """Without the transducer there is no token at all."""
    _, own, path = both
    fed = []
    monkeypatch.setattr(B.WordEncoder, "feed", lambda self, symbols, feed=B.WordEncoder.feed: fed.append(symbols) or feed(self, symbols))
    fresh = B.TextCodec(own.vocabulary)
    list(fresh.stream("some short words here"))
    assert len(fed) == 4


def test_slices_equal_the_whole(both, monkeypatch):
    library, _, _ = both
    monkeypatch.setattr(B, "_slices", lambda text, cut=B._slices: cut(text, 40))
    for text in ("word é " * 100, "a <|endoftext|> b " * 30, "x" * 100 + " y", "tabs\tand\nlines \u0301 marks " * 20):
        agree(both, text)
    assert len(list(B._slices("word é " * 100))) > 5


def test_digests_and_edges(spark, both):
    library, _, path = both
    docs = EDGES + [(50 + i, prose(i, 200)) for i in range(5)]
    want = []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in B.digests(frame(spark, docs), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.digests(empty(spark), path).count() == 0


def test_encode_keeps_columns(spark, both):
    library, _, path = both
    docs = frame(spark, [(1, "Hello there"), (2, None)])
    rows = {r["doc_id"]: r["loreweave_bpe"] for r in B.encode(docs, path).collect()}
    assert rows[1]["ids"] == library.encode("Hello there", add_special_tokens=False).ids and rows[2]["ids"] == []


def test_byte_decoder_state_machine():
    vocabulary = B.Vocabulary.__new__(B.Vocabulary)
    vocabulary.characters = B.shared.byte_characters()
    vocabulary.values = {c: b for b, c in enumerate(vocabulary.characters)}
    vocabulary.byte_decoder, vocabulary.special = True, {}
    data = "é🙂z".encode()
    vocabulary.names = {i: vocabulary.characters[b] for i, b in enumerate(data)}
    decoder = B.Decoder(vocabulary)
    steps = [decoder.push(i) for i in range(len(data))]
    assert steps == ["", "é", "", "", "", "🙂", "z"] and decoder.finish() == ""
