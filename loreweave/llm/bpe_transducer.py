"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

Encoding reads the symbols of a word from left to right. For each prefix it keeps the last token of the
prefix's encoding: the token that ends there, begins where another prefix ends, and is compatible with that
prefix's last token (merging both again leaves them apart). Tokens that end at least ``lookahead`` symbols
before the reader are stable: no symbol to come can change them. They are emitted and forgotten, so the state
of a word of any length is a window of constant size. ``sufficient_lookahead`` computes the bound from the
merge list: a token can only be taken apart by an earlier merge of its last part with what follows, which in
turn may hang on what follows that, by ever earlier merges.

Decoding feeds one id at a time. Tokenizers with a byte-level decoder map token characters to bytes and pass
through an incremental UTF-8 decoder whose state is at most three pending bytes; those without a decoder have
their tokens joined by a blank. Encoding a word feeds its decoder token by token.

A text is read slice by slice, cut before blanks; its ids and its decoded text are hashed as they come. The words of
a text come from the vocabulary file's own pattern, after its normalisation (NFC by the library's tables, white space,
lower case) and after special tokens were cut out of the raw text. Each worker keeps the output of short runs it met,
within a bound; a longer word goes symbol by symbol through the transducer and leaves token by token, so that of a
text of any length no more than the text itself and a window is held. Defined results: a null or empty text has no tokens; a null id stays null; repeated rows
are returned as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from loreweave.llm import shared

_KNOWN_WORDS = 300_000
#: Characters of a text that are encoded, decoded and hashed at a time.
SLICE = 1 << 16
#: No character composes with a blank before it, and marks do not move across one; no word reaches across.
_CUT = re.compile(r"[ \n]")
#: Characters of a run, and of a word, whose output is kept; tokens of a longer word, and runs, that leave together.
_SHORT, _TOKENS, _TOGETHER = 512, 64, 4096
_KNOWN_PAIRS = 300_000
_PLAIN = regex.compile("[!-~]*")
_SEPARATORS = regex.compile("[\\x1c-\\x1f]")
#: Code points that Unicode 16, which the vocabularies' words go by, has neither as letters nor as digits.
_LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Lower cases that are newer than Python's tables.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW_CASE = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_COMPOSABLE = re.compile("[\u0300-\U0010ffff]")
_NFC = normalizers.NFC()
_END = ""  # stands for the word-end suffix inside this module


class MergeList:
    """Ranked merges over symbols, and whether two tokens may stand side by side in an encoding."""

    def __init__(self, merges: list[tuple[str, str]], tokens: Iterable[str]) -> None:
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.tokens = frozenset(tokens)
        self.longest = max(map(len, self.tokens), default=1)
        self.parts = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(merges)))}
        self._spines: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        #: Of each left token, whether what it was asked about may follow it; and how many answers there are.
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.answers = 0
        #: The tokens by their characters from the last to the first; "" leads to the token that is read by then.
        self.endings: dict = {}
        for token in self.tokens:
            node = self.endings
            for c in reversed(token):
                node = node.setdefault(c, {})
            node[""] = token

    def _spine(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """The token, its part on that side (1: left, 2: right), that one's part and so on, each with the ranks of the
        merges that make it and that use it up."""
        known = self._spines.get((token, side))
        if known is None:
            known, used = [], float("inf")
            at: str | None = token
            while at is not None:
                made = self.parts.get(at)
                known.append((at, made[0] if made else -1, used))
                at, used = (made[side], made[0]) if made else (None, used)
            self._spines[(token, side)] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """No merge across the boundary comes before both of its sides are used up; of equal ranks the left one goes first."""
        known = self.pairs[left].get(right)
        if known is None:
            if self.answers >= _KNOWN_PAIRS:
                self.pairs.clear()
                self._spines.clear()
                self.answers = 0
            known, rank = True, self.rank
            for x, x_made, x_used in self._spine(left, 2):
                for y, y_made, y_used in self._spine(right, 1):
                    across = rank.get((x, y))
                    if across is not None and across < x_used and across <= y_used and x_made < y_used and y_made < x_used:
                        known = False
            self.pairs[left][right] = known
            self.answers += 1
        return known


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token that can matter for whether it stays.

    ``need[t]`` bounds, for the merges of rank so far, how far right of ``t`` its fate is decided: merging
    (a, b) needs what b needs; and from then on, leaving a alone needs to know that no b follows, for which b's
    symbols and b's own need must be read.
    """
    need: dict[str, int] = {}
    width = lambda t: len(t) - t.endswith(_END)
    for a, b in merges:
        right = need.get(b, 0)
        need[a + b] = max(need.get(a + b, 0), right)
        need[a] = max(need.get(a, 0), width(b) + right)
    return max(need.values(), default=0) + 1


class WordEncoder:
    """The transducer over one word's symbols; ``feed`` and ``finish`` return the tokens that became stable.

    ``last[i]`` is the last token of the prefix that ends at place i of the kept text: "" where the kept text
    begins, None where no prefix ends (inside a symbol). Of what was emitted, the token before the kept text is
    still needed, to judge what may follow it. No more is kept than ``limit`` places and what one call brings.
    """

    def __init__(self, merges: MergeList, lookahead: int) -> None:
        self.merges, self.lookahead = merges, lookahead
        self.text, self.last, self.begin = "", [""], 0
        self.limit = 2 * lookahead + 2 * merges.longest

    def feed(self, symbols: str) -> list[str]:
        """Read symbols; a word's end mark comes together with the symbol before it."""
        pairs, endings, fits_side_by_side = self.merges.pairs, self.merges.endings, self.merges.compatible
        read, last = len(self.text), self.last
        self.text = text = self.text + symbols
        size = len(text)
        inside = size - 1 if symbols[-1:] == _END else 0  # no prefix ends before the end mark
        for end in range(read + 1, size + 1):
            found, begin, node = None, end, endings
            if end == inside:
                begin = 0
            while begin:
                begin -= 1
                node = node.get(text[begin])
                if node is None:
                    break
                token = node.get("")
                if token is not None:
                    before = last[begin]
                    if before is None:
                        continue
                    if before:
                        fits = pairs[before].get(token)
                        if fits is None:
                            fits = fits_side_by_side(before, token)
                        if not fits:
                            continue
                    found = token
                    break
            last.append(found)
        return self._emit(size - self.lookahead) if size > self.limit else []

    def _emit(self, until: int) -> list[str]:
        """Let the tokens go that end at ``until`` or before: going back from the end, each prefix's last token."""
        at, found, last = len(self.text), [], self.last
        while at > self.begin:
            found.append((at, last[at]))
            at -= len(last[at])
        stable = [(end, token) for end, token in reversed(found) if end <= until]
        if stable:
            keep = stable[-1][0] - len(stable[-1][1])
            self.begin = stable[-1][0] - keep
            self.text, self.last = self.text[keep:], self.last[keep:]
            self.last[: self.begin] = [None] * self.begin
        return [token for _, token in stable]

    def finish(self) -> list[str]:
        """What is left, once the word is read."""
        at, found, last = len(self.text), [], self.last
        while at > self.begin:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]


def encode_word(pieces: Iterable[str], merges: MergeList, lookahead: int) -> Iterator[str]:
    """The tokens of a word that comes in pieces (the last with its end mark, if the vocabulary has one), as they become
    stable."""
    encoder = WordEncoder(merges, lookahead)
    for piece in pieces:
        at = 0
        while at < len(piece):
            end = at + encoder.limit
            end += piece[end : end + 1] == _END
            yield from encoder.feed(piece[at:end])
            at = end
    yield from encoder.finish()


class Vocabulary:
    """A tokenizer file (BPE with a Split or byte-level pre-tokenizer), read for the transducer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        inner = (lambda t: t[: -len(self.suffix)] + _END if t.endswith(self.suffix) else t) if self.suffix else (lambda t: t)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(inner(a), inner(b)) for a, b in pairs]
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.merges, self.lookahead = MergeList(merges, self.ids), sufficient_lookahead(merges)
        self.byte_decoder = spec.get("decoder") is not None
        split = next(p for p in [spec["pre_tokenizer"], *spec["pre_tokenizer"].get("pretokenizers", [])] if p["type"] == "Split")
        written = split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self.pattern = regex.compile(written)
        # the same for runs with code points that newer tables call letters or digits
        later = _LATER.pattern[1:-1]
        for kind in ("L", "N"):
            written = written.replace(rf"[\p{{{kind}}}]", rf"[\p{{{kind}}}--[{later}]]")
        written = written.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[{later}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])")
        self.strict_pattern = regex.compile(written, regex.V1)
        self.characters = shared.byte_characters()
        self.values = {c: b for b, c in enumerate(self.characters)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _splitter(self, text: str) -> regex.Pattern:
        return self.pattern if text.isascii() or not _LATER.search(text) else self.strict_pattern

    def words(self, text: str) -> Iterator[str]:
        return (m[0] for m in self._splitter(text).finditer(text))

    def short_words(self, text: str) -> list[str]:
        return self._splitter(text).findall(text)

    def short_tokens(self, word: str) -> list[str]:
        """``tokens`` of a word that is read at once."""
        raw = word if _PLAIN.fullmatch(word) else "".join(map(self.characters.__getitem__, word.encode()))
        encoder = WordEncoder(self.merges, self.lookahead)
        stable = encoder.feed(raw + _END if self.suffix else raw)
        return stable + encoder.finish() if stable else encoder.finish()

    def _symbols(self, word: str) -> Iterator[str]:
        for at in range(0, len(word), _SHORT):
            piece, last = word[at : at + _SHORT], at + _SHORT >= len(word)
            raw = piece if _PLAIN.fullmatch(piece) else "".join(map(self.characters.__getitem__, piece.encode()))
            yield raw + _END if last and self.suffix else raw

    def tokens(self, word: str) -> Iterator[str]:
        return encode_word(self._symbols(word), self.merges, self.lookahead)


def _normal(text: str) -> str:
    """NFC and lower case character by character; white space only separates words and needs no change."""
    if not text.isascii():
        if _COMPOSABLE.search(text):
            text = _NFC.normalize_str(text)
        text = text.replace("Σ", "σ")
        if _NEW_CASE.search(text):
            text = text.translate(_LOWER)
    return text.lower()


class Decoder:
    """Ids to text, one at a time; ``push`` returns what can be told now and ``finish`` the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.first = vocabulary, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if vocabulary.byte_decoder else None

    def push(self, token_id: int) -> str:
        token = self.vocabulary.names.get(token_id)
        if token is None:
            return ""
        if not self.vocabulary.byte_decoder:
            lead, self.first = "" if self.first else " ", False
            return lead + token
        if token in self.vocabulary.special:
            return self.utf8.decode(token.encode())
        return self.utf8.decode(bytes(map(self.vocabulary.values.__getitem__, token)))

    def finish(self) -> str:
        return "" if not self.vocabulary.byte_decoder else self.utf8.decode(b"", True)


class TextCodec(dict):
    """Per short run of a text without white space: its decimal ids and its decoded text, both joined by a blank."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        #: Per token its decimal id and its text.
        self.shown = {t: (str(i), vocabulary.names[i]) for t, i in vocabulary.ids.items()}

    def __missing__(self, run: str) -> tuple[str, str]:
        value = self.older.get(run)
        if value is None:
            words = self.vocabulary.short_words(run)
            if len(words) != 1 or words[0] != run:
                parts = [self[word] for word in words]
                value = (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
            elif self.vocabulary.byte_decoder:
                parts = list(self._word(run))
                value = (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
            else:
                parts = list(map(self.shown.__getitem__, self.vocabulary.short_tokens(run)))
                value = (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        if len(self) >= _KNOWN_WORDS:  # the runs met since the last time stay at hand
            self.older = dict(self)
            self.clear()
        self[run] = value
        return value

    def _word(self, word: str) -> Iterator[tuple[str, str]]:
        """A word's ids and text, some tokens at a time."""
        v, ids, text, decoder = self.vocabulary, [], [], Decoder(self.vocabulary)
        for token in v.tokens(word):
            ids.append(v.ids[token])
            text.append(decoder.push(ids[-1]))
            if len(ids) >= _TOKENS:
                yield " ".join(map(str, ids)), "".join(text)
                ids, text, decoder.first = [], [], True
        yield " ".join(map(str, ids)), "".join(text) + decoder.finish()

    def _plain(self, text: str) -> Iterator[tuple[str, str]]:
        """Of a slice without special tokens."""
        normal = _normal(text)
        # split() also splits at four control characters that are no white space to the vocabulary's pattern
        runs = list(self.vocabulary.words(normal)) if _SEPARATORS.search(normal) else normal.split()
        if max(map(len, runs), default=0) <= _SHORT:
            return map(self.__getitem__, runs)
        return chain.from_iterable(map(self._run, runs))

    def _run(self, run: str) -> Iterator[tuple[str, str]]:
        if len(run) <= _SHORT:
            yield self[run]
            return
        for word in self.vocabulary.words(run):
            if len(word) <= _SHORT:
                yield self[word]
            else:
                yield from self._word(word)

    def _encoded(self, text: str) -> Iterator[tuple[str, str]]:
        v = self.vocabulary
        if v.cut is None or "<" not in text or not v.cut.search(text):
            return self._plain(text)
        parts = [[(str(v.special[p]), p)] if p in v.special else self._plain(p) for p in v.cut.split(text)]
        return chain.from_iterable(parts)

    def stream(self, text: str) -> Iterator[tuple[str, str]]:
        """The decimal ids and the decoded text of a few thousand runs after the others, both joined by blanks."""
        for part in _slices(text):
            encoded = self._encoded(part)
            while words := list(islice(encoded, _TOGETHER)):
                words = [w for w in words if w[0]]
                if words:
                    yield " ".join([w[0] for w in words]), " ".join([w[1] for w in words])


def _slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text cut before blanks."""
    at = 0
    for m in _CUT.finditer(text, size) if len(text) > size else ():
        if m.start() - at >= size:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    return TextCodec(Vocabulary(path))


_CODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """Every column of ``documents``, and ``ids`` and ``decoded`` in a struct ``loreweave_bpe``. The file must be readable on every executor."""
    shared.small_batches(documents.sparkSession)

    @F.arrow_udf(_ENCODED)
    def bpe(text: pa.Array) -> pa.Array:
        own = codec(path)
        pairs = [list(own.stream(t or "")) for t in text.to_pylist()]
        ids = pa.array([[int(x) for a, _ in p for x in a.split()] for p in pairs], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array([" ".join(b for _, b in p) for p in pairs], pa.string())], ["ids", "decoded"])

    return documents.withColumn("loreweave_bpe", bpe(F.col("text")))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of the decoded text of every whole text."""
    shared.small_batches(documents.sparkSession)

    @F.arrow_udf(_CODED)
    def coded(text: pa.Array) -> pa.Array:
        own, counts, ids_hash, text_hash = codec(path), [], [], []
        for t in text.to_pylist():
            count, ids_digest, text_digest, lead = 0, hashlib.sha256(), hashlib.sha256(), ""
            for ids, decoded in own.stream(t or ""):
                count += ids.count(" ") + 1
                ids_digest.update((lead + ids).encode())
                text_digest.update((lead + decoded).encode())
                lead = " "
            counts.append(count)
            ids_hash.append(ids_digest.hexdigest())
            text_hash.append(text_digest.hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", coded(F.col("text")).alias("coded")).select("doc_id", "coded.*")
