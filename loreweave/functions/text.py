"""Text functions as column expressions: tokens, normal forms, titles, tags, anchors and redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The classes of searchable characters, the patterns of technical words, and the folder of each page type.
HAN = r"[\p{IsHan}&&[\p{L}\p{Nd}\p{M}]]+"
WORD = r"[\p{L}\p{Nd}\p{M}&&[^\p{IsHan}]]+"
FALLBACK_ANCHOR = r"(?iu)(?:[A-Z]{2,}-\d{3,}|[A-Z][A-Za-z0-9_$]*(?:Error|Exception)|[a-z][a-z0-9_]*_[a-z0-9_]+|[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+)"
RERANK_ANCHOR = r"([A-Z]{2,}[-_]?\d+|[A-Z][a-z]+[A-Z][a-z]+|[a-z]+(\.[a-z]+)+|\b[A-Za-z]+[-][a-z]+)"
WIKILINK = r"\[\[([^\[\]\r\n]+)\]\]"
PAGE_FOLDERS = {
    "CONCEPT": "concepts",
    "TECHNOLOGY": "technologies",
    "TROUBLESHOOTING": "troubleshooting",
    "DECISION": "decisions",
    "PROJECT": "projects",
    "REFERENCE": "references",
    "HOWTO": "howtos",
    "PERSON": "people",
    "ORGANIZATION": "organizations",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Marks and jamo, and the blocks around all other characters that canonical composition changes.
_COMPOSABLE = (
    r"[\p{M}\x{1100}-\x{11FF}\x{374}-\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}-\x{B5D}\x{F43}-\x{F69}\x{1F71}-\x{2001}"
    r"\x{2126}-\x{212B}\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FAD9}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D164}\x{1D1BB}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


def nfc(c: Column | str) -> Column:
    """Canonical composition. Spark has no such function; rows that it cannot change reach Python as null and come back as
    they were. Give a plain column: what stands here is worked out several times."""

    @F.arrow_udf(T.StringType())
    def compose(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())

    c = _col(c)
    beyond = c.rlike(r"[^\x{0}-\x{2FF}]")  # nothing before the first combining mark is changed; a cheap test that most texts end with
    return F.coalesce(compose(F.when(beyond & c.rlike(_COMPOSABLE), c)), c)


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space alone."""
    return ~F.coalesce(_col(c), F.lit("")).rlike(r"\S")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Composed letters whose base is one of A-Z or a-z, and that base; and final forms of Greek letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs) + "ςſ", "".join(d for _, d in pairs) + "σs"


def fold_accents(c: Column | str) -> Column:
    """Composed texts as the index's tokenizer folds them: Latin letters lose their marks, and combining diacritics go.
    Letters and marks of other scripts stay."""
    marked, plain = _accents()
    return F.regexp_replace(F.translate(_col(c), marked, plain), r"[\x{300}-\x{36F}]", "")


def folded_term(term: str) -> str:
    """A term of a query as the index holds it: the driver's twin of ``lower`` and ``fold_accents``."""
    term = unicodedata.normalize("NFC", term).lower().translate(str.maketrans(*_accents()))
    return "".join(c for c in term if not "\u0300" <= c <= "\u036f")


def segments(c: Column | str) -> Column:
    """Runs of searchable characters; Han and other scripts apart."""
    return F.regexp_extract_all(_col(c), F.lit(f"{HAN}|{WORD}"), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Index tokens of the composed text: overlapping pairs of a Han run (a single one as it is), other runs in lower case."""
    return composed_tokens(nfc(c))


def composed_tokens(c: Column) -> Column:
    """``tokens`` of a text that is composed already; unlike those it may stand in a lambda."""
    def one(s: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
        return F.when(s.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(F.lower(s)))

    plain = F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nd}\p{M}]+"), F.lit(0)), F.lower)
    found = F.when(c.rlike(r"\p{IsHan}"), F.flatten(F.transform(segments(c), one))).otherwise(plain)
    return F.coalesce(found, F.array().cast("array<string>"))


def index_tokens(c: Column | str) -> Column:
    """Tokens as the index stores them: folded after projection. Texts without Han need one pass of one pattern."""
    return composed_index_tokens(nfc(c))


def composed_index_tokens(c: Column) -> Column:
    """``index_tokens`` of a text that is composed already, such as a query."""
    plain = F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(r"[\p{L}\p{Nd}\p{M}]+"), F.lit(0))
    found = F.when(c.rlike(r"\p{IsHan}"), F.transform(composed_tokens(c), fold_accents)).otherwise(plain)
    return F.coalesce(found, F.array().cast("array<string>"))


def projected(c: Column | str) -> Column:
    """The text that is indexed: tokens joined by blanks; null stays null."""
    return F.when(_col(c).isNotNull(), F.array_join(tokens(c), " "))


def line_ends(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n|\r", "\n")


def strip_format_characters(c: Column | str) -> Column:
    """Without soft hyphens, zero-width spaces and word joiners anywhere, and byte order marks but at the start."""
    return F.regexp_replace(_col(c), r"(?<!^)\x{FEFF}|[\x{AD}\x{200B}\x{2060}]", "")


def strip_controls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0D-\x1F\x7F-\x9F]", "")


def strip_line_tails(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[\t ]+(?=\n|\f|$)", "")


def collapse_lines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\n{3,}", "\n\n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_edges(c: Column | str, minimum: int = 2) -> Column:
    """Pages (parted by form feeds) without a first or last shown line that ``minimum`` pages have in that place.

    Texts of fewer pages stay as they are. First lines and last lines are counted apart, and a page of one shown line
    has it as both.
    """
    c = _col(c)

    def edges(page: Column) -> Column:
        shown = F.filter(F.sequence(F.lit(0), F.size(page) - 1), lambda i: F.element_at(page, i + 1).rlike(r"\S"))
        at = lambda k: F.try_element_at(shown, F.lit(k))
        line = lambda k: F.when(F.size(shown) > 0, F.element_at(page, at(k) + 1))
        return F.struct(page.alias("lines"), at(1).alias("first"), at(-1).alias("last"), line(1).alias("header"), line(-1).alias("footer"))

    def often(pages: Column, name: str) -> Column:
        lines = F.array_sort(F.filter(F.transform(pages, lambda p: p[name]), lambda x: x.isNotNull()))
        # of equal lines in order, the one that is ``minimum`` - 1 places after an equal one
        return F.array_distinct(F.filter(lines, lambda x, i: (i >= minimum - 1) & (F.try_element_at(lines, F.greatest(i - minimum + 2, F.lit(1))) == x)))

    def kept(page: Column, headers: Column, footers: Column) -> Column:
        gone = lambda i, place, line, known: F.coalesce((i == page[place]) & F.array_contains(known, page[line]), F.lit(False))
        return F.array_join(F.filter(page["lines"], lambda _, i: ~gone(i, "first", "header", headers) & ~gone(i, "last", "footer", footers)), "\n")

    pages = F.transform(F.transform(F.split(c, "\f"), lambda p: F.split(p, "\n")), edges)
    cut = _let(pages, lambda own: _let(F.struct(often(own, "header").alias("h"), often(own, "footer").alias("f")), lambda k: F.array_join(F.transform(own, lambda p: kept(p, k["h"], k["f"])), "\f")))
    return F.when(F.size(F.split(c, "\f")) < minimum, c).otherwise(cut)


def normalized(c: Column | str, compose: bool = True, selected_format_strip: bool = True, edges: bool = False) -> Column:
    """The canonical text in its fixed order of steps; ``edges``: without repeated page edges, as the last but one."""
    out = line_ends(nfc(c) if compose else c)  # line ends and composition do not touch each other
    out = strip_format_characters(out) if selected_format_strip else out
    out = strip_line_tails(strip_controls(out))
    return collapse_lines(without_edges(out) if edges else out)


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def previews(c: Column | str, size: int = 2000) -> Column:
    """Fixed slices of ``size`` characters; an empty text has none."""
    c = _col(c)
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncated(c: Column | str, size: int) -> tuple[Column, Column]:
    """The first ``size`` characters, and whether any are missing."""
    return F.substring(_col(c), 1, size), F.length(_col(c)) > size


def token_estimate(characters: Column) -> Column:
    return F.floor((characters + 3) / 4)


def title_key(c: Column | str) -> Column:
    """A title as links compare it, composed."""
    return composed_title_key(nfc(c))


def composed_title_key(c: Column) -> Column:
    """``title_key`` of a text that is composed already."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column | str, limit: int = 200) -> Column:
    """A file name stem; null where nothing usable is left."""
    s = F.lower(F.regexp_replace(nfc(c), r"^\s+|\s+$", ""))
    for pattern, by in ((r"\s+", "-"), (r"[^\p{L}\p{N}\-_]", ""), (r"-{2,}", "-"), (r"^-+|-+$", "")):
        s = F.regexp_replace(s, pattern, by)
    s = F.regexp_replace(F.substring(s, 1, limit), r"-+$", "")
    return F.when(s != "", s)


def wiki_path(page_type: Column, title: Column | str) -> Column:
    """``vault/<folder>/<stem>.md``; null for an unknown type or an unusable title."""
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in PAGE_FOLDERS.items() for x in pair]), page_type)
    return F.concat(F.lit("vault/"), folder, F.lit("/"), slug(title), F.lit(".md"))


def joined_tags(c: Column | str) -> Column:
    """A row's tags as one text to compose, parted by U+0000."""
    return F.array_join(F.transform(_col(c), lambda t: F.regexp_replace(t, r"[\s\x00]+", " ")), "\x00")


def split_tags(joined: Column | str, count: int = 50, size: int = 80) -> Column:
    """``tags`` of ``joined_tags``, best given as a plain column."""
    own = F.transform(F.split(nfc(joined), "\x00"), composed_title_key)
    own = F.filter(own, lambda t: t.isNotNull() & (t != "") & (F.length(t) <= size))
    return F.slice(F.sort_array(F.array_distinct(own)), 1, count)


def tags(c: Column | str, count: int = 50, size: int = 80) -> Column:
    """Tags in normal form, distinct and sorted, of at most ``size`` characters; at most ``count``."""
    return split_tags(joined_tags(c), count, size)


def wikilinks(c: Column | str) -> Column:
    """Normalised targets of ``[[target|label]]`` links, first seen first."""
    found = F.regexp_extract_all(nfc(c), F.lit(WIKILINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: composed_title_key(F.substring_index(t, "|", 1))), lambda t: t != ""))


def anchors(c: Column | str, pattern: str = FALLBACK_ANCHOR, limit: int = 4) -> Column:
    """Technical words as written, one of each by lower case, first seen first."""
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))
    keys = F.transform(found, F.lower)
    first = F.filter(found, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return F.slice(first, 1, limit)


def rerank_bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring ideographs."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]{2,}"), F.lit(0))
    pairs = F.transform(runs, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return F.array_distinct(F.flatten(pairs))


def rerank_tokens(c: Column | str) -> Column:
    """Distinct lower-case runs of letters, digits and hyphens, and ideograph pairs."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"[\p{L}\p{Nd}\-]+"), F.lit(0))
    return F.array_union(F.array_distinct(F.transform(runs, F.lower)), rerank_bigrams(c))


# What a diagnostic may not show, in the order in which it is replaced.
_REDACTIONS = [
    (r"(?i)(api[-_ ]?key|authorization|token|secret|password)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+", "$1=[REDACTED]"),
    (r"(?i)\bbearer\s+[^\s,;]+", "Bearer [REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\b", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"(?i)(?:\bRID\s*#?\s*\d+:\d+)|#\d+:\d+", "[REDACTED]"),
    (r"%2F[A-Za-z0-9._@%-]+%2F[A-Za-z0-9._@%-]*", "[REDACTED]"),
    (r"(^|[\s:=(\"'])/(?:[A-Za-z0-9._@-]+/)+[A-Za-z0-9._@-]*", "$1[REDACTED]"),
    (r"(^|[\s:=(\"'])/(?:Users|home|var|tmp|private|opt|usr|etc|srv)(?=$|[\s/.,:;)\"])", "$1[REDACTED]"),
    (r"[A-Za-z]:\\[^ \"',;]*", "[REDACTED]"),
]
_UNSAFE = (
    r"(?i)(?:jdbc:|bolt:|sqlite|\bgql\b|sql-pgq|arcadedb|neo4j|ryugraph|bigquery|spanner|\bMATCH\s*\(|\bRETURN\s+\w|\bSELECT\s+.+\bFROM\b|"
    r"\bINSERT\s+INTO\b|\bDELETE\s+FROM\b|\bUPDATE\s+\w+\s+SET\b|\bCREATE\s+TRIGGER\b|\bDROP\s+(?:TABLE|TRIGGER|INDEX)\b|"
    r"\b(?:MERGE|DELETE|INSERT|UPDATE|UPSERT|TRAVERSE)\s+[(:]|\bat\s+[\w.$]+\(|\b[a-z][a-z0-9_]*(?:\.[a-z0-9_]+)+\.[A-Z][\w$]*Exception\b|"
    r"\{\"(?:error|type|code|message|status)\"|\bexception\b|stack\s*trace|caused\s+by\b)"
)


def redacted(c: Column | str, fallback: str, limit: int = 256) -> Column:
    """A message without secrets, paths and internals; the fallback where it is blank or anything unsafe is left."""
    s = F.trim(F.regexp_replace(_col(c), r"[\r\n\t]+", " "))
    for pattern, by in _REDACTIONS:
        s = F.regexp_replace(s, pattern, by)
    s = F.when(s.rlike(_UNSAFE) | (F.trim(s) == "") | s.isNull(), F.lit(fallback)).otherwise(F.substring(s, 1, limit))
    return s


def length_prefixed(*columns: Column | str) -> Column:
    """Fields one after another, each as ``<UTF-8 bytes>:<value>;``; a null is an empty value."""
    parts = []
    for c in columns:
        value = F.coalesce(_col(c).cast("string"), F.lit(""))
        parts += [F.octet_length(value).cast("string"), F.lit(":"), value, F.lit(";")]
    return F.concat(*parts)


def stable_id(prefix: str, *columns: Column | str) -> Column:
    """A graph identity: the prefix and the digest of its length-prefixed parts."""
    return F.concat(F.lit(prefix), sha256(length_prefixed(*columns)))
