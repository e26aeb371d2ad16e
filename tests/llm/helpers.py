"""Small fixtures for the operators of the training-data subpackage."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, bucket int, anchor long"


def rows_of(docs):
    """Rows of DOC_SCHEMA from (doc_id, text): the extra columns have names that operators use inside."""
    return [(i, t, None if k % 3 else "en", None if k % 4 else "a", None, "x", None, 1, 2) for k, (i, t) in enumerate(docs)]


def frame(spark, docs):
    return spark.createDataFrame(rows_of(docs), DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(words))


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "Füße, 全文搜尋 café 🙂"), (7, "a b c\x0bd"), (8, LONG), (9, LONG + " end"),
    (10, "same words here again"), (11, "same words here again"), (12, "same words here again"), (12, "same words here again"), (None, "same words here again"), (None, None), (13, "x" * 50_000),
]
