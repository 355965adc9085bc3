"""Rows that every operator must take."""

import random

WORDS = "the of and stone river green paper light seven house night water moves under bright signal".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source): nulls, blanks, repeats, ties, a long text, odd characters."""
    same = text(1, 40)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "b"), (4, "one", "en", "a"), (5, "four words are few", "en", "b"),
        (6, same, "en", "a"), (6, same, "en", "a"), (7, same, "de", "c"), (7, text(2, 30), "de", "c"), (8, same + " end", "en", None),
        (None, same, "en", "a"), (None, text(3, 25), None, None), (9, text(4, 20_000), "en", "b"), (10, "x" * 5000, "en", "a"),
        (11, "ÀÉ 漢字 ▁   😀 <s> \x00 é", "fr", "ß"), (12, "THE the The tHE " * 30, "en", "b"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHING = ["row", "size", "node", "key", "mark", "shard", "slot", "copies", "rate", "target", "n", "part", "unit", "run", "cell", "score", "list", "row_mark", "words", "n_chars"]


def documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def widened(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
