"""Documents with all that an operator has to stand: nulls, empty and long texts, repeated rows, clashing names."""

import random

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
CLASHING = ["id", "key", "ID", "size", "unit", "score", "label", "h", "words", "a", "slot", "gone_id", "n_tokens", "text_"]

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def awkward():
    base = prose(120, 1)
    long = prose(30_000, 2)
    return [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.replace("a", "a", 1) + " tail", None), (4, None, None), (5, "", "en"), (6, "  \n\t ", "de"),
        (7, "one", "en"), (8, "one", "de"), (9, long, "en"), (10, prose(80, 3) + " " + base, "fr"), (11, "é你😀 <s> ▁ " * 30, "fr"), (None, base, "en"), (12, "x" * 3000, None), (13, prose(200, 4), "de"), (14, "1234 !!", "en"),
    ]


def docs(spark, rows=None):
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({f"{c}": F.lit(7) for c in CLASHING if c.lower() != "id"} | {"Id": F.lit("x")})


def empty(spark):
    return docs(spark).filter("false")


def thue_morse(n, a="a", t="t"):
    """A word of n letters, and its complement: they collide in any polynomial hash modulo a power of 2."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, t)[b] for b in bits), "".join((t, a)[b] for b in bits)
