import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use for columns of their own.
CLASHING = ("id", "row", "h", "first", "n", "class", "rep", "component", "sketch", "rank", "bucket", "length", "gone",
            "pii_text", "pii_spans", "kept", "n_lines", "score", "part", "tail", "kind", "seq", "op", "tokens")


def story(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "or", "in", "ti", "on", "éa", "st", "über", "lo"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str]:
    """Documents with copies, near copies, shared lines and passages, and odd ones."""
    rng = random.Random(11)
    base = [story(rng, rng.randint(20, 120)) for _ in range(30)]
    passage = story(rng, 60)
    out = {}
    for i, text in enumerate(base):
        own = text.split(" ")
        out[10 * i] = text
        if i % 3 == 0:
            out[10 * i + 1] = text
        if i % 4 == 0:
            for j in range(2, 6):
                near = own[:]
                near[rng.randrange(len(near))] = f"new{j}"
                out[10 * i + j] = " ".join(near)
        if i % 5 == 0:
            out[10 * i + 6] = f"{passage} {text[: len(text) // 2]}\nA shared line of text\n  a SHARED line of text \nshort\n"
    out |= {
        1000: "", 1001: "   \n\t ", 1002: "one", 1003: "ONE", 1004: "one two three four", 1005: "\n\n\n",
        1006: "x" * 30_000, 1007: "ab " * 20_000, 1008: passage * 40, 1009: "你好，世界 " * 50, 1010: "1 2 3 4",
        1011: "mail a.b@c.de or joe@x-y.org.uk, ip 1.2.3.4 and 999.1.1.1, card 4111 1111 1111 1111, +1 (365) 555-2387",
        1012: "+49 30 1234567 x+@y.z 0.0.0.0.1.2.3.4 " + "9" * 5000 + " a@b" + ".c" * 300,
    }
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows and ids, and columns whose names clash."""
    same = "the same words come again and again in this one document of ours"
    rows = [
        (1, same, "en", "a", 3), (1, same, "en", "a", 3), (2, same, None, None, None), (2, "two texts of one id only here", "en", "b", 1),
        (None, same, "en", "a", 3), (None, None, None, None, None), (5, None, "fr", "a", 0), (6, "", "fr", "a", 0),
        (7, "une ligne\nune autre ligne ici\n", "fr", "a", 9), (8, "une autre ligne ici", "fr", None, 9),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
