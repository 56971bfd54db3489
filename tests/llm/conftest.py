import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, base string, name string, size long, rank long, text_sha256 string, __id long, __s string, __sha string, __text string, other long, th string, spans string, c0 string"
LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(30_000)) + "."


def table(spark, rows):
    """Rows (id, text) as a table with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "b", "n", 1, 2, "s", 3, "a", "b", "c", 4, "d", "e", "f") for i, t in rows], SHAPE)


def odd_rows():
    rng = random.Random(3)
    words = [w for w in "the of and to in that it was for on are as with his they at be this from have or by one had not but".split()]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n)) + "." for n in (40, 60, 80, 100)]
    return [(1, None), (2, ""), (3, " \t\n"), (4, texts[0]), (5, texts[0]), (6, texts[0] + " x"), (7, texts[1]), (7, texts[1]), (7, texts[2]), (None, texts[3]), (None, None), (8, LONG), (9, LONG), (10, "Ünïcode 𝔘 text é"), (11, "one two")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated ids and rows."""
    rows = odd_rows()
    return rows, table(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [(1, "x")]).limit(0)
