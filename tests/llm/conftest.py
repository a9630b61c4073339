import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that may break things: nulls, blanks, copies, repeated rows, long texts, clashing columns."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(30_000))
    texts = [None, "", "  \n\t", "one", "two words", long, long, long + " end", "same text here", "same text here", "é\x00 \U0001f600 x"]
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "c", 1.5, 2) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id", "fr", "s1", 5, "c", 1.5, 2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, size int"
    more = ", copies int, taken int, spans int, items int, n_words int, _key int, _size int, stats int, k1 int, cuts int, id int"
    return spark.createDataFrame([(*r, *range(11)) for r in rows], names + more).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
