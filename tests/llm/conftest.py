import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _size long, key string, k long, mix_size string, Mix_Key long, _sha long, dedup_keep string, _score double, quality_score string, _copies long"


def row(doc_id, text, source="a"):
    """A document with extra columns whose names clash with inner ones."""
    return (doc_id, text, "en", source, len(text or ""), 7, "x", 1, *CLASHING)


#: Values of the columns whose names clash with inner ones; every operator hands them on.
CLASHING = ("s", 8, 9, "k", 0.25, "q", 10)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "ß", "日本", "🙂x"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))
    shared = prose(30)
    long = prose(30_000)
    rows = [row(1, None), row(2, ""), row(3, "   \n\t"), row(4, "x"), row(5, long), row(6, long), row(7, long + " tail"), row(8, "a" * 5000), row(9, "a" * 5000 + "b")]
    rows += [row(10 + i, prose(20 + i) + " " + shared + " " + prose(10), "b" if i % 3 else None) for i in range(30)]
    rows += [row(40, prose(50), None), row(40, prose(50), "c"), row(41, "same row"), row(41, "same row"), row(42, "same row"), row(None, "no id"), row(None, "no id"), row(-3, "no id")]
    rows += [row(100 + i, "hot copy of one text that many documents have in full, word for word, all of it") for i in range(40)]
    return rows


@pytest.fixture
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
