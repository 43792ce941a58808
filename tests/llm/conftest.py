import random
import zlib

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "der die und in den von zu das mit sich des auf the of and to a is for that le la les et en un une que el los por con para ist".split()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, edge cases and repeated rows: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(7)
    rows = []
    make = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    for i in range(120):
        rows.append((i, make(rng.randint(1, 150))))
    for i in range(120, 180):  # near copies of a few
        words = rows[i % 9][1].split() or ["x"]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new%d" % rng.randint(0, 9)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "One two THREE"), (204, "one\ntwo three"), (205, make(6000)), (206, "Straße ÉTÉ naïve 日本 " * 3)]
    rows += [(k, rows[3][1]) for k in range(300, 330)] + [(3, rows[3][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
