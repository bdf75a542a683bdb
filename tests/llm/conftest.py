import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside, as extra columns
EXTRA = ("size", "score", "predicted", "weight", "toxic", "copies", "block", "key", "anchor", "low", "_id", "_hash",
         "_words", "_keep", "spans", "label", "cluster", "fingerprint", "held_out", "a", "b", "c0", "c1")


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


def make_docs(seed=3, n=60):
    """Rows with copies, near copies, shared passages, odd texts, nulls and ties."""
    rng = random.Random(seed)
    passage, line = words(rng, 60, 5000), words(rng, 14, 5000)
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([3, 8, 30, 120, 400]))
        if i % 5 == 0:
            w[len(w) // 2:len(w) // 2] = passage
        if i % 4 == 0:
            w += line
        if i % 6 == 5 and rows:
            w = rows[-1][1].split()
            if i % 12 == 11:
                w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), rng.choice(["en", "de"]), f"src{i % 4}"])
    big = words(rng, 6000, 100000)
    rows += [[n, " ".join(big), "en", "src0"], [n + 1, "\n".join(big) + "\n", "en", None],
             [n + 2, None, None, "src1"], [n + 3, "", "en", "src1"], [n + 4, " \n\t ", "de", None],
             [n + 5, "Ünïcödé Wörter — 日本語 ﬁ é <|endoftext|> a b", None, "ß"],
             [n + 6, "one", "en", "src2"], [n + 6, "one", "en", "src2"], [n + 7, "x " * 300, "en", "src3"]]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), COLUMNS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The same with a null id, nulls everywhere, and clashing extra columns."""
    from pyspark.sql import functions as F

    rows = make_docs() + [(None, "a row without an id " * 9, "en", "src0", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.select(*df.columns, *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
