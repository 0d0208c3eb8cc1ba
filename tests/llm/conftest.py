import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text): copies, near copies, shared passages, periodic text, odd white space."""
    rng = random.Random(9)
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = draw(70), draw(150)
    out = []
    for k in range(30):
        out.append(" ".join(draw(rng.randint(1, 120))))
    for k in range(8):
        out.append(" ".join(draw(rng.randint(0, 30)) + passage + draw(rng.randint(0, 30))))
    for k in range(12):
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(len(near))] = "edit" + str(k)
        out.append(("\n" if k % 3 == 0 else " ").join(near))
    out += ["the " * 300, "ab " * 200 + "x", " ".join(base), "", " \n\t ", "é ü " * 80, "one", "one", "a\x0bb\x0cc\rd", "x" * 350, "x" * 99]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="session")
def odd(spark, words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, None, None, None), (3, "", "de", "b"), (None, "no id here at all", "en", "a"), (None, None, None, None), (4, long, "en", "b"), (5, long, "fr", None), (6, " \n ", "en", "c"), (7, "%%% $$$ 123", "en", "c"), (8, "alpha beta gamma delta epsilon zeta", "fr", "a"), (9, "l'été est là et la mer aussi", "fr", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("g", "row", "of", "size", "digest", "bucket", "cell", "shuffle", "label", "side", "a", "start", "of_doc", "of_times", "item", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df
