import random

import pytest

LONG = "one long line without any end " * 4000


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with exact and near copies, shared lines and passages, empty, null and very long texts."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeiounrstü") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    line = "This very LINE stands in a good many documents. " * 2
    passage = prose(60)
    texts = [prose(r.randint(1, 200)) for _ in range(40)]
    base = prose(120).split()
    for _ in range(25):  # near copies of one another, also in chains
        i = r.randrange(len(base))
        base = base[:i] + [r.choice(vocabulary)] + base[i + 1 :]
        texts.append(" ".join(base))
    texts += [texts[0], texts[1].replace(" ", "\n", 3), texts[2].upper(), texts[3] + "  "]
    texts += [f"{prose(10)}\n  {line}\t\n{prose(12)}" for _ in range(5)] + [f"{prose(9)} {passage} {prose(9)}" for _ in range(4)]
    texts += [None, "", " \n\t ", "ab" * 400, "é" * 150, "z", LONG, "a b", "\n\n\n", "same words here " * 30]
    return list(enumerate(texts, 100))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", len(t or ""), -1, "x", True, 7) for i, t in corpus]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, t string, kept boolean, row int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a repeated id with another text, and null ids."""
    rows = [(1, "the same text again and again " * 20), (1, "the same text again and again " * 20), (2, "the same text again and again " * 20), (2, "other"), (None, "other"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")
