import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, score string, ids int, n int, kept string, `key` string, component_id int, epoch string, _done int, _l0 string"
EXTRA = (7, "x", "own", 3, 4, "own", "k", 5, "e", 6, "l")


def sentence(rng, n, words="lorem ipsum dolor sit amet elit sed tempor magna aliqua enim minim quis nisi".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "um", "is"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def prose():
    """Texts with repeats: (id, text) of several kinds."""
    rng = random.Random(3)
    shared = [sentence(rng, 40) for _ in range(3)]
    texts = [sentence(rng, rng.randint(5, 120)) for _ in range(40)]
    texts += [sentence(rng, 20) + "\n" + shared[i % 3] + "\n" + sentence(rng, 20) for i in range(9)]
    for i in range(6):  # near copies
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "The the the " * 60, "é" * 30 + "ß" * 30, "é" * 30 + "ß" * 30 + "x"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Every awkward row at once, among columns named like the operators' own."""
    long = "word " * 30000 + "end"
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}") for i, t in prose]
    rows += [
        (100, None, "en", "src1"), (101, "", "de", None), (102, " \t\n ", None, None), (103, long, "en", "src1"),
        (104, long, "en", "src2"), (105, "one two", "fr", "src9"), (105, "one two", "fr", "src9"),
        (None, "a row without an id that has some words in it", "fr", "src9"), (None, None, None, None), (None, "", "en", "src1"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
