import random

import pytest

ODD = [
    (1, "alpha beta gamma delta epsilon " * 30, "en"),
    (2, "alpha beta gamma delta epsilon " * 30, "en"),
    (2, "alpha beta gamma delta epsilon " * 30, "en"),  # a repeated row
    (3, "", "en"),
    (4, None, None),
    (None, "text without an id " * 20, "en"),
    (5, " \t\n ", None),
    (6, "short text", "en"),
    (7, "été île über straße 12 kg %% ½ İ \x00\x1c ", "fr"),
    (8, "lang " * 40_000, "en"),  # very long
    (9, "x" * 50_000, None),
]


@pytest.fixture()
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like inner ones."""
    rows = [(i, t, g, None, "a", 1.5) for i, t, g in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, row string, score double").repartition(3)


@pytest.fixture()
def nothing(odd):
    return odd.limit(0)


def prose(seed: int, n: int, copies: int = 0) -> list[str]:
    """Random texts with shared passages, near copies and exact copies."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    texts = []
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 160))]
        if r.random() < 0.3:
            words[r.randint(0, len(words)) :] = passage[r.randint(0, 10) :]
        texts.append(" ".join(w.title() if r.random() < 0.1 else w for w in words))
    base = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += texts[:5]
    r.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def corpus(spark):
    rows = list(enumerate(prose(3, 150, 60)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
