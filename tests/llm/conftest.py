import random

import pytest


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """doc_id -> text: prose with copies, near copies, shared passages, runs, empties and a null."""
    rng = random.Random(7)
    words = ["".join(rng.choice(["the", "on", "er", "ing", "ha", "ée", "ö"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts = {i: prose(rng, rng.randint(5, 260), words) for i in range(60)}
    passage = prose(rng, 70, words)
    for i in range(60, 72):
        texts[i] = prose(rng, rng.randint(0, 60), words) + " " + passage + " " + prose(rng, rng.randint(0, 60), words)
    for i in range(72, 80):
        texts[i] = texts[i - 72]
    for i in range(80, 92):
        w = texts[5].split() + texts[6].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    texts |= {92: "", 93: None, 94: "a", 95: "Ha " * 300, 96: "Ha " * 280, 97: "x" * 400, 98: "\n\t " * 50, 99: " ".join(f"w{i % 60}" for i in range(400))}
    return texts


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with a clashing extra column."""
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, i) for i, t in corpus.items()], "doc_id long, text string, source string, body long").repartition(5)
