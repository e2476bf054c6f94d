import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table and one whose name clashes."""

    def docs(rows, partitions=2):
        full = [(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows]
        frame = spark.createDataFrame(full, DOCUMENTS + ", n bigint, key string")
        return frame.repartition(partitions) if rows else frame

    return docs


@pytest.fixture(scope="session")
def prose():
    """Invented prose without repeats: words from a seeded generator."""
    import random

    def text(seed, n):
        rng = random.Random(seed)
        parts = ["the", "of", "and", "tion", "er", "an", "re", "on", "es", "st", "en", "at", "to", "nt", "ha", "nd"]
        words = [
            rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
            for _ in range(n)
        ]
        return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))

    return text
