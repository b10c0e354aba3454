import random

import pytest

WORDS = [a + b for a in ("al", "be", "cor", "du", "en", "fi", "gra", "ho") for b in ("ta", "ri", "mo", "sel", "n", "xu")]


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for the same seed."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.8 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts every operator must stand: null, empty, blank, one word, very long, control characters, accents."""
    return [None, "", " \t\r\n\x0b\x0c ", "one", "é ü ñ", "A b\x00c  d", "x " * 60_000, "same same same same same same"]


@pytest.fixture(scope="session")
def documents(spark):
    """documents rows from (doc_id, text), with the other columns and one whose name clashes with the operators' own."""

    def make(rows):
        full = [(i, t, "en", f"s{n % 3}", None if t is None else len(t), "mine") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, hash string")

    return make
