from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, g int, fp long, batch string, cell int, node string, block int, start_token string, v string, kept_doc_id string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents frame from (id, text[, lang]) rows, with columns whose names the operators use inside."""

    def run(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), "x", 1, 2, "b", 3, "n", 4, "s", "v", "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return run


@pytest.fixture(scope="session")
def prose(words):
    def run(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return run
