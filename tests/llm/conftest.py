from __future__ import annotations

import random

import pytest

WORDS = "the of and to stone river light idiot trash runs over under green seven harbour window paper signal".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents():
    """Rows (doc_id, text): nulls, empty and blank texts, a very long one, copies, near copies, repeated rows and ids."""
    rng = random.Random(3)
    base = prose(rng, 80)
    words = base.split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    rows = [(None, base), (None, None), (1, None), (2, ""), (3, "  \n "), (4, base), (5, base), (6, near), (6, near), (7, "one"), (8, "One"), (9, "x" * 60_000), (10, prose(rng, 6000)), (11, "ünï 𝒳 çode\ttab")]
    return rows + [(100 + k, prose(rng, rng.randrange(1, 120))) for k in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_documents):
    """The same with extra columns whose names clash with internal ones."""
    rows = [(i, t, k, "s") for k, (i, t) in enumerate(odd_documents)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, sha string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
