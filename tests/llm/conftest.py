import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from ticklake.session import get_spark
    return get_spark(cpus="*", shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from texts (ids from 0), or from (id, text) pairs."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return make


def words(rng: random.Random, n: int, vocab: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def edited(rng: random.Random, base: list[str], share: float) -> list[str]:
    return [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in base]
