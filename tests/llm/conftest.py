from __future__ import annotations

import random

import pytest
from llm_cases import SCHEMA, WORDS, make

@pytest.fixture(scope="session")
def mess(spark):
    """Nulls, empty and blank texts, a very long one, repeats, ties, and columns whose names the operators use inside."""
    r = random.Random(3)
    long_ = " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(20_000))
    texts = [None, "", " \n\t ", "one", "two words", long_, long_, "three little words", "three little words", "a" * 5000, "é\x00\x0b\x0cñ \x1c z"]
    rows = [(*row, 1, "k", [1]) for row in make(texts)]
    rows += [rows[7], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"{SCHEMA}, n int, k string, hits array<int>").repartition(3)
