"""Near copies whose sets are so large that counts per bin no longer fit a byte."""

import numpy as np

from logwarden.llm import jaccard_join
from tests.llm.cases import documents


def test_very_long_near_copies(spark):
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in draw.integers(0, 3000, 30_000)]
    rows = []
    for d in range(3):  # 300 of 30 000 words changed: 1 500 of 30 000 shingles
        own = list(base)
        for k in draw.integers(0, 30_000, 300):
            own[k] = f"x{d}"
        rows.append((d, " ".join(own), "en", "a"))
    rows.append((3, " ".join(base[:15_000]), "en", "a"))  # half of it isn't similar enough
    rows += [(10 + d, " ".join(f"v{k}" for k in draw.integers(0, 3000, 12_000)), "en", "a") for d in range(2)]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 10: 10, 11: 11}
