"""Operators of sequences against brute force."""

import itertools
import random

from quillspan.operators import sequences as S


def test_similar_sets_in_blocks(spark, monkeypatch):
    """Equal sets are compared once, and their owners paired block by block."""
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = random.Random(1)
    kinds = [frozenset(rng.sample(range(12), rng.randint(8, 12))) for _ in range(9)]
    held = {k: kinds[rng.randrange(9)] for k in range(60)} | {99: frozenset([50])}
    got = S.similar_sets(spark.createDataFrame([(k, str(p)) for k, x in held.items() for p in x], "k int, p string"), "k", "p", 75).collect()
    want = [(a, b, len(held[a]), len(held[b])) for a, b in itertools.combinations(sorted(held), 2) if 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])]
    assert sorted(map(tuple, got)) == want
