"""Faster ways of the differences give the same as the plain ones."""

import difflib
import random

import numpy as np

from quillspan.operators import diff as D


def test_same_blocks_as_the_library():
    rng = random.Random(2)
    for k in range(600):
        a, b = (["abcdef "[rng.randrange(2 + k % 6)] for _ in range(rng.randrange(40))] for _ in range(2))
        b = a[: k % 9] + b if k % 3 else b
        assert D.Matcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_same_cuts_by_strings_of_bits(monkeypatch):
    rng = random.Random(3)
    for k in range(600):
        a, b, c = (["abcdefgh"[rng.randrange(1 + k % 8)] for _ in range(rng.randrange(1, 30))] for _ in range(3))
        assert D._cut(a, b, c) == int(np.argmax(D._reached(a, b) + D._reached(a[::-1], c[::-1])[::-1]))


def test_ratios_of_all_at_once():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ({k: "".join(rng.choice("abc") for _ in range(rng.randrange(12))) for k in range(rng.randrange(6))} for _ in range(2))
        want = [(D.ratio(a[i], b[j]), i, j) for i in a for j in b if b[j] and min(len(a[i]), len(b[j])) >= 0.4 * max(len(a[i]), len(b[j]))]
        assert sorted(D.close_pairs(a, b, 0.4)) == sorted(want)
