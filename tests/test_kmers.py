"""Runs of characters in one vectorised pass against plain Python."""

import math
from collections import Counter

import pytest

from breakwater.operators import kmers as N

TEXTS = ["", "abcd", "abcde", "abababababab", "ACGTNNACGTTTGCA", "häß\n日本語日本語日本x", "\U0001f600a\U0001f600b" * 5, "a" * 400, None]


def test_kmers(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("k", N.four_entropy()("t").alias("e"), N.packed_range(6)("t").alias("p")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.k] or ""
        n = Counter(text[i : i + 4] for i in range(len(text) - 4))
        assert r.e.kinds == (len(n) or None)
        if n:
            assert r.e.entropy == pytest.approx(-sum(x / n.total() * math.log(x / n.total()) for x in n.values()), abs=1e-12)
        v = [sum("ATGC".find(c) % 4 * (c in "ATGC") * 4 ** (5 - j) for j, c in enumerate(text[i : i + 6])) for i in range(len(text) - 5)]
        assert (r.p.n, r.p.low, r.p.high, r.p.total) == ((len(v), min(v), max(v), sum(v)) if v else (0, 0, 0, 0))
