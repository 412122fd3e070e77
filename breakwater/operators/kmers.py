"""Summaries of a text's runs of k characters, Arrow-batched: one vectorised pass a text, nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Two bits a base: A 0, T 1, G 2, C 3, others 0.
CODES = np.zeros(256, np.int64)
CODES[np.frombuffer(b"TGC", np.uint8)] = 1, 2, 3


def fours(text: str) -> np.ndarray:
    """A number for each run of four characters, in order; equal runs have equal numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 4:
        return np.zeros(0, np.uint64)
    bits = 8 if (top := int(c.max())) < 1 << 8 else 16
    if top < 1 << 16:
        c = c.astype(np.uint32 if bits == 8 else np.uint64)
        return c[:-3] << (3 * bits) | c[1:-2] << (2 * bits) | c[2:-1] << bits | c[3:]
    pairs = np.unique(c[:-1].astype(np.uint64) << np.uint64(32) | c[1:], return_inverse=True)[1].astype(np.uint64)
    return pairs[:-2] << np.uint64(32) | pairs[2:]


def entropy(text: str | None) -> tuple[int | None, float | None]:
    runs = np.sort(fours(text or "")[:-1])
    if not len(runs):
        return None, None
    n = np.diff(np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]])))
    many = n[n > 1].astype(np.float64)
    # sum p ln(1 / p) over the counts alone: ln t - (sum n ln n) / t
    return len(n), float(np.log(len(runs)) - (many * np.log(many)).sum() / len(runs))


def four_entropy():
    """A function of a text column: how many kinds of runs of four characters a text has and their entropy (natural logarithm), the last
    run not counted (a known quirk); nulls without a run."""

    @F.pandas_udf("struct<kinds:bigint,entropy:double>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([entropy(t) for t in texts], columns=["kinds", "entropy"])
        return out.astype({"kinds": "Int64", "entropy": "float64"})

    return counted


def packed(text: str | None, k: int) -> np.ndarray:
    """Every run of ``k`` bases as a number, two bits a base, the first base highest (see ``scalar.pack_kmer``)."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    codes = CODES[b[(b & 0xC0) != 0x80]]  # one code a character, however many bytes it has
    n = max(len(codes) - k + 1, 0)
    return sum((codes[j : j + n] << 2 * (k - 1 - j) for j in range(k)), np.zeros(n, np.int64))


def packed_range(k: int):
    """A function of a text column that gives the number, least, greatest and sum of its ``packed`` runs; without runs ``n`` is 0."""

    @F.pandas_udf("struct<n:bigint,low:bigint,high:bigint,total:bigint>")
    def ranged(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(v), int(v.min()), int(v.max()), int(v.sum())) if len(v) else (0, 0, 0, 0) for v in (packed(t, k) for t in texts)]
        return pd.DataFrame(rows, columns=["n", "low", "high", "total"], dtype="int64")

    return ranged
