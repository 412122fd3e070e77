"""Clip consensus, local alignment of a consensus to a reference window, refined ends and pair-HMM likelihoods.

The consensus and the refinement are expressions; alignment and likelihood are Arrow-batched, vectorised along the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from breakwater.functions.hof import let

#: Most clips of a place that vote.
VOTERS = 21

ALIGNED = "struct<score:int,ref_begin:int,ref_end:int,query_begin:int,query_end:int,mismatches:int,deleted:int,inserted:int>"

# Fixed values of the pair HMM: log10 transition probabilities.
MATCH_MATCH, MATCH_GAP, GAP_MATCH, GAP_GAP = -2.744828e-05, -4.5, -0.04575749, -1.0


def consensus(clips: Column, from_end: bool = False) -> Column:
    """The bases on which all clips that reach a column agree, else ``N``; clips are anchored at the breakpoint, without gaps.

    No clips give ``.``, one gives itself. ``from_end`` anchors clips at their last base (clips left of a breakpoint).
    """
    said = F.slice(F.filter(F.coalesce(clips, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")), 1, VOTERS)
    if from_end:
        said = F.transform(said, F.reverse)

    def column(voters: Column):
        def of(i: Column) -> Column:
            kinds = F.array_distinct(F.filter(F.transform(voters, lambda c: F.substring(c, i, F.lit(1))), lambda b: b != ""))
            return let(kinds, "string", lambda k: F.when(F.size(k) == 1, k[0]).otherwise(F.lit("N")))

        return of

    def vote(voters: Column) -> Column:
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.array_max(F.transform(voters, F.length))), column(voters)), "")
        return F.when(F.size(voters) == 0, F.lit(".")).otherwise(F.reverse(text) if from_end else text)

    return let(said, "string", vote)


def n_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("N"), F.lit("")))


def best_ends(queries: list[np.ndarray], refs: list[np.ndarray], match: int, mismatch: int, gap_open: int, gap_extend: int) -> list[tuple[int, int, int]]:
    """(score, query end, reference end) of each pair's best local alignment: the first reference column of the highest score, in it the
    smallest query end. A gap of k costs open + (k - 1) extend. Ends are -1 if nothing matches. All pairs go through one table of rows."""
    count, rows, m = len(queries), max(map(len, queries), default=0), max(map(len, refs), default=0)
    q, r = np.zeros((count, rows), np.int16), np.full((count, m), -1, np.int16)  # what lies beyond a text matches nothing
    for k in range(count):
        q[k, : len(queries[k])], r[k, : len(refs[k])] = queries[k], refs[k]
    lengths = np.array([len(x) for x in queries], np.int64)[:, None]
    place = np.arange(m + 1, dtype=np.int64) * gap_extend
    above, vertical = np.zeros((count, m + 1), np.int64), np.full((count, m + 1), -(1 << 30), np.int64)
    top, row = np.zeros((count, m + 1), np.int64), np.full((count, m + 1), -1, np.int64)
    for i in range(rows):
        vertical = np.maximum(vertical - gap_extend, above - gap_open)
        here = np.maximum(vertical, 0)
        here[:, 0] = 0
        here[:, 1:] = np.maximum(here[:, 1:], above[:, :-1] + np.where(r == q[:, i : i + 1], match, -mismatch))
        reach = np.maximum.accumulate(here + place, axis=1)  # the best start of a gap along the reference, whatever its length
        here[:, 1:] = np.maximum(here[:, 1:], reach[:, :-1] - gap_open - place[:-1])
        better = (here > top) & (i < lengths)
        top[better], row[better] = here[better], i
        above = here
    end = np.argmax(top, axis=1)  # columns beyond a reference cost a gap or a mismatch, so none is its first best
    k = np.arange(count)
    return [(int(s), int(i), int(e) - 1) if s > 0 else (0, -1, -1) for s, i, e in zip(top[k, end], row[k, end], end, strict=True)]


def _differences(query: np.ndarray, ref: np.ndarray, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[int, int, int]:
    """(mismatched bases, deleted, inserted) of the end-to-end alignment of two spans; matches are preferred among ties."""
    n, m = len(query), len(ref)
    low = -(1 << 30)
    best, down, along = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    best[0, 0] = 0
    place = np.arange(m + 1, dtype=np.int64) * gap_extend
    for i in range(n + 1):
        if i:
            down[i] = np.maximum(down[i - 1] - gap_extend, best[i - 1] - gap_open)
            best[i] = down[i]
            best[i, 1:] = np.maximum(best[i, 1:], best[i - 1, :-1] + np.where(ref == query[i - 1], match, -mismatch))
        along[i, 1:] = np.maximum.accumulate(best[i] + place)[:-1] - gap_open - place[:-1]
        best[i] = np.maximum(best[i], along[i])
    wrong = deleted = inserted = 0
    i, j = n, m
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + (match if query[i - 1] == ref[j - 1] else -mismatch):
            wrong, i, j = wrong + int(query[i - 1] != ref[j - 1]), i - 1, j - 1
        elif j and best[i, j] == along[i, j]:
            k = next(k for k in range(1, j + 1) if best[i, j - k] - gap_open - (k - 1) * gap_extend == best[i, j])
            deleted, j = deleted + k, j - k
        else:
            k = next(k for k in range(1, i + 1) if best[i - k, j] - gap_open - (k - 1) * gap_extend == best[i, j])
            inserted, i = inserted + k, i - k
    return wrong, deleted, inserted


def align_all(queries: list[str], refs: list[str], match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1) -> list[tuple[int, ...]]:
    """Score, reference and query spans (0-based, ends included), mismatched, deleted and inserted bases of each pair's best local alignment.

    The begin is found by aligning the reversed prefixes back from the end. Empty texts, or no match at all, give score 0 and -1 places.
    """
    pairs = [tuple(np.frombuffer(x.encode(), np.uint8) for x in p) for p in zip(queries, refs, strict=True)]
    costs = match, mismatch, gap_open, gap_extend
    out: list[tuple[int, ...]] = [(0, -1, -1, -1, -1, 0, 0, 0)] * len(pairs)
    # Pairs of like sizes share a table of at most 2^18 cells a row.
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        n = max(1, (1 << 18) // (len(pairs[order[0]][1]) + 1))
        own, order = order[:n], order[n:]
        while len(own) > 1 and len(pairs[own[-1]][1]) > 2 * len(pairs[own[0]][1]) + 64:
            order.insert(0, own.pop())
        ends = dict(zip(own, best_ends([pairs[k][0] for k in own], [pairs[k][1] for k in own], *costs), strict=True))
        some = [k for k in own if ends[k][0]]
        cut = {k: (pairs[k][0][: ends[k][1] + 1], pairs[k][1][: ends[k][2] + 1]) for k in some}
        backs = best_ends([cut[k][0][::-1] for k in some], [cut[k][1][::-1] for k in some], *costs)
        for k, (_, q_back, r_back) in zip(some, backs, strict=True):
            score, q_end, r_end = ends[k]
            q_begin, r_begin = q_end - q_back, r_end - r_back
            q, r = cut[k][0][q_begin:], cut[k][1][r_begin:]
            wrong = int((q != r).sum()) if len(q) == len(r) else -1
            # An alignment without gaps that has the best score is the one that matches lead through.
            plain = wrong >= 0 and match * (len(q) - wrong) - mismatch * wrong == score
            out[k] = score, r_begin, r_end, q_begin, q_end, *((wrong, 0, 0) if plain else _differences(q, r, *costs))
    return out


def align(query: str, ref: str, match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1) -> tuple[int, ...]:
    """``align_all`` of one pair."""
    return align_all([query], [ref], match, mismatch, gap_open, gap_extend)[0]


def local_alignment(match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1):
    """A function of two string columns (query, reference window) that gives ``ALIGNED``; a null text is an empty one."""

    @F.pandas_udf(ALIGNED)
    def aligned(queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        names = [part.split(":")[0] for part in ALIGNED[7:-1].split(",")]
        rows = align_all([q or "" for q in queries], [r or "" for r in refs], match, mismatch, gap_open, gap_extend)
        return pd.DataFrame(rows, columns=names, dtype="int32")

    return aligned


def refined_end(pos: Column, end: Column, aligned: Column, flank: int = 200, most_mismatches: int = 5) -> Column:
    """``struct<end, kind, size>``: an internal deletion or insertion of the alignment against the window ``flank`` before ``pos`` names
    the end; else the end stays, without a kind."""
    few = aligned["mismatches"] < most_mismatches
    deletion = few & (aligned["deleted"] > F.greatest(aligned["inserted"], F.lit(0)))
    insertion = few & (aligned["inserted"] > F.greatest(aligned["deleted"], F.lit(0))) & (aligned["query_begin"] > 0)
    kept = F.struct(end.cast("long").alias("end"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("size"))
    moved = lambda kind, size: F.struct((pos - flank + aligned["ref_begin"]).cast("long").alias("end"), F.lit(kind).alias("kind"), size.alias("size"))
    return F.when(deletion, moved("DEL", aligned["deleted"])).when(insertion, moved("INS", aligned["inserted"])).otherwise(kept)


def pair_hmms(cases: list[tuple[str, str, str]]) -> list[float]:
    """log10 likelihoods of reads given haplotypes (haplotype, read, qualities; forward algorithm); in the closing sum matches count twice,
    as in the workflow.

    An ``N`` on either side matches anything. Minus infinity for an empty read or a haplotype shorter than the read. Reads of one length share
    a table; a column depends on those before it only, so haplotypes of other lengths do not meet.
    """
    out = [float("-inf")] * len(cases)
    order = sorted((k for k, (hap, read, _) in enumerate(cases) if read and len(hap) >= len(read)), key=lambda k: (len(cases[k][1]), len(cases[k][0])))
    while order:
        read, first = len(cases[order[0]][1]), len(cases[order[0]][0])
        n = next((i for i, k in enumerate(order[: max(1, (1 << 16) // (first + 1))]) if len(cases[k][1]) != read or len(cases[k][0]) > 2 * first + 64), max(1, (1 << 16) // (first + 1)))
        own, order = order[:n], order[n:]
        for k, value in zip(own, _likelihoods([cases[k] for k in own]), strict=True):
            out[k] = value
    return out


def _likelihoods(cases: list[tuple[str, str, str]]) -> list[float]:
    ln10 = np.log(10)
    sizes = np.array([len(h) for h, _, _ in cases])[:, None]
    width = int(sizes.max())
    hap = np.zeros((len(cases), width), np.uint8)
    for k, (h, _, _) in enumerate(cases):
        hap[k, : len(h)] = np.frombuffer(h.encode(), np.uint8)
    reads, quals = (np.array([list(c[x].encode()) for c in cases]) for x in (1, 2))
    match, insertion = (np.full((len(cases), width + 1), -np.inf) for _ in range(2))
    deletion = np.repeat(-np.log(sizes + 1), width + 1, axis=1)
    place = -np.arange(width + 1) * GAP_GAP * ln10
    a, b, c, d = (x * ln10 for x in (MATCH_MATCH, MATCH_GAP, GAP_MATCH, GAP_GAP))
    for i in range(reads.shape[1]):
        base, wrong = reads[:, i : i + 1], 10 ** (-(quals[:, i : i + 1] - 33) / 10)
        with np.errstate(divide="ignore"):
            prior = np.where((hap == base) | (hap == 78) | (base == 78), np.log(1 - wrong), np.log(wrong))
        own = np.full_like(match, -np.inf)
        own[:, 1:] = prior + np.logaddexp(match[:, :-1] + a, np.logaddexp(insertion, deletion)[:, :-1] + c)
        insertion = np.logaddexp(match + b, insertion + d)
        insertion[:, 0] = -np.inf
        deletion = np.full_like(match, -np.inf)
        deletion[:, 1:] = np.logaddexp.accumulate(own[:, :-1] + b + place[1:], axis=1) - place[1:]
        match = own
    inside = np.arange(1, width + 1) <= sizes
    ends = [np.where(inside, x[:, 1:], -np.inf) for x in (match, match, insertion, deletion)]
    return (np.logaddexp.reduce(np.concatenate(ends, axis=1), axis=1) / ln10).tolist()


def pair_hmm(haplotype: str, read: str, quals: str) -> float:
    """``pair_hmms`` of one case."""
    return pair_hmms([(haplotype, read, quals)])[0]


@F.pandas_udf(DoubleType())
def pair_likelihood(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``pair_hmm`` of columns (haplotype, read, qualities); null if one is null or the qualities are of another length."""
    for haps, reads, quals in batches:
        cases = list(zip(haps, reads, quals, strict=True))
        told = [k for k, c in enumerate(cases) if None not in c and len(c[1]) == len(c[2])]
        out = pd.Series([None] * len(cases), dtype="float64")
        out.iloc[told] = pair_hmms([cases[k] for k in told])
        yield out
