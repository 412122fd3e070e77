"""Clip consensus by progressive multiple alignment: clips of one place are aligned one by one to a profile of those before.

Clips share their breakpoint end, so gaps there cost; where a clip simply ends earlier than others, nothing is charged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most clips of a place that are aligned: of front clips the first ones, of back clips the last.
VOTERS = {"f": 21, "b": 20}
GAP = 0
_LOW = -1e18


def profile_steps(clip: np.ndarray, counts: np.ndarray, match: float, mismatch: float, gap_open: float, gap_extend: float) -> tuple[float, list[tuple[int, int]]]:
    """The best score, and the steps (clip base or -1, column or -1), of a clip against a profile's ``counts`` (a row of 256 a column).

    A gap of k costs open + (k - 1) extend; what is left of either side at the end is free. A base scores the mean over the column's bases.
    Ties prefer a base in a column, then a skipped column.
    """
    n, m = len(clip), len(counts)
    depth = counts.sum(1)
    place = np.arange(m + 1) * gap_extend
    best, down, along = (np.full((n + 1, m + 1), _LOW) for _ in range(3))
    score = np.zeros((n, m))
    best[0, 0] = 0
    for i in range(n + 1):
        if i:
            score[i - 1] = (counts[:, clip[i - 1]] * (match + mismatch)) / depth - mismatch
            down[i] = np.maximum(down[i - 1] - gap_extend, best[i - 1] - gap_open)
            best[i] = down[i]
            best[i, 1:] = np.maximum(best[i, 1:], best[i - 1, :-1] + score[i - 1])
        along[i, 1:] = np.maximum.accumulate(best[i] + place)[:-1] - gap_open - place[:-1]
        best[i] = np.maximum(best[i], along[i])
    j = int(best[n].argmax())
    i = int(best[:, m].argmax())
    i, j = (n, j) if best[n, j] >= best[i, m] else (i, m)
    top = float(best[i, j])
    steps = [(-1, k) for k in range(m - 1, j - 1, -1)] + [(k, -1) for k in range(n - 1, i - 1, -1)]
    near = lambda a, b: abs(a - b) < 1e-6
    while i or j:
        if i and j and near(best[i, j], best[i - 1, j - 1] + score[i - 1, j - 1]):
            i, j = i - 1, j - 1
            steps.append((i, j))
        elif j and near(best[i, j], along[i, j]):
            k = next(k for k in range(1, j + 1) if near(best[i, j - k] - gap_open - (k - 1) * gap_extend, best[i, j]))
            steps += [(-1, j - x) for x in range(1, k + 1)]
            j -= k
        else:
            k = next(k for k in range(1, i + 1) if near(best[i - k, j] - gap_open - (k - 1) * gap_extend, best[i, j]))
            steps += [(i - x, -1) for x in range(1, k + 1)]
            i -= k
    return top, steps[::-1]


def aligned_rows(clips: list[bytes], match: float = 5, mismatch: float = 4, gap_open: float = 11, gap_extend: float = 1) -> np.ndarray:
    """The multiple alignment of clips anchored at their first base: a row a clip, ``GAP`` where it has none; the longest comes first."""
    order = sorted(range(len(clips)), key=lambda k: (-len(clips[k]), k))
    rows = np.frombuffer(clips[order[0]], np.uint8)[None, :]
    for k in order[1:]:
        clip = np.frombuffer(clips[k], np.uint8)
        counts = np.stack([np.bincount(column[column != GAP], minlength=256) for column in rows.T])
        _, steps = profile_steps(clip, counts, match, mismatch, gap_open, gap_extend)
        at = np.array([j for _, j in steps])
        wide = np.where(at >= 0, rows[:, np.maximum(at, 0)], GAP)
        own = np.array([clip[i] if i >= 0 else GAP for i, _ in steps], np.uint8)
        rows = np.vstack([wide, own]).astype(np.uint8)
    return rows


def consensus_of(clips: list[str], from_end: bool = False) -> tuple[str, int]:
    """The bases on which all clips with a base in a column agree, else ``N``, and how many ``N`` that made.

    No clips give ``.``, one gives itself. Clips that agree base by base need no gaps, and are not aligned. Null and empty clips do not count.
    """
    said = [c[::-1].encode() if from_end else c.encode() for c in clips if c]
    if not said:
        return ".", 0
    longest = max(said, key=len)
    if all(longest.startswith(c) for c in said):
        text, unclear = longest.decode(), 0
    else:
        columns = [set(column[column != GAP].tolist()) for column in aligned_rows(said).T]
        text, unclear = "".join(chr(c.copy().pop()) if len(c) == 1 else "N" for c in columns), sum(len(c) > 1 for c in columns)
    return (text[::-1] if from_end else text), unclear


def clip_consensus():
    """``consensus_of`` as a function of columns (clips, direction) that gives ``alt, unclear``; clips of direction ``f`` lie left of the
    breakpoint and are anchored at their last base."""

    @F.pandas_udf("struct<alt:string,unclear:int>")
    def said(clips: pd.Series, direction: pd.Series) -> pd.DataFrame:
        rows = [consensus_of(list(c) if c is not None else [], d == "f") for c, d in zip(clips, direction, strict=True)]
        return pd.DataFrame({"alt": pd.Series([t for t, _ in rows], dtype=object), "unclear": pd.Series([n for _, n in rows], dtype="int32")})

    return said


def place_consensus(clips: DataFrame, directions: DataFrame) -> DataFrame:
    """``ref_id, bp, direction, n_clips, alt, unclear``: the consensus of each place's clips in the direction that most of them have.

    ``clips`` has ``ref_id, bp, direction, bases, pos, read_name``. Of more clips than ``VOTERS`` the first by read place and name count for front
    clips, the last for back clips; Spark cuts the rest in each task before the shuffle, so a place of any depth is a few rows a task.
    """
    own = clips.join(directions.select("ref_id", "bp", "direction", F.col("n").alias("n_clips")), ["ref_id", "bp", "direction"])
    order = F.when(F.col("direction") == "f", F.col("pos")).otherwise(-F.col("pos"))
    rank = F.row_number().over(Window.partitionBy("ref_id", "bp").orderBy(order, "read_name", "bases"))
    most: Column = F.when(F.col("direction") == "f", VOTERS["f"]).otherwise(VOTERS["b"])
    few = own.withColumn("k", rank).where(F.col("k") <= max(VOTERS.values())).where(F.col("k") <= most)
    gathered = few.groupBy("ref_id", "bp", "direction", "n_clips").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "bases"))), lambda x: x["bases"]).alias("clips"))
    return gathered.withColumn("c", clip_consensus()("clips", "direction")).select("ref_id", "bp", "direction", "n_clips", "c.alt", "c.unclear")
