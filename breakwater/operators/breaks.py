"""Natural breaks: the classes of one-dimensional values with the least sum of squared deviations from their means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_classes(values: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """Where each class begins in ``values`` (different, rising), exactly: dynamic programming over sums of counts.

    The best last border only moves up with the end of the range, so each class takes n log n steps. Ties take the lower border.
    """
    centre = values - np.average(values, weights=counts)
    n, s, q = (np.concatenate([[0.0], np.cumsum(counts * centre**k)]) for k in range(3))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Of the class of values i to j - 1."""
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (n[j] - n[i]), 0)

    size = len(values)
    classes = min(classes, size)
    best = np.array([0.0, *(cost(np.array([0]), j)[0] for j in range(1, size + 1))])
    froms = []
    for k in range(2, classes + 1):
        now, start = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        todo = [(k, size, k - 1, size - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            at = np.arange(first, min(last, j - 1) + 1)
            total = best[at] + cost(at, j)
            start[j] = at[total.argmin()]
            now[j] = total.min()
            todo += [(low, j - 1, first, start[j]), (j + 1, high, start[j], last)]
        best = now
        froms.append(start)
    begins, j = [], size
    for start in reversed(froms):
        j = int(start[j])
        begins.append(j)
    return np.array([0, *reversed(begins)])


def natural_breaks(rows: DataFrame, by: list[str], value: str, classes: int, most: int = 1 << 20) -> DataFrame:
    """``by, class`` (from 1), ``low, high, n, deviation`` (the sum of squares) of the best ``classes`` of ``value`` in each group.

    Values are counted first, so a group costs its different values (at most ``most``, beyond which it is an error), not its rows. Groups of
    fewer different values have as many classes. Nulls and NaN do not count. Ranges of values, not rows, go through one task.
    """
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    kinds = dict(rows.dtypes)

    def classed(own: pd.DataFrame) -> pd.DataFrame:
        if len(own) > most:
            raise ValueError(f"a group has over {most} different values")
        own = own.sort_values("__v")
        v, n = own["__v"].to_numpy(float), own["__n"].to_numpy(float)
        begins = best_classes(v, n, classes)
        ends = [*begins[1:], len(v)]
        out = [(v[a], v[b - 1], int(n[a:b].sum()), float((n[a:b] * (v[a:b] - np.average(v[a:b], weights=n[a:b])) ** 2).sum())) for a, b in zip(begins, ends, strict=True)]
        found = pd.DataFrame(out, columns=["low", "high", "n", "deviation"])
        for c in by:
            found[c] = own[c].iloc[0]
        found["class"] = np.arange(1, len(found) + 1, dtype="int32")
        return found[[*by, "class", "low", "high", "n", "deviation"]]

    return counted.groupBy(*by).applyInPandas(classed, ", ".join([*(f"{c} {kinds[c]}" for c in by), "class int, low double, high double, n long, deviation double"]))
