"""Merging of near calls over a stream of sorted calls: each contig holds its open cluster's sums only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SUMS = "svtype string, n long, five string, three string, five_squares string, three_squares string, support long, ids array<string>"
MERGED = "seqid string, svtype string, five long, three long, ci_five long, ci_three long, support long, collapsed long, ids string"


def _half(n: int, total: int, squares: int) -> int:
    """Two deviations up, 10 at least, from whole sums (of integers of any size)."""
    return max(10, math.ceil(2 * math.sqrt((n * squares - total * total) / (n * (n - 1))))) if n > 1 else 10


class Clusters(StatefulProcessor):
    """Joins a call to the open cluster if both ends are less than ``gap`` beyond those of the call before; else the cluster is complete.

    The state is a row of sums for each type in the open cluster, and the last call's ends. Sums are texts, as squares of places may pass 63 bits.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getListState("sums", _SUMS)
        self.last = handle.getValueState("last", "five long, three long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        last = (last[0], last[1]) if last else None
        sums = {r[0]: [r[1], *map(int, r[2:6]), r[6], set(r[7])] for r in self.sums.get()} if self.sums.exists() else {}
        came = pd.concat(list(rows), ignore_index=True)
        closing, done = bool(came["five"].isna().any()), []
        for five, three, svtype, name, support in came[came["five"].notna()].sort_values(["five", "three", "svtype", "id"], kind="stable")[["five", "three", "svtype", "id", "support"]].itertuples(index=False):
            five, three = int(five), int(three)
            if last and five < last[0]:
                raise ValueError(f"{key[0]}: a call at {five} comes after one at {last[0]}: the stream is not sorted")
            if last and not (five - last[0] < self.gap and three - last[1] < self.gap):
                done += self._merged(key[0], sums)
                sums = {}
            own = sums.setdefault(svtype, [0, 0, 0, 0, 0, 0, set()])
            for k, x in enumerate((1, five, three, five * five, three * three, int(support))):
                own[k] += x
            own[6].add(str(name))
            last = (five, three)
        if closing:
            done += self._merged(key[0], sums)
            self.sums.clear()
            self.last.clear()
        else:
            self.sums.put([(t, s[0], *map(str, s[1:5]), s[5], sorted(s[6])) for t, s in sums.items()])
            if last:
                self.last.update(last)
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in MERGED.split(", ")])

    @staticmethod
    def _merged(contig: str, sums: dict) -> list[tuple]:
        mean = lambda total, n: math.ceil(Fraction(total, n) - Fraction(1, 2))  # noqa: E731  halves go down
        return [(contig, t, mean(five, n), mean(three, n), _half(n, five, five2), _half(n, three, three2), support, n, ",".join(sorted(ids))) for t, (n, five, three, five2, three2, support, ids) in sums.items()]

    def close(self) -> None:
        pass


def stream_merge_calls(calls: DataFrame, gap: int = 5) -> DataFrame:
    """What ``merge_calls`` gives, cluster by cluster as the stream passes them; ``ids`` are in text order.

    ``calls`` (``seqid, five, three, svtype, id, support``) are sorted by place within each contig from one micro-batch to the next; a call before the
    contig's last one is an error. A row without ``five`` closes its contig. Needs a state store on disk (RocksDB).
    """
    rows = calls.selectExpr("cast(seqid as string) as seqid", "cast(five as long) as five", "cast(three as long) as three", "svtype", "cast(id as string) as id", "cast(support as long) as support")
    return rows.groupBy("seqid").transformWithStateInPandas(Clusters(gap), MERGED, "append", "none")
