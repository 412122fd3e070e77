"""Pileups over a stream of sorted alignments, with state evicted by place: a contig keeps only the reads that still reach its front."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``front`` and ``back``: a soft clip there; ``named_``: one that makes its place a candidate.
_READ = "pos long, end_pos long, mapq int, front boolean, back boolean, named_front boolean, named_back boolean"
COUNTS = "ref_id string, bp long, n_reads long, mapq_sum long, n_primary long"


class Piles(StatefulProcessor):
    """Counts each clip place of a contig once the stream has passed it.

    The state of a contig is the reads that end at its front or behind it; the front is the largest begin that was seen. Every place in front
    of it is complete, as later reads begin at the front or behind it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reads = handle.getListState("reads", _READ)
        self.front = handle.getValueState("front", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        front = self.front.get()[0] if self.front.exists() else -1
        names = [c.split()[0] for c in _READ.split(", ")]
        held = pd.DataFrame(list(self.reads.get()), columns=names) if self.reads.exists() else pd.DataFrame(columns=names)
        came = pd.concat(list(rows), ignore_index=True)
        closing = bool(came["pos"].isna().any())
        came = came[came["pos"].notna()][names]
        if len(came) and came["pos"].min() < front:
            raise ValueError(f"{key[0]}: a read begins at {int(came['pos'].min())}, before {front}: the stream is not sorted")
        every = pd.concat([held, came], ignore_index=True) if len(held) else came
        now = max(front, int(came["pos"].max()) if len(came) else front)
        limit = np.iinfo(np.int64).max if closing else now
        if len(every):
            yield from self._passed(key[0], every, front, limit)
        left = every[every["end_pos"] >= limit]
        if len(left):
            self.reads.put([tuple(r) for r in left.astype(object).itertuples(index=False)])
        else:
            self.reads.clear()
        if closing:
            self.front.clear()
        else:
            self.front.update((now,))

    @staticmethod
    def _passed(contig, every: pd.DataFrame, front: int, limit: int) -> Iterator[pd.DataFrame]:
        pos, end, mapq = (every[c].to_numpy(np.int64) for c in ("pos", "end_pos", "mapq"))
        chosen = lambda kind: np.concatenate([x[every[f"{kind}{c}"].to_numpy(bool)] for x, c in ((pos, "front"), (end, "back"))])
        named, clips = chosen("named_"), np.sort(chosen(""))
        places = np.unique(named[(named >= front) & (named < limit)])
        if not len(places):
            return
        begins, ends = np.argsort(pos, kind="stable"), np.argsort(end, kind="stable")
        upto, gone = np.searchsorted(pos[begins], places, "right"), np.searchsorted(end[ends], places, "left")
        sums = lambda order: np.concatenate([[0], np.cumsum(mapq[order])])
        yield pd.DataFrame({"ref_id": contig, "bp": places, "n_reads": upto - gone, "mapq_sum": sums(begins)[upto] - sums(ends)[gone], "n_primary": np.searchsorted(clips, places, "right") - np.searchsorted(clips, places, "left")})

    def close(self) -> None:
        pass


def stream_piles(reads: DataFrame, least_clip: int = 9, quality: int = 15) -> DataFrame:
    """``ref_id, bp, n_reads, mapq_sum, n_primary`` of each place that a soft clip of more than ``least_clip`` bases of a read above
    ``quality`` names, as ``pileup_counts`` has them, as soon as the stream has passed the place.

    ``reads`` are primary, parsed (``with_cigar``) and sorted by place within each contig; a read that begins before its contig's front is an
    error. A row without ``pos`` closes its contig, which gives its last places. Needs a state store on disk (RocksDB).
    """
    soft = lambda end: F.coalesce(F.col(end) == "S", F.lit(False))
    named = lambda end: (soft(end) & F.coalesce((F.col(f"{end}_len") > least_clip) & (F.col("mapq") > quality), F.lit(False))).alias(f"named_{end}")
    rows = reads.select(F.col("ref_id").cast("string").alias("ref_id"), "pos", "end_pos", F.col("mapq").cast("int").alias("mapq"), soft("front").alias("front"), soft("back").alias("back"), named("front"), named("back"))
    return rows.groupBy("ref_id").transformWithStateInPandas(Piles(), COUNTS, "append", "none")
