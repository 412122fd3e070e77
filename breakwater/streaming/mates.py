"""Mate pairing and breakpoint counts over streams of alignments, with state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_mate_pairs(reads: DataFrame, time: str = "ts", delay: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """``sample, read_name, r1, r2`` of mates that arrive within ``apart`` of each other, as soon as the second one does.

    Both sides carry a watermark, so a read without a mate leaves the state once ``delay`` and ``apart`` have passed.
    """
    kept = reads.where(F.col(time).isNotNull()).withWatermark(time, delay)
    first, second = (kept.where((F.col("flag").bitwiseAND(F.lit(bit)) != 0) & (F.col("flag").bitwiseAND(F.lit(0x900)) == 0)) for bit in (0x40, 0x80))
    a = first.select("sample", "read_name", F.col(time).alias("__t1"), F.struct("ref_id", "pos", "mapq", "flag", "cigar").alias("r1"))
    b = second.select(F.col("sample").alias("__s"), F.col("read_name").alias("__n"), F.col(time).alias("__t2"), F.struct("ref_id", "pos", "mapq", "flag", "cigar").alias("r2"))
    near = F.expr(f"sample = __s AND read_name = __n AND __t2 >= __t1 - INTERVAL {apart} AND __t2 <= __t1 + INTERVAL {apart}")
    return a.join(b, near).select("sample", "read_name", "r1", "r2")


def stream_clip_counts(reads: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "10 minutes", least: int = 10) -> DataFrame:
    """``start, ref_id, bp, n``: reads whose first or last operation is a soft clip of ``least`` bases or more, by place and window."""
    from breakwater.operators.reads import with_cigar

    parsed = with_cigar(reads.withWatermark(time, delay))
    front = F.when((F.col("front") == "S") & (F.col("front_len") >= least), F.col("pos"))
    back = F.when((F.col("back") == "S") & (F.col("back_len") >= least), F.col("end_pos"))
    placed = parsed.select(time, "ref_id", F.explode(F.array_compact(F.array(front, back))).alias("bp"))
    return placed.groupBy(F.window(time, window).alias("w"), "ref_id", "bp").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "ref_id", "bp", "n")
