"""Even shares of rows: joins on keys some of which are hot, and inputs of fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], count: str, share: int = 1000, parts: int = 64) -> DataFrame:
    """``rows`` with what ``values`` says of their ``keys``: it has each key once and counts its rows in ``count`` (left out of the result).

    Keys of more than one in ``share`` of all rows are fewer than ``share``, so a broadcast marks their rows, which are dealt over
    ``parts`` by a hash of the row; their values go to every part. ``values`` is read three times, so it should be a written table.
    """
    total = values.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) > total / share
    marked = rows.join(F.broadcast(values.where(often).select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    dealt = marked.withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(parts)).cast("int")).otherwise(0)).drop("__hot")
    copies = F.when(often, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(values.withColumn("__part", F.explode(copies)).drop(count), [*keys, "__part"]).drop("__part")


def broadcast_small(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``rows``, to be broadcast if they are ``most`` at most, which is counted up to there and no further.

    Beyond that they are joined by a shuffle, in which Spark splits the other side's hot keys. For lists that are read and not worked out.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def for_all_cores(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it comes in fewer partitions than the cluster has cores (a small file cannot be split); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
