"""Interval operators: binned range joins, islands of near neighbours and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.operators.ranges import runs


def _dealt(points: DataFrame, spans: DataFrame, at: list[str], share: int, parts: int, least: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them on, with the rows of hot bins dealt over a grid of cells.

    A bin is hot for a side if it holds over ``least`` and more than one in ``share`` of its rows, so fewer than ``share`` bins are, and
    a broadcast marks them. A hot side's rows go to one of ``parts`` lines of the grid by a hash, the other side's to every line, so each
    pair meets in one cell; where both are hot, each has the square root of ``parts`` lines. Without hot bins nothing changes.
    """
    one = lambda df, p, s: df.select(*at, F.lit(p).alias("__p"), F.lit(s).alias("__s"))
    counted = one(points, 1, 0).unionByName(one(spans, 0, 1)).dropna(subset=at).groupBy(*at).agg(F.sum("__p").alias("__p"), F.sum("__s").alias("__s"))
    top = counted.agg(*(f(c).alias(f"{f.__name__}{c}") for f in (F.sum, F.max) for c in ("__p", "__s"))).first()
    limit = {c: max(least, (top[f"sum{c}"] or 0) // share) for c in ("__p", "__s")}
    if all((top[f"max{c}"] or 0) <= limit[c] for c in limit):
        return points, spans, at
    hot_p, hot_s = (F.col(c) > limit[c] for c in ("__p", "__s"))
    lines = lambda own, other: F.when(own & other, round(parts**0.5)).when(own, parts).otherwise(1)
    hot = F.broadcast(counted.where(hot_p | hot_s).select(*at, lines(hot_p, hot_s).alias("__rows"), lines(hot_s, hot_p).alias("__columns")))

    def deal(df: DataFrame, own: str, others: str) -> DataFrame:
        plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
        n = lambda c: F.coalesce(c, F.lit(1))
        cell = {"__rows": "__row", "__columns": "__column"}
        placed = df.join(hot, at, "left").withColumn(cell[own], F.pmod(F.xxhash64(*plain), n(own)).cast("int"))
        placed = placed.withColumn(cell[others], F.explode(F.sequence(F.lit(0), n(others) - 1)))
        return placed.select(*(F.col(f"`{c}`") for c in df.columns), "__row", "__column")

    return deal(points, "__rows", "__columns"), deal(spans, "__columns", "__rows"), [*at, "__row", "__column"]


def points_in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, width: int = 1000, how: str = "inner", share: int = 1000, parts: int = 64, least: int = 10_000) -> DataFrame:
    """Rows of both sides with equal ``keys`` and ``start <= point <= end`` (closed), each pair once.

    Spans are copied into every bin of ``width`` that they touch, points lie in one bin, so the join is an equality on keys and bin.
    In an inner join a bin that holds many of either side's rows (a place that very many reads cover) is dealt over ``parts`` keys, see
    ``_dealt``; one grouped count of both sides' bins tells which. Null keys or places meet nothing.
    """
    a = points.withColumn("__bin", F.floor(F.col(point) / width))
    b = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    at = [*keys, "__bin"]
    if how == "inner":
        a, b, at = _dealt(a, b, at, share, parts, least)
    right = {k: f"__right_{k}" for k in at}
    a, b = a.withColumn("__place", F.col(point)), b.withColumns({"__low": F.col(start), "__high": F.col(end)}).withColumnsRenamed(right)
    condition = (F.col("__place") >= F.col("__low")) & (F.col("__place") <= F.col("__high"))
    for k, other in right.items():
        condition = condition & (F.col(k) == F.col(other))
    out = a.join(b, condition, how)
    out = out.drop(*right.values()) if how == "inner" else out.withColumnsRenamed({right[k]: k for k in keys}).drop(right["__bin"])
    return out.drop("__bin", "__row", "__column", "__place", "__low", "__high")


def islands(rows: DataFrame, by: str, start: str, end: str, gap: int, ties: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``island``: rows in order of ``start`` join the row before if both ends differ from its by less than ``gap`` (signed).

    Islands are numbered over all rows. A contig's rows are dealt over tasks by range of place, and islands that cross a border are stitched.
    """
    last = lambda c: F.col(f"__last_{c}")
    near = F.col(by).eqNullSafe(last(by)) & (F.col(start) - last(start) < gap) & (F.col(end) - last(end) < gap)
    return runs(rows, [by, start, end, *(ties or [])], [by, start, end], near, "island", parts)


def tile(pos: Column, width: int = 1_000_000) -> Column:
    return F.floor(pos / width).cast("long")


def tiles(contigs: DataFrame, width: int = 1_000_000, least: int = 1000) -> DataFrame:
    """``ref_id, start, end`` of each tile of each contig longer than ``least``."""
    out = contigs.where(F.col("length") > least).select("ref_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width))).alias("k"))
    return out.select("ref_id", (F.col("k") * width).alias("start"), F.least((F.col("k") + 1) * width, F.col("length").cast("long")).alias("end"))
