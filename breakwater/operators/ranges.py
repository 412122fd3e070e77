"""Order over all rows without one task for all: ranges of the order are partitions, and what crosses their borders is a row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakwater.plans.lineage import cut

_BITS = 33


def ranged(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows``, written, with ``__part``, the number of their range of ``order``, and ``__at``, which rises with the order.

    Spark samples the order's values for the borders, so ranges are even however few contigs (first values of the order) there are;
    only rows that are equal in all of ``order`` stay together. Nulls come first.
    """
    spread = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("__at", F.monotonically_increasing_id()))
    return placed.withColumn("__part", F.shiftright("__at", _BITS).cast("int"))


def _offsets(sizes: DataFrame, size: str) -> DataFrame:
    """``__part, __offset``: the sum of ``size`` over all ranges before; there is a row a range, as many as shuffle partitions at most."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__part", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("__offset"))


def numbered(rows: DataFrame, order: list[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, … over all rows by ``order``. Rows that are equal in it are numbered in any order."""
    placed = ranged(rows, order, parts)
    offsets = _offsets(placed.groupBy("__part").agg(F.count("*").alias("n")), "n")
    own = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), _BITS) + 1  # rows of a range are numbered without gaps
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, own + F.col("__offset")).drop("__part", "__at", "__offset")


def runs(rows: DataFrame, order: list[str], joins: list[str], same: Column, name: str = "run", parts: int | None = None) -> DataFrame:
    """Adds ``name``, the number of a row's run: it goes on with the run of the row before it in ``order`` if ``same`` holds.

    ``same`` reads this row's columns and, with ``__last_`` before their names, the ``joins`` columns of the row before. A range's first row
    looks at the last row of the range before; that and the number of runs are all that ranges tell each other.
    """
    placed = ranged(rows, order, parts)
    held = F.struct(*joins)
    ends = placed.groupBy("__part").agg(F.max_by(held, "__at").alias("end"))
    entering = ends.select("__part", F.lag("end").over(Window.orderBy("__part")).alias("__enter"))
    within = Window.partitionBy("__part").orderBy("__at")
    looked = placed.join(F.broadcast(entering), "__part").withColumn("__before", F.coalesce(F.lag(held).over(within), F.col("__enter")))
    told = looked.withColumns({f"__last_{c}": F.col("__before")[c] for c in joins})
    fresh = told.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("__before", "__enter", *(f"__last_{c}" for c in joins))
    counted = cut(fresh.withColumn("__own", F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0))))
    offsets = _offsets(counted.groupBy("__part").agg(F.max("__own").alias("n")), "n")
    return counted.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__own") + F.col("__offset")).drop("__part", "__at", "__new", "__own", "__offset")
