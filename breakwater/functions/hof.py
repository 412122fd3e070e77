"""Higher-order helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and however often ``body`` uses it; ``kind`` is the result's type."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))
