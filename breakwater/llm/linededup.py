"""Line dedup: overlapping windows of consecutive lines are hashed, and every later copy of a window gives up its lines.

Windows are hashed inside each row, counted once with partial sums (so a window that half of all documents share costs one row a task),
and only documents that hold a repeated window are touched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions.hof import let

WIDTH = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text.alias("__text"), *more)


def _windows(text: Column, width: int) -> Column:
    """The 128-bit hash of each window of ``width`` lines and its place; windows of nothing but empty lines are left out."""
    kind = "array<struct<at:int,h1:bigint,h2:bigint,empty:boolean>>"
    hashed = F.transform(F.split(text, "\n"), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"), (line == "").alias("empty")))

    def windows(lines: Column) -> Column:
        def window(i: Column) -> Column:
            own = [F.get(lines, i + k) for k in range(width)]
            empty = own[0]["empty"]
            for x in own[1:]:
                empty = empty & x["empty"]
            return F.struct(i.alias("at"), F.xxhash64(*(x["a"] for x in own)).alias("h1"), F.xxhash64(*(x["b"] for x in own)).alias("h2"), empty.alias("empty"))

        return F.when(F.size(lines) >= width, F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - width), window), lambda w: ~w["empty"]))

    return let(hashed, kind, windows)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Remove each line covered by a window of ``width`` lines that stands earlier, in this or another document.

    The earliest copy of a window is the one of the smallest (id, place); null ids come first. Lines are split at ``\\n``; windows
    whose lines are all empty never count. Covered places of overlapping windows are merged. Returns a row per input row:
    ``doc_id, n_lines, n_removed, text`` (the remaining lines joined again) and ``kept_sha256``. Null and empty texts have one
    empty line and lose nothing. Rows that repeat both id and text are one document and give equal rows; rows that share an id
    with different texts are different documents, told apart by a hash of the text.
    """
    out = _cleaned(_keyed(docs, id_col, text_col), width)
    digest = F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256")
    return out.select(F.col("__id").alias("doc_id"), "n_lines", "n_removed", *([F.col("__kept").alias("text")] if keep_text else []), digest)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with all its columns, its texts without the lines that ``dedup_lines`` removes; untouched texts stay as they are."""
    keyed = _keyed(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    out = _cleaned(keyed, width, "__row")
    text = F.when(F.col("n_removed") > 0, F.col("__kept")).otherwise(F.col("__row").getField(text_col))
    return out.select(*(text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns))


def _cleaned(keyed: DataFrame, width: int, *more: str) -> DataFrame:
    """Each row of ``keyed`` with ``n_lines``, ``n_removed`` and the text left, ``__kept``."""
    keyed = keyed.withColumn("__key", F.xxhash64("__text"))
    windows = keyed.select("__id", "__key", _windows(F.col("__text"), width).alias("w"))
    found = windows.where("size(w) > 0").select("__id", "__key", F.explode("w").alias("w")).select("__id", "__key", "w.at", "w.h1", "w.h2")
    place = F.struct("__id", "__key", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT (first <=> last)").select("h1", "h2", "first")
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("__id", "__key").agg(F.collect_set("at").alias("starts")).withColumnsRenamed({"__id": "__cid", "__key": "__ckey"})
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + width - 1))))
    joined = keyed.join(covered, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__key") == F.col("__ckey")), "left")
    lines = F.split("__text", "\n")
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    rest = let(lines, "string", lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    joined = joined.select("__id", "__text", *more, F.when(F.col("starts").isNotNull(), gone).alias("gone"))
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    kept = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(rest)
    return joined.select("__id", *more, F.size(lines).cast("long").alias("n_lines"), n_removed.alias("n_removed"), kept.alias("__kept"))
