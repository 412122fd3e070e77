"""Reference sequences: FASTA text as bins of bases, and the bases of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakwater.plans.lineage import cut

#: Bases of a bin.
BIN = 1 << 16


def read_fasta(spark: SparkSession, paths: str | list[str], width: int = BIN) -> DataFrame:
    """``name, bin, bases``: each sequence in bins of ``width`` bases, from 0 on; the name is the header's first word.

    Files are read as lines, in as many tasks as they have splits. Each split numbers its own lines; what a split needs of those before it
    (which sequence it goes on with, and how many bases that has) is a row a split. Then a line's pieces meet by bin, so nothing larger
    than a bin is in one row. Lines before the first header, and sequences without bases, are left out.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(paths).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    head = F.startswith("value", F.lit(">"))
    told = lines.select("file", "block", "line", F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("header"), F.when(head, "").otherwise(F.regexp_replace("value", r"\s", "")).alias("bases"))
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    total = told.withColumn("total", F.sum(F.length("bases").cast("long")).over(within))
    known = cut(total.withColumns({"name": F.last("header", ignorenulls=True).over(within), "base": F.last(F.when(F.col("header").isNotNull(), F.col("total")), ignorenulls=True).over(within)}))
    # A row a split: its last header, and its bases after that header (all its bases, if it has none).
    ends = known.groupBy("file", "block").agg(F.max_by(F.struct("name", (F.col("total") - F.coalesce("base", F.lit(0))).alias("tail")), "line").alias("x")).select("file", "block", "x.name", "x.tail")
    before, through = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = ends.withColumns({"carry": F.last("name", ignorenulls=True).over(before), "passed": F.coalesce(F.sum("tail").over(before), F.lit(0)), "thus": F.sum("tail").over(through) - F.col("tail")})
    carried = summed.withColumn("offset", F.col("passed") - F.coalesce(F.last(F.when(F.col("name").isNotNull(), F.col("thus")), ignorenulls=True).over(before), F.lit(0)))
    placed = known.join(F.broadcast(carried.select("file", "block", "carry", "offset")), ["file", "block"]).where("bases <> ''")
    start = F.col("total") - F.length("bases") - F.coalesce("base", F.lit(0)) + F.when(F.col("name").isNull(), F.col("offset")).otherwise(0)
    owned = placed.select(F.coalesce("name", "carry").alias("name"), start.alias("at"), "bases").where("name IS NOT NULL")
    bins = owned.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.length("bases") - 1) / width))))
    first = F.greatest(F.col("bin") * width - F.col("at"), F.lit(0))
    last = F.least((F.col("bin") + 1) * width - F.col("at"), F.length("bases").cast("long"))
    pieces = bins.select("name", "bin", F.struct("at", F.substr("bases", (first + 1).cast("int"), (last - first).cast("int")).alias("bases")).alias("p"))
    return pieces.groupBy("name", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["bases"]), "").alias("bases"))


def reference_bases(places: DataFrame, sequences: DataFrame, name: str, pos: str, width: int = BIN) -> DataFrame:
    """``places`` with ``base``, the upper-case base at the 0-based ``pos``; null outside the sequences."""
    found = places.withColumn("bin", F.floor(F.col(pos) / width)).join(sequences.withColumnRenamed("name", name), [name, "bin"], "left")
    return found.withColumn("base", F.nullif(F.upper(F.substr("bases", (F.col(pos) % width + 1).cast("int"), F.lit(1))), F.lit(""))).drop("bin", "bases")


def reference_windows(places: DataFrame, sequences: DataFrame, name: str, start: str, length: int, out: str = "window", width: int = BIN) -> DataFrame:
    """``places`` with ``out``, the upper-case bases of [start, start + length) of the sequence, less where it has none; null if none at all.

    A window that crosses borders of bins is stitched from the bins' pieces: places meet bins by an equality, then a window's few pieces
    meet by the window. Places of one window (a key of many rows) fetch it once.
    """
    own = places.select(F.col(name).alias("__name"), F.col(start).cast("long").alias("__start")).where("__name IS NOT NULL AND __start IS NOT NULL").distinct()
    first, last = F.greatest("__start", F.lit(0)), F.col("__start") + length - 1
    spread = own.where(last >= 0).withColumn("bin", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    bins = sequences.select(F.col("name").alias("__name"), "bin", "bases")
    begin = F.greatest(F.col("__start") - F.col("bin") * width, F.lit(0))
    end = F.least(F.col("__start") + length - F.col("bin") * width, F.lit(width))
    piece = F.substr("bases", (begin + 1).cast("int"), (end - begin).cast("int"))
    pieces = spread.join(bins, ["__name", "bin"]).select("__name", "__start", F.struct("bin", piece.alias("bases")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["bases"]), "")
    windows = pieces.groupBy("__name", "__start").agg(F.nullif(F.upper(whole), F.lit("")).alias(out))
    return places.join(windows, (F.col(name) == F.col("__name")) & (F.col(start) == F.col("__start")), "left").drop("__name", "__start")


def with_reference(records: DataFrame, sequences: DataFrame) -> DataFrame:
    """Record lines with the reference's base in the REF column instead of ``N``, in order of place again."""
    c = F.split("value", "\t")
    places = records.select("value", c[0].alias("chrom"), (c[1].cast("long") - 1).alias("pos"))
    based = reference_bases(places, sequences, "chrom", "pos")
    line = F.array_join(F.concat(F.slice(c, 1, 3), F.array(F.coalesce("base", F.lit("N"))), F.slice(c, 5, 100000)), "\t")
    return based.orderBy("chrom", "pos", "value").select(line.alias("value"))
