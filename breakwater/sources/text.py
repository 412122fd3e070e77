"""Readers of alignment, region, call and truth formats that are text, each a projection over Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.functions.scalar import info_value


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def file_list(spark: SparkSession, given: str) -> list[str]:
    """``a.bam,b.bam``, or a text file that names one path a line (any last ending other than bam or sam)."""
    if given.rsplit(".", 1)[-1].lower() in ("bam", "sam"):
        return [p for p in given.split(",") if p]
    return [r.value.strip() for r in spark.read.text(given).collect() if r.value.strip()]


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of SAM text with 0-based places; ``ref`` and ``mate_ref`` are contig names, tags a map of name to value."""
    rows = _lines(spark, paths).where(~F.startswith("value", F.lit("@"))).withColumn("c", F.split("value", "\t")).where("size(c) >= 11")
    c = lambda k, kind="string": F.get("c", F.lit(k)).try_cast(kind)
    tags = F.map_from_entries(F.transform(F.slice("c", 12, 1000), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_extract(t, r"^..:.:(.*)$", 1).alias("v"))))
    mate = F.when(c(6) == "=", c(2)).otherwise(c(6))
    return rows.select("file", c(0).alias("read_name"), c(1, "int").alias("flag"), c(2).alias("ref"), (c(3, "long") - 1).alias("pos"), c(4, "int").alias("mapq"), c(5).alias("cigar"), mate.alias("mate_ref"), (c(7, "long") - 1).alias("mate_pos"), c(8, "long").alias("insert_size"), c(9).alias("seq"), c(10).alias("qual"), tags.alias("tags"))


def read_sam_header(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``contigs`` (file, name, length) and ``samples`` (file, sample, sort order); of several read groups the first sample counts."""
    rows = _lines(spark, paths).where(F.startswith("value", F.lit("@")))
    tag = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    contigs = rows.where(F.startswith("value", F.lit("@SQ"))).select("file", tag("SN").alias("name"), tag("LN").cast("long").alias("length"))
    groups = rows.where(F.startswith("value", F.lit("@RG"))).groupBy("file").agg(F.min_by(tag("SM"), tag("ID")).alias("sample"))
    order = rows.where(F.startswith("value", F.lit("@HD"))).groupBy("file").agg(F.first(tag("SO")).alias("sort_order"))
    return contigs, order.join(groups, "file", "full")


def checked_headers(samples: DataFrame) -> DataFrame:
    """``samples`` of headers, if each file names its sample and is sorted by coordinate; else an error that names the files."""
    bad = samples.where("sample IS NULL OR coalesce(sort_order, '') <> 'coordinate'").orderBy("file").limit(20).collect()
    if bad:
        raise ValueError("no sample or not sorted by coordinate: " + ", ".join(r.file for r in bad))
    return samples


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end``; lines with fewer columns or without numbers are dropped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where("size(c) >= 3")
    return rows.select(F.col("c")[0].alias("chr"), F.expr("try_cast(c[1] AS BIGINT)").alias("start"), F.expr("try_cast(c[2] AS BIGINT)").alias("end")).where("start IS NOT NULL AND end IS NOT NULL")


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records with the sample columns as an array; header lines are dropped."""
    rows = _lines(spark, paths).where(~F.startswith("value", F.lit("#"))).withColumn("c", F.split("value", "\t")).where("size(c) >= 8")
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    return rows.select("file", *(F.get("c", F.lit(k)).cast("long" if n == "pos" else "string").alias(n) for k, n in enumerate(names)), F.slice("c", 10, 100000).alias("samples"))


def vcf_keys(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The keys that headers name: ``kind`` (INFO, FORMAT or FILTER), ``id, number, type, description``; null where a line lacks one."""
    lines = spark.read.text(paths).where("value RLIKE '^##(INFO|FORMAT|FILTER)=<'")
    part = lambda key: F.nullif(F.regexp_extract("value", rf"[<,]{key}=([^,>\"]+)", 1), F.lit(""))
    said = F.nullif(F.regexp_extract("value", r'Description="([^"]*)"', 1), F.lit(""))
    return lines.select(F.regexp_extract("value", "^##([A-Z]+)=", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"), said.alias("description")).distinct()


def vcf_header_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, value`` of the header lines, numbered within their file (headers stand at its begin, in its first split)."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return rows.where(F.startswith("value", F.lit("#")))


def read_merge_input(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What merging needs of records: both ends (POS and END where the older keys are missing), type, id and support, and what it
    hands on: the base, both ends' support and samples, and the marks of earlier merging and refining."""
    i = F.col("info")
    first = lambda key, k: F.get(F.split(info_value(i, key), ","), F.lit(k)).cast("long")
    names = lambda key: F.coalesce(F.split(info_value(i, key), ","), F.split(info_value(i, "TAGS"), ","), F.array().cast("array<string>"))
    left, right = F.coalesce(first("SUPPORT", 0), info_value(i, "A").cast("long")), F.coalesce(first("SUPPORT", 1), F.lit(0).cast("long"))
    mark = lambda key: F.coalesce(first(key, 0), F.lit(0).cast("long"))
    return read_vcf(spark, paths).select(
        F.col("chrom").alias("seqid"), F.coalesce(first("POS", 0), F.col("pos")).alias("five"), F.coalesce(first("POS", 1), info_value(i, "END").cast("long")).alias("three"), info_value(i, "SVTYPE").alias("svtype"), F.coalesce(info_value(i, "ID"), F.col("id")).alias("id"),
        (left + right).alias("support"), left.alias("left_support"), right.alias("right_support"), F.col("ref").alias("base"), names("LID").alias("lid"), names("RID").alias("rid"), mark("MERGED").alias("merged"), mark("REFINED").alias("refined"),
    )


def read_training_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``features`` (all columns but the first and the last) and ``label``; lines that start with ``#`` are an error."""
    rows = spark.read.text(path)
    checked = rows.withColumn("value", F.when(F.startswith("value", F.lit("#")), F.raise_error(F.lit("a training matrix has no comment lines"))).otherwise(F.col("value")))
    return checked.select(F.split("value", "\t").alias("c")).select(F.slice("c", 2, F.size("c") - 2).cast("array<double>").alias("features"), F.element_at("c", -1).alias("label"))


def read_gvf(spark: SparkSession, path: str) -> DataFrame:
    """``chr, type, start, end`` and the ranges of both ends, null where an attribute is missing."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).where("size(c) >= 9")
    part = lambda key, k: F.nullif(F.regexp_extract(F.col("c")[8], rf"{key}=(\d+),(\d+)", k), F.lit("")).cast("long")
    return rows.select(F.col("c")[0].alias("chr"), F.col("c")[2].alias("type"), F.col("c")[3].cast("long").alias("start"), F.col("c")[4].cast("long").alias("end"), F.col("c")[8].alias("attributes"), part("Start_range", 1).alias("start_low"), part("Start_range", 2).alias("start_high"), part("End_range", 1).alias("end_low"), part("End_range", 2).alias("end_high"))


def read_best_ends(spark: SparkSession, path: str) -> DataFrame:
    """The most likely ends in the 14th column of a paired BED: ``MAX:chr:pos;chr:pos``."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where("size(c) > 13").select(F.split(F.col("c")[13], "[:;]").alias("m"))
    return rows.select(F.col("m")[1].alias("chr_a"), F.col("m")[2].cast("long").alias("pos_a"), F.col("m")[3].alias("chr_b"), F.col("m")[4].cast("long").alias("pos_b"))


def read_simulated_events(spark: SparkSession, path: str) -> DataFrame:
    """Simulated events: id, type, length and up to three places."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where("size(c) >= 8")
    c = lambda k, kind="string": F.expr(f"try_cast(get(c, {k}) AS {kind})")
    return rows.select(c(0).alias("id"), c(1).alias("type"), c(2, "bigint").alias("length"), c(3).alias("chr_a"), c(4, "bigint").alias("pos_a"), c(5).alias("chr_b"), c(6, "bigint").alias("pos_b"), c(7).alias("strand"), c(8).alias("chr_c"), c(9, "bigint").alias("pos_c"))
