"""Command line: ``python -m breakwater call|cohort|pileup|stats|merge|classify|evaluate``; results are written by Spark as text folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.functions import scalar as S
from breakwater.operators import callsets as V
from breakwater.operators import forest
from breakwater.operators import reads as R
from breakwater.plans import calling, piling
from breakwater.plans.lineage import clear, cut
from breakwater.sources import bam, fasta, sinks, text


def alignments(spark: SparkSession, files: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prepared alignments, contigs, samples) of binary or text files, by their ending."""
    paths = text.file_list(spark, files)
    binary, plain = ([p for p in paths if p.lower().endswith(".bam") == k] for k in (True, False))
    heads = bam.read_bam_header(spark, binary) if binary else ()
    read = [(bam.read_bam(spark, binary), heads[0].drop("number"), heads[1])] if binary else []
    read += [(text.read_sam(spark, plain), *text.read_sam_header(spark, plain))] * bool(plain)
    rows, contigs, samples = read[0]
    for more in read[1:]:
        rows, contigs, samples = (a.unionByName(b) for a, b in zip((rows, contigs, samples), more, strict=True))
    return calling.prepare(rows, samples), contigs, samples


def restricted(reads: DataFrame, contigs: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Reads of contigs that are long enough, named if any are, and not skipped; with a region ``name:start-end`` the reads of all pairs of
    which a mate overlaps it."""
    lengths = contigs.groupBy(F.col("name").alias("ref_id")).agg(F.max("length").alias("length"))
    if args.include:
        lengths = lengths.where(F.col("ref_id").isin(args.include.split(",")))
    skip = lengths.where(F.col("ref_id").isin(args.skip.split(","))) if args.skip else None
    out = R.contig_filter(reads, lengths, skip)
    if args.region:
        name, span = args.region.rsplit(":", 1)
        start, end = map(int, span.split("-"))
        over = R.region_filter(R.with_cigar(out), name, start, end).select("sample", "read_name").distinct()
        out = out.join(over, ["sample", "read_name"], "left_semi")
    return out


def run(spark: SparkSession, argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="breakwater", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("call", "calls of structural variants"), ("cohort", "calls of each sample, merged"), ("stats", "insert sizes of each sample")):
        sub = commands.add_parser(name, help=about)
        sub.add_argument("-f", "--files", required=True, help="alignments separated by commas, or a file that lists them")
        sub.add_argument("-o", "--out", required=True)
        sub.add_argument("-e", "--skip", default="", help="contigs to leave out, separated by commas")
        sub.add_argument("-c", "--include", default="", help="the only contigs to read, separated by commas")
        sub.add_argument("-r", "--region", default="", help="name:start-end")
        sub.add_argument("-m", "--quality", type=int, default=20, help="mapping quality that a mate of each pair needs")
        sub.add_argument("-d", "--matched", type=int, default=100, help="matching bases that a pair needs")
        sub.add_argument("-i", "--tag", choices=("SA", "XP"), default="SA", help="tag of split reads")
        sub.add_argument("--strict", action="store_true", help="files must name their sample and be sorted by coordinate")
        sub.add_argument("-g", "--graph", default="", help="folder for the graphs of the called components")
        sub.add_argument("-a", "--fasta", default="", help="reference sequences, for the REF bases of records")
    sub = commands.add_parser("pileup", help="calls at places of many clips, with genotypes, targets against backgrounds")
    sub.add_argument("-t", "--targets", default="", help="alignments separated by commas")
    sub.add_argument("-b", "--backgrounds", default="", help="alignments separated by commas")
    sub.add_argument("-f", "--fasta", required=True, help="reference sequences")
    sub.add_argument("-o", "--out", required=True)
    sub.add_argument("-m", "--least", type=int, default=3, help="primary clips that a place needs")
    sub.add_argument("-p", "--quality", type=int, default=15, help="mapping quality that clips must pass")
    sub.add_argument("-q", "--base-quality", type=int, default=20, help="mean base quality that clips need beside the breakpoint")
    sub.add_argument("-e", "--bed", default="", help="regions in which places are scored")
    sub.add_argument("-r", "--region", default="", help="name:start-end")
    sub.add_argument("-i", "--illumina", action="store_true", help="qualities have the offset 64")
    sub = commands.add_parser("classify", help="the class of each record of the pileup caller, by a forest trained on a matrix")
    sub.add_argument("-f", "--file", required=True, help="records")
    sub.add_argument("-t", "--training", required=True, help="training matrix")
    sub.add_argument("-o", "--out", required=True)
    sub.add_argument("-n", "--trees", type=int, default=500)
    sub.add_argument("-c", "--least", type=float, default=0.0, help="probability below which a record's class is unknown")
    sub.add_argument("-l", "--filter", choices=("sensitive", "specific"), default=None)
    sub = commands.add_parser("evaluate", help="true and false calls against known events")
    sub.add_argument("-f", "--file", required=True, help="records")
    sub.add_argument("-t", "--truth", required=True, help="events: contig, start, end and more columns, separated by tabs")
    sub.add_argument("-o", "--out", required=True)
    sub.add_argument("-w", "--window", type=int, default=25)
    sub.add_argument("-n", "--name", default="breakwater")
    sub.add_argument("-x", "--without", default="", help="contigs whose calls are left out, separated by commas")
    sub = commands.add_parser("merge", help="near calls of several files as one")
    sub.add_argument("-f", "--files", required=True, help="call files separated by commas")
    sub.add_argument("-o", "--out", required=True)
    sub.add_argument("-d", "--distance", type=int, default=5)
    args = parser.parse_args(argv)

    if args.command == "merge":
        merged = V.merge_calls(text.read_merge_input(spark, args.files.split(",")), args.distance, more=True)
        header = sinks.vcf_header(["NONE"], form=sinks.MERGED_FORMAT)
        return sinks.write_vcf(sinks.merged_records(merged), [], args.out, header=header)
    if args.command == "pileup":
        return pileup(spark, args)
    if args.command == "classify":
        return classify(spark, args)
    if args.command == "evaluate":
        return evaluate(spark, args)
    reads, contigs, samples = alignments(spark, args.files)
    if args.strict:
        text.checked_headers(samples)
    whole, reads = reads, restricted(reads, contigs, args)
    if args.command == "stats":
        depth = R.depth_stats(R.with_cigar(R.stats_read_filter(reads)))
        every = R.library_stats(reads).join(depth.drop("places"), "sample").join(R.base_quality(reads), "sample")
        return sinks.write_table(every, args.out)
    if args.command == "cohort":
        names = [r["sample"] for r in reads.select("sample").distinct().orderBy("sample").collect()]
        merged = calling.merged_cohort(reads, contigs, names, quality=args.quality, matched=args.matched, tag=args.tag)
        return sinks.write_vcf(sinks.merged_records(merged), [], args.out, header=sinks.vcf_header(["NONE"], form=sinks.MERGED_FORMAT))
    calls, edges, comps = calling.call_variants(calling.evidence_of(reads, contigs, quality=args.quality, matched=args.matched, tag=args.tag, library=whole))
    names = [r.sample for r in samples.where("sample IS NOT NULL").select("sample").distinct().orderBy("sample").collect()]
    records = sinks.vcf_records(calls, names)
    if args.fasta:
        records = fasta.with_reference(records, fasta.read_fasta(spark, args.fasta))
    sinks.write_vcf(records, names, args.out, args.fasta or None)
    if args.graph:
        called = comps.join(calls.select("seqid", "component"), ["seqid", "component"], "left_semi")
        sinks.dot_graphs(edges, called).select("dot").write.text(args.graph)


def classify(spark: SparkSession, args: argparse.Namespace) -> None:
    records = forest.record_features(text.read_vcf(spark, args.file))
    if args.filter:
        keys = {"nc": "NC", "ed": "ED", "be": "BE"}
        told = records.withColumns({k: S.info_value(F.col("info"), v) for k, v in keys.items()})
        told = told.withColumns({"nc": F.col("nc").cast("int"), "be": F.element_at(F.split("be", ","), -1).cast("int")})
        records = V.classifier_filter(told, args.filter).drop(*keys)
    scored = forest.score_forest(records, forest.train_forest(text.read_training_matrix(spark, args.training), args.trees), args.least)
    sinks.classified_lines(text.vcf_header_lines(spark, args.file), forest.annotated(scored)).write.text(args.out)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """A call is true if either end lies within the window of a place of an event on its contig (``chr`` before names does not count)."""
    records = text.read_vcf(spark, args.file)
    calls = records.select(F.monotonically_increasing_id().alias("call_id"), S.strip_chr(F.col("chrom")).alias("seqid"), (F.col("pos") - 1).alias("start"), F.coalesce(S.info_value(F.col("info"), "END").try_cast("long") - 1, F.col("pos") - 1).alias("end"))
    calls = cut(V.without_contigs(calls, [c for c in args.without.split(",") if c]))
    events = text.read_bed(spark, args.truth).select(F.monotonically_increasing_id().alias("truth_id"), S.strip_chr(F.col("chr")).alias("seqid"), V.anchors_of(F.col("start"), F.col("end"), F.col("end") - F.col("start")).alias("anchors"))
    rates = V.discovery_rates(V.truth_matches(calls, cut(events), args.window))
    sinks.summary_line(rates, args.name, "SV", args.window).write.text(args.out)


def pileup(spark: SparkSession, args: argparse.Namespace) -> None:
    groups = [p for p in (args.targets, args.backgrounds) if p]
    if not groups:
        raise SystemExit("targets or backgrounds must be given")
    reads, contigs, samples = alignments(spark, ",".join(groups))
    ofs = {r.file: r.sample for r in samples.collect()}  # a row a file
    wanted = {p.rsplit("/", 1)[-1] for p in text.file_list(spark, args.targets)} if args.targets else set()
    targets = sorted({s or f for f, s in ofs.items() if f.rsplit("/", 1)[-1] in wanted})
    names = targets + sorted({s or f for f, s in ofs.items()} - set(targets))
    if args.illumina:
        reads = reads.withColumn("qual", S.shift_quality(F.col("qual"), -31))
    named = contigs.select(F.col("name").alias("ref_id"), "name").distinct()
    inside = text.read_bed(spark, args.bed).select(F.col("chr").alias("ref_id"), "start", "end") if args.bed else None
    if args.region:
        name, span = args.region.rsplit(":", 1)
        inside = spark.createDataFrame([(name, *map(int, span.split("-")))], "ref_id string, start long, end long")
    calls = piling.pileup_calls(reads, named, targets, fasta.read_fasta(spark, args.fasta), args.least, args.quality, args.base_quality, inside)
    records = sinks.pileup_records(calls.withColumns({"chrom": F.col("ref_id"), "chr2_name": F.col("chr2")}), names)
    header = sinks.vcf_header(names, "4.1", args.fasta, sinks.PILE_INFO, sinks.PILE_FORMAT)
    sinks.write_vcf(records, names, args.out, header=header)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("breakwater").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        clear(spark)
        spark.stop()


if __name__ == "__main__":
    main()
