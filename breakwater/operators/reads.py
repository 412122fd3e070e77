"""From alignments to evidence: read filters, mate pairing, pair filters, insert classes and graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions import cigar as C
from breakwater.functions.scalar import DUPLICATE, FAILED, MATE_UNMAPPED, PAIRED, PROPER, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, has_flag, only_flags  # noqa: F401
from breakwater.operators.skew import broadcast_small
from breakwater.plans.lineage import cut

EVIDENCE = "HMLRAXSVZID"


def graph_read_filter(reads: DataFrame) -> DataFrame:
    """Primary, paired reads that are no duplicates and not both unmapped; failed quality checks are kept."""
    bits = F.col("flag").bitwiseAND(F.lit(SUPPLEMENTARY | SECONDARY | PAIRED | DUPLICATE | UNMAPPED | MATE_UNMAPPED))
    return reads.where(bits.isin(PAIRED, PAIRED | UNMAPPED, PAIRED | MATE_UNMAPPED))


def clean_sequence(seq: Column) -> Column:
    """At least 20 bases, at most 5 ``N`` among the first ten."""
    head = F.substring(seq, 1, 10)
    return (F.length(seq) >= 20) & (F.length(head) - F.length(F.replace(head, F.lit("N"), F.lit(""))) <= 5)


def pileup_read_filter(reads: DataFrame) -> DataFrame:
    """Mapped reads, no duplicates, primary or supplementary, with a split or a mapping quality, few alternatives, clean bases."""
    sa, xa = F.col("tags").getItem("SA"), F.col("tags").getItem("XA")
    return reads.where(only_flags(F.col("flag"), 0, UNMAPPED | DUPLICATE | SECONDARY) & (sa.isNotNull() | (F.col("mapq") >= 1)) & (F.coalesce(F.size(F.split(xa, ";")), F.lit(0)) <= 5) & clean_sequence(F.col("seq")))


def tells_stats(xa: Column | None = None, sa: Column | None = None) -> Column:
    """Proper pairs without alternatives or splits (in their tags, or as columns), mates mapped to the same contig within 10 kb."""
    xa, sa = (F.col("tags").getItem(tag) if c is None else c for tag, c in (("XA", xa), ("SA", sa)))
    return only_flags(F.col("flag"), PROPER, UNMAPPED | DUPLICATE | MATE_UNMAPPED) & xa.isNull() & sa.isNull() & (F.abs("insert_size") < 10000) & (F.col("ref_id") == F.col("mate_ref_id"))


def stats_read_filter(reads: DataFrame) -> DataFrame:
    """The reads that ``tells_stats``."""
    return reads.where(tells_stats())


def contig_filter(reads: DataFrame, contigs: DataFrame, skip: DataFrame | None = None, least: int = 1000) -> DataFrame:
    """Reads of contigs longer than ``least`` and not in the skip list (both are lists of contigs)."""
    keep = contigs.where(F.col("length") > least).select("ref_id")
    if skip is not None:
        keep = keep.join(skip.select("ref_id"), "ref_id", "left_anti")
    return reads.join(broadcast_small(keep), "ref_id", "left_semi")


def region_filter(reads: DataFrame, ref_id: int, start: int, end: int) -> DataFrame:
    return reads.where((F.col("ref_id") == ref_id) & (F.col("pos") < end) & (F.col("end_pos") >= start))


def with_cigar(reads: DataFrame) -> DataFrame:
    """Adds the parsed operations, both ends' clips, the closed end, the matched and the read's bases."""
    out = reads.withColumn("ops", C.parse_cigar(F.col("cigar")))
    ops = F.col("ops")
    return out.withColumns({"end_pos": C.reference_end(F.col("pos"), ops).cast("long"), "matched": C.match_bases(ops), "read_len": C.read_bases(ops), "front": C.first(ops)["op"], "front_len": C.first(ops)["len"], "back": C.last(ops)["op"], "back_len": C.last(ops)["len"], "reverse": has_flag(F.col("flag"), REVERSE)})


def with_cigar_once(reads: DataFrame, most: int = 1 << 22) -> DataFrame:
    """``with_cigar`` of reads that come of a written table (they are read twice): each different alignment string is parsed once, and the
    reads look theirs up in a broadcast.

    Strings of over ``most`` characters in all (each counts 32 more) are not broadcast; then every read's own is parsed.
    """
    seen = cut(reads.where("cigar IS NOT NULL").select("cigar").distinct())
    if (seen.agg(F.sum(F.length("cigar").cast("long") + 32)).first()[0] or 0) > most:
        return with_cigar(reads)
    parsed = with_cigar(seen.withColumns({"pos": F.lit(0).cast("long"), "flag": F.lit(0)})).drop("pos", "flag", "reverse")
    added = [c for c in parsed.columns if c != "cigar"]
    out = reads.join(F.broadcast(parsed), "cigar", "left")
    return out.withColumns({"end_pos": F.col("pos") + F.col("end_pos"), "reverse": has_flag(F.col("flag"), REVERSE)}).select(*reads.columns, *added, "reverse")


def mate_pairs(reads: DataFrame) -> DataFrame:
    """One row per read name whose two mates are both there, by one aggregation: ``read_name, sample, r1, r2``.

    Of repeated mates the one of the smallest place counts.
    """
    fields = [c for c in reads.columns if c not in ("read_name", "sample", "mate")]
    row = F.struct("pos", *(c for c in fields if c != "pos"))
    # Rows are sorted for this; names come first, as their first bytes tell more rows apart than those of samples.
    both = reads.groupBy("read_name", "sample").agg(F.min(F.when(F.col("mate") == 1, row)).alias("r1"), F.min(F.when(F.col("mate") == 2, row)).alias("r2"))
    return both.where("r1 IS NOT NULL AND r2 IS NOT NULL").select("sample", "read_name", "r1", "r2")


def unpaired_reads(reads: DataFrame) -> DataFrame:
    """Names of which only one mate is there."""
    return reads.groupBy("sample", "read_name").agg(F.min("mate").alias("mate"), F.max("mate").alias("last")).where("mate = last").drop("last")


def pair_quality(least: int = 5, good: int = 20, matched: int = 100) -> Column:
    """Both mapped, neither below ``least``, one of them ``good``, not both fully matched, enough matched bases."""
    r1, r2 = F.col("r1"), F.col("r2")
    full = lambda r: (r["front"] == "M") & (r["front_len"] == r["read_len"])
    return ~has_flag(r1["flag"], UNMAPPED) & ~has_flag(r2["flag"], UNMAPPED) & (F.least(r1["mapq"], r2["mapq"]) >= least) & (F.greatest(r1["mapq"], r2["mapq"]) >= good) & ~(full(r1) & full(r2)) & (r1["matched"] + r2["matched"] >= matched)


def facing_clips() -> Column:
    """Same contig, clips that face each other: what an insertion looks like."""
    r1, r2 = F.col("r1"), F.col("r2")
    return (r1["ref_id"] == r2["ref_id"]) & F.when(r1["pos"] <= r2["pos"], (r1["back"] == "S") & (r2["front"] == "S")).otherwise((r1["front"] == "S") & (r2["back"] == "S"))


def too_much_overlap(most: float = 0.2, parity: bool = False) -> Column:
    """Same contig and overlapping by more than ``most`` of both lengths; ``parity`` takes mate 1's end for both."""
    r1, r2 = F.col("r1"), F.col("r2")
    touch = (r1["pos"] <= r2["end_pos"]) & (r2["pos"] <= r1["end_pos"])
    end = r1["end_pos"] if parity else F.least(r1["end_pos"], r2["end_pos"])
    return (r1["ref_id"] == r2["ref_id"]) & touch & ((end - F.greatest(r1["pos"], r2["pos"])) / (r1["read_len"] + r2["read_len"]) > most)


def has_long_clip(least: int = 5) -> Column:
    clip = lambda r: ((r["front"] == "S") & (r["front_len"] >= least)) | ((r["back"] == "S") & (r["back_len"] >= least))
    return clip(F.col("r1")) | clip(F.col("r2"))


def few_hits(xa: Column, most: int = 3) -> Column:
    return F.coalesce(F.size(F.split(xa, ";")), F.lit(0)) <= most


def everted() -> Column:
    """Same contig, the left mate reverse and the right one forward."""
    r1, r2 = F.col("r1"), F.col("r2")
    left_first = r1["pos"] <= r2["pos"]
    return (r1["ref_id"] == r2["ref_id"]) & F.when(left_first, r1["reverse"]).otherwise(r2["reverse"]) & ~F.when(left_first, r2["reverse"]).otherwise(r1["reverse"])


def same_strand() -> Column:
    return F.col("r1")["reverse"] == F.col("r2")["reverse"]


def insert_size() -> Column:
    """The template length that the aligner gave the first mate."""
    return F.abs(F.col("r1")["insert_size"])


def filtered_pairs(pairs: DataFrame, parity: bool = False, good: int = 20, matched: int = 100) -> DataFrame:
    """Pairs that pass the quality, insertion, overlap and contig filters."""
    return pairs.where(pair_quality(good=good, matched=matched) & ~facing_clips() & ~too_much_overlap(parity=parity) & (F.col("r1")["ref_id"] == F.col("r2")["ref_id"]))


def library_stats(reads: DataFrame, by: str = "sample") -> DataFrame:
    """Per library, over ``stats_read_filter``'s reads: their number, mean, lower median and deviation of the template length, the cutoffs
    mean - 1.6 sd (not below 0) and mean + 2.5 sd, and the mean mapping quality.

    All reads are counted, not a sample of regions. Libraries without such reads have no row.
    """
    return template_stats(stats_read_filter(reads), by)


def template_stats(chosen: DataFrame, by: str = "sample") -> DataFrame:
    """``library_stats`` over reads that are chosen already."""
    size = F.abs("insert_size").alias("size")
    out = chosen.select(by, size, "mapq").groupBy(by).agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("sd"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").cast("long").alias("median"), F.avg("mapq").alias("mapq"))
    return out.withColumns({"low": F.greatest(F.lit(0.0), F.col("mean") - 1.6 * F.col("sd")), "high": F.col("mean") + 2.5 * F.col("sd")})


def depth_stats(reads: DataFrame, by: str = "sample", step: int = 100) -> DataFrame:
    """Per library: mean and deviation of the number of reads over every ``step``-th place that any read covers."""
    first, last = F.ceil(F.col("pos") / step), F.floor(F.col("end_pos") / step)
    over = reads.where(first <= last).select(by, "ref_id", F.explode(F.sequence(first, last)).alias("at"))
    depth = over.groupBy(by, "ref_id", "at").agg(F.count("*").alias("depth"))
    return depth.groupBy(by).agg(F.count("*").alias("places"), F.avg("depth").alias("mean_depth"), F.stddev_samp("depth").alias("sd_depth"))


def base_quality(reads: DataFrame, by: str = "sample") -> DataFrame:
    """Per library, over ``stats_read_filter``'s reads: the mean quality of all their bases."""
    chars = F.filter(F.split("qual", ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n + F.ascii(c) - 33)
    sums = stats_read_filter(reads).groupBy(by).agg(F.sum(total).alias("total"), F.sum(F.size(chars)).alias("bases"))
    return sums.select(by, F.try_divide("total", "bases").alias("base_quality"))


def insert_classes(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``evidence``: M or H (too far), R or L (too close), A (same strand), X (everted), else null. Stats are a row per library."""
    out = pairs.join(F.broadcast(stats.select("sample", "low", "high")), "sample")
    size = insert_size()
    kind = F.when(everted(), "X").when(size > F.col("high"), F.when(same_strand(), "M").otherwise("H")).when(size < F.col("low"), F.when(same_strand(), "R").otherwise("L")).when(same_strand(), "A")
    return out.withColumn("evidence", kind)


def insert_edges(classes: DataFrame) -> DataFrame:
    """Edges of pairs with evidence and a clip: mate places, moved to read ends at back clips (with the known asymmetry of the
    case where only mate 2 is clipped at its back: its end and its own place)."""
    r1, r2 = F.col("r1"), F.col("r2")
    clipped1 = (r1["front"] == "S") | (r1["back"] == "S")
    start = F.when(clipped1, F.when(r1["back"] == "S", r1["end_pos"]).otherwise(r1["pos"])).otherwise(F.when(r2["back"] == "S", r2["end_pos"]).otherwise(r1["pos"]))
    end = F.when(clipped1, F.when(r2["back"] == "S", r2["end_pos"]).otherwise(r2["pos"])).otherwise(r2["pos"])
    # What conditions read is worked out once, below them: copies of it in each condition cost more than twice as much.
    made = F.inline_outer(F.array(F.struct(start.alias("a"), end.alias("b"), "evidence")))
    return _ordered(classes.where(has_long_clip(5)).select("sample", r1["ref_id"].alias("seqid"), made).where("evidence IS NOT NULL"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("sample", "seqid", F.least("a", "b").alias("lpos"), F.greatest("a", "b").alias("rpos"), "evidence")


def split_edges(reads: DataFrame, contigs: DataFrame, most_mismatches: int = 10, least_quality: int = 5, tag: str = "SA") -> DataFrame:
    """Edges of reads with exactly one split: S, V if strands differ, Z if the other part lies on the wrong side.

    Splits stand in ``tag``: SA, or XP, which tells neither mapping quality nor mismatches, so its splits are not held to limits of them.
    """
    parts = (C.parse_xp if tag == "XP" else C.parse_sa)(F.col("tags").getItem(tag))
    one = reads.withColumn("all", parts).where("size(all) = 1").withColumn("sa", F.get("all", F.lit(0)))
    one = one.join(broadcast_small(contigs.select(F.col("ref_id").alias("sa_ref"), "name")), F.col("sa.seqid") == F.col("name"))
    ops, other = F.col("ops"), F.col("sa.cigar")
    one = one.where((F.coalesce("sa.nm", F.lit(0)) <= most_mismatches) & (F.coalesce("sa.mapq", F.lit(least_quality)) >= least_quality) & ~C.both_clipped(ops) & ~C.both_clipped(other) & (F.col("sa_ref") == F.col("ref_id")))
    back, front = F.col("back").isin("S", "H"), F.col("front").isin("S", "H")
    start = F.when(back, F.col("end_pos")).otherwise(F.col("pos"))
    end = F.when(C.last(other)["op"].isin("S", "H"), F.col("sa.pos") + C.reference_span(other)).otherwise(F.col("sa.pos"))
    kind = F.when((front & (end > start)) | (back & (end < start)), "Z").when(F.col("reverse") != F.col("sa.reverse"), "V").otherwise("S")
    return _ordered(one.select("sample", F.col("ref_id").alias("seqid"), start.alias("a"), end.alias("b"), kind.alias("evidence")))


def indel_edges(reads: DataFrame, least: int = 20, quality: int = 30, parity: bool = False) -> DataFrame:
    """Edges of insertions and deletions within reads of good mapping quality. Reads whose ``cigar``, if it is there, names neither
    operation have no such edge and are not parsed for it."""
    if "cigar" in reads.columns:
        reads = reads.where(F.contains("cigar", F.lit("I")) | F.contains("cigar", F.lit("D")))
    found = reads.where(F.col("mapq") >= quality).select("sample", F.col("ref_id").alias("seqid"), F.explode(C.indels(F.col("pos"), F.col("ops"), least, parity)).alias("x"))
    return _ordered(found.select("sample", "seqid", F.col("x.left").alias("a"), F.col("x.right").alias("b"), F.col("x.op").alias("evidence")))
