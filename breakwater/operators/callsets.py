"""Call sets: filters, merging of near calls, comparison with truth sets, selection and conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions.scalar import info_map, info_value, round_half_down, sample_deviation, slop
from breakwater.operators.intervals import islands
from breakwater.operators.ranges import numbered


def high_coverage_filter(calls: DataFrame) -> DataFrame:
    """The seven rules over ``svtype, svlen, tf, u, v, cw`` (weights of DEL, DUP, INV, INS, BND), ``a`` and ``sp`` (support by sample)."""
    place = F.when(F.col("svtype") == "DEL", 1).when(F.col("svtype") == "DUP", 2).when(F.col("svtype") == "INV", 3).when(F.col("svtype") == "INS", 4).otherwise(5)
    own = {"DEL": F.col("tf"), "DUP": F.col("u"), "INV": F.col("v")}
    out = calls.where(F.abs("svlen").between(50, 1_000_000))
    for kind, n in own.items():
        out = out.where((F.col("svtype") != kind) | (n >= 4))
    carriers = F.size(F.filter("sp", lambda x: x > 0))
    return out.where((F.element_at("cw", place) >= 0.2) & (F.element_at("cw", 5) <= 0.2) & (F.col("a") >= 1.5 * carriers) & F.exists("sp", lambda x: x > 7))


def merge_calls(calls: DataFrame, gap: int = 5, more: bool = False) -> DataFrame:
    """Clusters near calls whatever their type, then merges each type of a cluster: ``five, three`` (means, halves down), intervals
    of two deviations (10 at least), summed support, different ids. With ``more`` (calls of ``read_merge_input``) also the rest of a merged record:
    both ends' support, samples, the merged calls' ends in order, their marks, and the first one's base."""
    clustered = islands(calls, "seqid", "five", "three", gap, ["svtype", "id"])
    square = lambda c: F.sum((F.col(c).cast("decimal(18,0)") * F.col(c).cast("decimal(18,0)")).cast("decimal(28,0)"))
    g = clustered.groupBy("seqid", "island", "svtype").agg(
        F.count("*").alias("collapsed"), F.sum("five").alias("sum5"), F.sum("three").alias("sum3"), square("five").alias("square5"), square("three").alias("square3"),
        F.sum("support").alias("support"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), *(_handed_on() if more else []),
    )
    mean = lambda k: round_half_down(F.col(f"sum{k}") / F.col("collapsed"))
    sd = lambda k: F.coalesce(sample_deviation(F.col("collapsed"), F.col(f"sum{k}"), F.col(f"square{k}")), F.lit(0.0))
    half = lambda k: F.greatest(F.lit(10), F.ceil(2 * sd(k))).cast("long")
    return g.select("seqid", "svtype", mean(5).alias("five"), mean(3).alias("three"), half(5).alias("ci_five"), half(3).alias("ci_three"), "support", "collapsed", "ids", *(HANDED_ON if more else []))


HANDED_ON = ["left_support", "right_support", "lid", "rid", "fives", "threes", "merged", "refined", "base"]


def _handed_on() -> list[Column]:
    """A cluster is a few calls of as many files, which lie within a few places of each other, so its lists are short."""
    first = F.struct("five", "three", "id")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("five", "three", "id", F.col(c).alias("x")))), lambda e: e["x"])
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return [F.sum("left_support").alias("left_support"), F.sum("right_support").alias("right_support"), names("lid").alias("lid"), names("rid").alias("rid"), in_order("five").alias("fives"), in_order("three").alias("threes"), in_order("merged").alias("merged"), in_order("refined").alias("refined"), F.min_by("base", first).alias("base")]


def truth_matches(calls: DataFrame, truth: DataFrame, window: int = 25, by: tuple[str, ...] = ("seqid",)) -> DataFrame:
    """Adds ``truth_id``: the smallest truth event with a breakpoint t such that t - window <= place < t + window for either end.

    ``truth`` has ``truth_id, anchors`` (an array of places) and the columns ``by``, which must be equal: the contig, or contig and type.
    """
    wide = 2 * window
    anchors = truth.select(*by, "truth_id", F.explode("anchors").alias("t"))
    anchors = anchors.withColumn("bin", F.explode(F.array(F.floor((F.col("t") - window) / wide), F.floor((F.col("t") + window - 1) / wide)))).distinct()
    ends = calls.select("call_id", *by, F.explode(F.array("start", "end")).alias("p")).withColumn("bin", F.floor(F.col("p") / wide))
    hits = ends.join(anchors, [*by, "bin"]).where((F.col("p") >= F.col("t") - window) & (F.col("p") < F.col("t") + window))
    return calls.join(hits.groupBy("call_id").agg(F.min("truth_id").alias("truth_id")), "call_id", "left")


def once_per_truth(matched: DataFrame) -> DataFrame:
    """Of the calls that hit one truth event, the one of the smallest id; calls that hit none stay."""
    first = matched.where("truth_id IS NOT NULL").groupBy("truth_id").agg(F.min("call_id").alias("call_id"))
    return first.select("call_id", "truth_id").unionByName(matched.where("truth_id IS NULL").select("call_id", "truth_id"))


def anchors_of(start: Column, end: Column, length: Column, third: Column | None = None) -> Column:
    """A truth event's places, with its length and half of it to both sides."""
    half = (length / 2).cast("long")
    places = [start, end, *([third] if third is not None else [])]
    return F.array_distinct(F.array(*places, start + length, start - length, start + half, start - half))


def discovery_rates(matched: DataFrame) -> DataFrame:
    """``tp`` (different truth events hit), ``fp`` (calls that hit none) and ``fdr``."""
    out = matched.agg(F.countDistinct("truth_id").alias("tp"), F.count_if(F.col("truth_id").isNull()).alias("fp"))
    return out.withColumn("fdr", F.try_divide(F.col("fp"), F.col("tp") + F.col("fp")))


def evaluation_filter(calls: DataFrame, least_end: int = 0, least_clips: int = 0, most_places: int = 10**9, most_reads: int = 10**9) -> DataFrame:
    """Thresholds of calls: of those without a partner (``be`` null, or no such column) SI, PU, and NC or SU; of all N/NC, N and CU against RD, and
    the evaluation's own: the partner's count, NC, CU and RD."""
    n, nc = F.col("n"), F.col("nc")
    end = F.col("be") if "be" in calls.columns else F.lit(None).cast("string")
    alone = (F.col("si") >= 0.5) & (F.col("pu") >= 6) & ((nc >= 6) | (F.col("su") >= 1))
    out = calls.where((end.isNotNull() | alone) & (F.try_divide(n, nc) <= 1.5) & (n <= 18) & (F.col("cu") <= 1.4 * F.col("rd")))
    count = F.coalesce(F.get(F.split(end, ","), F.lit(2)).try_cast("long"), F.lit(0))
    return out.where((count >= least_end) & (nc >= least_clips) & (F.col("cu") <= most_places) & (F.col("rd") <= most_reads))


def without_contigs(calls: DataFrame, names: list[str]) -> DataFrame:
    return calls.where(~F.col("seqid").isin(names))


def classifier_filter(calls: DataFrame, mode: str = "none") -> DataFrame:
    """none, sensitive (NC >= 2) or specific (ED known, last BE >= 2, NC >= 3)."""
    if mode == "none":
        return calls
    if mode == "sensitive":
        return calls.where("nc >= 2")
    if mode == "specific":
        return calls.where("ed IS NOT NULL AND lower(ed) <> 'nan' AND be >= 2 AND nc >= 3")
    raise ValueError(f"unknown filter {mode!r}")


def select_columns(records: DataFrame, fields: list[str], info: list[str], chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Fields and INFO keys (by key) of records, of one contig or region; of repeated places the first in file order stays."""
    out = records
    if chrom is not None:
        out = out.where(F.col("chrom") == chrom)
    if start is not None:
        out = out.where(F.col("pos").between(start, end))
    if "line" in records.columns:
        out = out.groupBy("chrom", "pos").agg(F.min_by(F.struct(*(c for c in records.columns if c not in ("chrom", "pos"))), "line").alias("r")).select("chrom", "pos", "r.*")
    parsed = out.withColumn("__info", info_map(F.col("info")))
    return parsed.select(*fields, *(F.col("__info").getItem(k).alias(k.lower()) for k in info))


def pooled_frequency(table: DataFrame, ref_target: str, alt_target: str, ref_back: str, alt_back: str) -> DataFrame:
    """``af_target, af_background``: alternative over all reads, null without reads."""
    share = lambda r, a: F.try_divide(F.col(a), F.col(r) + F.col(a))
    return table.withColumns({"af_target": share(ref_target, alt_target), "af_background": share(ref_back, alt_back)})


def to_bed(calls: DataFrame, by: int = 0, paired: bool = False) -> DataFrame:
    """``chr, start, end, name, score``; with ``paired`` calls without an end are dropped."""
    start, end = slop(F.col("start"), F.col("end"), by)
    kept = calls.where("end IS NOT NULL AND chr2 = seqid") if paired else calls
    return kept.select(F.col("seqid").alias("chr"), start.alias("start"), end.alias("end"), F.concat_ws(":", "svtype", F.col("call_id").cast("string")).alias("name"), F.col("support").alias("score"))


def to_bedpe(calls: DataFrame, by: int = 0, parts: int | None = None) -> DataFrame:
    """Both ends as intervals, the smaller first, numbered over all contigs in order of place."""
    a, b = F.least("start", "end"), F.greatest("start", "end")
    counted = numbered(calls, ["seqid", "start", "end", "call_id"], "__k", parts)
    return counted.select(F.col("seqid").alias("chr_a"), F.greatest(a - by, F.lit(0)).alias("start_a"), (a + by).alias("end_a"), F.coalesce("chr2", "seqid").alias("chr_b"), F.greatest(b - by, F.lit(0)).alias("start_b"), (b + by).alias("end_b"), F.concat_ws("_", "seqid", F.col("__k").cast("string"), "svtype").alias("name"), F.col("support").alias("score"))


def ranges_to_bedpe(calls: DataFrame, order: list[str], by: int = 0, parts: int | None = None) -> DataFrame:
    """Calls with ranges of both ends (``chr_a, low_a, high_a, chr_b, low_b, high_b, label, extra``) as paired intervals, widened by ``by`` and
    numbered in ``order``; on one contig the smaller interval stands first."""
    counted = numbered(calls, order, "__k", parts)
    a, b = F.struct((F.col("low_a") - by).alias("low"), (F.col("high_a") + by).alias("high")), F.struct((F.col("low_b") - by).alias("low"), (F.col("high_b") + by).alias("high"))
    turned = (F.col("chr_a") == F.col("chr_b")) & (a["low"] > b["high"])
    first, second = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    name = F.concat_ws(":", F.col("__k").cast("string"), "label")
    return counted.select("chr_a", first["low"].alias("start_a"), first["high"].alias("end_a"), "chr_b", second["low"].alias("start_b"), second["high"].alias("end_b"), name.alias("name"), "extra")


def delly_to_bedpe(records: DataFrame, by: int = 0, parts: int | None = None) -> DataFrame:
    """Another caller's records as paired intervals of their confidence intervals, named by number, type and length."""
    f = delly_fields(records)
    wide = f.select(F.col("chrom").alias("chr_a"), (F.col("pos") - 1 - F.abs("pos_low")).alias("low_a"), (F.col("pos") - 1 + F.abs("pos_high")).alias("high_a"), F.coalesce("chr2", "chrom").alias("chr_b"), (F.col("end") - 1 - F.abs("end_low")).alias("low_b"), (F.col("end") - 1 + F.abs("end_high")).alias("high_b"), F.concat_ws(":", "svtype", F.col("svlen").cast("string")).alias("label"), F.lit(None).cast("string").alias("extra"))
    return ranges_to_bedpe(wide, ["chr_a", "low_a", "chr_b", "low_b", "high_a", "high_b", "label"], by, parts)


def gvf_to_bedpe(features: DataFrame, by: int = 0, parts: int | None = None) -> DataFrame:
    """Features (``read_gvf``) as paired intervals of their ranges, or of the places themselves where they have none."""
    at = lambda c, d: F.coalesce(F.col(c) - 1, F.col(d))
    wide = features.select(F.col("chr").alias("chr_a"), at("start_low", "start").alias("low_a"), at("start_high", "start").alias("high_a"), F.col("chr").alias("chr_b"), at("end_low", "end").alias("low_b"), at("end_high", "end").alias("high_b"), F.concat_ws(":", "type", (F.col("end") - F.col("start")).cast("string")).alias("label"), F.col("attributes").alias("extra"))
    return ranges_to_bedpe(wide, ["chr_a", "low_a", "low_b", "high_a", "high_b", "label", "extra"], by, parts)


def delly_fields(records: DataFrame) -> DataFrame:
    """What the converters need of another caller's INFO: second contig, end, intervals, type and length; low-quality rows go."""
    i = F.col("info")
    low = lambda key, k: F.get(F.split(info_value(i, key), ","), F.lit(k)).cast("long")
    return records.where("filter <> 'LowQual'").select("chrom", "pos", info_value(i, "CHR2").alias("chr2"), info_value(i, "END").cast("long").alias("end"), low("CIPOS", 0).alias("pos_low"), low("CIPOS", 1).alias("pos_high"), low("CIEND", 0).alias("end_low"), low("CIEND", 1).alias("end_high"), info_value(i, "SVTYPE").alias("svtype"), info_value(i, "SVLEN").cast("long").alias("svlen"))
