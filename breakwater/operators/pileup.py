"""Pileup calling: clip places, the reads over them, evidence by sample, genotype likelihoods, association, other ends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakwater.functions.scalar import MATE_REVERSE, MATE_UNMAPPED, PAIRED, PROPER, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, has_flag, round_to_ten, sample_deviation
from breakwater.operators.intervals import points_in_intervals


def clip_positions(reads: DataFrame, least_clip: int = 9, quality: int = 15) -> DataFrame:
    """Candidate breakpoints: places of terminal soft clips over ``least_clip`` bases in reads above ``quality``."""
    ends = F.array_compact(F.array(F.when((F.col("front") == "S") & (F.col("front_len") > least_clip), F.col("pos")), F.when((F.col("back") == "S") & (F.col("back_len") > least_clip), F.col("end_pos"))))
    return reads.where(F.col("mapq") > quality).select("ref_id", F.explode(ends).alias("bp")).distinct()


def clip_support(reads: DataFrame) -> DataFrame:
    """How many primary reads are soft-clipped at each place: ``ref_id, at, n``."""
    ends = F.array_compact(F.array(F.when(F.col("front") == "S", F.col("pos")), F.when(F.col("back") == "S", F.col("end_pos"))))
    primary = reads.where(~has_flag(F.col("flag"), SUPPLEMENTARY))
    return primary.select("ref_id", F.explode(ends).alias("at")).groupBy("ref_id", "at").agg(F.count("*").alias("n"))


def pile_features(reads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the counters need of each read, made once before it is laid over places: a few numbers instead of operations and tags.

    ``split`` reads have an SA tag; of others pairs are looked at. ``odd`` reads show any sign of a variant. Columns ``keep`` go along.
    """
    flag, sa = F.col("flag"), F.col("tags").getItem("SA")
    reverse, mate_reverse = has_flag(flag, REVERSE), has_flag(flag, MATE_REVERSE)
    split, mated, extra = sa.isNotNull(), ~has_flag(flag, MATE_UNMAPPED), has_flag(flag, SUPPLEMENTARY)
    pair = ~split & has_flag(flag, PAIRED)
    plus = F.get(F.split(F.get(F.split(sa, ";"), F.lit(0)), ","), F.lit(2)) == "+"
    cross, same = F.col("ref_id") != F.col("mate_ref_id"), reverse == mate_reverse
    turned = (reverse & ~mate_reverse & (F.col("pos") < F.col("mate_pos"))) | (~reverse & mate_reverse & (F.col("pos") > F.col("mate_pos")))
    many = lambda op: F.size(F.filter("ops", lambda c: (c["op"] == op) & (c["len"] > 3)))
    soft_front, soft_back = ~extra & (F.col("front") == "S"), ~extra & (F.col("back") == "S")
    columns = {
        "split": split, "complex": F.size("ops") > 3, "low": F.col("mapq") < 50, "mate_missing": ~mated,
        "paired": (split & has_flag(flag, PROPER)) | pair, "discordant": (split | pair) & ~has_flag(flag, PROPER),
        "evert": (split & turned) | (pair & mated & ~cross & ~same & turned), "cross": pair & mated & cross, "same_strand": pair & mated & ~cross & same,
        "split_same": split & (plus != reverse), "first_same": split & mated & same, "second_same": split & mated & plus & ~reverse,
        "split_other": split & mated & ~plus, "split_cross": split & mated & cross,
        "inserted": F.when(pair, many("I")).otherwise(0), "deleted": F.when(pair, many("D")).otherwise(0), "soft_front": soft_front, "soft_back": soft_back,
        "extra_front": (extra & (F.col("front") == "H")) | (soft_front & split), "extra_back": (extra & (F.col("back") == "H")) | (soft_back & split), "mapped_pair": mated & ~cross & ~has_flag(flag, UNMAPPED), "same_pair": same, "extra": extra | has_flag(flag, SECONDARY),
    }
    out = reads.withColumns({k: F.coalesce(v, F.lit(False)) if k not in ("inserted", "deleted") else v for k, v in columns.items()})
    odd = F.col("split") | F.col("cross") | F.col("same_strand") | F.col("soft_front") | F.col("soft_back") | (F.col("inserted") > 0) | (F.col("deleted") > 0)
    return out.select("read_name", "sample", "ref_id", "pos", "end_pos", "mapq", F.abs("insert_size").alias("insert"), *columns, odd.alias("odd"), *keep)


def pileup(places: DataFrame, reads: DataFrame) -> DataFrame:
    """Every read over every place (``pos <= bp <= end_pos``)."""
    return points_in_intervals(places, reads, ["ref_id"], "bp", "pos", "end_pos")


#: What ``pileup_counts`` counts besides reads: flags of a read, or their sums over a stack of reads.
FLAGS = ["complex", "low", "mate_missing", "paired", "discordant", "split", "evert", "cross", "same_strand", "split_same", "first_same", "second_same", "split_other", "split_cross", "soft_front", "soft_back"]


def stacked(reads: DataFrame) -> DataFrame:
    """Reads ``with_support`` of one place and end as one row of their sums (``n`` reads), which counts like them over every place.

    A row without reads (``n`` 0) stands for each different clip place: it lies over all places that a read clipped there covers
    (these touch in the clip place, so they are one span), so ``clusters`` sums to the number of different clip places over a place.
    """
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    primary = ~F.col("extra")
    more = {"far": primary & F.col("far"), "close": primary & F.col("deviant") & ~F.col("far"), "zero": primary & F.col("deviant") & (F.col("insert") == 0)}
    sums = [*map(n, [*FLAGS, "mapq", "inserted", "deleted", "extra_front", "extra_back", "odd"]), *(F.count_if(c).alias(k) for k, c in more.items())]
    rows = reads.groupBy("ref_id", "pos", "end_pos").agg(F.count("*").alias("n"), *sums).withColumn("clusters", F.lit(0).cast("long"))
    clip = lambda kind, side, at: F.when(F.col(f"{kind}_{side}"), F.struct(F.lit(kind).alias("kind"), F.col(at).alias("clip")))
    clips = F.array_compact(F.array(*(clip(k, s, at) for k in ("soft", "extra") for s, at in (("front", "pos"), ("back", "end_pos")))))
    spans = reads.select("ref_id", "pos", "end_pos", F.explode(clips).alias("c")).groupBy("ref_id", "c.kind", "c.clip").agg(F.min("pos").alias("pos"), F.max("end_pos").alias("end_pos"))
    return rows.unionByName(spans.select("ref_id", "pos", "end_pos", *(F.lit(int(c == "clusters")).cast("long").alias(c) for c in rows.columns[3:])))


def pileup_counts(piled: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """The counters of each place over ``pile_features`` or ``stacked`` reads, and ``more``, in one partial aggregation."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = lambda c: total(F.col(c)).alias(f"n_{c}")
    at = lambda front, back: F.sum(F.when(F.col("pos") == F.col("bp"), F.col(front).cast("long")).otherwise(0) + F.when(F.col("end_pos") == F.col("bp"), F.col(back).cast("long")).otherwise(0))
    reads = F.sum("n") if "n" in piled.columns else F.count("*")
    return piled.groupBy("ref_id", "bp").agg(
        reads.alias("n_reads"), F.sum(F.col("mapq").cast("long")).alias("mapq_sum"), *map(n, FLAGS), F.sum(F.col("inserted").cast("long")).alias("n_inserted"), F.sum(F.col("deleted").cast("long")).alias("n_deleted"),
        at("soft_front", "soft_back").alias("n_primary"), at("extra_front", "extra_back").alias("n_supplement"), n("odd"), *more,
    )


def counted_more(within: int = 50) -> tuple[Column, ...]:
    """What the counters lack for calls, over ``stacked`` reads: pairs of deviant template lengths (``n_far, n_close``, and those of length 0,
    ``n_zero``), different clip places (``n_clusters``), and the sums from which ``start_bounds`` tells the spread of clips."""
    a, b = F.col("pos") - F.col("bp"), F.col("end_pos") - F.col("bp")
    at = lambda x: F.sum(F.when(F.abs(a) <= within, F.col("soft_front") * x(a)).otherwise(0) + F.when(F.abs(b) <= within, F.col("soft_back") * x(b)).otherwise(0)).cast("long")
    return (
        *(F.sum(c).alias(f"n_{c}") for c in ("far", "close", "zero", "clusters")),
        at(lambda d: F.lit(1)).alias("clips_near"), at(lambda d: d).alias("clips_sum"), at(lambda d: d * d).alias("clips_squares"),
    )


def start_bounds(counts: DataFrame) -> DataFrame:
    """Adds ``start_low, start_high``: the place itself, or int(1.96 sd) + 1 to both sides of it where two clips or more lie near.

    Each clipped end of a primary read near the place is one value; a read that is clipped at both ends has two.
    """
    half = F.coalesce(F.floor(1.96 * sample_deviation(F.col("clips_near"), F.col("clips_sum"), F.col("clips_squares"))) + 1, F.lit(0)).cast("long")
    return counts.withColumns({"start_low": F.col("bp") - half, "start_high": F.col("bp") + half})


#: Fixed order of the attribute vector.
ATTRIBUTES = ["paired", "discordant", "mate_missing", "same_strand", "cross", "split", "first_same", "second_same", "split_same", "inserted", "deleted"]


def attributes(counts: DataFrame) -> DataFrame:
    """The counters as shares of the reads, in a fixed order (``at``)."""
    return counts.withColumn("at", F.array(*(F.try_divide(F.col(f"n_{c}"), F.col("n_reads")) for c in ATTRIBUTES)))


def scoring_gates(counts: DataFrame, least: int = 3) -> DataFrame:
    """Places worth scoring: ``least`` primary clips or two supplementary ones, and some sign besides few clips."""
    silent = (F.col("n_discordant") == 0) & (F.col("n_split") == 0) & (F.col("n_evert") == 0) & (F.col("n_primary") < least)
    return counts.where(((F.col("n_primary") >= least) | (F.col("n_supplement") >= 2)) & ~silent)


def with_support(reads: DataFrame, support: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds, read by read, ``clips`` (the greater support of its two ends) and ``deviant`` (a template length off the library's mean by
    more than 2.5 deviations). The support is joined before reads are laid over places, so no place's reads need be gathered for it."""
    at = lambda c: support.select("ref_id", F.col("at").alias(c), F.col("n").alias(f"__{c}"))
    out = reads.join(at("pos"), ["ref_id", "pos"], "left").join(at("end_pos"), ["ref_id", "end_pos"], "left")
    # One row a library.
    out = out.join(F.broadcast(stats.select("sample", F.col("mean").alias("__mean"), F.col("sd").alias("__sd"))), "sample", "left")
    off = F.col("mapped_pair") & (F.abs(F.col("insert") - F.col("__mean")) > 2.5 * F.col("__sd"))
    return out.withColumns({"clips": F.coalesce(F.greatest("__pos", "__end_pos"), F.lit(0)), "deviant": F.coalesce(off, F.lit(False)), "far": F.coalesce(off & (F.col("insert") > F.col("__mean")), F.lit(False))}).drop("__pos", "__end_pos", "__mean", "__sd")


def read_evidence(piled: DataFrame, near: int = 5) -> DataFrame:
    """Primary reads of each place with ``alt``: clipped near the place where others are clipped too, same strand, deviant, or of the name
    of an odd read over the place."""
    named = piled.groupBy("ref_id", "bp", "read_name").agg(F.max("odd").alias("odd"), F.collect_list(F.struct("sample", "pos", "end_pos", "mapq", "soft_front", "soft_back", "clips", "mapped_pair", "same_pair", "deviant", "far", "extra")).alias("r"))
    each = named.select("ref_id", "bp", "read_name", "odd", F.inline("r")).where("NOT extra")
    close = (F.abs(F.col("pos") - F.col("bp")) < near) | (F.abs(F.col("end_pos") - F.col("bp")) < near)
    out = each.withColumns({"clipped": close & (F.col("soft_front") | F.col("soft_back")) & (F.col("clips") > 1), "same": F.col("mapped_pair") & F.col("same_pair")})
    return out.withColumn("alt", F.col("clipped") | F.col("same") | F.col("deviant") | F.col("odd"))


def read_error(mapq: Column) -> tuple[Column, Column]:
    """ln(2e) and ln(2(1 - e)) of a read's error e = 10 ** (-mapq / 10), with a quality of 0 taken as 1."""
    e = F.pow(F.lit(10.0), -F.greatest(mapq, F.lit(1)) / 10)
    return F.ln(2 * e), F.ln(2 * (1 - e))


def evidence_spans(reads: DataFrame, width: int = 1000) -> DataFrame:
    """What primary reads ``with_support`` say of the places that they cover, summed over reads that say the same of the same places:
    ``ref_id, sample, first, last, alt, near`` and ``n, n_same, n_deviant, n_far, wrong, right``.

    ``alt`` is as in ``read_evidence``, but told before reads are laid over places: a read without a sign of its own is alternative just
    where odd reads of its name lie, so it is cut there. Spans of a name meet by bins of ``width``, which bounds what is gathered. Odd reads
    hold all clipped ones, so these are not cut; ``near`` marks those that count as clipped close to their ends.
    """
    binned = lambda df: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("end_pos") / width)))).withColumns({"first": F.greatest("pos", F.col("__bin") * width), "last": F.least("end_pos", (F.col("__bin") + 1) * width - 1)})
    same = F.col("mapped_pair") & F.col("same_pair")
    rows = reads.where("pos <= end_pos").withColumns({"same": same, "near": (F.col("soft_front") | F.col("soft_back")) & (F.col("clips") > 1)})
    sure = F.col("odd") | F.col("same") | F.col("deviant")
    said = ["ref_id", "sample", "first", "last", "alt", "near", "same", "deviant", "far", "mapq"]
    loud = rows.where(sure & ~F.col("extra")).select("*", F.col("pos").alias("first"), F.col("end_pos").alias("last"), F.lit(True).alias("alt")).select(*said)
    covers = binned(rows.where("odd").select("ref_id", "read_name", "pos", "end_pos")).groupBy("ref_id", "__bin", F.col("read_name").alias("__name")).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("__over"))
    quiet = binned(rows.where(~sure & ~F.col("extra")))
    met = quiet.join(covers.withColumnsRenamed({"ref_id": "__ref", "__bin": "__at"}), (F.col("ref_id") == F.col("__ref")) & (F.col("__bin") == F.col("__at")) & F.col("read_name").eqNullSafe(F.col("__name")), "left")
    piece = lambda low, high, alt: F.struct(low.cast("long").alias("first"), high.cast("long").alias("last"), F.lit(alt).alias("alt"))
    kind = "struct<at:bigint,out:array<struct<first:bigint,last:bigint,alt:boolean>>>"

    def step(s: Column, x: Column) -> Column:
        begin, end = F.greatest(x["first"], s["at"]), F.least(x["last"], F.col("last"))
        out = F.concat(s["out"], F.array(piece(s["at"], begin - 1, False), piece(begin, end, True)))
        return F.when(begin <= end, F.struct((end + 1).cast("long").alias("at"), out.alias("out")).cast(kind)).otherwise(s)

    begin = F.struct(F.col("first").cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint,alt:boolean>>").alias("out")).cast(kind)
    cutting = F.aggregate("__over", begin, step, lambda s: F.concat(s["out"], F.array(piece(s["at"], F.col("last"), False))))
    pieces = F.coalesce(cutting, F.array(piece(F.col("first"), F.col("last"), False)))
    parts = met.select("ref_id", "sample", "near", "same", "deviant", "far", "mapq", F.explode(pieces).alias("p")).where("p.first <= p.last").select("*", "p.*").select(*said)
    wrong, right = read_error(F.col("mapq"))
    kinds = [F.count_if(c).alias(f"n_{c}") for c in ("same", "deviant", "far")]
    return loud.unionByName(parts).groupBy("ref_id", "sample", "first", "last", "alt", "near").agg(F.count("*").alias("n"), *kinds, F.sum(wrong).alias("wrong"), F.sum(right).alias("right"))


def span_evidence(places: DataFrame, spans: DataFrame, near: int = 5) -> DataFrame:
    """``sample_evidence`` of ``places`` from written ``evidence_spans``, with the sums of ``wrong`` and ``right`` over alternative (``_alt``)
    and reference reads (``_ref``) for likelihoods."""
    close = F.col("near") & ((F.abs(F.col("first") - F.col("bp")) < near) | (F.abs(F.col("last") - F.col("bp")) < near))
    total = lambda x, where: F.coalesce(F.sum(F.when(where, F.col(x))), F.lit(0))
    by = {f"{k}_{w}": total(k, c).cast("double") for k in ("wrong", "right") for w, c in (("alt", F.col("alt")), ("ref", ~F.col("alt")))}
    over = points_in_intervals(places.select("ref_id", "bp"), spans, ["ref_id"], "bp", "first", "last")
    out = over.groupBy("ref_id", "bp", "sample").agg(F.sum("n").alias("n_reads"), total("n", F.col("alt")).alias("n_alt"), total("n", close).alias("n_clip"), *(F.sum(c).alias(c) for c in ("n_same", "n_deviant", "n_far")), *(c.alias(k) for k, c in by.items()))
    return out.withColumns({"n_close": F.col("n_deviant") - F.col("n_far"), "clip_share": F.col("n_clip") / F.col("n_reads")})


def span_likelihoods(seen: DataFrame, by: list[str], ruled: Column | None = None) -> DataFrame:
    """``genotype_likelihoods`` of ``span_evidence``; where ``ruled`` is false no read is alternative."""
    yes = F.lit(True) if ruled is None else ruled
    alt = lambda a, b: F.when(yes, F.col(a)).otherwise(F.col(b))
    sums = seen.select(*by, F.col("n_reads").alias("n"), F.when(yes, F.col("n_alt")).otherwise(0).alias("n_alt"), (alt("wrong_alt", "right_alt") + F.col("right_ref")).alias("aa"), (alt("right_alt", "wrong_alt") + F.col("wrong_ref")).alias("bb"))
    return _likelihoods(sums, by)


def sample_evidence(marked: DataFrame) -> DataFrame:
    """Reads, reads against the reference and their kinds, of each sample at each place."""
    n = F.count_if
    out = marked.groupBy("ref_id", "bp", "sample").agg(F.count("*").alias("n_reads"), n("alt").alias("n_alt"), n("clipped").alias("n_clip"), n("same").alias("n_same"), n("deviant").alias("n_deviant"), n("far").alias("n_far"))
    return out.withColumns({"n_close": F.col("n_deviant") - F.col("n_far"), "clip_share": F.col("n_clip") / F.col("n_reads")})


def odd_spans(reads: DataFrame) -> DataFrame:
    """``ref_id, first, last, n``: where odd reads lie, each place once a name, summed over names.

    In the order of a name's reads each adds what those before it leave uncovered, so its pieces are disjoint.
    """
    before = F.max("end_pos").over(Window.partitionBy("ref_id", "read_name").orderBy("pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1))
    fresh = reads.where("odd").select("ref_id", "end_pos", F.coalesce(F.greatest("pos", before + 1), "pos").alias("first"))
    return fresh.where("first <= end_pos").groupBy("ref_id", "first", F.col("end_pos").alias("last")).agg(F.count("*").alias("n"))


def odd_names(places: DataFrame, spans: DataFrame) -> DataFrame:
    """How many different names of odd reads lie over each place that has any: ``ref_id, bp, n_odd_names``, from written ``odd_spans``."""
    over = points_in_intervals(places.select("ref_id", "bp"), spans, ["ref_id"], "bp", "first", "last")
    return over.groupBy("ref_id", "bp").agg(F.sum("n").alias("n_odd_names"))


def most_reads(reads: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of each group's reads at most ``most``, those of the lowest hash of name and place; Spark cuts groups in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("read_name", "pos"), "read_name", "pos"))
    return reads.withColumn("__k", rank).where(F.col("__k") <= most).drop("__k")


#: What stands for a likelihood that cannot be told.
UNKNOWN = -255.0


def genotype_likelihoods(reads: DataFrame, by: list[str]) -> DataFrame:
    """``gl_aa, gl_ab, gl_bb`` and ``gt`` from reads with ``mapq`` and ``alt`` (boolean), summed by group.

    A read's error is 10 ** (-mapq / 10), with a quality of 0 taken as 1. Fewer than two reads tell nothing; without reference reads
    aa and ab are unknown, without alternative ones ab and bb. The greatest likelihood wins, ties keep 0/0, then 0/1.
    """
    wrong, right = read_error(F.col("mapq"))
    sums = reads.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("alt").alias("n_alt"), F.sum(F.when(F.col("alt"), wrong).otherwise(right)).alias("aa"), F.sum(F.when(F.col("alt"), right).otherwise(wrong)).alias("bb"))
    return _likelihoods(sums, by)


def _likelihoods(sums: DataFrame, by: list[str]) -> DataFrame:
    base = F.col("n") * math.log(2)
    some, ref, alt = F.col("n") >= 2, F.col("n") > F.col("n_alt"), F.col("n_alt") > 0
    out = sums.select(*by, "n", "n_alt", F.when(some & ref, F.col("aa") - base).otherwise(UNKNOWN).alias("gl_aa"), F.when(some & ref & alt, -base).otherwise(UNKNOWN).alias("gl_ab"), F.when(some & alt, F.col("bb") - base).otherwise(UNKNOWN).alias("gl_bb"))
    best = F.when(F.col("n") < 2, "./.").when((F.col("gl_aa") >= F.col("gl_ab")) & (F.col("gl_aa") >= F.col("gl_bb")), "0/0").when(F.col("gl_ab") >= F.col("gl_bb"), "0/1").otherwise("1/1")
    return out.withColumn("gt", best)


def association(genotypes: DataFrame, target: Column, by: list[str]) -> DataFrame:
    """Likelihood ratio of different allele frequencies in target and background samples; 0 where it is negative or undefined.

    A cohort all of whose alleles are alternative has an undefined ratio (a known quirk: its frequency exceeds 1 by 1e-6).
    """
    alleles = F.when(F.col("gt") == "0/0", 0).when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2)
    called = genotypes.where("gt <> './.'").withColumns({"__t": target, "__a": alleles})
    s = called.groupBy(*by).agg(*(F.sum(F.when(F.col("__t") == t, x).otherwise(0)).cast("long").alias(f"{n}_{w}") for t, w in ((True, "t"), (False, "b")) for x, n in ((F.col("__a"), "alt"), (F.lit(2), "all"))))
    k, n = {}, {}
    for w in "tb":
        k[w], n[w] = F.col(f"alt_{w}"), F.col(f"all_{w}")
    freq = lambda a, b: F.try_divide(a, b) + 1e-6
    pooled = freq(k["t"] + k["b"], n["t"] + n["b"])
    log = lambda a, b, p: a * F.ln(p) + (b - a) * F.ln(1 - p)
    own = log(k["t"], n["t"], freq(k["t"], n["t"])) + log(k["b"], n["b"], freq(k["b"], n["b"]))
    null = log(k["t"], n["t"], pooled) + log(k["b"], n["b"], pooled)
    return s.withColumns({"af_t": freq(k["t"], n["t"]), "af_b": freq(k["b"], n["b"]), "lrt": F.greatest(F.coalesce(2 * (own - null), F.lit(0.0)), F.lit(0.0))})


def end_mode(ends: DataFrame, by: list[str], target: str = "bp", end: str = "end") -> DataFrame:
    """The most frequent end (each counts ``times``), rounded to tens; ties and ends seen only once go to the one nearest the target."""
    counted = ends.withColumn("bucket", round_to_ten(F.col(end))).groupBy(*by, target, "bucket").agg(F.sum(times(ends)).alias("n"))
    far = F.abs(F.col("bucket") - F.col(target))
    most = counted.groupBy(*by, target).agg(F.max("n").alias("most"), F.max_by(F.struct("bucket", "n"), F.struct("n", -far, -F.col("bucket"))).alias("x"), F.min_by(F.struct("bucket", "n"), F.struct(far, "bucket")).alias("y"))
    pick = F.when(F.col("most") < 2, F.col("y")).otherwise(F.col("x"))
    return most.select(*by, target, pick["bucket"].alias("best_end"), pick["n"].alias("n"))


def end_interval(ends: DataFrame, modes: DataFrame, by: list[str], target: str = "bp", end: str = "end", within: int = 150, refine: int = 20) -> DataFrame:
    """Around each best end, ends counting ``times``: mean and deviation of those within ``within``, the interval best ± int(1.96 sd), and the most frequent
    raw place within ``refine``."""
    near = ends.join(modes, [*by, target]).where(F.abs(F.col(end) - F.col("best_end")) <= within)
    off, n = F.col(end) - F.col("best_end"), times(ends)
    sums = near.groupBy(*by, target, "best_end").agg(F.sum(n).alias("n"), F.sum(off * n).alias("s"), F.sum(off * off * n).alias("q"))
    sd = F.coalesce(sample_deviation(F.col("n"), F.col("s"), F.col("q")), F.lit(0.0))
    stats = sums.select(*by, target, "best_end", (F.col("best_end") + F.col("s") / F.col("n")).alias("mean_end"), sd.alias("sd_end"))
    raw = near.where(F.abs(F.col(end) - F.col("best_end")) <= refine).groupBy(*by, target, F.col(end).alias("raw")).agg(F.sum(n).alias("m")).groupBy(*by, target).agg(F.max_by("raw", F.struct("m", -F.col("raw"))).alias("refined_end"))
    half = F.floor(1.96 * F.col("sd_end")).cast("long")
    return stats.join(raw, [*by, target], "left").withColumns({"ci_low": F.col("best_end") - half, "ci_high": F.col("best_end") + half})


def times(rows: DataFrame) -> Column:
    """How often a row counts: its ``n``, once where there is none."""
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("long")


def partner_contig(mates: DataFrame, by: list[str], own: str = "ref_id", other: str = "mate_ref_id") -> DataFrame:
    """The contig that most mates lie on (each counts ``times``); a place's own contig wins ties, then the smallest."""
    counted = mates.groupBy(*by, own, other).agg(F.sum(times(mates)).alias("n"))
    rank = F.struct(-F.col("n"), F.col(own) != F.col(other), F.col(other))
    return counted.groupBy(*by, own).agg(F.min_by(F.col(other), rank).alias("partner"), F.max("n").alias("n"))


def end_union(mates: DataFrame, splits: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Other ends of each place from mates (``mp``), splits (``sr``) and alternative hits (``xa``): ``ref_id, bp, end, source``."""
    tagged = lambda x, name: x.select("ref_id", "bp", F.col("end").cast("long").alias("end"), F.lit(name).alias("source"))
    return tagged(mates, "mp").unionByName(tagged(splits, "sr")).unionByName(tagged(alternatives, "xa"))


def clip_bases(reads: DataFrame, quality: int = 20, beside: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clipped bases of each primary read's soft ends whose ``beside`` bases next to the breakpoint have a mean quality of ``quality`` or
    more: ``ref_id, bp, direction`` (f for a front clip, b for a back clip)``, bases``, and the reads' columns ``keep``."""
    score = lambda text: F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: n + F.ascii(c) - 33) / beside
    n, seq, qual = F.length("seq"), F.col("seq"), F.col("qual")
    front = F.struct(F.col("pos").alias("bp"), F.lit("f").alias("direction"), F.substr(seq, F.lit(1), F.col("front_len")).alias("bases"), score(F.substr(qual, F.greatest(F.col("front_len") - beside + 1, F.lit(1)), F.lit(beside))).alias("score"))
    back = F.struct(F.col("end_pos").alias("bp"), F.lit("b").alias("direction"), F.substr(seq, F.greatest(n - F.col("back_len") + 1, F.lit(1)), F.col("back_len")).alias("bases"), score(F.substr(qual, F.greatest(n - F.col("back_len") + 1, F.lit(1)), F.lit(beside))).alias("score"))
    ends = F.array_compact(F.array(F.when(F.col("front") == "S", front), F.when(F.col("back") == "S", back)))
    primary = reads.where(~has_flag(F.col("flag"), SUPPLEMENTARY))
    return primary.select("ref_id", *keep, F.explode(ends).alias("e")).select("ref_id", *keep, "e.*").where(F.col("score") >= quality).drop("score")


def clip_direction(clips: DataFrame) -> DataFrame:
    """The direction that most clips of a place have (f on ties), and how many have it."""
    n = clips.groupBy("ref_id", "bp").agg(F.count_if(F.col("direction") == "f").alias("f"), F.count_if(F.col("direction") == "b").alias("b"))
    return n.select("ref_id", "bp", F.when(F.col("b") > F.col("f"), "b").otherwise("f").alias("direction"), F.greatest("f", "b").alias("n"))
