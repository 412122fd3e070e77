"""The pileup caller as one plan: clip places, counters, consensus, other ends, refinement against the reference, genotypes, records.

Places that fail a gate leave before what is costlier: reads are laid over all places for the counters only, and again over those few
that have enough clips of one direction and a usable consensus for ends and genotypes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions import cigar as C
from breakwater.functions.scalar import round_to_ten, sample_deviation
from breakwater.operators import alignment as A
from breakwater.operators import pileup as P
from breakwater.operators import reads as R
from breakwater.operators.consensus import place_consensus
from breakwater.operators.intervals import points_in_intervals
from breakwater.plans.lineage import cut
from breakwater.sources.fasta import reference_windows

PLACE = ["ref_id", "bp"]
SPAN = ["ref_id", "pos", "end_pos"]
#: What evidence, ends and genotypes need of a read besides its features.
KEPT = ("mate_ref_id", "mate_pos", "tags")


def prepared_pile(reads: DataFrame) -> DataFrame:
    return cut(R.with_cigar(R.pileup_read_filter(reads)))


def featured(pile: DataFrame, reads: DataFrame) -> DataFrame:
    """Features of the pile's reads with the support of their clips and their library's template lengths, written once."""
    return cut(P.with_support(P.pile_features(pile, KEPT), P.clip_support(pile), R.library_stats(reads)))


def counted_places(pile: DataFrame, features: DataFrame, least: int = 3, quality: int = 15) -> DataFrame:
    """Counters and start bounds of the places that pass the first two gates."""
    places = P.clip_positions(pile, quality=quality)
    counts = P.pileup_counts(P.pileup(places, cut(P.stacked(features))), P.counted_more())
    return P.start_bounds(P.scoring_gates(counts, least))


def clipped_bases(pile: DataFrame, base_quality: int = 20, shortest: int = 5) -> DataFrame:
    return P.clip_bases(pile, quality=base_quality, keep=("pos", "read_name")).where(F.length("bases") >= shortest)


def with_consensus(places: DataFrame, clips: DataFrame, least: int = 2, shortest: int = 10, unclear: float = 0.5) -> DataFrame:
    """Places with at least ``least`` clips of one direction, whose consensus has ``shortest`` bases and at most that share of ``N``."""
    near = clips.join(places.select(*PLACE), PLACE, "left_semi")
    directions = P.clip_direction(near).where(F.col("n") >= least)
    said = place_consensus(near, directions).where((F.length("alt") >= shortest) & (F.col("unclear") / F.length("alt") <= unclear))
    return places.join(said, PLACE)


def hits(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """``ref_id, pos, end_pos, other, end, source, usable``: each split (``sr``) and alternative (``xa``) hit of the reads.

    A hit's end is where its clip is; hits that are clipped at both ends name a contig (``other``) but no end (not ``usable``).
    """
    parsed = lambda tag, parse, name: F.transform(parse(F.col("tags")[tag]), lambda h: F.struct(h["seqid"].alias("seqid"), h["pos"].alias("pos"), h["cigar"].alias("cigar"), F.lit(name).alias("source")))
    none = F.array().cast("array<struct<seqid:string,pos:bigint,cigar:array<struct<len:int,op:string>>,source:string>>")
    each = reads.where("tags['SA'] IS NOT NULL OR tags['XA'] IS NOT NULL").select(*SPAN, F.explode(F.concat(F.coalesce(parsed("SA", C.parse_sa, "sr"), none), F.coalesce(parsed("XA", C.parse_xa, "xa"), none))).alias("h"))
    front, back = C.first(F.col("h.cigar"))["op"], C.last(F.col("h.cigar"))["op"]
    end = F.when(back == "S", C.reference_end(F.col("h.pos"), F.col("h.cigar"))).otherwise(F.col("h.pos")).cast("long")
    named = contigs.select(F.col("name").alias("__name"), F.col("ref_id").alias("other")).distinct()
    out = each.select(*SPAN, F.col("h.seqid").alias("__name"), end.alias("end"), F.col("h.source").alias("source"), (~((front == "S") & (back == "S"))).alias("usable"))
    return out.join(named, "__name").drop("__name")


def signs(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """``hits``, mates of deviant pairs (``dp``) and mates on other contigs (``mp``) of the reads, with ``at_front, at_back``, whether the read
    is soft-clipped there; equal signs of reads of one place and end are one row (``n``)."""
    no = {"at_front": F.lit(False), "at_back": F.lit(False)}
    mates = reads.select(*SPAN, F.col("mate_pos").cast("long").alias("end"), "mate_ref_id", "deviant", "extra", "mate_missing", "soft_front", "soft_back").withColumn("usable", F.lit(True))
    pairs = mates.where("deviant AND NOT extra").withColumns({"other": F.col("ref_id"), "source": F.lit("dp"), **no})
    away = mates.where("NOT mate_missing AND mate_ref_id <> ref_id").withColumns({"other": F.col("mate_ref_id"), "source": F.lit("mp"), "at_front": F.col("soft_front"), "at_back": F.col("soft_back")})
    columns = [*SPAN, "other", "end", "source", "usable", "at_front", "at_back"]
    return hits(reads, contigs).withColumns(no).select(*columns).unionByName(pairs.select(*columns)).unionByName(away.select(*columns)).groupBy(*columns).agg(F.count("*").alias("n"))


def laid(places: DataFrame, said: DataFrame) -> DataFrame:
    """``ref_id, bp, other, end, source, usable, at, n``: written signs over each place, equal ones summed; ``at``: clipped at the place."""
    at = (F.col("at_front") & (F.col("pos") == F.col("bp"))) | (F.col("at_back") & (F.col("end_pos") == F.col("bp")))
    return P.pileup(places.select(*PLACE), said).groupBy(*PLACE, "other", "end", "source", "usable", at.alias("at")).agg(F.sum("n").alias("n"))


def partners(over: DataFrame) -> DataFrame:
    """``ref_id, bp, chr2``: the contig that most mates and splits of a place lie on. The place's own contig counts its deviant pairs and
    its splits, and wins ties; of others the first by name does. Places without any stay on their contig (no row)."""
    return P.partner_contig(over.where("source <> 'xa'"), ["bp"], "ref_id", "other").select(*PLACE, F.col("partner").alias("chr2"))


def end_evidence(over: DataFrame, chosen: DataFrame) -> DataFrame:
    """``ref_id, bp, chr2, end, source, n`` of every sign of the other end on the contig ``chr2`` of each place (``chosen``).

    On the place's own contig mates (``mp``) of deviant pairs count, on another one the mates there of the reads that are clipped at the place.
    """
    mates = F.when(F.col("source") == "dp", F.col("chr2") == F.col("ref_id")).when(F.col("source") == "mp", (F.col("chr2") != F.col("ref_id")) & F.col("at"))
    kept = over.join(chosen, PLACE).where((F.col("other") == F.col("chr2")) & F.coalesce(mates, F.col("usable")))
    return kept.select(*PLACE, "chr2", "end", F.when(F.col("source") == "dp", "mp").otherwise(F.col("source")).alias("source"), "n")


def target_zones(ends: DataFrame) -> DataFrame:
    """``ref_id, bp, zone``: the mean of a place's mates (each counts ``times``), cut to a whole number, where it has several."""
    n = P.times(ends)
    mean = ends.where("source = 'mp'").groupBy(*PLACE).agg(F.sum(n).alias("n"), F.sum(F.col("end") * n).alias("s"))
    return mean.where("n > 1").select(*PLACE, F.expr("s div n").alias("zone"))


def best_ends(ends: DataFrame, zones: DataFrame, within: int = 150, refine: int = 20) -> DataFrame:
    """``ref_id, bp, end`` (0-based), ``low, high, n_mp, n_sr, n_xa, n_ends`` of each place's best end.

    Ends are counted by tens; the most frequent wins, then the one nearest to the zone (``zones``: ``ref_id, bp, zone``). Ends nearer
    than ``within`` to it support it and give the interval of 1.96 deviations. The end is the most frequent raw one within ``refine``
    of the raw end nearest to the winner. A winner of 0 is no end. Everything is summed by place and raw end first.
    """
    n = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, P.times(ends))), F.lit(0)).alias(f"n_{s}")
    raw = ends.groupBy(*PLACE, "end").agg(F.sum(P.times(ends)).alias("n"), n("mp"), n("sr"), n("xa"))
    tens = raw.groupBy(*PLACE, round_to_ten(F.col("end")).alias("ten")).agg(F.sum("n").alias("n")).join(zones, PLACE)
    won = tens.groupBy(*PLACE).agg(F.max_by("ten", F.struct("n", -F.abs(F.col("ten") - F.col("zone")), -F.col("ten"))).alias("ten")).where("ten <> 0")
    off = F.col("end") - F.col("ten")
    near = raw.join(won, PLACE)
    close = F.abs(off) < within
    s = lambda x, name: F.coalesce(F.sum(F.when(close, x)), F.lit(0)).alias(name)
    sums = near.groupBy(*PLACE, "ten").agg(s(F.col("n"), "n_ends"), s(F.col("n") * off, "s"), s(F.col("n") * off * off, "q"), *(s(F.col(c), c) for c in ("n_mp", "n_sr", "n_xa")), F.min_by("end", F.struct(F.abs(off), F.col("end"))).alias("nearest"))
    honed = raw.join(sums.select(*PLACE, "nearest"), PLACE).where(F.abs(F.col("end") - F.col("nearest")) <= refine).groupBy(*PLACE).agg(F.max_by("end", F.struct("n", -F.col("end"))).alias("end"))
    half = F.coalesce(F.floor(1.96 * sample_deviation(F.col("n_ends"), F.col("s"), F.col("q"))), F.lit(0)).cast("long")
    return sums.join(honed, PLACE).select(*PLACE, "end", (F.col("end") - half).alias("low"), (F.col("end") + half).alias("high"), "n_mp", "n_sr", "n_xa", "n_ends")


def _aligned(places: DataFrame, sequences: DataFrame, names: DataFrame, contig: str, start: Column, length: int, out: str) -> DataFrame:
    """``places`` with ``out``, the local alignment of their consensus to the reference from ``start`` on."""
    named = places.join(names.select(F.col("ref_id").alias(contig), F.col("name").alias("__contig")), contig, "left").withColumn("__from", start)
    return reference_windows(named, sequences, "__contig", "__from", length, "__window").withColumn(out, A.local_alignment()("alt", "__window")).drop("__contig", "__from", "__window")


def other_ends(places: DataFrame, features: DataFrame, contigs: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """``places`` with ``chr2, other`` (1-based; 0: none), ``ci_low, ci_high, svlen`` and the numbers of supporting ends.

    With ``sequences`` the consensus is first aligned around the mean of the mates, which moves the zone (by 500 less than the window's begin
    is off: a known quirk of the workflow). More pairs of length 0 than supporting ends put the end on the place itself.
    """
    over = cut(laid(places, cut(signs(features, contigs))))
    chosen = places.select(*PLACE).join(partners(over), PLACE, "left").select(*PLACE, F.coalesce("chr2", "ref_id").alias("chr2"))
    ends = cut(end_evidence(over, chosen))
    zones = places.join(chosen, PLACE).join(target_zones(ends), PLACE, "left").withColumn("zone", F.coalesce("zone", "bp"))
    if sequences is not None:
        zones = _aligned(zones, sequences, contigs, "chr2", F.col("zone") - 300, 600, "__at")
        zones = zones.withColumn("zone", F.when(F.abs(F.col("__at.ref_begin") - 500) < 500, F.col("zone") - 500 + F.col("__at.ref_begin")).otherwise(F.col("zone")))
    best = best_ends(ends, zones.select(*PLACE, "zone"))
    some = ends.select(*PLACE).distinct().withColumn("__some", F.lit(True))
    out = places.join(chosen, PLACE).join(best, PLACE, "left").join(some, PLACE, "left")
    zero = F.col("__some").isNotNull() & (F.col("n_zero") > F.coalesce("n_ends", F.lit(0)))
    own = F.col("bp") + 1
    out = out.withColumns({"other": F.when(zero, own).otherwise(F.coalesce(F.col("end") + 1, F.lit(0))), "ci_low": F.when(zero, own).otherwise(F.coalesce("low", F.lit(0))), "ci_high": F.when(zero, own).otherwise(F.coalesce("high", F.lit(0)))})
    length = F.when(F.col("__some").isNull() | (F.col("chr2") != F.col("ref_id")), F.lit(0)).otherwise(F.abs(F.col("bp") - F.col("other")))
    return out.withColumns({"svlen": length.cast("long"), **{c: F.coalesce(c, F.lit(0)) for c in ("n_mp", "n_sr", "n_xa")}}).drop("end", "low", "high", "n_ends", "__some")


def refined(calls: DataFrame, sequences: DataFrame, contigs: DataFrame, flank: int = 200, most: int = 5) -> DataFrame:
    """Ends, lengths and alleles from the local alignment of the consensus (``flank`` to both sides of the place) where the reads have
    deletions or insertions of their own: ``ref, alt`` and ``end_score``, the consensus' score around the other end."""
    local = _aligned(calls, sequences, contigs, "ref_id", F.col("bp") - flank, 2 * flank, "__local")
    both = _aligned(local, sequences, contigs, "chr2", F.col("other") - flank, 2 * flank, "__end")
    at = F.col("bp") - flank + F.col("__local.ref_begin")
    few, same, on = F.col("__local.mismatches") < most, F.col("chr2") == F.col("ref_id"), at >= F.col("bp")
    deletion = few & (F.col("n_deleted") > F.col("n_inserted"))
    insertion = few & (F.col("__local.query_begin") > 0) & (F.col("n_inserted") > F.col("n_deleted"))
    moved = deletion | insertion
    size = F.when(deletion, F.abs(F.col("bp") - at) - 1).otherwise(F.col("__local.query_begin"))
    written = moved & same & on
    out = both.withColumns({
        "__del": written & deletion, "__ins": written & insertion, "ci_low": F.when(moved, at - 10).otherwise(F.col("ci_low")), "ci_high": F.when(moved, at + 10).otherwise(F.col("ci_high")),
        "svlen": F.when(written, size).otherwise(F.col("svlen")).cast("long"), "other": F.when(moved, F.when(same & ~on, 0).otherwise(at)).otherwise(F.col("other")).cast("long"), "end_score": F.coalesce(F.col("__end.score"), F.lit(0)), "__query": F.col("__local.query_begin"),
    }).drop("__local", "__end")
    named = out.join(contigs.select("ref_id", F.col("name").alias("__contig")), "ref_id", "left").withColumn("__from", F.col("bp") - 1)
    based = reference_windows(named, sequences, "__contig", "__from", 2 * flank + 2, "__bases")
    base = F.coalesce("__bases", F.lit(""))
    ref = F.when(F.col("__del"), F.substr(base, F.lit(2), (F.col("svlen") + 1).cast("int"))).when(F.col("__ins"), F.substr(base, F.lit(1), F.lit(2))).otherwise("N")
    alt = F.when(F.col("__del"), F.substr(base, F.lit(2), F.lit(1))).when(F.col("__ins"), F.concat(F.substr(base, F.lit(1), F.lit(2)), F.substr("alt", F.lit(1), F.col("__query")))).otherwise(F.col("alt"))
    return based.withColumns({"ref": ref, "alt": alt}).drop("__del", "__ins", "__query", "__contig", "__from", "__bases")


def end_gates(calls: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """Calls with another end, and mates or splits for it where it is farther than ``longest``."""
    return calls.where(F.col("other") != 0).where(~((F.col("svlen") > longest) & (F.col("n_mp") == 0) & (F.col("n_sr") == 0)))


def sample_genotypes(places: DataFrame, features: DataFrame, most: int | None = 1001) -> DataFrame:
    """Genotypes of each sample at each place. A read is alternative only in samples with two clips there or more, and over 1 percent of
    their reads. Of more than ``most`` reads of a sample those of the lowest hash of their name count for the likelihoods (None: all do);
    only where there are so many are reads laid over the place one by one, elsewhere sums of equal spans are."""
    by = [*PLACE, "sample"]
    seen = cut(P.span_evidence(places.select(*PLACE), cut(P.evidence_spans(features))))
    ruled = (F.col("n_clip") > 1) & (F.col("clip_share") > 0.01)
    deep = F.lit(False) if most is None else F.col("n_reads") > most
    likely = P.span_likelihoods(seen.where(~deep), by, ruled)
    if most is not None and not (many := seen.where(deep).select(*by, ruled.alias("__ruled"))).isEmpty():
        piled = P.pileup(many.select(*PLACE).distinct(), features)
        each = P.read_evidence(piled).select(*by, "read_name", "pos", "mapq", "alt").join(many, by).withColumn("alt", F.col("alt") & F.col("__ruled"))
        likely = likely.unionByName(P.genotype_likelihoods(P.most_reads(each, by, most), by))
    return likely.withColumn("n_good", F.when(F.col("n") < 2, 0).otherwise(F.col("n") - F.col("n_alt"))).withColumn("n_bad", F.when(F.col("n") < 2, 0).otherwise(F.col("n_alt"))).drop("n", "n_alt").join(seen.select(*by, "n_reads", "n_clip"), by)


def genotyped(calls: DataFrame, genotypes: DataFrame, target: Column, depth: DataFrame) -> DataFrame:
    """``calls`` with the association of targets, ``genotypes`` as a map by sample and ``depth_ratio``, the mean of alternative samples' reads
    over their mean depth. Calls without an alternative allele, or without a sample of two alternative reads, go."""
    tested = P.association(genotypes, target, PLACE)
    of = F.when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2).otherwise(0)
    called = F.count_if((F.col("gt") != "./.") & target)
    rows = genotypes.join(depth.select("sample", "mean_depth"), "sample", "left")
    by = rows.groupBy(*PLACE).agg(
        F.sum(of).alias("n_alleles"), F.max("n_bad").alias("most_bad"), F.avg(F.when(of > 0, F.col("n_reads") / F.col("mean_depth"))).alias("depth_ratio"), called.alias("gc_t"), F.count_if((F.col("gt") != "./.") & ~target).alias("gc_b"),
        F.map_from_entries(F.collect_list(F.struct("sample", F.struct("gt", "gl_aa", "gl_ab", "gl_bb", "n_good", "n_bad", "n_clip", "n_reads")))).alias("genotypes"),
    )
    return calls.join(by.where("n_alleles > 0 AND most_bad > 1"), PLACE).join(tested, PLACE, "left").drop("most_bad")


def pileup_calls(reads: DataFrame, contigs: DataFrame, targets: list[str], sequences: DataFrame | None = None, least: int = 3, quality: int = 15, base_quality: int = 20, inside: DataFrame | None = None) -> DataFrame:
    """Calls of prepared alignments (``calling.prepare``), with everything that their records say.

    ``contigs`` has ``ref_id, name``; ``targets`` lists the samples that are tested against all others. Without ``sequences`` nothing is refined and
    ``ref`` is N. ``inside`` (``ref_id, start, end``) restricts places. Calls whose allele is shorter than five bases go, as in the workflow.
    """
    pile = prepared_pile(reads)
    features = featured(pile, reads)
    counts = counted_places(pile, features, least, quality)
    if inside is not None:
        spans = inside.groupBy("ref_id", "start").agg(F.max("end").alias("stop"))
        counts = points_in_intervals(counts, spans, ["ref_id"], "bp", "start", "stop").drop("start", "stop").distinct()
    places = cut(with_consensus(counts, clipped_bases(pile, base_quality)))
    found = other_ends(places, features, contigs, sequences)
    found = refined(found, sequences, contigs) if sequences is not None else found.withColumn("ref", F.lit("N"))
    calls = cut(end_gates(found).where(F.length("alt") >= 5))
    target = F.col("sample").isin(targets)
    return genotyped(calls, cut(sample_genotypes(calls, features)), target, R.depth_stats(pile))
