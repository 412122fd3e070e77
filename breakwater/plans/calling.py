"""The workflow from alignments to emitted calls with each sample's support, as one plan with its edges written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.operators import calls as K
from breakwater.operators import reads as R
from breakwater.operators.callsets import merge_calls
from breakwater.operators.skew import broadcast_small
from breakwater.plans.lineage import cut

#: Names of call types.
TYPES = {"D": "DEL", "U": "DUP", "V": "INV", "I": "INS", "T": "BND"}


def prepare(alignments: DataFrame, samples: DataFrame) -> DataFrame:
    """Alignments of a reader as the operators take them: sample and mate, the contig's name as its id, mismatches and hits from tags.

    ``samples`` (file, sample) has one row a file; a file without a sample stands for itself.
    """
    named = alignments.join(broadcast_small(samples.select("file", F.col("sample").alias("__sample"))), "file", "left")
    mate = F.when(F.col("flag").bitwiseAND(F.lit(0x40)) != 0, 1).when(F.col("flag").bitwiseAND(F.lit(0x80)) != 0, 2)
    extra = {"sample": F.coalesce("__sample", "file"), "mate": mate, "ref_id": F.col("ref"), "mate_ref_id": F.col("mate_ref"), "nm": F.col("tags")["NM"].cast("int"), "xa": F.col("tags")["XA"]}
    return named.withColumns(extra).drop("__sample", "ref", "mate_ref")


def pairs_of(kept: DataFrame, hits: bool = True) -> DataFrame:
    """Mate pairs of filtered reads; only what the pair operators read takes part in the shuffle (mismatches and other hits with ``hits``)."""
    return R.mate_pairs(kept.select("sample", "read_name", "mate", "ref_id", "pos", "end_pos", "mapq", "flag", "front", "front_len", "back", "back_len", "matched", "read_len", "reverse", "insert_size", *(["nm", "xa"] if hits else [])))


def evidence_of(alignments: DataFrame, contigs: DataFrame, most_mismatches: int = 10, quality: int = 20, matched: int = 100, tag: str = "SA", library: DataFrame | None = None) -> DataFrame:
    """Evidence edges of prepared alignments: pairs, operations within reads and splits (in ``tag``).

    A pair needs a mate of ``quality`` and ``matched`` bases that match. ``library`` are the alignments that tell template lengths if these
    are not all of them.
    """
    kept = R.with_cigar(R.graph_read_filter(alignments))
    pairs = pairs_of(kept)
    few = lambda r: (F.coalesce(r["nm"], F.lit(0)) <= most_mismatches) & R.few_hits(r["xa"])
    good = R.filtered_pairs(pairs, good=quality, matched=matched).where(few(F.col("r1")) & few(F.col("r2")))
    classes = R.insert_classes(good, R.library_stats(alignments if library is None else library))
    splits = R.split_edges(kept, contigs.select(F.col("name").alias("ref_id"), "name").distinct(), most_mismatches, tag=tag)
    return R.insert_edges(classes).unionByName(R.indel_edges(kept)).unionByName(splits)


def call_variants(evidence: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls with ``start, other, by_sample`` and ``tags``, edges, components) of evidence edges."""
    evidence = cut(evidence)
    edges = cut(K.evidence_edges(evidence))
    comps = cut(K.components(edges))
    points = K.nodes(edges)
    called = K.terminal_first(K.emitted(K.typed_calls(edges, points, comps), least), points)
    return K.call_samples(called, K.sample_support(evidence)), edges, comps


def merged_cohort(alignments: DataFrame, contigs: DataFrame, names: list[str], gap: int = 5, **options) -> DataFrame:
    """Each sample called on its own, then all samples' calls merged: the workflow of one call set a sample, sorted and merged.

    ``names`` is the list of samples, a plan each; their calls are written once each, and only calls meet.
    """
    found = None
    for name in names:
        calls, *_ = call_variants(evidence_of(alignments.where(F.col("sample") == name), contigs, **options))
        kind = F.element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.col("type"))
        own = cut(calls.select(
            "seqid", (F.col("lpos") + 1).alias("five"), (F.col("rpos") + 1).alias("three"), kind.alias("svtype"), F.concat_ws(":", F.lit(name), F.col("lpos").cast("string"), F.col("rpos").cast("string")).alias("id"), F.col("n_total").alias("support"), F.col("n_total").alias("left_support"), F.lit(0).cast("long").alias("right_support"),
            F.lit("N").alias("base"), F.array(F.lit(name)).alias("lid"), F.array(F.lit(name)).alias("rid"), F.lit(0).cast("long").alias("merged"), F.lit(0).cast("long").alias("refined"),
        ))
        found = own if found is None else found.unionByName(own)
    return merge_calls(found, gap, more=True)
