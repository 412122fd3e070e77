"""From evidence edges to typed calls: edge and node tables, components, the best breakpoint of each, counters, types and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.operators.graph import connected_components
from breakwater.operators.reads import EVIDENCE
from breakwater.plans.lineage import cut

#: Sums of evidence letters, each with its weight.
COUNTERS = {
    "ss": "MAR", "split": "SVZ", "far": "HM", "everted": "X", "internal_del": "D", "del": "HDS", "ins": "IRL", "inv": "MARV", "dup": "ZSX",
    "tra": "HDSSIRLMAVXZ", "total": "HDSIRLMAVVXZ",
}


def letters(text: str) -> Column:
    out = F.lit(0).cast("long")
    for c in text:
        out = out + F.col(c)
    return out


def evidence_edges(evidence: DataFrame) -> DataFrame:
    """One row per edge with a count for each kind of evidence."""
    return evidence.groupBy("seqid", "lpos", "rpos").agg(*(F.count_if(F.col("evidence") == c).alias(c) for c in EVIDENCE))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from both its nodes: ``seqid, pos, other`` and the counts."""
    end = F.explode(F.array(F.struct(F.col("lpos").alias("pos"), F.col("rpos").alias("other")), F.struct(F.col("rpos").alias("pos"), F.col("lpos").alias("other")))).alias("e")
    return edges.select("seqid", end, *EVIDENCE).select("seqid", "e.pos", "e.other", *EVIDENCE)


def nodes(edges: DataFrame) -> DataFrame:
    """Degree and support (the sum of all evidence) of each node."""
    return edge_ends(edges).groupBy("seqid", "pos").agg(F.count("*").alias("degree"), F.sum(letters(EVIDENCE)).alias("support"))


def sample_support(evidence: DataFrame) -> DataFrame:
    """How often each sample touches each node."""
    return evidence.select("sample", "seqid", F.explode(F.array("lpos", "rpos")).alias("pos")).groupBy("seqid", "pos", "sample").agg(F.count("*").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """``seqid, pos, component, size``: the component is its smallest node's place."""
    key = lambda p: F.struct(F.col("seqid").alias("seqid"), F.col(p).alias("pos"))
    found = connected_components(edges.select(key("lpos").alias("a"), key("rpos").alias("b")))
    found = found.select("node.seqid", "node.pos", F.col("component.pos").alias("component"))
    sizes = found.groupBy("seqid", "component").agg(F.count("*").alias("size"))
    return found.join(sizes, ["seqid", "component"]).select("seqid", "pos", "component", "size")


def best_breakpoints(edges: DataFrame, node_table: DataFrame, comps: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """The edge of the greatest support of both its nodes in each component of ``least`` to ``most`` nodes; ties: the smallest."""
    own = comps.where(F.col("size").between(least, most)).join(node_table, ["seqid", "pos"]).select("seqid", "pos", "component", "size", "support", "degree")
    left = own.select("seqid", F.col("pos").alias("lpos"), "component", "size", F.col("support").alias("lsupport"))
    right = own.select("seqid", F.col("pos").alias("rpos"), F.col("support").alias("rsupport"))
    scored = edges.select("seqid", "lpos", "rpos").join(left, ["seqid", "lpos"]).join(right, ["seqid", "rpos"]).withColumn("score", F.col("lsupport") + F.col("rsupport"))
    best = scored.groupBy("seqid", "component").agg(F.max("score").alias("score"), F.first("size").alias("size"), F.max_by(F.struct("lpos", "rpos"), F.struct(F.col("score"), -F.col("lpos"), -F.col("rpos"))).alias("edge"))
    return best.select("seqid", "component", "size", "score", F.col("edge.lpos").alias("lpos"), F.col("edge.rpos").alias("rpos"))


def touching(best: DataFrame, edges: DataFrame) -> DataFrame:
    """The different edges that touch a call's nodes, with the node they touch (``at``) and the other end."""
    ends = edge_ends(edges)
    nodes_ = best.select("seqid", "component", "lpos", "rpos", F.explode(F.array("lpos", "rpos")).alias("pos"))
    return nodes_.join(ends, ["seqid", "pos"])


def support_counts(best: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the counters over the different edges touching either node."""
    touch = touching(best, edges).where("NOT (pos = rpos AND other = lpos)")  # the chosen edge itself counts once
    sums = touch.groupBy("seqid", "component").agg(*(F.sum(letters(v)).alias(f"n_{k}") for k, v in COUNTERS.items()))
    return best.join(sums, ["seqid", "component"])


def sv_type() -> Column:
    """D, replaced by U, V and I in turn where their count is strictly greater (T needs edges between contigs, which are left out)."""
    best, kind = F.col("n_del"), F.lit("D")
    for name, letter in (("dup", "U"), ("inv", "V"), ("ins", "I")):
        kind = F.when(F.col(f"n_{name}") > best, letter).otherwise(kind)
        best = F.greatest(best, F.col(f"n_{name}"))
    return kind


def type_weights() -> dict[str, Column]:
    total = F.col("n_del") + F.col("n_dup") + F.col("n_inv") + F.col("n_ins") + F.col("n_tra")
    return {f"w_{k}": F.try_divide(F.col(f"n_{k}"), total) for k in ("del", "dup", "inv", "ins", "tra")}


def cluster_fractions(calls: DataFrame, edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """Adds ``cluster_frac`` and ``avg_dist`` of the type's cluster check (0 where there is none).

    Deletions: far edges that reach beyond the other node; only agreeing ones are counted, so the fraction is 0 or 1. Duplications:
    everted edges to leaves agree when nearer to the right node; no distance is kept. Inversions: same-strand edges to leaves within
    the call agree when nearer to the opposite node; edges with A but no R are skipped.
    """
    key = calls.select("seqid", "component", "lpos", "rpos", "type")
    touch = touching(key.drop("type"), edges).join(key.select("seqid", "component", "type"), ["seqid", "component"])
    degrees = node_table.select("seqid", F.col("pos").alias("other"), F.col("degree").alias("leaf"))
    touch = touch.join(degrees, ["seqid", "other"]).join(degrees.select("seqid", F.col("other").alias("pos"), F.col("leaf").alias("own")), ["seqid", "pos"])
    left, leaf = F.col("pos") == F.col("lpos"), F.col("leaf") == 1
    to_left, to_right = F.abs(F.col("other") - F.col("lpos")), F.abs(F.col("other") - F.col("rpos"))
    beyond = F.when(left, F.col("other") > F.col("rpos")).otherwise(F.col("other") < F.col("lpos")) & (F.col("H") > 0)
    # The right node, if it is a leaf, also votes for itself through the call's own edge.
    itself = ~left & (F.col("other") == F.col("lpos")) & ~leaf & (F.col("own") == 1) & (F.col("X") > 0)
    dup = leaf & (F.col("X") > 0)
    same = F.col("R") + F.col("A") + F.col("M")
    within = F.when(left, (F.col("other") >= F.col("lpos")) & (F.col("other") <= F.col("rpos"))).otherwise((F.col("other") > F.col("lpos")) & (F.col("other") < F.col("rpos")))
    inv = leaf & ~((F.col("R") == 0) & (F.col("A") > 0)) & within
    agrees = F.when(left, to_right < to_left).otherwise(to_right > to_left)
    kind = F.col("type")
    yes = F.when(kind == "D", F.when(beyond, F.col("H"))).when(kind == "U", F.when((dup & (to_right < to_left)) | itself, F.col("X"))).when(kind == "V", F.when(inv & agrees, same))
    no = F.when(kind == "U", F.when(dup & (to_right >= to_left), F.col("X"))).when(kind == "V", F.when(inv & ~agrees, same))
    far = F.when(kind == "D", F.when(beyond, F.when(left, to_right).otherwise(to_left))).when(kind == "V", F.when(inv & agrees, to_right))
    sums = touch.groupBy("seqid", "component").agg(F.coalesce(F.sum(yes), F.lit(0)).alias("y"), F.coalesce(F.sum(no), F.lit(0)).alias("n"), F.avg(far).alias("d"))
    out = calls.join(sums, ["seqid", "component"], "left")
    return out.withColumns({"cluster_frac": F.coalesce(F.try_divide("y", F.col("y") + F.col("n")), F.lit(0.0)), "avg_dist": F.coalesce("d", F.lit(0.0))}).drop("y", "n", "d")


def passes_checks() -> Column:
    """The type's own check on counts, cluster fraction and length."""
    cf, length = F.col("cluster_frac"), F.col("rpos") - F.col("lpos")
    n = lambda k: F.col(f"n_{k}")
    d = ((cf > 0.1) & (n("far") > 1) & (n("del") > 1)) | ((n("internal_del") > 2) & (n("split") > 2))
    u = ((cf > 0.1) & (n("everted") > 1) & (n("dup") > 1)) | ((n("split") > 3) & (length < 500))
    v = ((cf > 0.1) & (n("ss") > 2) & (n("inv") > 2)) | ~((length < 500) & ((n("ss") < 3) | (n("inv") < 3) | (n("split") < 1)))
    return F.when(F.col("type") == "D", d).when(F.col("type") == "U", u).when(F.col("type") == "V", v).when(F.col("type") == "I", n("ins") > 4).otherwise(F.lit(False))


def typed_calls(edges: DataFrame, node_table: DataFrame, comps: DataFrame) -> DataFrame:
    best = cut(best_breakpoints(edges, node_table, comps))  # few rows, read by every step that follows
    return cluster_fractions(support_counts(best, edges).withColumn("type", sv_type()), edges, node_table).withColumns(type_weights())


def emitted(calls: DataFrame, least: int = 3) -> DataFrame:
    """Calls that pass their checks with a total support of ``least`` or more."""
    return calls.where(passes_checks() & (F.col("n_total") >= least))


def terminal_first(calls: DataFrame, node_table: DataFrame) -> DataFrame:
    """Calls with ``start`` and ``other``, their left and right nodes; of an insertion the node of more edges comes first."""
    degree = lambda c: node_table.select("seqid", F.col("pos").alias(c), F.col("degree").alias(f"__{c}"))
    both = calls.join(degree("lpos"), ["seqid", "lpos"]).join(degree("rpos"), ["seqid", "rpos"])
    turned = (F.col("type") == "I") & (F.col("__rpos") > F.col("__lpos"))
    return both.withColumns({"start": F.when(turned, F.col("rpos")).otherwise(F.col("lpos")), "other": F.when(turned, F.col("lpos")).otherwise(F.col("rpos"))}).drop("__lpos", "__rpos")


def weighted_neighbours(edges: DataFrame) -> DataFrame:
    """The mean place of each node's neighbours, weighted by their far pairs (H); null without such pairs."""
    return edge_ends(edges).groupBy("seqid", "pos").agg(F.try_divide(F.sum(F.col("other") * F.col("H")), F.sum("H")).alias("mean_other"))


def contig_counts(best: DataFrame) -> DataFrame:
    """Breakpoints of each contig."""
    return best.groupBy("seqid").agg(F.count("*").alias("n"))


def call_samples(calls: DataFrame, support: DataFrame) -> DataFrame:
    """Adds the support of each sample over both nodes (``by_sample``) and the sorted sample names (``tags``)."""
    touch = calls.select("seqid", "component", F.explode(F.array("lpos", "rpos")).alias("pos")).join(support, ["seqid", "pos"])
    sums = touch.groupBy("seqid", "component", "sample").agg(F.sum("n").alias("n"))
    maps = sums.groupBy("seqid", "component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "n")))).alias("by_sample"))
    return calls.join(maps, ["seqid", "component"], "left").withColumn("tags", F.array_join(F.map_keys("by_sample"), ","))
