import pytest
from pyspark.sql import functions as F

from breakwater.functions import cigar as C
from breakwater.functions import scalar as S
from breakwater.functions import special as X
from breakwater.operators.intervals import islands, points_in_intervals
from breakwater.operators.graph import connected_components


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cigar(spark):
    ops = C.parse_cigar(F.lit("10S90M2I5D"))
    r = one(spark, ops.alias("ops"), C.reference_span(ops).alias("span"), C.cigar_text(ops).alias("text"), C.long_clip(ops, 5).alias("clip"), C.match_bases(ops).alias("m"))
    assert [x.op for x in r.ops] == list("SMID") and (r.span, r.text, r.clip, r.m) == (95, "10S90M2I5D", True, 90)


def test_first_length_quirk(spark):
    r = one(spark, C.reference_span(C.parse_cigar(F.lit("50M5D45M10S"), True)).alias("quirk"), C.reference_span(C.parse_cigar(F.lit("50M5D45M10S"))).alias("right"))
    assert (r.quirk, r.right) == (150, 100)


def test_indels(spark):
    ops = C.parse_cigar(F.lit("15M30D60M"))
    r = one(spark, C.indels(F.lit(100), ops, parity=True).alias("quirk"), C.indels(F.lit(100), ops).alias("right"))
    assert [tuple(x) for x in r.quirk] == [(100, 130, "D")] and [tuple(x) for x in r.right] == [(115, 145, "D")]


def test_split_tags(spark):
    r = one(spark, C.parse_sa(F.lit("chr1,11,-,5S10M,30,2;")).alias("sa"), C.parse_sa(F.lit("nonsense")).alias("none"), C.parse_xa(F.lit("chr2,-21,10M,1;")).alias("xa"))
    assert (r.sa[0].pos, r.sa[0].reverse, r.sa[0].nm) == (10, True, 2) and r.none == [] and (r.xa[0].pos, r.xa[0].reverse) == (20, True)


def test_numbers(spark):
    r = one(spark, S.round_half_down(F.lit(2.5)).alias("h"), S.round_to_ten(F.lit(15)).alias("t"), S.log10_add(F.lit(-1.0), F.lit(-1.0)).alias("a"), X.normal_cdf(F.lit(1.96)).alias("p"), S.mean_quality(F.lit("II")).alias("q"))
    assert (r.h, r.t, r.q) == (2, 20, 40) and r.a == pytest.approx(-0.69897, abs=1e-5) and r.p == pytest.approx(0.975, abs=1e-4)


def test_kmers(spark):
    r = one(spark, S.pack_kmer(F.lit("ATGC")).alias("p"), S.unpack_kmer(S.pack_kmer(F.lit("GATTC")), 5).alias("u"), S.kmers(F.lit("ab"), 3).alias("none"))
    assert (r.p, r.u, r.none) == (0b00011011, "GATTC", [])


def test_islands(spark):
    rows = spark.createDataFrame([("a", 100, 200), ("a", 104, 203), ("a", 109, 300)], "seqid string, five int, three int")
    assert [r.island for r in islands(rows, "seqid", "five", "three", 5).orderBy("five").collect()] == [1, 1, 2]


def test_points_in_intervals_are_closed_and_once(spark):
    p = spark.createDataFrame([(1, 999), (1, 2000), (1, 2001), (2, 1500)], "k int, p int")
    s = spark.createDataFrame([(1, 999, 2000)], "k int, a int, b int")
    assert sorted(r.p for r in points_in_intervals(p, s, ["k"], "p", "a", "b", 500).collect()) == [999, 2000]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), *[(100 + k, 101 + k) for k in range(40)]], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{100 + k: 100 for k in range(41)}}
    assert connected_components(e.where("a < 0")).count() == 0
