"""Order over ranges, exact deviations, natural breaks and special functions against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.functions import special as X
from breakwater.functions.scalar import sample_deviation
from breakwater.operators import breaks, callsets, ranges
from breakwater.operators.intervals import _dealt, islands, points_in_intervals
from breakwater.operators.skew import broadcast_small


def calls(n, contigs, seed):
    r = random.Random(seed)
    return [(r.randrange(contigs), v := r.randrange(4 * n), v + r.randrange(60), r.choice(["DEL", "DUP"]), k, r.randrange(5)) for k in range(n)]


def plain_islands(rows, gap=5):
    out, last, island = {}, None, 0
    for row in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3], x[4])):
        if not (last and last[0] == row[0] and row[1] - last[1] < gap and row[2] - last[2] < gap):
            island += 1
        out[row[4]], last = island, row
    return out


@pytest.mark.parametrize("contigs", [1, 3])
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_islands_over_borders(spark, contigs, parts):
    rows = calls(400, contigs, parts)
    df = spark.createDataFrame(rows, "seqid long, five long, three long, svtype string, id long, support long").repartition(3)
    got = islands(df, "seqid", "five", "three", 5, ["svtype", "id"], parts)
    assert {r.id: r.island for r in got.collect()} == plain_islands(rows)
    if parts > 1:  # one contig is no longer one task
        assert ranges.ranged(df, ["seqid", "five", "three"], parts).select("__part").distinct().count() == parts


def test_hot_bins_are_dealt(spark):
    """Bins with a third of the spans, of the points, and of both: every pair once, and no key keeps a hot bin."""
    r = random.Random(6)
    points = [(r.choice(["a", "b", None]), r.randrange(20_000), k) for k in range(300)]
    points += [("p", 700, 300 + k) for k in range(150)] + [("both", 40 + k % 5, 450 + k) for k in range(150)] + [("s", 777, 600), ("s", None, 601)]
    spans = [(r.choice(["a", "b", None]), v := r.randrange(20_000), v + r.randrange(1500), k) for k in range(300)]
    spans += [("s", 700 - k % 9, 790, 300 + k) for k in range(150)] + [("both", 38, 40 + k % 6, 450 + k) for k in range(150)] + [("p", 600, 1100, 600), ("p", None, 5, 601)]
    a = spark.createDataFrame(points, "k string, at long, p long").withColumn("more", F.create_map(F.lit("x"), "p"))
    b = spark.createDataFrame(spans, "k string, low long, high long, s long")
    want = sorted((p[2], s[3]) for p in points for s in spans if p[0] and p[0] == s[0] and None not in (p[1], s[1]) and s[1] <= p[1] <= s[2])
    for least in (40, 10_000):
        got = points_in_intervals(a, b, ["k"], "at", "low", "high", share=20, parts=16, least=least)
        assert got.columns == ["k", "at", "p", "more", "low", "high", "s"] and sorted((x.p, x.s) for x in got.collect()) == want
    near = [df.withColumn("__bin", F.floor(F.col(c) / 1000)) for df, c in ((a, "at"), (b, "low"))]
    for df, at in zip(_dealt(*near, ["k", "__bin"], 20, 16, 40)[:2], (150, 150), strict=True):
        assert max(x["count"] for x in df.groupBy("k", "__bin", "__row", "__column").count().collect()) < at / 2
    assert points_in_intervals(a.where("false"), b, ["k"], "at", "low", "high").count() == 0


def test_only_small_lists_are_broadcast(spark):
    reads, contigs = spark.range(50).withColumn("ref_id", F.col("id") % 7), spark.range(5).select(F.col("id").alias("ref_id"))
    kinds = []
    for most in (5, 4):
        out = reads.join(broadcast_small(contigs, most), "ref_id", "left_semi")
        assert sorted(r.id for r in out.collect()) == [k for k in range(50) if k % 7 < 5]
        kinds.append("BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString())
    assert kinds == [True, False]


def test_place_of_many_reads(spark):
    """A place that 60,000 of 100,000 reads cover has the counters of any other."""
    reads = spark.range(100_000).select(F.lit(1).alias("ref_id"), F.when(F.col("id") < 60_000, 5_000).otherwise(F.col("id") * 10).alias("pos"), "id").withColumn("end_pos", F.col("pos") + 99)
    places = spark.range(40).select(F.lit(1).alias("ref_id"), (F.lit(4_990) + F.col("id")).alias("bp"))
    piled = points_in_intervals(places, reads, ["ref_id"], "bp", "pos", "end_pos")
    assert {(x.bp, x["count"]) for x in piled.groupBy("bp").count().collect()} == {(5_000 + k, 60_000) for k in range(30)}
    assert "__row" in points_in_intervals(places, reads, ["ref_id"], "bp", "pos", "end_pos")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_over_all(spark, parts):
    rows = calls(300, 4, 8)
    df = spark.createDataFrame(rows, "seqid long, five long, three long, svtype string, id long, support long")
    got = ranges.numbered(df, ["seqid", "five", "id"], parts=parts).collect()
    order = [x[4] for x in sorted(rows, key=lambda x: (x[0], x[1], x[4]))]
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == order and sorted(r.number for r in got) == list(range(1, 301))
    assert ranges.numbered(df.where("false"), ["seqid", "five", "id"], parts=parts).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_deviations_are_exact(spark, parts):
    """Four places whose variance is exactly 625 far from zero: 1.96 * 25 is 49, whatever the order of rows."""
    values = [280695, 280720, 280745, 280720, 280720] + [280720 + d for d in (-25, 25, -25, 25)]
    exact = [280720 - 25, 280720 + 25, 280720 - 25, 280720 + 25]
    sd = float(np.std(exact, ddof=0))
    df = spark.createDataFrame([(g, v) for g in range(40) for v in (values if g % 2 else [280720 + 25 * k for k in (-1, 1)])], "g int, v long").repartition(parts)
    got = df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).select("g", sample_deviation(F.col("n"), F.col("s"), F.col("q")).alias("sd"))
    n = len(values)
    want = math.sqrt((n * sum(v * v for v in values) - sum(values) ** 2) / (n * (n - 1)))
    assert sd == 25 and {r.sd for r in got.where("g % 2 = 1").collect()} == {want} and {r.sd for r in got.where("g % 2 = 0").collect()} == {math.sqrt(1250)}


def test_merged_calls_are_the_same_in_any_parts(spark):
    rows = calls(500, 2, 3)
    df = spark.createDataFrame(rows, "seqid long, five long, three long, svtype string, id long, support long")
    results = [sorted(map(tuple, callsets.merge_calls(df.repartition(k)).collect())) for k in (1, 7)]
    assert results[0] == results[1]


def test_natural_breaks(spark):
    r = random.Random(2)
    for trial in range(25):
        values = [r.choice([1, 2, 3, 10, 11, 30]) + r.randrange(3) for _ in range(r.randrange(1, 40))]
        v, n = np.unique(np.array(values, float), return_counts=True)
        for k in (1, 2, 3, 4):
            cost = lambda b: sum((n[i:j] * (v[i:j] - np.average(v[i:j], weights=n[i:j])) ** 2).sum() for i, j in itertools.pairwise([*b, len(v)]))
            got = breaks.best_classes(v, n.astype(float), k)
            best = min(cost((0, *b)) for b in itertools.combinations(range(1, len(v)), min(k, len(v)) - 1))
            assert len(got) == min(k, len(v)) and abs(cost(got) - best) < 1e-9, (trial, k)
    df = spark.createDataFrame([("a", x) for x in [1.0, 1.0, 2.0, 9.0, 10.0, 10.0, 50.0]] + [("b", 5.0), ("b", None), ("b", float("nan")), (None, 1.0), (None, 7.0)], "g string, v double")
    got = sorted(((r.g or "", r["class"], r.low, r.high, r.n) for r in breaks.natural_breaks(df, ["g"], "v", 3).collect()))
    assert got == [("", 1, 1.0, 1.0, 1), ("", 2, 7.0, 7.0, 1), ("a", 1, 1.0, 2.0, 3), ("a", 2, 9.0, 10.0, 3), ("a", 3, 50.0, 50.0, 1), ("b", 1, 5.0, 5.0, 1)]


def test_special_functions(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.5, 2.0, 2.4999, 2.5, 3.0, 4.0, 6.0, 9.0, 20.0, -0.3, -1.7, -2.5, -3.3, -8.0]
    close = lambda a, b: abs(a - b) <= 1e-12 * max(1e-300, abs(b)) or a == b
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", X.erf(F.col("x")).alias("e"), X.erfc(F.col("x")).alias("c"), X.normal_cdf(F.col("x")).alias("p"), X.normal_tail(F.col("x")).alias("q")).collect():
        assert close(r.e, math.erf(r.x)) and close(r.p, math.erfc(-r.x / math.sqrt(2)) / 2) and close(r.q, math.erfc(r.x / math.sqrt(2)) / 2), r
        assert abs(r.c - math.erfc(r.x)) <= 2e-12 * max(math.erfc(r.x), 1e-300), r
    ys = [1e-6, 0.01, 0.3, 0.9, 1.0, 1.4616321449683623, 2.0, 2.5, 7.0, 11.99, 12.0, 13.5, 100.0, 1e5, 1e12]
    df = spark.createDataFrame([(x,) for x in ys], "x double")
    digamma = lambda x: math.log(x) - 0.5 / x - sum(b / (2 * k) * x ** (-2.0 * k) for k, b in enumerate([1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66], 1)) if x > 50 else digamma(x + 1) - 1 / x
    for r in df.select("x", X.lgamma(F.col("x")).alias("g"), X.digamma(F.col("x")).alias("d")).collect():
        assert abs(r.g - math.lgamma(r.x)) < 1e-12 * max(1, abs(math.lgamma(r.x))) and abs(r.d - digamma(r.x)) < 1e-11 * max(1, abs(digamma(r.x))), r
    ws = [-1 / math.e, -0.36, -0.2, -1e-8, 0.0, 1e-7, 0.5, 1.0, math.e, 3.0, 10.0, 1e5, 1e100]
    df = spark.createDataFrame([(x,) for x in ws], "x double")
    for r in df.select("x", X.lambert_w(F.col("x")).alias("w")).collect():
        assert abs(r.w * math.exp(r.w) - r.x) <= 1e-12 * max(abs(r.x), 1e-3), r
    one = spark.range(1).select(X.lgamma(F.lit(-1.0)).alias("a"), X.lambert_w(F.lit(-1.0)).alias("b"), X.erf(F.lit(None).cast("double")).alias("c"), X.digamma(F.lit(0.0)).alias("d")).first()
    assert tuple(one) == (None, None, None, None)
