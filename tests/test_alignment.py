"""Consensus, alignment, likelihoods, the forest and the graph sink on hand-made cases."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from breakwater import catalog
from breakwater.operators import alignment as A
from breakwater.operators import forest
from breakwater.sources.sinks import dot_graphs


def test_consensus(spark):
    cases = [([], ".", "."), (["ACGT"], "ACGT", "ACGT"), (["ACGT", "ACGA"], "ACGN", "ACGN"), (["ACG", "ACGTT", None, ""], "ACGTT", "ACNNN"), (None, ".", ".")]
    df = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(cases)], "k int, clips array<string>")
    out = df.select("k", A.consensus(F.col("clips")).alias("a"), A.consensus(F.col("clips"), True).alias("b")).orderBy("k").collect()
    assert [r.a for r in out] == [a for _, a, _ in cases]
    assert out[2].b == "ACGN" and out[3].b == "AC" "NNN"
    assert df.select(A.n_count(F.lit("ANNG")).alias("n")).first().n == 2


def brute(q, r, match=2, mismatch=2, go=3, ge=1):
    n, m = len(q), len(r)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        gaps = [h[i - k][j] - go - (k - 1) * ge for k in range(1, i + 1)] + [h[i][j - k] - go - (k - 1) * ge for k in range(1, j + 1)]
        h[i][j] = max(0, h[i - 1][j - 1] + (match if q[i - 1] == r[j - 1] else -mismatch), *gaps)
    top = max(map(max, h))
    if not top:
        return 0, -1, -1
    j = min(j for j in range(m + 1) if any(h[i][j] == top for i in range(n + 1)))
    return top, min(i for i in range(n + 1) if h[i][j] == top) - 1, j - 1


def test_alignment_is_the_full_matrix():
    r = random.Random(3)
    for _ in range(150):
        q, t = ("".join(r.choice("ACG") for _ in range(r.randint(1, 14))) for _ in range(2))
        score, rb, re, qb, qe, wrong, deleted, inserted = A.align(q, t)
        assert (score, qe, re) == brute(q, t)
        if score:
            matched = (qe - qb + 1) - inserted - wrong
            assert matched == (re - rb + 1) - deleted - wrong
            assert score <= 2 * matched - 2 * wrong


def test_alignment_finds_a_deletion(spark):
    r = random.Random(5)
    ref = "".join(r.choice("ACGT") for _ in range(120))
    query = ref[20:50] + ref[58:95]
    df = spark.createDataFrame([(query, ref), (None, ref), ("ACGT", "")], "q string, r string")
    rows = df.select(A.local_alignment()("q", "r").alias("x"), F.lit(1000).alias("pos"), F.lit(1200).alias("end")).withColumn("y", A.refined_end(F.col("pos"), F.col("end"), F.col("x"))).collect()
    assert (rows[0].x.ref_begin, rows[0].x.ref_end, rows[0].x.deleted, rows[0].x.mismatches) == (20, 94, 8, 0)
    assert (rows[0].y.kind, rows[0].y.end) == ("DEL", 820)
    assert rows[1].x.score == rows[2].x.score == 0 and rows[1].y.end == 1200


def test_pair_hmm(spark):
    def forward(hap, read, quals):
        n, m = len(read) + 1, len(hap) + 1
        M, I, D = ([[0.0] * m for _ in range(n)] for _ in range(3))
        D[0] = [1 / m] * m
        for i in range(1, n):
            e = 10 ** (-(ord(quals[i - 1]) - 33) / 10)
            for j in range(1, m):
                p = 1 - e if hap[j - 1] == read[i - 1] or "N" in (hap[j - 1], read[i - 1]) else e
                M[i][j] = p * (M[i - 1][j - 1] * 10**A.MATCH_MATCH + (I[i - 1][j - 1] + D[i - 1][j - 1]) * 10**A.GAP_MATCH)
                I[i][j] = M[i - 1][j] * 10**A.MATCH_GAP + I[i - 1][j] * 10**A.GAP_GAP
                D[i][j] = M[i][j - 1] * 10**A.MATCH_GAP + D[i][j - 1] * 10**A.GAP_GAP
        return math.log10(sum(2 * M[-1][j] + I[-1][j] + D[-1][j] for j in range(1, m)))

    cases = [("ACGTACGTAC", "GTACG", "IIIII"), ("ACGTNCGTAC", "GTTCG", "I5I#I"), ("AAAA", "AAAA", "##5I")]
    for case in cases:
        assert A.pair_hmm(*case) == pytest.approx(forward(*case), abs=1e-9)
    got = [r.p for r in spark.createDataFrame([*cases, ("ACGT", "AC", None)], "h string, r string, q string").select(A.pair_likelihood("h", "r", "q").alias("p")).collect()]
    assert got[:3] == pytest.approx([forward(*c) for c in cases], abs=1e-9) and got[3] is None


def test_forest(spark):
    rows = spark.createDataFrame([([float(k % 7), float(k % 2), 0.5], "DEL" if k % 2 else "DUP") for k in range(200)] + [(None, "DEL"), ([1.0, 1.0, 1.0], None)], "features array<double>, label string")
    f = forest.train_forest(rows, trees=10)
    assert f.classes == ["DEL", "DUP"] and f.importances[1] > 0.9
    got = forest.score_forest(rows, f, least=0.6).collect()
    assert all(r.wc == r.label for r in got if r.features and r.label) and [r.wc for r in got if not r.features] == [None]
    assert forest.score_forest(rows, f, least=1.1).where("wc = 'UKN'").count() == 201


def test_dot_graphs(spark):
    edges = spark.createDataFrame([(1, 10, 20, 2, 0), (1, 20, 30, 0, 1), (2, 5, 5, 1, 0)], "seqid int, lpos long, rpos long, H long, X long")
    parts = spark.createDataFrame([(1, 10, 10), (1, 20, 10), (1, 30, 10), (2, 5, 5)], "seqid int, pos long, component long")
    got = {(r.seqid, r.component): r.dot for r in dot_graphs(edges, parts).collect()}
    assert got[1, 10].startswith("graph {\n") and got[1, 10].endswith("}\n") and got[1, 10].count("--") == 4
    assert "1.10 -- 1.20" in got[1, 10] and "1.20 -- 1.10" in got[1, 10] and "--" not in got[2, 5]


SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def forward(hap, read, quals):
    """The likelihood by the plain three-state recursion."""
    n, m = len(read) + 1, len(hap) + 1
    M, I, D = ([[0.0] * m for _ in range(n)] for _ in range(3))
    D[0] = [1 / m] * m
    for i in range(1, n):
        e = 10 ** (-(ord(quals[i - 1]) - 33) / 10)
        for j in range(1, m):
            p = 1 - e if hap[j - 1] == read[i - 1] or "N" in (hap[j - 1], read[i - 1]) else e
            M[i][j] = p * (M[i - 1][j - 1] * 10**A.MATCH_MATCH + (I[i - 1][j - 1] + D[i - 1][j - 1]) * 10**A.GAP_MATCH)
            I[i][j] = M[i - 1][j] * 10**A.MATCH_GAP + I[i - 1][j] * 10**A.GAP_GAP
            D[i][j] = M[i][j - 1] * 10**A.MATCH_GAP + D[i][j - 1] * 10**A.GAP_GAP
    return math.log10(sum(2 * M[-1][j] + I[-1][j] + D[-1][j] for j in range(1, m)))


@tables
def test_alignment_query_rows(spark):
    """Every row of the queries without SQL is the plain recursion's."""
    bases = lambda c: F.expr(catalog._BASES.format(c))
    part = catalog.table(spark, SF, "part")
    texts = {r.p_partkey: r for r in part.select("p_partkey", bases("p_name").alias("q"), bases("concat(p_type, p_name, p_brand)").alias("w"), bases("concat(p_type, p_name)").alias("hap"), bases("p_type").alias("read")).collect()}
    for r in catalog.QUERIES["sw_align"](spark, SF).collect():
        assert (r.score, r.query_end, r.ref_end) == brute(texts[r.p_partkey].q, texts[r.p_partkey].w)
    got = catalog.QUERIES["pair_hmm"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.p_partkey]
        assert r.log10_likelihood == pytest.approx(forward(t.hap, t.read, "I" * len(t.read)), abs=2e-6)


@tables
def test_forest_query_learns_the_rule(spark):
    rows = catalog.QUERIES["rf_classify"](spark, SF).collect()
    assert len(rows) == catalog.table(spark, SF, "customer").count() and sum(r.wc == r.label for r in rows) > 0.97 * len(rows)
