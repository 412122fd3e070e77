"""What is summed before reads are laid over places says the same as the reads laid one by one."""

import random

from pyspark.sql import functions as F

from breakwater.operators import pileup as P

KIND = "read_name string, sample string, ref_id int, pos long, end_pos long, mapq int, insert long, clips int, " + ", ".join(f"{c} boolean" for c in ("mapped_pair", "same_pair", "deviant", "far", "extra", "odd", "extra_front", "extra_back", *P.FLAGS)) + ", inserted int, deleted int"


def features(spark, n=400, seed=3):
    """Reads of few names that overlap in many ways, across bins of 1000 too; an odd read is clipped or has an insertion."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        pos = r.choice([960, 990, 1000, 1990, 40]) + r.randrange(40)
        front, back, inserted = r.random() < 0.15, r.random() < 0.15, int(r.random() < 0.1)
        coin = lambda share=0.3: r.random() < share
        deviant = coin()
        flags = {c: coin() for c in P.FLAGS} | {"soft_front": front, "soft_back": back}
        rows.append((r.choice(["a", "b", "c", "d", "e", "f", None]), r.choice("xyz"), r.randrange(2), pos, pos + r.choice([0, 10, 60, 1200]), r.randrange(50), r.choice([0, 300]), r.randrange(4), coin(), coin(), deviant, deviant and coin(), coin(0.1), front or back or inserted > 0, coin(), coin(), *(flags[c] for c in P.FLAGS), inserted, 0))
    places = spark.createDataFrame([(ref, bp) for ref in range(2) for bp in range(30, 2100, 7)] + [(0, 1000), (1, 999)], "ref_id int, bp long").distinct()
    return places, spark.createDataFrame(rows, KIND)


def same(a, b):
    flat = lambda df: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.select(*sorted(a.columns)).collect())
    assert flat(a) == flat(b) and a.count() > 100


def test_span_evidence_is_that_of_reads(spark):
    places, reads = features(spark)
    each = P.read_evidence(P.pileup(places, reads))
    seen = P.span_evidence(places, P.evidence_spans(reads))
    same(P.sample_evidence(each), seen)
    by = ["ref_id", "bp", "sample"]
    same(P.genotype_likelihoods(each, by), P.span_likelihoods(seen, by))
    same(P.genotype_likelihoods(each.withColumn("alt", F.lit(False)), by), P.span_likelihoods(seen, by, F.lit(False)))


def test_equal_reads_are_laid_over_places_once(spark):
    places, reads = features(spark, 50)
    many = reads.crossJoin(spark.range(40)).drop("id")
    assert P.evidence_spans(many).count() <= P.evidence_spans(reads).count()
    assert P.stacked(many).count() == P.stacked(reads).count() and P.odd_spans(many).count() == P.odd_spans(reads).count()


def test_odd_names_over_places(spark):
    places, reads = features(spark)
    odd = [x for x in reads.collect() if x.odd]
    want = {(p.ref_id, p.bp): len({x.read_name for x in odd if x.ref_id == p.ref_id and x.pos <= p.bp <= x.end_pos}) for p in places.collect()}
    assert {(x.ref_id, x.bp): x.n_odd_names for x in P.odd_names(places, P.odd_spans(reads)).collect()} == {k: v for k, v in want.items() if v}


def test_stacked_counts(spark):
    places, reads = features(spark)
    piled = P.pileup(places, reads)
    got = P.pileup_counts(P.pileup(places, P.stacked(reads)), P.counted_more())
    same(P.pileup_counts(piled), got.select(*P.pileup_counts(piled).columns))
    want = {}
    for p in places.collect():
        over = [x for x in reads.collect() if x.ref_id == p.ref_id and x.pos <= p.bp <= x.end_pos] if p.bp in (1000, 999, 1003, 2001, 51) else []
        if over:
            clips = lambda f, b: len({x.pos for x in over if x[f]} | {x.end_pos for x in over if x[b]})  # noqa: E731, B023
            near = [q for x in over for q, on in ((x.pos, x.soft_front), (x.end_pos, x.soft_back)) if on and abs(q - p.bp) <= 50]
            own = [x for x in over if not x.extra]
            want[p.ref_id, p.bp] = (sum(x.far for x in own), sum(x.deviant and not x.far for x in own), sum(x.deviant and x.insert == 0 for x in own), clips("soft_front", "soft_back") + clips("extra_front", "extra_back"), len(near), sum(q - p.bp for q in near))
    rows = {(x.ref_id, x.bp): (x.n_far, x.n_close, x.n_zero, x.n_clusters, x.clips_near, x.clips_sum) for x in got.collect()}
    assert want and {k: rows[k] for k in want} == want
