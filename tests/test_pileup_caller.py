"""The pileup caller: gapped consensus, reference windows, best ends, and the command from alignments to records."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.__main__ import run
from breakwater.operators import consensus as M
from breakwater.plans import piling
from breakwater.sources import fasta


def best_score(a, b, match, mismatch, gap_open, gap_extend):
    """Plain alignment of two texts anchored at their begin, with free ends, by all three states."""
    low = -(10**9)
    s = {(0, 0, "m"): 0}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        any_of = lambda i, j: max(s.get((i, j, k), low) for k in "mdi")
        if i and j:
            s[i, j, "m"] = any_of(i - 1, j - 1) + (match if a[i - 1] == b[j - 1] else -mismatch)
        if i:
            s[i, j, "i"] = max(max(s.get((i - 1, j, k), low) for k in "md") - gap_open, s.get((i - 1, j, "i"), low) - gap_extend)
        if j:
            s[i, j, "d"] = max(max(s.get((i, j - 1, k), low) for k in "mi") - gap_open, s.get((i, j - 1, "d"), low) - gap_extend)
    ends = [(len(a), j) for j in range(len(b) + 1)] + [(i, len(b)) for i in range(len(a) + 1)]
    return max(s.get((i, j, k), low) for i, j in ends for k in "mdi")


@pytest.mark.parametrize("seed", range(6))
def test_two_clips_align_best(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a = say(r.randrange(1, 40))
    b = list(a)
    for _ in range(r.randrange(4)):
        at = r.randrange(len(b) + 1)
        b[at : at + r.randrange(3)] = list(say(r.randrange(4)))
    b = "".join(b) or "A"
    counts = np.zeros((len(b), 256))
    counts[np.arange(len(b)), np.frombuffer(b.encode(), np.uint8)] = 1
    top, steps = M.profile_steps(np.frombuffer(a.encode(), np.uint8), counts, 5, 4, 11, 1)
    assert top == best_score(a, b, 5, 4, 11, 1)
    assert [i for i, _ in steps if i >= 0] == list(range(len(a))) and [j for _, j in steps if j >= 0] == list(range(len(b)))


def test_consensus_with_gaps():
    r = random.Random(1)
    base = "".join(r.choice("ACGT") for _ in range(60))
    clips = [base, base[:20] + base[22:50], base[:35] + "TT" + base[35:55], base[:44]]
    clips[2] = base[:35] + ("GG" if base[35] != "G" else "CC") + base[35:55]
    text, unclear = M.consensus_of(clips)
    assert unclear == 0 and text == clips[2][:37] + base[35:]  # two bases more in one clip, two fewer in another, no disagreement
    wrong = base[:10] + ("A" if base[10] != "A" else "C") + base[11:]
    assert M.consensus_of([base, wrong, base[:30]]) == (base[:10] + "N" + base[11:], 1)
    back = [c[::-1] for c in clips]
    assert M.consensus_of(back, from_end=True) == (text[::-1], 0)
    assert M.consensus_of([]) == (".", 0) and M.consensus_of([None, "", "ACG"]) == ("ACG", 0)
    assert M.consensus_of(["ACGTA", "ACG", "ACGT"]) == ("ACGTA", 0)
    lone = M.aligned_rows([b"ACGT", b"ACGT", b"ACG"])
    assert lone.tolist() == [list(b"ACGT"), list(b"ACGT"), [*b"ACG", 0]]


def test_place_consensus_takes_a_bounded_number_of_clips(spark):
    rows = [(1, 10, "f", "ACGTACGT"[k % 3 :], k, f"r{k:04}") for k in range(3000)] + [(1, 10, "b", "TTTT", 5, "x")] + [(2, 7, "b", "GGGAC", k, f"r{k}") for k in range(3)]
    clips = spark.createDataFrame(rows, "ref_id int, bp long, direction string, bases string, pos long, read_name string")
    directions = spark.createDataFrame([(1, 10, "f", 3000), (2, 7, "b", 3)], "ref_id int, bp long, direction string, n long")
    out = M.place_consensus(clips, directions)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 10, "f", 3000, "ACGTACGT", 0), (2, 7, "b", 3, "GGGAC", 0)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_windows_over_borders(spark, tmp_path):
    r = random.Random(3)
    first, second = "".join(r.choice("acgt") for _ in range(500)), "ggccA"
    (tmp_path / "x.fa").write_text(f">one\n{first}\n>two\n{second}\n")
    bins = fasta.read_fasta(spark, str(tmp_path / "x.fa"), 64)
    starts = [-30, 0, 1, 63, 64, 100, 450, 499, 500, 700, -200, None]
    places = spark.createDataFrame([("one", s) for s in starts] + [("one", 100), ("two", -2), ("zzz", 3)], "chrom string, at long")
    got = fasta.reference_windows(places, bins, "chrom", "at", 150, width=64).collect()
    cut = lambda s, a: (s[max(0, a) : max(0, a + 150)].upper() or None) if a is not None else None
    want = Counter([("one", s, cut(first, s)) for s in starts] + [("one", 100, cut(first, 100)), ("two", -2, cut(second, -2)), ("zzz", 3, None)])
    assert Counter((r.chrom, r.at, r.window) for r in got) == want


def plain_best(ends, zone):
    count = Counter((e + 5) // 10 * 10 for e, _ in ends)
    best = min(count, key=lambda b: (-count[b], abs(b - zone), b))
    if best == 0:
        return None
    near = [(e, s) for e, s in ends if abs(e - best) < 150]
    nearest = min((e for e, _ in ends), key=lambda e: (abs(e - best), e))
    raw = Counter(e for e, _ in ends if abs(e - nearest) <= 20)
    end = min(raw, key=lambda e: (-raw[e], e))
    spread = int(1.96 * float(np.std([e for e, _ in near], ddof=1))) if len(near) > 1 else 0
    return (end, end - spread, end + spread, *(sum(s == k for _, s in near) for k in ("mp", "sr", "xa")), len(near))


def test_best_ends(spark):
    r = random.Random(9)
    rows, zones, want = [], [], {}
    for bp in range(40):
        middle = r.choice([3, 700, 5000])
        ends = [(max(0, middle + r.choice([0, 0, 0, 4, 7, -160, 149, 150, 12, r.randrange(-300, 300)])), r.choice(["mp", "sr", "xa"])) for _ in range(r.randrange(1, 30))]
        zone = r.choice([middle, bp])
        rows += [(1, bp, e, s) for e, s in ends]
        zones.append((1, bp, zone))
        if (found := plain_best(ends, zone)) is not None:
            want[bp] = found
    ends = spark.createDataFrame(rows, "ref_id int, bp long, end long, source string")
    got = piling.best_ends(ends, spark.createDataFrame(zones, "ref_id int, bp long, zone long"))
    assert {x.bp: (x.end, x.low, x.high, x.n_mp, x.n_sr, x.n_xa, x.n_ends) for x in got.collect()} == want


def simulated(path, seed=5):
    """A reference of two contigs; pairs of one library, and a deletion of [5001, 7000) that clips and mates of half the reads show."""
    r = random.Random(seed)
    chrom = "".join(r.choice("ACGT") for _ in range(20000))
    (path / "ref.fa").write_text(f">chr1\n{chrom}\n>chr2\n{'ACGT' * 500}\n")
    head = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:20000", "@SQ\tSN:chr2\tLN:2000"]

    def pair(name, a, ca, seq_a, b, seq_b, flag=99):
        return [f"{name}\t{flag}\tchr1\t{a + 1}\t60\t{ca}\t=\t{b + 1}\t{b - a + 100}\t{seq_a}\t{'I' * len(seq_a)}\tNM:i:0", f"{name}\t{flag + 48}\tchr1\t{b + 1}\t60\t100M\t=\t{a + 1}\t{a - b - 100}\t{seq_b}\t{'I' * len(seq_b)}\tNM:i:0"]

    def library(sample, carrier, start):
        rows = []
        for k in range(200):
            a = start + 90 * k % 18000
            b = a + 300 + r.randint(-20, 20)
            rows += pair(f"{sample}{k}", a, "100M", chrom[a : a + 100], b, chrom[b : b + 100])
        for k in range(30):  # reads over the place without the deletion
            a = 4930 + k
            rows += pair(f"{sample}r{k}", a, "100M", chrom[a : a + 100], a + 300, chrom[a + 300 : a + 400])
        if carrier:
            for k in range(20):
                clip = 20 + k % 11
                a = 5001 - (100 - clip)
                b = 7100 + 4 * (k % 3)
                rows += pair(f"{sample}d{k}", a, f"{100 - clip}M{clip}S", chrom[a:5001] + chrom[7000 : 7000 + clip], b, chrom[b : b + 100])
        return rows

    for name, carrier in (("case", True), ("control", False)):
        body = sorted(library(name, carrier, 40), key=lambda x: int(x.split("\t")[3]))
        (path / f"{name}.sam").write_text("\n".join([*head, f"@RG\tID:x\tSM:{name}", *body]) + "\n")
    return chrom


def test_pileup_command(spark, tmp_path):
    chrom = simulated(tmp_path)
    args = ["pileup", "-t", str(tmp_path / "case.sam"), "-b", str(tmp_path / "control.sam"), "-f", str(tmp_path / "ref.fa")]
    run(spark, [*args, "-o", str(tmp_path / "calls")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "calls")).collect()]
    assert lines[0] == "##fileformat=VCFv4.1" and any(x.endswith("FORMAT\tcase\tcontrol") for x in lines)
    records = [x.split("\t") for x in lines if x[0] != "#"]
    assert [(x[0], x[1], x[3]) for x in records] == [("chr1", "5001", "N")]
    chr_, pos, _, ref, alt, _, _, info, form, case, control = records[0]
    said = dict(x.split("=") for x in info.split(";"))
    assert alt == chrom[7000:7030] and said["DI"] == "b" and said["CHR2"] == "chr1" and form == "GT:GL:NR:NA:NS:RD"
    assert 7100 <= int(said["END"]) <= 7110 and int(said["SVLEN"]) == int(said["END"]) - 5000 and said["SP"] == "20,0,0" and said["PU"] == said["NC"] == "20"
    assert len(said["AT"].split(",")) == 15 and said["GC"] == "1,1" and list(said)[:4] == ["LRT", "WAF", "GC", "AT"]
    assert case.split(":")[0] == "0/1" and case.split(":")[4] == "20" and control.split(":")[0] == "0/0"
    run(spark, [*args, "-o", str(tmp_path / "none"), "-r", "chr1:9000-9500", "-m", "2"])
    assert spark.read.text(str(tmp_path / "none")).where("value NOT LIKE '#%'").count() == 0


def test_refined_alleles(spark, tmp_path):
    """Reads with operations of their own: the local alignment of the consensus names the end, the length and the alleles."""
    r = random.Random(4)
    chrom = "".join(r.choice("ACGT") for _ in range(3000))
    sequences = spark.createDataFrame([("chr1", 0, chrom)], "name string, bin long, bases string")
    contigs = spark.createDataFrame([("chr1", "chr1"), ("chr2", "chr2")], "ref_id string, name string")
    row = lambda bp, alt, dels, ins, chr2="chr1": ("chr1", bp, chr2, 40, 39, 41, 5, alt, dels, ins)
    # consensus that stands 60 bases on, consensus after 7 new bases 30 bases on, neither, other contig, consensus before the place
    rows = [row(1000, chrom[1060:1100], 3, 0), row(1200, "A" * 7 + chrom[1230:1270], 0, 2), row(1400, chrom[1450:1490], 0, 0), row(1600, chrom[1650:1690], 2, 0, "chr2"), row(1800, chrom[1700:1740], 2, 0)]
    calls = spark.createDataFrame(rows, "ref_id string, bp long, chr2 string, other long, ci_low long, ci_high long, svlen long, alt string, n_deleted long, n_inserted long")
    got = {x.bp: x for x in piling.refined(calls, sequences, contigs).collect()}
    a = got[1000]
    assert (a.other, a.svlen, a.ci_low, a.ci_high, a.ref, a.alt) == (1060, 59, 1050, 1070, chrom[1000:1060], chrom[1000])
    b = got[1200]
    begin = 7 if chrom[1229] != "A" else None
    assert begin is None or (b.other, b.svlen, b.ref, b.alt) == (1230, 7, chrom[1199:1201], chrom[1199:1201] + "A" * 7)
    assert (got[1400].other, got[1400].svlen, got[1400].ref, got[1400].alt) == (40, 5, "N", chrom[1450:1490])
    assert (got[1600].other, got[1600].ref, got[1600].svlen) == (1650, "N", 5)
    assert got[1800].other == 0


def test_genotypes_need_clips_and_take_a_bounded_number_of_reads(spark):
    places = spark.createDataFrame([(1, 50)], "ref_id int, bp long")
    read = lambda k, sample, clip, same: (f"{sample}{k}", sample, 1, 50 if clip else 20, 120 if clip else 100, 30, 300, clip, False, 2 if clip else 0, True, same, False, False, False, clip)
    kind = "read_name string, sample string, ref_id int, pos long, end_pos long, mapq int, insert long, soft_front boolean, soft_back boolean, clips int, mapped_pair boolean, same_pair boolean, deviant boolean, far boolean, extra boolean, odd boolean"
    rows = [read(k, "two", k < 2, False) for k in range(4)] + [read(k, "one", k < 1, False) for k in range(4)] + [read(k, "same", False, k < 3) for k in range(4)] + [read(k, "deep", k < 900, False) for k in range(1500)] + [read(0, "lone", True, False)]
    got = {r["sample"]: r for r in piling.sample_genotypes(places, spark.createDataFrame(rows, kind)).collect()}
    assert (got["two"].gt, got["two"].n_good, got["two"].n_bad, got["two"].n_clip) == ("0/1", 2, 2, 2) and abs(got["two"].gl_ab + 4 * np.log(2)) < 1e-9
    assert (got["one"].gt, got["one"].n_bad) == ("0/0", 0) and (got["same"].gt, got["same"].n_bad) == ("0/0", 0)
    assert got["deep"].n_good + got["deep"].n_bad == 1001 and got["deep"].n_reads == 1500 and got["deep"].n_clip == 900
    assert (got["lone"].gt, got["lone"].gl_aa, got["lone"].n_good) == ("./.", -255.0, 0)
