"""The command line from text alignments to records."""

import random

import pytest

from breakwater.__main__ import run
from breakwater.operators import callsets
from breakwater.sources import text


def sam(path):
    r = random.Random(2)
    out = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:100000", "@SQ\tSN:chr2\tLN:100000", "@RG\tID:x\tSM:first"]
    pair = lambda name, a, ca, b, cb: [f"{name}\t99\tchr1\t{a}\t60\t{ca}\t=\t{b}\t{b - a + 100}\t{'A' * 100}\t{'I' * 100}\tNM:i:0", f"{name}\t147\tchr1\t{b}\t60\t{cb}\t=\t{a}\t{a - b - 100}\t{'A' * 100}\t{'I' * 100}\tNM:i:0"]
    for k in range(400):
        a = 20000 + 40 * k
        out += pair(f"n{k}", a, "100M", a + 300 + r.randint(-20, 20), "100M")
    for k in range(8):  # a deletion of 1000..3000, seen by clips before it and mates at three places after it
        out += pair(f"d{k}", 901 - k % 2, "80M20S", 3000 + (k % 3) * 40, "100M")
    path.write_text("\n".join(out) + "\n")


def test_call_stats_and_merge(spark, tmp_path):
    sam(tmp_path / "x.sam")
    run(spark, ["stats", "-f", str(tmp_path / "x.sam"), "-o", str(tmp_path / "stats")])
    stats = spark.read.csv(str(tmp_path / "stats"), sep="\t", header=True).collect()
    assert [(r["sample"], r["n"]) for r in stats] == [("first", "816")] and float(stats[0]["base_quality"]) == 40 and float(stats[0]["mean_depth"]) > 0
    run(spark, ["call", "-f", str(tmp_path / "x.sam"), "-o", str(tmp_path / "calls"), "-g", str(tmp_path / "graphs"), "-e", "chr2"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "calls")).collect()]
    assert sum(x.startswith("##INFO") for x in lines) > 15 and sum(x.startswith("#CHROM") and x.endswith("FORMAT\tfirst") for x in lines) == 1
    records = [x.split("\t") for x in lines if x[0] != "#"]
    assert len(records) == 1 and records[0][0] == "chr1" and records[0][4] == "<DEL>" and records[0][9].startswith(".:.:")
    assert "graph {" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "graphs")).collect())
    run(spark, ["merge", "-f", str(tmp_path / "calls"), "-o", str(tmp_path / "merged")])
    merged = [x.value.split("\t") for x in spark.read.text(str(tmp_path / "merged")).collect() if x.value[0] != "#"]
    assert len(merged) == 1 and merged[0][:2] == records[0][:2] and merged[0][4] == "<DEL>" and "COLLAPSED=1" in merged[0][7].split(";")
    run(spark, ["call", "-f", str(tmp_path / "x.sam"), "-o", str(tmp_path / "none"), "-r", "chr1:50000-60000"])
    assert spark.read.text(str(tmp_path / "none")).where("value NOT LIKE '#%'").count() == 0


def test_cohort_and_options(spark, tmp_path):
    """Two samples with one deletion each called on their own, then merged; a region of pairs that reach into it; contigs by name."""
    for name in ("first", "second"):
        sam(tmp_path / f"{name}.sam")
        body = (tmp_path / f"{name}.sam").read_text().replace("SM:first", f"SM:{name}")
        (tmp_path / f"{name}.sam").write_text(body)
    files = ",".join(str(tmp_path / f"{n}.sam") for n in ("first", "second"))
    run(spark, ["cohort", "-f", files, "-o", str(tmp_path / "merged")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "merged")).collect()]
    records = [x.split("\t") for x in lines if x[0] != "#"]
    assert len(records) == 1 and records[0][4] == "<DEL>" and records[0][8:] == ["GT:GL:AS:RS", ".:.:.:."] and records[0][2].startswith("WG:DEL:")
    said = dict(x.split("=") for x in records[0][7].split(";"))
    assert said["COLLAPSED"] == "2" and said["LID"] == "first,second" == said["RID"] and said["FIVE"].count(",") == 1 and said["MERGED"] == "0,0"
    assert list(said) == "SVTYPE SVLEN ID SUPPORT MERGED REFINED END POS LID FIVE THREE RID CIPOS CIEND COLLAPSED".split()
    run(spark, ["call", "-f", str(tmp_path / "first.sam"), "-o", str(tmp_path / "region"), "-r", "chr1:3000-3300", "-c", "chr1", "-m", "30"])
    found = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "region")).collect() if r.value[0] != "#"]
    assert len(found) == 1 and "CIPOS=-10,10" in found[0][7] and ";T=" in found[0][7]  # the clipped mates lie outside the region
    run(spark, ["call", "-f", str(tmp_path / "first.sam"), "-o", str(tmp_path / "strict"), "-m", "61", "--strict"])
    assert spark.read.text(str(tmp_path / "strict")).where("value NOT LIKE '#%'").count() == 0


def test_classify(spark, tmp_path):
    r = random.Random(1)
    at = lambda kind: [round(r.random() * 0.2 + (0.7 if (k < 7) == (kind == "DEL") else 0), 4) for k in range(14)]
    (tmp_path / "matrix.txt").write_text("".join(f"x\t" + "\t".join(map(str, at(k))) + f"\t{k}\n" for k in ["DEL", "DUP"] * 40))
    head = '##fileformat=VCFv4.1\n##INFO=<ID=AT,Number=15,Type=Float,Description="Attributes of, the pileup">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\n'
    rows = [(10, "DEL", 5), (20, "DUP", 3), (30, "DUP", 1)]
    (tmp_path / "in.vcf").write_text(head + "".join(f"c\t{p}\t.\tN\tACGT\t.\t.\tAT=1," + ",".join(map(str, at(k))) + f";NC={n}\tGT\t0/1\n" for p, k, n in rows))
    run(spark, ["classify", "-f", str(tmp_path / "in.vcf"), "-t", str(tmp_path / "matrix.txt"), "-o", str(tmp_path / "out"), "-n", "20", "-l", "sensitive"])
    lines = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x.split(",")[0] for x in lines if x[0] == "#"] == ["##fileformat=VCFv4.1", "##INFO=<ID=AT", "##FORMAT=<ID=GT", "##INFO=<ID=WC", "##INFO=<ID=WP", lines[5].split(",")[0]] and lines[5].startswith("#CHROM")
    records = [x.split("\t") for x in lines if x[0] != "#"]
    assert [x[1] for x in records] == ["10", "20"] and [x[7].split(";WC=")[1].split(";")[0] for x in records] == ["DEL", "DUP"] and records[0][8:] == ["GT", "0/1"]
    keys = {(k.kind, k.id): (k.number, k.type, k.description) for k in text.vcf_keys(spark, str(tmp_path / "in.vcf")).collect()}
    assert keys == {("INFO", "AT"): ("15", "Float", "Attributes of, the pileup"), ("FORMAT", "GT"): ("1", "String", "Genotype")}


def test_converters(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    row = lambda p, f, i: f"c1\t{p}\tx\tN\t<DEL>\t.\t{f}\t{i}\n"
    (tmp_path / "d.vcf").write_text(head + row(901, "PASS", "CHR2=c1;END=501;CIPOS=-5,7;CIEND=-1,2;SVTYPE=DEL;SVLEN=400;X=1") + row(100, "PASS", "CHR2=c2;END=50;CIPOS=-1,1;CIEND=-1,1;SVTYPE=TRA;SVLEN=0;X=1") + row(5, "LowQual", "CHR2=c1;END=9;CIPOS=0,0;CIEND=0,0;SVTYPE=DEL;SVLEN=4;X=1"))
    got = callsets.delly_to_bedpe(text.read_vcf(spark, str(tmp_path / "d.vcf")), 10).orderBy("name").collect()
    assert [tuple(x)[:7] for x in got] == [("c1", 88, 110, "c2", 38, 60, "1:TRA:0"), ("c1", 489, 512, "c1", 885, 917, "2:DEL:400")]
    (tmp_path / "x.gvf").write_text("##gvf\nc1\ts\tdel\t100\t300\t.\t+\t.\tStart_range=90,110;End_range=290,310;\nc2\ts\tdup\t50\t60\t.\t+\t.\tID=3;\n")
    got = callsets.gvf_to_bedpe(text.read_gvf(spark, str(tmp_path / "x.gvf")), 5).orderBy("name").collect()
    assert [tuple(x)[:7] for x in got] == [("c1", 84, 114, "c1", 284, 314, "1:del:200"), ("c2", 45, 55, "c2", 55, 65, "2:dup:10")] and got[1].extra == "ID=3;"


def test_evaluate(spark, tmp_path):
    rec = lambda c, p, e: f"{c}\t{p}\t.\tN\t<DEL>\t.\t.\tEND={e};SVTYPE=DEL\n"
    (tmp_path / "in.vcf").write_text("#CHROM\tPOS\n" + rec("chr1", 1001, 2001) + rec("chr1", 1010, 2500) + rec("1", 9001, 9500) + rec("chr2", 1001, 2001) + rec("MT", 1001, 2001))
    (tmp_path / "truth.bed").write_text("chr1\t1000\t2000\tx\nchr1\t5000\t5100\ty\nbad line\n")
    run(spark, ["evaluate", "-f", str(tmp_path / "in.vcf"), "-t", str(tmp_path / "truth.bed"), "-o", str(tmp_path / "out"), "-x", "MT", "-n", "own"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["own\tSV\t25\t2\t1\t0.666667"]


def test_strict_headers(spark, tmp_path):
    sam(tmp_path / "a.sam")
    (tmp_path / "b.sam").write_text((tmp_path / "a.sam").read_text().replace("SO:coordinate", "SO:unsorted"))
    (tmp_path / "c.sam").write_text((tmp_path / "a.sam").read_text().replace("@RG\tID:x\tSM:first\n", ""))
    heads = lambda *names: text.read_sam_header(spark, [str(tmp_path / f"{n}.sam") for n in names])[1]
    assert text.checked_headers(heads("a")).count() == 1
    with pytest.raises(ValueError, match=r"b\.sam, .*c\.sam"):
        text.checked_headers(heads("a", "b", "c"))
