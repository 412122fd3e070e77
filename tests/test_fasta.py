"""Reference sequences against plain slices."""

import random

from pyspark.sql import functions as F

from breakwater.sources import fasta


def test_bins_and_bases(spark, tmp_path):
    first, second = "ACGTTGCATGCCAATT" * 10, "ggcc"
    lines = lambda s: "\n".join(s[k : k + 7] for k in range(0, len(s), 7))
    (tmp_path / "x.fa").write_text(f">one about it\n{lines(first)}\n>two\n{second}\n>none\n")
    bins = fasta.read_fasta(spark, str(tmp_path / "x.fa"), 50)
    assert {(r.name, r.bin): r.bases for r in bins.collect()} == {("one", k): first[50 * k : 50 * k + 50] for k in range(4)} | {("two", 0): second}
    places = spark.createDataFrame([("one", k) for k in (0, 49, 50, 159, 160)] + [("two", 1), ("other", 3), ("one", None)], "chrom string, pos long")
    got = {(r.chrom, r.pos): r.base for r in fasta.reference_bases(places, bins, "chrom", "pos", 50).collect()}
    assert got == {("one", 0): "A", ("one", 49): first[49], ("one", 50): first[50], ("one", 159): "T", ("one", 160): None, ("two", 1): "G", ("other", 3): None, ("one", None): None}
    records = spark.createDataFrame([("one\t3\tx\tN\t<DEL>\t.",), ("zz\t3\tx\tN\t<DEL>\t.",)], "value string")
    whole = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [r.value.split("\t")[3] for r in fasta.with_reference(records, whole).collect()] == ["G", "N"]
    assert whole.agg(F.sum(F.length("bases"))).first()[0] == len(first) + 4


def test_sequences_over_splits(spark, tmp_path):
    """Splits of a few lines: sequences begin, end and go on anywhere; several files, blank lines, and text before the first header."""
    r = random.Random(7)
    want, key = {}, "spark.sql.files.maxPartitionBytes"
    for f in range(3):
        out = ["stray"] if f == 1 else []
        for k in range(12):
            seq = "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 1, 9, 40, 333])))
            out += [f">s{f}_{k} about", *(seq[i : i + 10] for i in range(0, len(seq), 10)), *([""] if k % 3 == 0 else [])]
            if seq:
                want[f"s{f}_{k}"] = seq
        (tmp_path / f"{f}.fa").write_text("\n".join(out) + "\n")
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for row in sorted(fasta.read_fasta(spark, str(tmp_path), 16).collect(), key=lambda x: (x.name, x.bin)):
            got[row.name] = got.get(row.name, "") + row.bases
            assert len(row.bases) == 16 or len(got[row.name]) == len(want[row.name])
    finally:
        spark.conf.set(key, before)
    assert got == want
