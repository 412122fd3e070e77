"""The steps from alignments to evidence work out once what they read more than once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from breakwater import catalog
from breakwater.functions import cigar as C
from breakwater.operators import reads as R
from breakwater.plans import calling

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_flag_is_worked_out_once_for_the_filter(spark):
    made = spark.range(4096).select(F.expr("CAST(pmod(id * 5, 4096) AS INT)").alias("flag"))
    assert plan(R.graph_read_filter(made)).count("pmod") == 2  # in the condition and in the column
    got = {r.flag for r in R.graph_read_filter(made).collect()}
    assert got == {f for f in range(4096) if not f & (2048 | 256 | 1024) and f & 1 and f & 12 != 12}


def test_all_flags_for_template_lengths_and_pileups(spark):
    made = spark.range(4096).select(F.col("id").cast("int").alias("flag"), F.expr("CAST(map() AS map<string, string>)").alias("tags"), F.lit(300).alias("insert_size"), F.lit(1).alias("ref_id"), F.lit(1).alias("mate_ref_id"), F.lit(9).alias("mapq"), F.lit("ACGT" * 9).alias("seq"))
    assert {r.flag for r in R.stats_read_filter(made).collect()} == {f for f in range(4096) if f & 2 and not f & (4 | 1024 | 8)}
    assert {r.flag for r in R.pileup_read_filter(made).collect()} == {f for f in range(4096) if not f & (4 | 1024 | 256)}


def test_alignment_strings_are_read_in_one_pass(spark):
    texts = ["10S90M", "*", "", None, "5M3", "x12I4D", "100=2X", "0M", "3M4Q5D", "M5", "1234567H1P2N"]
    df = spark.createDataFrame([(t,) for t in texts], "cigar string").select("cigar", C.parse_cigar(F.col("cigar")).alias("ops"), C.parse_cigar(F.col("cigar"), True).alias("first"))
    assert plan(df.select("ops")).count("regexp_extract_all") == 1
    for r in df.collect():
        want = None if r.cigar is None else [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r.cigar)]
        assert (r.ops and [tuple(x) for x in r.ops]) == want if want else r.ops == want
        assert [tuple(x) for x in r.first or []] == [(want[0][0], o) for _, o in want or []]


def test_each_alignment_string_is_parsed_once(spark):
    texts = ["10S90M", None, "5M3", "x12I4D", "100=2X", "0M", "3M4Q5D", "1234567H1P2N", "40M25D60M", "10S90M"]
    rows = spark.createDataFrame([(f"r{i}", 100 + i if i % 5 else None, 16 * (i % 2), t) for i, t in enumerate(texts * 3)], "read_name string, pos long, flag int, cigar string")
    want = R.with_cigar(rows)
    for most, parses in ((1 << 22, 0), (10, 1)):
        got = R.with_cigar_once(rows, most)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        text = plan(got)
        assert ("Join LeftOuter" not in text) == parses  # too many strings: each read's own is parsed
    assert R.with_cigar_once(rows.limit(0)).count() == 0


@tables
def test_evidence_looks_alignment_strings_up(spark):
    text = plan(catalog.evidence(spark, SF))
    assert text.count("Join LeftOuter, (cigar#") == 2 == text.count("regexp_extract_all")  # of pairs and within reads


@tables
def test_pairs_carry_no_hits_unless_asked(spark):
    assert not {"nm", "xa"} & set(catalog.pairs(spark, SF).schema["r1"].dataType.names)
    assert {"nm", "xa"} <= set(calling.pairs_of(catalog.kept(spark, SF)).schema["r1"].dataType.names)


@tables
def test_written_alignments_are_what_is_read_of_them(spark):
    assert set(catalog.written(spark, SF).columns) == {"sample", "read_name", "mate", "ref_id", "pos", "mapq", "flag", "cigar", "insert_size", "tells_stats"}


def test_reads_without_indels_are_not_parsed_for_them(spark):
    reads = spark.createDataFrame([("s", 1, 10, 60, "50M30I20M"), ("s", 1, 10, 60, "100M"), ("s", 1, 10, 60, "40M25D60M"), ("s", 1, 10, 60, "5I95M"), ("s", 1, 10, 60, None)], "sample string, ref_id int, pos long, mapq int, cigar string")
    reads = reads.withColumn("flag", F.lit(1))
    found = R.indel_edges(R.with_cigar(reads))
    text = plan(found)
    assert 0 < text.find("regexp_extract_all") < text.find("Contains(cigar")  # the filter stands below the parsing
    assert sorted((r.lpos, r.rpos, r.evidence) for r in found.collect()) == [(50, 75, "D"), (60, 90, "I")]
    bare = R.indel_edges(R.with_cigar(reads).drop("cigar"))
    assert sorted(bare.collect()) == sorted(found.collect())


def test_pair_edges_are_worked_out_once(spark):
    mate = "struct<ref_id:int,pos:bigint,end_pos:bigint,front:string,front_len:int,back:string,back_len:int>"
    rows = [("s", "M", (1, 100, 199, "S", 10, "M", 90), (1, 900, 999, "M", 90, "S", 10)), ("s", None, (1, 100, 199, "S", 10, "M", 90), (1, 900, 999, "M", 90, "S", 10)), ("s", "H", (1, 100, 199, "M", 100, "M", 100), (1, 900, 999, "M", 96, "S", 4)), ("s", "A", (1, 999, 1100, "S", 10, "M", 90), (1, 900, 999, "M", 90, "S", 10))]
    classes = spark.createDataFrame(rows, f"sample string, kind string, r1 {mate}, r2 {mate}").repartition(2).withColumn("evidence", F.replace("kind", F.lit("_"), F.lit("-")))
    found = R.insert_edges(classes)
    assert plan(found).count("replace(") == 1
    assert [(r.seqid, r.lpos, r.rpos, r.evidence) for r in found.collect()] == [(1, 100, 999, "M")]
