
from breakwater import catalog
from breakwater.operators import calls as K
from breakwater.sources import sinks, text


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_sam(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1\tSO:coordinate\n@SQ\tSN:c1\tLN:5000\n@RG\tID:1\tSM:s1\nr\t99\tc1\t11\t60\t5S10M\t=\t41\t40\tACGT\tIIII\tSA:Z:c1,5,+,5M,9,0;\tNM:i:1\n")
    r = text.read_sam(spark, p).first()
    assert (r.pos, r.mate_ref, r.mate_pos, r.tags["NM"]) == (10, "c1", 40, "1")
    contigs, samples = text.read_sam_header(spark, p)
    assert contigs.first().length == 5000 and (samples.first().sample, samples.first().sort_order) == ("s1", "coordinate")


def test_small_formats(spark, tmp_path):
    assert [tuple(r) for r in text.read_bed(spark, put(tmp_path, "a.bed", "c1\t5\t9\nshort\nc2\tx\t3\n")).collect()] == [("c1", 5, 9)]
    r = text.read_merge_input(spark, put(tmp_path, "a.vcf", "#h\nc1\t7\tid1\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=90;A=5\n")).first()
    assert tuple(r)[:6] == ("c1", 7, 90, "DEL", "id1", 5)
    r = text.read_training_matrix(spark, put(tmp_path, "t.tsv", "x\t1\t2.5\tDEL\n")).first()
    assert r.features == [1.0, 2.5] and r.label == "DEL"
    r = text.read_gvf(spark, put(tmp_path, "g.gvf", "c1\ts\tdeletion\t5\t9\t.\t.\t.\tID=1;Start_range=3,7;End_range=8,11;\n")).first()
    assert (r.start_low, r.end_high) == (3, 11)
    assert tuple(text.read_best_ends(spark, put(tmp_path, "l.bedpe", "\t" * 13 + "MAX:c1:5;c2:9\n")).first()) == ("c1", 5, "c2", 9)
    assert text.file_list(spark, "a.bam,b.bam") == ["a.bam", "b.bam"]


def test_vcf_sink(spark):
    sf = "/root/testdata/sf0.001"
    e = catalog.edges(spark, sf)
    calls = K.call_samples(K.emitted(K.typed_calls(e, K.nodes(e), K.components(e))), K.sample_support(catalog.evidence(spark, sf)))
    lines = [r.value.split("\t") for r in sinks.vcf_records(calls, ["s0", "s1", "s2"]).collect()]
    assert len(lines) == calls.count() > 9 and all(len(x) == 12 and "SVTYPE=" in x[7] for x in lines)
    assert all(sum(int(s.rsplit(":", 1)[1]) for s in x[9:]) > 0 for x in lines) and sinks.vcf_header(["a"]).endswith("FORMAT\ta")
