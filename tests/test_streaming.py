"""Streams give what the batch operators give once all input is read."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from breakwater.operators import callsets
from breakwater.operators import pileup as P
from breakwater.operators import reads as R
from breakwater.streaming import clusters, mates, piles


def run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "s", "a", 65, 0, 100, 60, "20S80M"), ("2024-01-01 00:01:00", "s", "a", 129, 0, 500, 60, "100M"), ("2024-01-01 00:02:00", "s", "b", 65, 0, 100, 60, "20S80M"), ("2024-01-01 09:00:00", "s", "b", 129, 0, 700, 60, "100M")]
    spark.createDataFrame(rows, "t string, sample string, read_name string, flag int, ref_id int, pos long, mapq int, cigar string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = run(mates.stream_mate_pairs(reads), "mates_out", spark)
    assert [(r.read_name, r.r1.pos, r.r2.pos) for r in got] == [("a", 100, 500)]  # b's mate is too late
    counts = run(mates.stream_clip_counts(reads), "clips_out", spark, "complete")
    assert [(r.ref_id, r.bp, r.n) for r in counts] == [(0, 100, 2)]


@pytest.fixture
def on_disk(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def sorted_reads(n, contigs, seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(contigs), r.randrange(3 * n)) for _ in range(n))
    return [(f"r{k}", f"c{c}", pos, r.randrange(60), r.choice(["60M", "12S48M", "48M12S", "4S46M10S", "9S51M", "20S30M20S"]), "s") for k, (c, pos) in enumerate(rows)]


def test_stream_piles_are_the_batch(spark, tmp_path, on_disk):
    rows = sorted_reads(600, 2, 1)
    kind = "read_name string, ref_id string, pos long, mapq int, cigar string, sample string"
    source = spark.createDataFrame(rows, kind).withColumns({"flag": F.lit(0), "mate_ref_id": F.lit("x"), "mate_pos": F.lit(-1).cast("long"), "insert_size": F.lit(0).cast("long"), "tags": F.create_map().cast("map<string,string>")})
    parsed = R.with_cigar(source)
    counts = P.pileup_counts(P.pileup(P.clip_positions(parsed), P.pile_features(parsed)))
    want = sorted((r.ref_id, r.bp, r.n_reads, r.mapq_sum, r.n_primary) for r in counts.collect())
    for k in range(6):  # a file a micro-batch, in order of place
        chunk = [r for c in ("c0", "c1") for r in [x for x in rows if x[1] == c][k * 60 : (k + 1) * 60 if k < 5 else None]]
        last = [(None, c, None, None, None, None) for c in ("c0", "c1")] if k == 5 else []
        spark.createDataFrame(chunk + last, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(piles.stream_piles(R.with_cigar(stream.withColumn("flag", F.lit(0)))), "piles_out", spark)
    assert sorted(tuple(r) for r in got) == want and len(want) > 300


def test_piles_keep_what_reaches_the_front():
    """State holds the reads that still reach the front, whatever came before; unsorted reads are an error."""

    class Held:
        def __init__(self):
            self.x = None

        def exists(self):
            return self.x is not None

        def get(self):
            return self.x

        def put(self, x):
            self.x = x

        update = put

        def clear(self):
            self.x = None

    class Handle:
        def getListState(self, *_):
            return Held()

        getValueState = getListState

    p = piles.Piles()
    p.init(Handle())
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["pos", "end_pos", "mapq", "front", "back", "named_front", "named_back"])])
    for start in range(0, 5000, 50):
        list(p.handleInputRows(("c",), frame([(start + k, start + k + 30, 20, True, False, True, False) for k in range(50)]), None))
        assert len(p.reads.get()) <= 31
    with pytest.raises(ValueError, match="not sorted"):
        list(p.handleInputRows(("c",), frame([(10, 20, 1, False, False, False, False)]), None))
    out = pd.concat(list(p.handleInputRows(("c",), frame([(None, None, None, None, None, None, None)]), None)))
    assert out["bp"].tolist() == [4999] and not p.reads.exists() and not p.front.exists()


def test_stream_of_calls_is_merged_as_the_batch(spark, tmp_path, on_disk):
    r = random.Random(4)
    rows = sorted((str(r.randrange(2)), v := r.randrange(600), v + r.randrange(40), r.choice(["DEL", "DUP"]), f"x{k:03}", r.randrange(5)) for k in range(300))
    kind = "seqid string, five long, three long, svtype string, id string, support long"
    want = sorted(tuple(x) for x in callsets.merge_calls(spark.createDataFrame(rows, kind)).collect())
    for k in range(4):
        chunk = [x for c in "01" for x in [y for y in rows if y[0] == c][k * 30 : (k + 1) * 30 if k < 3 else None]]
        spark.createDataFrame(chunk + ([(c, None, None, None, None, None) for c in "01"] if k == 3 else []), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(tuple(x) for x in run(clusters.stream_merge_calls(stream), "clusters_out", spark)) == want
