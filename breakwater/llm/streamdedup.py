"""Exact dedup as a stateful stream: keyed state on disk, never expired, holds digest, identifier and content locator.

Two streams run until their input is used up. The first reads files of documents and appends a narrow entry for each row: id, digest
of the normalised text, and where the text lies (file and row in it). The second aggregates entries by digest in a RocksDB state
store: what it retains of a text is the digest, the largest id with that row's locator, and the number of rows. Entries are summed in
each task before they are shuffled, so a text that a third of all rows share is one row a task. A later run in the same folder
reads only files that it has not seen, against the state of the earlier ones.

Digests that were hit more than once are held against full bytes afterwards, by one grouping of the texts themselves. A digest under
which different texts meet is then taken apart by those texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm.textvec import slices, utf8
from breakwater.operators.skew import spread_join
from breakwater.plans.lineage import cut, shared_dir

#: Bytes of files that one micro-batch reads at most (a single file if that is larger).
BATCH = 256 << 30
#: Leading bytes of SHA-256 by which texts are keyed.
DIGEST = 32
ENTRY = "id long, file string, row long, n_bytes long, sha binary, digest binary"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store holds 4 MB of disk while it is empty
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def entries(located: DataFrame, digest: int = DIGEST, text: bool = False) -> DataFrame:
    """``id, file, row, n_bytes, sha, digest`` of rows of ``id, file, row, text``; with ``text`` the normalised text's bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            norm = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
            raw, at = utf8(norm)
            view = memoryview(raw)
            sha = [hashlib.sha256(view[i:j]).digest() for i, j in zip(at[:-1], at[1:], strict=True)]
            own = [b.column("id"), b.column("file"), b.column("row"), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(sha, pa.binary()), pa.array([x[:digest] for x in sha], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *([norm] if text else [])], [*"id file row n_bytes sha digest".split(), *(["text"] if text else [])])

    return located.mapInArrow(run, ENTRY + (", text string" if text else ""))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _run(writer, spark: SparkSession) -> None:
    """Runs a stream under the settings of the state store until its input is used up; the session has its own ones again once it runs."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        query = writer.trigger(availableNow=True).start()  # keeps the settings that it was started with
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def stream_entries(spark: SparkSession, path: str, folder: str, id_col: str, text_col: str, batch: int = BATCH, digest: int = DIGEST) -> None:
    """Appends an entry for each row of the Parquet files at ``path`` that no earlier run with this ``folder`` has read."""
    path = path.rstrip("/")
    found = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch)
    docs = found.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no path that names one file
    out = entries(_located(docs, id_col, text_col), digest).writeStream.format("parquet").outputMode("append")
    _run(out.option("path", f"{folder}/entries").option("checkpointLocation", f"{folder}/entries-log"), spark)


def stream_state(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    """``digest, keep(id, file, row), size`` of each digest of all runs with this ``folder``: what the keyed state retains of it.

    Each micro-batch writes the digests that it changed; sizes only grow, so a digest's largest one is its latest.
    """
    came = spark.readStream.schema(ENTRY).option("maxBytesPerTrigger", batch).parquet(f"{folder}/entries")
    retained = came.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("size"))

    def put(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/state-changes/epoch={epoch}")

    out = retained.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state")
    _run(out, spark)
    changes = spark.read.schema("digest binary, keep struct<id:bigint,file:string,row:bigint>, size bigint").parquet(f"{folder}/state-changes")
    latest = changes.groupBy("digest").agg(F.max(F.struct("size", "keep")).alias("x"))
    return latest.select("digest", "x.keep", "x.size")


def dedup_stream(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, batch: int = BATCH, digest: int = DIGEST) -> DataFrame:
    """Which rows of the Parquet files at ``path`` stay if of equal texts only the row of the largest id does.

    Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one. Returns one row per row read by any
    run with ``folder`` (a new one in the shared folder if None): ``doc_id, keep_id, group_size, kept, text_sha256``, ``n_bytes`` of
    the normalised text and ``keep_file, keep_row``, where the retained text lies. A null id is less than every other, and
    ``keep_id`` is null only where all ids of a text are. Of rows that share the largest id (repeated rows, say) the one of the last
    file and place stays, so each text has one row with ``kept``. No row gives an empty result. Other columns are not read.
    Files must stay as they are once read; the check of bytes reads them again.
    """
    folder = folder or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    stream_entries(spark, path, folder, id_col, text_col, batch, digest)
    state = cut(stream_state(spark, folder, batch))
    rows = spark.read.schema(ENTRY).parquet(f"{folder}/entries")
    judged = spread_join(rows, state.withColumn("group_size", F.col("size")), ["digest"], "size")
    located = _located(spark.read.parquet(path), id_col, text_col)
    unlike = cut(_unlike(located, state, digest))
    if not unlike.isEmpty():
        again = cut(entries(located, digest, text=True).join(unlike, "digest", "left_semi"))
        own = cut(again.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("size")))
        apart = spread_join(again, own.withColumn("group_size", F.col("size")), ["digest", "text"], "size").drop("text")
        judged = judged.join(unlike, "digest", "left_anti").unionByName(apart)
    kept = F.struct("id", "file", "row").eqNullSafe(F.col("keep"))
    return judged.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_bytes", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))


def _unlike(located: DataFrame, state: DataFrame, digest: int) -> DataFrame:
    """The digests that were hit by bytes other than the retained ones: texts are grouped as they are, in each task first."""
    texts = entries(located, digest, text=True).groupBy("digest", "text").agg(F.count("*").alias("n"))
    held = texts.groupBy("digest").agg(F.count("*").alias("texts"))
    return held.where("texts > 1").join(state.where("size > 1"), "digest", "left_semi").select("digest")
