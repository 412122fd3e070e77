"""Lineage cuts that survive lost executors: written tables in the shared checkpoint folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset in a local run, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", master := spark.conf.get("spark.master", "local")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = _local_dir()
    return found


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="breakwater-")


#: What this process has written and not cleared.
_written: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has cut so far, and say how many; results that were not written or collected yet are lost."""
    done = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Like ``cut``, into one bucket by ``key`` for each shuffle partition, sorted by ``key`` and ``order``.

    What groups or joins the rows by ``key`` afterwards reads the buckets and does not shuffle them again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"breakwater_{uuid.uuid4().hex}"
    _written.append(f"{shared_dir(spark)}/{name}")
    written = df.repartition(n, key).sortWithinPartitions(key, *order).write.format("parquet").option("path", f"{shared_dir(spark)}/{name}")
    written.bucketBy(n, key).sortBy(key, *order).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolves the table before its name goes; the files are outside the warehouse and stay
    spark.sql(f"DROP TABLE {name}")
    return out
