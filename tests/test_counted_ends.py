"""Ends that are counted beforehand give the modes and intervals of single ones."""

import random

from pyspark.sql import functions as F

from breakwater.operators import pileup as P


def test_counted_ends(spark):
    r = random.Random(2)
    ends = spark.createDataFrame([(1, r.randrange(4), r.choice([100, 104, 230, 900]) + r.randrange(3)) for _ in range(200)], "ref_id int, bp long, end long")
    counted = ends.groupBy("ref_id", "bp", "end").agg(F.count("*").alias("n"))
    both = [P.end_mode(x, ["ref_id"]) for x in (ends, counted)]
    assert sorted(both[0].collect()) == sorted(both[1].collect())
    a, b = (P.end_interval(x, m.drop("n"), ["ref_id"]) for x, m in zip((ends, counted), both, strict=True))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 4
