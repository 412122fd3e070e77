import os

import pytest

from breakwater.plans import lineage


class Session:
    """A session with these settings; a session's own folder cannot be set while it runs."""

    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_shared_dir():
    assert lineage.shared_dir(Session(spark_checkpoint_dir="s3://b/c", spark_master="yarn")) == "s3://b/c"
    one, two = (lineage.shared_dir(Session(spark_master="local[2]")) for _ in range(2))
    assert one == two and one.startswith("file:///")
    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session(spark_master="yarn"))


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_cut_by(spark, rows):
    df = spark.range(rows).selectExpr("id % 7 AS k", "hash(id) AS h", "id", "CASE WHEN id % 3 = 0 THEN NULL ELSE repeat('x', int(id)) END AS x")
    tables = spark.catalog.listTables()
    out = lineage.cut_by(df, "k", "h")
    assert spark.catalog.listTables() == tables
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    grouped = out.groupBy("k").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r["count"] for r in grouped.collect()} == {r.k: r["count"] for r in df.groupBy("k").count().collect()}


def test_cut_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(lineage, "_written", [])
    assert lineage.cut(spark.range(3)).count() == 3 and lineage.cut_by(spark.range(5), "id").count() == 5
    assert len(os.listdir(tmp_path / "shared")) == 2 and lineage.clear(spark) == 2
    assert os.listdir(tmp_path / "shared") == [] and lineage.clear(spark) == 0
