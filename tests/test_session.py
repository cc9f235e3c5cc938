"""Shuffles that are as wide as the tables read ask for."""

from __future__ import annotations

from marginalia import session
from marginalia.plans.queries import read


def test_shuffles_grow_with_the_tables_read(spark, tmp_path, monkeypatch):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(session, "INPUT_BYTES", 64)
    try:
        read(spark, str(tmp_path), "t")
        assert int(spark.conf.get(names[0])) > 4 and spark.conf.get(names[1]).rstrip("b") == str(session.TASK_BYTES)
        spark.conf.set(names[0], 1 << 20)
        spark.conf.set(names[1], "16m")
        read(spark, str(tmp_path), "t")
        assert (spark.conf.get(names[0]), spark.conf.get(names[1])) == (str(1 << 20), "16m")
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
