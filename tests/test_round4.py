"""Findings of round 4, each by a case that came out wrong, or failed, before."""

import duckdb
from oracle import cell
from pyspark.sql import types as T

from waymark import plans

plans.load()


def test_lots_stand_in_the_order_of_sql(spark, tmp_path):
    """Nulls of a lot's place come last, and a discount is rounded by its product."""
    kind = T.StructType.fromDDL("l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    rows = [
        (1, None, 1, 1.0, 0.1, 0.0, "A", "F"), (1, 2, 1, 1.0, 0.2, 0.0, "N", "F"),
        (2, 1, None, 1.0, 0.1, 0.0, "A", "F"), (2, 1, 9, 1.0, 0.2, 0.0, "N", "F"),
        (3, 1, 1, None, 0.1, 0.0, "A", "F"), (3, 1, 1, 9.0, 0.2, 0.0, "N", "F"),
        (4, 1, 1, 1.0, 0.285, 0.0, "A", "F"), (4, 2, 1, 1.0, 1.005, 0.0, "A", "F"), (4, 3, 1, 1.0, 1e307, 0.0, "A", "F"), (4, 4, 1, 1.0, None, 0.0, "A", "F"), (4, 5, 1, 1.0, -0.285, 0.0, "A", "F"), (4, 6, 1, 1.0, float("nan"), 0.0, "A", "F"),
        (None, None, None, None, None, None, None, None), (None, 1, 1, 50.0, 0.1, 0.05, "R", "O"),
    ]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = db.execute(plans.SQL["d6_lot_merge"])
    names = [c[0] for c in found.description]
    want = sorted(tuple(cell(v) for v in r) for r in found.fetchall())
    got = sorted(tuple(cell(r[c]) for c in names) for r in plans.QUERIES["d6_lot_merge"](spark, str(tmp_path)).collect())
    assert got == want
    assert [r[0] for r in got if r[-1] == "True" and r[1] == "N"] == ["1", "2", "3"]


def test_quality_sample_comes_to_the_driver_in_small_partitions(spark, monkeypatch):
    """90 pieces of one file's partition, of which the driver gets about ten at a time."""
    from pyspark.sql.classic.dataframe import DataFrame

    from waymark.llm import quality

    sent, whole = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *rest: sent.extend(len(p) for p in self.rdd.glom().collect()) or whole(self, *rest))
    monkeypatch.setattr(quality, "SENT", 10, raising=False)
    monkeypatch.setattr(quality, "PIECE", 2)
    rows = [(i, "a plain word of text " * 39, i % 2) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    assert sum(sent) == 90 and max(sent) <= 20
