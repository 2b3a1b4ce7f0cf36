"""Findings of the fourth round: what comes out is small on disk where it repeats itself."""

import pytest
from pyspark.sql import functions as F
from test_round3 import _equal, _written

from quillspark.operators import code
from quillspark.plans import catalogue


def _parts(spark, n, names):
    return spark.range(n).selectExpr("id AS p_partkey", f"concat('N ', (id DIV 5) % {names}) AS p_name", "'T' AS p_type", "'B' AS p_brand", "1 AS p_size")


def test_relations_to_one_name_share_its_text(spark, tmp_path):
    """A file of the result has a name's text once, also where all texts together are more than a dictionary takes."""
    folder = _written(spark, tmp_path, part=_parts(spark, 8000, 16))
    frame = catalogue.QUERIES["code_resolve"](spark, folder)
    frame.write.option("parquet.dictionary.page.size", 1 << 15).parquet(f"{tmp_path}/out")
    told = spark.read.parquet(f"{tmp_path}/out").agg(F.sum(F.length("candidates"))).first()[0]
    assert told > 9_000_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < told / 10


@pytest.mark.parametrize("listed", [1000, 10**9])
def test_relations_to_a_hot_name_are_dealt_out(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(code, "LISTED", listed)
    folder = _written(spark, tmp_path, part=_parts(spark, 400, 3))
    rows = catalogue.QUERIES["code_resolve"](spark, folder).withColumn("task", F.spark_partition_id())
    tasks = {r.target: r.n for r in rows.groupBy("target").agg(F.count_distinct("task").alias("n")).collect()}
    _equal(spark, folder, "code_resolve", ["part"])
    assert (max(tasks.values()) > 1) == (listed < 10**9) and tasks["none.2"] == 1


@pytest.mark.parametrize("listed", [25, 10**9])
def test_relations_to_nothing_are_dealt_out(spark, monkeypatch, listed):
    """Relations without a target, or to one unknown, are as many rows and may be many too."""
    monkeypatch.setattr(code, "LISTED", listed)
    symbols = spark.createDataFrame([("s1", "a", "x.a"), ("s2", "a", ""), ("s3", None, "b")], "id string, name string, qualified_name string")
    relations = spark.range(40).selectExpr("concat('r', id) AS id", "element_at(array('a', NULL, 'nobody', ''), CAST(id % 4 AS INT) + 1) AS target")
    got = code.resolve(relations, symbols).withColumn("task", F.spark_partition_id()).collect()
    want = {"a": ["s1", "s2"]}
    assert sorted((r.id, r.target, list(r.candidates), r.n_candidates) for r in got) == sorted((r.id, r.target, want.get(r.target, []), len(want.get(r.target, []))) for r in relations.collect())
    assert all((len({r.task for r in got if r.target == t}) > 1) == (listed < 10**9) for t in (None, "nobody", ""))
