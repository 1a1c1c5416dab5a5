"""Checks in one scan, tables published only if they hold, upserts that rewrite what they touch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.sources import sinks


def names(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_table_is_scanned_once_for_all_its_checks(spark):
    orders, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "lineitem"))
    made = checks.table_checks(items, {"a": F.col("l_quantity") > 10, "b": F.col("l_discount") < 0.05, "c": F.col("l_tax").isNull() | (F.col("l_tax") >= 0)}, {"d": ("l_orderkey", orders.where("o_orderkey % 7 > 0"), "o_orderkey"), "e": ("l_linenumber", orders.select(F.lit(1).alias("k")), "k")})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    got = {r.check_name: r.violations for r in made.collect()}
    assert got == {"a": items.where("not l_quantity > 10").count(), "b": items.where("not l_discount < 0.05").count(), "c": 0, "d": items.where("l_orderkey % 7 = 0 or l_orderkey not in (0)").join(orders.where("o_orderkey % 7 > 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count(), "e": items.where("l_linenumber <> 1").count()}


def test_nulls_hold_and_missing_parents_do_not(spark):
    child = spark.createDataFrame([(1, 1, "x"), (2, None, None), (3, 9, "y"), (4, 9, "x")], "id int, p int, v string")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "p int")
    got = {r.check_name: r.violations for r in checks.table_checks(child, {"v": F.col("v") == "x"}, {"link": ("p", parent, "p")}).collect()}
    assert got == {"v": 1, "link": 2}
    assert {r.violations for r in checks.table_checks(child.limit(0), {"v": F.col("v") == "x"}, {"link": ("p", parent, "p")}).collect()} == {0}


def test_a_failing_load_leaves_the_old_partition(spark, tmp_path):
    path, rules = tmp_path / "t", {"v_positive": F.col("v") > 0, "k_format": F.col("k").rlike("^[a-z]$")}
    first = spark.createDataFrame([("a", 1, "x 1"), ("b", 2, "x 1"), ("c", 3, "y")], "k string, v int, part string")
    assert sinks.publish(first, str(path), ["part"], rules) == {"rows": 3, "v_positive": 0, "k_format": 0}
    before = names(path)
    bad = spark.createDataFrame([("a", 5, "x 1"), ("B", -1, "x 1"), ("d", None, "z")], "k string, v int, part string")
    with pytest.raises(AssertionError, match="k_format: 1; v_positive: 1"):
        sinks.publish(bad, str(path), ["part"], rules)
    unique = lambda staged: checks.unique(staged, ["k"], "k_unique")
    with pytest.raises(AssertionError, match="k_unique: 1"):
        sinks.publish(first.union(first.where("k = 'a'")), str(path), ["part"], rules, unique)
    assert names(path) == before and not list(path.glob(".*-*"))
    good = spark.createDataFrame([("a", 7, "x 1"), ("d", None, "z")], "k string, v int, part string")
    assert sinks.publish(good, str(path), ["part"], rules, unique)["rows"] == 2
    assert sorted(map(tuple, spark.read.parquet(str(path)).select("k", "v", "part").collect()), key=str) == [("a", 7, "x 1"), ("c", 3, "y"), ("d", None, "z")]
    assert {n for n in names(path) if "part=y" in n} == {n for n in before if "part=y" in n}
    assert sinks.publish(first.limit(0), str(path), ["part"], rules)["rows"] == 0


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = tmp_path / "u"
    rows = spark.range(5000).select("id", (F.col("id") * 2).alias("v"), F.lit("old").alias("w"))
    assert len(sinks.upsert(rows, str(path), ["id"], buckets=128)) == 128
    before = names(path)
    batch = spark.createDataFrame([(7, -1, "new"), (4999, -2, "new"), (9001, -3, "new")], "id long, v long, w string")
    touched = sinks.upsert(batch, str(path), ["id"], update=["v"], buckets=5)
    after = names(path)
    assert 1 <= len(touched) <= 3 and {n.split("/")[0] for n in before ^ after} == {f"bucket={b}" for b in touched}
    got = {r.id: (r.v, r.w) for r in spark.read.parquet(str(path)).collect()}
    assert len(got) == 5001 and got[7] == (-1, "old") and got[4999] == (-2, "old") and got[9001] == (-3, "new") and got[8] == (16, "old")
    sinks.upsert(batch.where("id = 7"), str(path), ["id"])
    assert {r.w for r in spark.read.parquet(str(path)).where("id = 7").collect()} == {"new"}
    for broken in (batch.union(batch.limit(1)), batch.withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            sinks.upsert(broken, str(path), ["id"])
    assert spark.read.parquet(str(path)).count() == 5001 and sinks.upsert(batch.limit(0), str(path), ["id"]) == []


def test_a_key_of_several_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, l int, v int")
    sinks.upsert(rows, str(tmp_path / "u"), ["k", "l"], buckets=4)
    sinks.upsert(spark.createDataFrame([("a", 2, 5), ("b", 2, 6)], "k string, l int, v int"), str(tmp_path / "u"), ["k", "l"])
    assert sorted((r.k, r.l, r.v) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("a", 1, 1), ("a", 2, 5), ("b", 2, 6)]
