"""Manifest scans whose files are opened by tasks, and databases read by counted ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


def test_a_long_file_comes_page_by_page(spark, tmp_path):
    """A file of 1,000 pages is 1,000 rows, none of which holds it; the reader never has more than one piece of it."""
    (tmp_path / "long.html").write_text("\f".join(f"<p>page {k} é</p>{'x' * 3000}" for k in range(1000)), encoding="utf-8")
    (tmp_path / "empty.html").write_bytes(b"")
    (tmp_path / "cut.html").write_bytes("one\ftwo\f".encode() + b"\xff\xfe" * 50_000)
    names = ["long", "empty", "cut", "missing", "long"]
    manifest = spark.createDataFrame([("약관", str(tmp_path / f"{n}.html")) for n in names] + [("x", None)], "doc_type string, file_path string")
    got = files.extracted(manifest, files.html_stream)
    assert "collect" not in got._jdf.queryExecution().toString()
    rows = got.withColumn("name", F.regexp_extract("file_path", r"(\w+)\.html$", 1)).collect()
    long = sorted(r.page for r in rows if r.name == "long")
    assert long == sorted([*range(1, 1001)] * 2) and all(len(r.text) < 3100 for r in rows if r.text)
    assert [(r.page, r.text, r.status) for r in rows if r.name == "empty"] == [(1, "", "success")]
    cut = [r for r in rows if r.name == "cut"]
    assert cut[-1].status == "error" and "Unicode" in cut[-1].error
    assert [(r.status, r.error) for r in rows if r.name == "missing"] == [("error", "file not found")]
    assert files.extracted(manifest.limit(0), files.html_stream).count() == 0


def test_pieces_do_not_show(tmp_path):
    text = "é<b>one</b>\f\ftwo ü\fthree"
    (tmp_path / "a").write_text(text, encoding="utf-8")
    for size in (1, 2, 3, 7, 1000):
        with open(tmp_path / "a", "rb") as file:
            assert list(files.html_stream(file, size)) == files.html_pages(text.encode())


@pytest.fixture
def derby(spark, tmp_path):
    """An in-memory database; Derby is among Spark's own jars."""
    jvm, url = spark._jvm, f"jdbc:derby:memory:{tmp_path.name};create=true"
    jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    connection = jvm.java.lang.Class.forName(driver).getDeclaredConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)).connect(url, jvm.java.util.Properties())
    yield url, driver, connection
    connection.close()


def test_a_database_read_by_counted_ranges(spark, derby):
    url, driver, connection = derby
    statement = connection.createStatement()
    statement.execute("create table coverage (id int generated always as identity primary key, code varchar(20), k int)")
    rows = spark.createDataFrame([(f"A{i % 7}", i if i < 900 else 1_000_000 + i) for i in range(1000)] + [("null", None)] * 5, "code string, k int")
    files.jdbc_append(rows, url, "coverage", driver=driver)
    read = files.jdbc_ranges(spark, url, "coverage", "K", 8, driver=driver)
    assert read.rdd.getNumPartitions() == 9
    sizes = sorted(read.groupBy(F.spark_partition_id()).count().select("count").rdd.flatMap(tuple).collect())
    assert sizes[0] == 5 and sizes[-1] <= 190 and sum(sizes) == 1005
    assert read.select(F.count_distinct("ID"), F.min("ID"), F.max("ID")).first()[:] == (1005, 1, 1005)
    some = read.where("CODE = 'A3' and K < 100").select("K")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "CODE" in plan.split("PushedFilters")[1] and "ID" not in plan.split("ReadSchema")[1]
    assert sorted(r.K for r in some.collect()) == [i for i in range(100) if i % 7 == 3]
    statement.execute("create table nothing (k int)")
    assert files.jdbc_ranges(spark, url, "nothing", "K", 8, driver=driver).count() == 0
    statement.execute("insert into nothing values (5), (5), (5)")
    assert files.jdbc_ranges(spark, url, "nothing", "K", 8, driver=driver).count() == 3
