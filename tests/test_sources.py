"""Batches of several tables, and folders as a data source."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import pdf
from lakeweave.sources import folder_source
from lakeweave.sources.batches import BatchStore


def counts(store):
    return [store.read(t, "k long").groupBy("batch").count().orderBy("batch").collect() for t in ("first", "second")]


def test_repeated_and_broken_batches_leave_each_row_once(spark, tmp_path):
    store = BatchStore(spark, f"file:{tmp_path}/store")
    assert counts(store) == [[], []]
    tables = lambda n: {"first": spark.range(n).withColumnRenamed("id", "k"), "second": spark.range(2 * n).withColumnRenamed("id", "k")}
    assert store.write(1, tables(3)) and not store.write(1, tables(3))
    bad = tables(5) | {"second": spark.range(4).select(F.raise_error(F.lit("killed")).cast("long").alias("k"))}
    with pytest.raises(Exception, match="killed"):
        store.write(2, bad)
    assert not store.committed(2)
    assert [[tuple(r) for r in x] for x in counts(store)] == [[(1, 3)], [(1, 6)]]
    assert store.write(2, tables(5))
    assert [[tuple(r) for r in x] for x in counts(store)] == [[(1, 3), (2, 5)], [(1, 6), (2, 10)]]
    assert store.commits().count() == 2


def test_of_two_attempts_at_one_time_one_wins(spark, tmp_path, monkeypatch):
    store, other = (BatchStore(spark, f"file:{tmp_path}/store") for _ in range(2))
    real = BatchStore.committed
    monkeypatch.setattr(other, "committed", lambda batch: False)  # it looked before the first was done
    assert store.write(7, {"first": spark.range(2).withColumnRenamed("id", "k")})
    assert not other.write(7, {"first": spark.range(2).withColumnRenamed("id", "k")})
    assert real(store, 7) and store.read("first", "k long").count() == 2


def test_stream_batches_are_stored_once(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    store = BatchStore(spark, f"file:{tmp_path}/store")
    for folder in ("a", "b"):  # a second checkpoint plays the same batch again
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        rows.writeStream.foreachBatch(lambda df, n: store.write(n, {"first": df.selectExpr("id AS k")}) and None).option("checkpointLocation", f"{tmp_path}/{folder}").trigger(availableNow=True).start().awaitTermination()
    assert store.read("first", "k long").count() == 20


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>From Word</w:t></w:r></w:p></w:body></w:document>')
    files = {"a.md": b"# Head", "sub/b.rtf": b"{\\rtf1 Rich \\'e9}", "c.docx": docx.getvalue(), "d.docx": b"broken", "e.pdf": pdf.made([[(50.0, 700.0, "Set text")]]), "f.bin": b"\0\1", "g.html": b"<h1>T</h1>", "_hidden": b"x", "h.txt": "Größe".encode("latin-1")}
    for name, data in files.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(data)
    return str(base)


def test_whole_folder(spark, folder):
    folder_source.register(spark)
    got = {r["name"]: r for r in spark.read.format("folder").load(folder).collect()}
    texts = {k: r["text"] for k, r in got.items()}
    assert texts == {"a.md": "# Head", "b.rtf": "Rich é", "c.docx": "From Word", "d.docx": None, "e.pdf": texts["e.pdf"], "f.bin": None, "g.html": "# T", "h.txt": "Größe"}
    assert "Set text" in texts["e.pdf"] and got["d.docx"]["error"] and got["f.bin"]["error"] is None and bytes(got["f.bin"]["content"]) == b"\0\1"


def test_filters_are_pushed_and_columns_chosen(spark, folder):
    folder_source.register(spark)
    df = spark.read.format("folder").schema("name string, suffix string, size long").load(folder).where("suffix IN ('md', 'docx') AND size > 6 AND length(name) < 9")
    assert [r["name"] for r in df.collect()] == ["c.docx"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length(name" in plan and "> 6" not in plan and "docx" not in plan  # the source has taken the other filters over
    assert "text" not in plan and "content" not in plan
    parts = spark.read.format("folder").option("partition_bytes", 30).load(folder).rdd.getNumPartitions()
    assert parts > 2
    assert spark.read.format("folder").load(folder).where("suffix = 'none'").count() == 0


def test_files_are_dealt_by_size():
    files = [(f"p{k}", "", "", size, None) for k, size in enumerate([5, 90, 40, 40, 10])]
    assert [[f[3] for f in g] for g in folder_source.dealt(files, 100)] == [[90], [40, 40, 10, 5]]
    assert [[f[3] for f in g] for g in folder_source.dealt(files, 20)] == [[90], [40], [40], [10, 5]]
