"""Streams that are stopped, started again, folded and read meanwhile."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from webtables.catalog import load
from webtables.plans import files
from webtables.streaming.extract import stream_extract
from webtables.streaming.index import IndexStream
from webtables.streaming.versions import VersionedTable

ITEMS = "page long, pos int, id string, url string, name string"
BATCHES = [
    [(2, 0, "1", None, "later"), (2, 1, None, None, "keyless")],
    [(1, 0, "1", None, "first"), (1, 1, "2", None, "two"), (1, 1, "2", None, "two")],
    [(2, 1, None, None, "keyless"), (3, 0, " ", "2", "two again"), (3, 1, "5", None, "five")],
    [(4, 0, None, " ", "none"), (1, 0, "1", None, "first")],
]
WANT = ["first", "five", "keyless", "none", "two"]


class Stopped(Exception):
    pass


def landed(spark, folder, batches, schema=ITEMS):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def names(df):
    return sorted(r.name for r in df.collect())


def flow(spark, tmp_path, **more):
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return IndexStream(spark, stream, lambda df: df, str(tmp_path / "index"), str(tmp_path / "checkpoint"), **more)


@pytest.mark.parametrize("fold_every", [None, 2])
def test_index_goes_on(spark, tmp_path, fold_every):
    landed(spark, str(tmp_path / "in"), BATCHES[:2])
    assert names(flow(spark, tmp_path, fold_every=fold_every).run()) == ["first", "keyless", "two"]
    landed(spark, str(tmp_path / "in"), BATCHES[2:])
    again = flow(spark, tmp_path, fold_every=fold_every)
    assert names(again.run()) == WANT
    assert again.table_.version().last_batch == 3
    again.run()
    assert names(again.table()) == WANT and again.table_.version().last_batch == 3


@pytest.mark.parametrize("when", ["before", "after"])
def test_index_stopped_around_its_commit(spark, tmp_path, monkeypatch, when):
    landed(spark, str(tmp_path / "in"), BATCHES)
    create, calls = files.create_once, []

    def stop(spark_, path, text):
        calls.append(path)
        if len(calls) != 2:
            return create(spark_, path, text)
        if when == "after":
            create(spark_, path, text)
        raise Stopped

    monkeypatch.setattr(files, "create_once", stop)
    with pytest.raises(Exception):
        flow(spark, tmp_path).run()
    monkeypatch.setattr(files, "create_once", create)
    again = flow(spark, tmp_path)
    assert names(again.run()) == WANT
    version = again.table_.version()
    assert version.last_batch == 3 and len(version.deltas) == 4
    again.table_.vacuum()
    left = files.names(spark, f"{again.table_.path}/deltas")
    assert len(left) == 4 and names(again.table()) == WANT


def test_a_reader_keeps_its_version(spark, tmp_path):
    landed(spark, str(tmp_path / "in"), BATCHES[:2])
    index = flow(spark, tmp_path, fold_every=None)
    index.run()
    old = index.table_.version()
    reader = index.table(old)
    landed(spark, str(tmp_path / "in"), BATCHES[2:])
    index.run()
    assert index.fold()
    new = index.table_.version()
    assert new.base and not new.deltas and len(new.folders) == 1
    assert names(reader) == ["first", "keyless", "two"] and names(index.table()) == WANT
    assert index.table_.read(new).count() == len(WANT)
    assert not index.fold()
    index.table_.vacuum(keep=1)
    assert files.names(spark, f"{index.table_.path}/deltas") == [] and names(index.table()) == WANT


def test_a_fold_while_batches_arrive(spark, tmp_path):
    schema = spark.createDataFrame([], "k long").schema
    table = VersionedTable(spark, str(tmp_path / "t"), schema)
    assert table.read().count() == 0 and not table.fold(lambda df: df)
    table.append(spark.createDataFrame([(1,)], schema), 0)

    def slow(df):
        table.append(spark.createDataFrame([(2,)], schema), 1)  # arrives while the fold runs
        assert VersionedTable(spark, table.path, schema).fold(lambda x: x.where("k > 0"))  # another fold is faster
        table.append(spark.createDataFrame([(3,)], schema), 2)
        return df

    assert not table.fold(slow)
    assert sorted(r.k for r in table.read().collect()) == [1, 2, 3]
    assert not table.append(spark.createDataFrame([(9,)], schema), 2)
    version = table.version()
    assert version.last_batch == 2 and len(version.deltas) == 1
    table.vacuum(keep=1)
    assert sorted(r.k for r in table.read().collect()) == [1, 2, 3]
    assert files.names(spark, f"{table.path}/bases") == [version.base.partition("/")[2]]


def test_files_are_created_once(spark, tmp_path):
    path = f"{tmp_path}/m/1"
    assert files.create_once(spark, path, "á") and not files.create_once(spark, path, "b")
    assert files.read_small(spark, path) == "á" and files.names(spark, f"{tmp_path}/m") == ["1"]


@pytest.mark.parametrize("lost", ["commit", "commit and log"])
def test_extract_stopped_between_write_and_commit(spark, tmp_path, lost):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "page_id long, html string"
    landed(spark, src, [[(n, f"<p>{n}</p>")] for n in range(3)], schema)

    def run():
        return stream_extract(spark, src, schema, lambda df: df.select("page_id", F.upper("html").alias("h")), out, checkpoint, files_per_batch=1)

    assert sorted(r.page_id for r in run().collect()) == [0, 1, 2]
    # As if the stream had been stopped in its last batch: files are there, the end of the batch is not known.
    for name in ["2", ".2.crc"]:
        (tmp_path / "checkpoint" / "commits" / name).unlink()
        if lost == "commit and log":
            (tmp_path / "out" / "_spark_metadata" / name).unlink()
    landed(spark, src, [[(3, "<p>3</p>")]], schema)
    assert sorted(r.page_id for r in run().collect()) == [0, 1, 2, 3]
    assert sorted(r.page_id for r in run().collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("name", ["stream_index", "stream_extract"])
def test_a_table_that_is_a_folder(spark, tmp_path, name):
    def page(n):
        links = "".join(f'<li><a href="/p/{k % 4}">{"x" * (1 + (n + k) % 9)}{k % 3}</a></li>' for k in range(n % 5))
        return n, f"https://e{n % 2}.example/{n}", f"<html><body><nav><ul>{links}</ul></nav></body></html>"

    table = tmp_path / "in" / "pages.parquet"
    spark.createDataFrame([page(n) for n in range(40)], "page_id long, url string, html string").repartition(3).write.parquet(str(table))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{table}/*.parquet'")
    queries, sql = load()
    n, problem = compare(spark, con, queries[name], sql[name], str(tmp_path / "in"))
    assert n > 0 and problem is None
