"""Small rows with dear work: dealt out by their number, and read without lambdas where they are plain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from webtables.catalog import jsonx
from webtables.catalog import params as catalog_params
from webtables.functions.variant import json_path, json_text, parse_json
from webtables.operators import params as R
from webtables.plans.spec import ALL
from webtables.sources import pages

REQUEST = {"path": "/o/{code}", "query": {"z": "{page}", "b": "{name}"}, "omit_empty_query": True}


def orders(spark, tmp_path, n):
    cols = "id AS o_orderkey, id % 7 AS o_custkey, 'O' AS o_orderstatus, 1.5D AS o_totalprice, TIMESTAMP'2020-01-01 00:00:00' AS o_orderdate, '2-HIGH' AS o_orderpriority"
    spark.range(n).selectExpr(*cols.split(", ")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows", [catalog_params.raw, jsonx.bodies])
def test_more_rows_get_more_tasks(spark, tmp_path, monkeypatch, rows):
    sf = orders(spark, tmp_path, 500)
    monkeypatch.setattr(pages, "ROWS", 10)
    df = rows(spark, sf)
    assert df.rdd.getNumPartitions() == 50
    assert df.count() == 500


def planned(spark, base="HTTPS://a.example/base/x?y=1", request=REQUEST):
    given = [("1", "2", "a b&c"), ("..", None, "é"), ("/x", " ", "1"), ("a/./b", "1", "1"), ("q?z=9&k=1", "2", "x"), ("h#f?g", None, "y"), ("é ü", "3", "3"), ("%zz", "", ""), ("", None, None), ("(a)*~[b]", "1", "*~"), ("a\n", "1", "1"), (None, "1", "1")]
    df = spark.createDataFrame([(n, *g) for n, g in enumerate(given)], "n int, code string, page string, name string")
    params = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("code", "page", "name")]), lambda e: e["v"].isNotNull()))
    df = df.select("n", params.alias("params"))
    return df, df.select("n", R.build_url(base, request, F.col("params")).alias("url"))


@pytest.mark.parametrize("request_", [REQUEST, {**REQUEST, "omit_empty_query": False}, {"path": "/o/{code}"}])
def test_plain_paths_like_the_others(spark, request_):
    base = "HTTPS://a.example/base/x?y=1"
    df, fast = planned(spark, base, request_)
    p = F.col("params")
    whole = R.U.with_query(R.U.resolve_url(F.lit(base), R.P.render_map("/o/{code}", p)), R.query_column(request_, p))
    want = {r.n: r.url for r in df.select("n", whole.alias("url")).collect()}
    assert {r.n: r.url for r in fast.collect()} == want
    assert want[0].startswith("https://a.example/o/1")


def test_plain_paths_take_no_parsing(spark, monkeypatch):
    monkeypatch.setattr(R.U, "with_query", lambda url, entries: F.raise_error(F.lit("parsed")).cast("string"))
    _, fast = planned(spark)
    assert fast.where("n = 0").collect()[0].url == "https://a.example/o/1?b=a+b%26c&z=2"


def test_paths_to_one_value(spark):
    body = '{"a":[{"b":null,"c":1.5,"d":7},{"b":"x"}],"o":{"k2":{"v":2},"k1":{"v":1}},"n":null}'
    df = spark.createDataFrame([(body,), ("broken",), ("null",), ("[]",)], "body string").select(parse_json(F.col("body")).alias("v"))

    def texts(path):
        return [r[0] for r in df.select(F.transform(json_path(F.col("v"), path), json_text)).collect()]

    assert texts(("a", ALL, "b")) == [[None, "x"], [], [], []]
    assert texts(("a", 0, "c")) == [["1.5"], [], [], []]
    assert texts(("o", ALL, "v")) == [["1", "2"], [], [], []]
    assert texts((ALL, ALL, "d")) == [["7"], [], [], []]
    assert texts(("n",)) == [[None], [], [], []]
    assert texts(("a", -1)) == [[], [], [], []]
    assert texts(())[2:] == [[None], ["[]"]]
