"""Documents read by splits, freshness and merging without payloads, repeated JSON keys, entities, siblings."""

from __future__ import annotations

import html
import json
import random
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from webtables.functions import select as S
from webtables.functions import variant as V
from webtables.functions.entities import unescape
from webtables.operators import html as H
from webtables.operators import listing as L
from webtables.operators import lookup as K
from webtables.sources import assets as A
from webtables.sources import index as I
from webtables.sources.json_split import read_index_split
from webtables.sources.pages import read_json_pages


@pytest.fixture
def settings(spark):
    """Set options for one test."""
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


# -- one document, many splits ------------------------------------------------------------------
NAMES = ["a", 'q"u}o{te', "back\\slash\\", '"items": [', "é 日本", "", "[[]]}}", "tab\tnl\n", '\\"', None]


def document(rng, n, key="items"):
    def value(depth):
        kind = rng.random()
        if depth < 3 and kind < 0.2:
            return {rng.choice(["k", "items", "x}"]): value(depth + 1) for _ in range(rng.randint(0, 2))}
        if depth < 3 and kind < 0.4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, -2.5e3, True, None, *NAMES])

    return {
        "head": {"items": [{"name": "no"}], "t": '"items": ['}, "list": [[], [{"items": []}], "}"], key: [{"name": rng.choice(NAMES), "id": k, "more": value(0)} for k in range(n)],
        "tail": [{"name": "not this"}], "end": {"a": {"b": "}"}},
    }


@pytest.mark.parametrize("indent, ascii_, split", [(None, True, 500), (4, False, 900), (1, True, 1 << 20)])
def test_document_by_splits(spark, tmp_path, settings, indent, ascii_, split):
    settings("spark.sql.files.maxPartitionBytes", str(split))
    settings("spark.sql.files.openCostInBytes", "0")
    doc = document(random.Random(split + (indent or 0)), 20)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_) + ("\n" if indent else ""))
    got = read_index_split(spark, str(path)).select("pos", F.col("item").cast("string").alias("i")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(20)) and [json.loads(r.i) for r in got] == doc["items"]
    whole = I.read_index(spark, str(path), schema="name string, id long").select("pos", "name", "id").collect()
    parts = read_index_split(spark, str(path), schema="name string, id long").orderBy("pos").collect()
    assert [tuple(r) for r in parts] == [tuple(r) for r in whole]


def test_document_keys(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"a": 1, "items" : [ ], "übung":[{"id":1} , {"id":{"x":[2]}}], "s": {"z": [{"id": 9}]}}')
    assert read_index_split(spark, str(path), "").count() == 0
    assert [r.pos for r in read_index_split(spark, str(path), "übung").orderBy("pos").collect()] == [0, 1]
    for missing in ("z", "a", "no"):
        with pytest.raises(ValueError, match="items key"):
            read_index_split(spark, str(path), missing)
    path.write_text('{"items": [{"id": 1}, 5, {"id": 2}]}')
    with pytest.raises(Exception, match="no object"):
        read_index_split(spark, str(path)).collect()
    parts = tmp_path / "parts"
    parts.mkdir()
    for n, text in enumerate(['{"items": [{"id"', ': 1}', '\n,\n{"id":2}\n', ']}\n']):
        (parts / f"part-{n}").write_text(text)
    assert [r.id for r in read_index_split(spark, str(parts), schema="id long").orderBy("pos").collect()] == [1, 2]


# -- plans without payloads ---------------------------------------------------------------------
def moved_columns(df):
    """Names of the columns that exchanges and aggregations of the plan put out."""
    out, stack = set(), [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if "Exchange" in name or "Aggregate" in name:
            attrs = node.output()
            out |= {attrs.apply(i).name() for i in range(attrs.size())}
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return out


def test_merge_moves_no_items(spark, tmp_path, settings):
    settings("spark.sql.adaptive.enabled", "false")
    rows = [(p, q, f"k{(p * q) % 7}" if q else None, None, {"big": "x"}) for p in range(1, 9) for q in range(5)]
    spark.createDataFrame(rows, "page long, pos int, id string, url string, payload map<string,string>").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    merged = L.merge_dedupe(items)
    moved = moved_columns(merged)
    assert moved and not moved & {"payload", "_row"}
    got = sorted((r.page, r.pos) for r in merged.collect())
    first = {}
    for p, q, k, *_ in sorted(rows, key=lambda r: r[:2]):
        if k:
            first.setdefault(k, (p, q))
    assert got == sorted([*first.values(), *[(p, 0) for p in range(1, 9)]])


def test_building_an_index_writes_nothing(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("written"))
    listing = spark.createDataFrame([(1, 0, True, [("1", None, "a"), ("1", None, "b")])], "page long, attempt int, ok boolean, items array<struct<id:string,url:string,name:string>>")
    rows, header, missing = L.build_index(listing)
    assert [r.name for r in rows.collect()] == ["a"] and header.first()["count"] == 1 and missing.count() == 0


SNAPSHOTS = [("s", "cache", 1, True, "old"), ("s", "cache", 9, True, "new"), ("s", "cache", 9, True, "new"), ("t", "download", 5, True, "got"), ("t", "cache", 1, True, "stale"), ("u", "download", 5, False, "bad"), (None, "cache", 9, True, "none")]


@pytest.mark.parametrize("with_id", [True, False])
def test_snapshots_move_no_bodies(spark, tmp_path, settings, with_id):
    settings("spark.sql.adaptive.enabled", "false")
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(SNAPSHOTS)], "source string, kind string, day int, ok boolean, body string, snapshot_id int")
    df = df.withColumn("captured_at", F.expr("timestampadd(DAY, day, timestamp'2024-01-01 00:00:00')")).drop("day")
    (df if with_id else df.drop("snapshot_id")).write.parquet(str(tmp_path / "s"))
    out = A.snapshot_with_ttl(spark.read.parquet(str(tmp_path / "s")), F.lit("2024-01-10 12:00:00").cast("timestamp"))
    assert "body" not in moved_columns(out)
    assert sorted(((r.source or "", r.body, r.freshness) for r in out.collect())) == [("", "none", 0), ("s", "new", 0), ("t", "got", 1)]
    assert "_file" not in out.columns


# -- lookups ------------------------------------------------------------------------------------
def test_list_join_keeps_lists_apart(spark):
    schema = "rec_id long, people array<struct<name:string,image:string>>"
    rows = [(1, [("a", "o"), (None, "o")]), (1, [(None, "o"), ("a", "o")]), (1, [("a", "o"), (None, "o")]), (1, []), (None, [(" b ", "o")]), (2, None)]
    lookup = spark.createDataFrame([("a", "u/a"), ("b", "u/b")], "name string, url string")
    got = sorted((r.rec_id or 0, None if r.people is None else tuple(p.image for p in r.people)) for r in K.replace_in_list(spark.createDataFrame(rows, schema), lookup, "people").collect() if r.people is not None)
    assert got == [(0, ("u/b",)), (1, ()), (1, ("o", "u/a")), (1, ("u/a", "o")), (1, ("u/a", "o"))]


def test_list_join_exchanges(spark, tmp_path, settings):
    settings("spark.sql.adaptive.enabled", "false")
    spark.createDataFrame([(1, [("a", "o")])], "rec_id long, people array<struct<name:string,image:string>>").write.parquet(str(tmp_path / "r"))
    lookup = spark.createDataFrame([("a", "u/a")], "name string, url string").hint("broadcast")
    plan = K.replace_in_list(spark.read.parquet(str(tmp_path / "r")), lookup, "people")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_report_of_a_hot_probe(spark, settings):
    settings("spark.sql.adaptive.enabled", "false")
    index = spark.createDataFrame([(n, "hot" if n else "Other ", f"i{n}") for n in range(300)], "pos int, name string, id string")
    probes = spark.createDataFrame([(" HOT",), (" HOT",), ("other",), ("none",), (" ",), (None,)], "probe string")
    counts, matches = K.lookup_report(probes, index)
    assert {r.probe: (r.ok, r["count"], r.first_pos, r.last_pos) for r in counts.collect()} == {" HOT": (True, 299, 1, 299), "other": (True, 1, 0, 0), "none": (False, 0, None, None), " ": (False, 0, None, None), None: (False, 0, None, None)}
    got = [(r.probe, r.pos) for r in matches.collect()]
    assert got == [(" HOT", n) for n in range(1, 300)] + [("other", 0)]
    sizes = [n for n in matches.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 2 and max(sizes) < 200


# -- JSON, entities, siblings -------------------------------------------------------------------
@pytest.mark.parametrize("allowed", ["true", "false"])
def test_repeated_json_keys(spark, settings, allowed):
    settings("spark.sql.variant.allowDuplicateKeys", allowed)
    bodies = ['{"a":1,"a":2}', ' {"b":{"x":1,"x":[1.50,12345678901234567890]},"b2":"é\\u0000"} tail', '{"a":', None, '{"k":"\\"a\\":1","n":-0.0,"k":"v"}', "[NaN]", '{"a":1,"a":NaN}']
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, body string")
    got = [(r.t, r.json_error) for r in read_json_pages(df).select("n", F.to_json("json").alias("t"), "json_error").orderBy("n").collect()]
    assert got[0] == ('{"a":2}', None) and json.loads(got[1][0])["b"]["x"][0] == 1.5 and got[2] == (None, "extract_error") and got[3] == (None, None)
    assert json.loads(got[4][0]) == {"k": "v", "n": 0.0} and got[5][1] == got[6][1] == "extract_error"


def test_every_entity(spark):
    rng = random.Random(3)
    names = sorted(html5)
    texts = [f"&{n}" for n in names] + [f"x&{rng.choice(names).rstrip(';')}{rng.choice(['', ';', 'z', '1;', '=', ' '])}&{rng.choice(names)}" for _ in range(800)] + ["&", "&;", "&#65;&#x41&#0;", "&zzzz;", "&ampamp;amp", "&notit;", "a&b;c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    wrong = [(r.t, r.u) for r in df.select("t", unescape(F.col("t")).alias("u")).collect() if r.u != html.unescape(r.t)]
    assert not wrong, wrong[:5]


def test_families(spark):
    page = "<ul id=a><li>1<ul><li>in</ul><li>2<p>x</p><li>3</ul><dl><dt>t<dd>d<dt>u<dd>e</dl><p>last"
    dom = H.with_dom(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string"))
    nodes = {r.k: r for r in dom.select("k", "dom").collect()}
    assert nodes[2].dom is None
    for k in (1, 3):
        d = nodes[k].dom
        for n in d.nodes:
            kids = [m.pre for m in d.nodes if m.parent == n.pre]
            assert d.kids[n.k0 : n.k0 + n.kn] == kids and [d.nodes[i].rank for i in kids] == list(range(len(kids)))
    root = F.get(F.col("dom.nodes"), F.lit(0))

    def texts(sel, only_first=False):
        found = sel.apply(F.col("dom"), root, only_first)
        return dom.where("k = 1").select(F.transform(found, lambda n: S.D.node_text(F.col("dom"), n)).alias("t")).first().t

    assert texts(S.descendant("dt").following_sibling("dd")) == ["d", "e"] and texts(S.descendant("dt").following_sibling("dd").nth(1)) == ["d", "e"]
    assert texts(S.descendant("dt").first().following_sibling()) == ["d", "u", "e"] and texts(S.descendant("dt").first().following_sibling("dd"), True) == ["d"]
    assert texts(S.descendant("dt").first().following_sibling("dd").nth(2)) == ["e"] and texts(S.descendant("dt").first().following_sibling("*").nth(-1)) == ["e"]
    assert texts(S.descendant("ul", S.attr_is("id", "a")).child("li").nth(2)) == ["2x"] and texts(S.descendant("dt").first().following_sibling("*").nth(9)) == []
    assert texts(S.parent()) == [] and texts(S.following_sibling()) == []


def test_wide_pages_take_time_in_proportion(spark):
    def seconds(n):
        body = "<ul>" + "".join(f"<li>{i}</li><!-- -->" for i in range(n)) + "</ul>"
        df = spark.createDataFrame([(1, "u", body)], "page_id int, url string, html string")
        from webtables.plans.spec import Extract, Field

        spec = Extract(scope=S.descendant("li"), fields={"own": Field(S.self_node()), "next": Field(S.following_sibling("li")), "any": Field(S.following_sibling().nth(2))})
        start = time.time()
        rows = H.extract_items(df, spec, keep=["page_id"]).collect()
        assert len(rows) == n and rows[0].next == "1" and rows[n - 2].next == str(n - 1) and rows[n - 1].next is None and rows[0].any == "2"
        return time.time() - start

    seconds(100)
    assert seconds(20_000) < 15  # quadratic work takes minutes
