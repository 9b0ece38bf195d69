"""Lookups, skew, listings, enrichment, JSON, sources and streams on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from webtables.functions import variant as V
from webtables.operators import enrich as E
from webtables.operators import listing as L
from webtables.operators import lookup as K
from webtables.operators import outcome as O
from webtables.operators import params as R
from webtables.operators.json import extract_json
from webtables.operators.shape import group_items, shape
from webtables.operators.html import extract_html
from webtables.functions import select as S
from webtables.plans.skew import keyed_join
from webtables.plans.spec import ALL, Extract, Field
from webtables.plans.task import run_task
from webtables.sources import assets as A
from webtables.sources import index as I
from webtables.sources.pages import decode_bodies, encode_results
from webtables.streaming.index import IndexStream


# -- lookups and skew ---------------------------------------------------------------------------
def people(spark):
    rows = [
        (0, "Ann Lee", ["annie", "Ann", "ann"], "1"), (1, "Bob", ["rob", "shared"], "2"), (2, "Cy", ["shared"], "3"),
        (3, "Dee", ["same"], "9"), (4, "Dee2", ["same"], " 9 "), (5, "Eve", ["void"], None), (6, "Fay", ["void", " "], "  "),
    ]
    return spark.createDataFrame(rows, "pos int, name string, aliases array<string>, id string")


def test_lookup_statuses(spark):
    probes = spark.createDataFrame([(1, " ANNIE "), (2, "shared"), (3, "same"), (4, "void"), (5, "nobody"), (6, "  "), (7, None), (8, "ann")], "n int, probe string")
    got = {r.n: (r.value, r.n_matches, r.status) for r in K.lookup_one(probes, people(spark), "aliases", "id").collect()}
    assert got == {
        1: ("1", 1, "ok"), 2: (None, 2, "ambiguous"), 3: ("9", 2, "ok"), 4: (None, 2, "no_value"), 5: (None, 0, "no_match"),
        6: (None, 0, "blank"), 7: (None, 0, "blank"), 8: ("1", 2, "ok"),  # a repeated alias repeats its row
    }
    exact = K.lookup_one(probes, people(spark), "aliases", "id", case_sensitive=True)
    assert {r.n: r.status for r in exact.collect()}[1] == "no_match"
    found = K.lookup_all(probes, people(spark), "aliases")
    assert sorted((r.n, r.pos) for r in found.collect()) == [(1, 0), (2, 1), (2, 2), (3, 3), (3, 4), (4, 5), (4, 6), (8, 0), (8, 0)]


def test_keyed_join_spreads_hot_keys(spark):
    n = 60_000
    left = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k")
    )
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 5000, 2)], "k string, v int")
    out = keyed_join(left, right, "k")
    assert out.count() == n
    assert out.exceptAll(left.join(right, "k", "left").select("id", "k", "v")).isEmpty()
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        full = left.repartition(8).withColumn("pay", F.sha2(F.col("id").cast("string"), 256))
        parts = keyed_join(full, right, "k").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("pay")).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert max(p["count"] for p in parts) < n / 4  # "hot" alone has a third of the rows


def test_scans_grow_linearly_with_resolvers(spark, tmp_path):
    spark.createDataFrame([(1, {"a": "x"})], "request_id long, params map<string,string>").write.parquet(f"{tmp_path}/p")
    people(spark).write.parquet(f"{tmp_path}/i")
    df = spark.read.parquet(f"{tmp_path}/p").withColumn("error", F.lit(None).cast("string"))
    index = spark.read.parquet(f"{tmp_path}/i")
    scans = []
    for n in (1, 2, 3, 4):
        task = {"resolve_params": {f"t{i}": {"index": "p", "from": "a", "match_field": "aliases", "value_field": "id"} for i in range(n)}}
        plan = R.resolve_params(df, task, {"p": {}}, {"p": index})
        scans.append(plan._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert scans == [2, 3, 4, 5]


def test_lists_of_repeated_rows_stay_apart(spark):
    lookup = spark.createDataFrame([("A", "u/a"), ("c", "u/c")], "name string, url string")
    rec = spark.createDataFrame([(1, [("A", "o1")]), (1, [("c", "o2"), ("x", "o3")]), (1, [("A", "o1")]), (2, None), (None, [("A", "o4")])], "rec_id int, people array<struct<name:string,image:string>>")
    out = [(r.rec_id, r.people and [p.image for p in r.people]) for r in K.replace_in_list(rec, lookup, "people").collect()]
    assert sorted(out, key=str) == sorted([(1, ["u/a"]), (1, ["u/c", "o3"]), (1, ["u/a"]), (2, None), (None, ["u/a"])], key=str)


def test_optional_resolution_never_tolerates_ambiguity(spark):
    df = spark.createDataFrame([(1, {"n": "shared"}), (2, {"n": "nobody"}), (3, {"n": "void"}), (4, {"n": "rob", "id": "given"}), (5, {"n": "rob", "id": " "})], "request_id int, params map<string,string>")
    df = df.withColumn("error", F.lit(None).cast("string"))

    def run(optional):
        task = {"resolve_params": {"id": {"index": "p", "from": "n", "match_field": "aliases", "optional": optional}}}
        out = R.resolve_params(df, task, {"p": {}}, {"p": people(spark)}).collect()
        return {r.request_id: (r.params.get("id"), r.error and r.error.rsplit(": ", 1)[1]) for r in out}

    assert run(False) == {1: (None, "ambiguous"), 2: (None, "no_match"), 3: (None, "no_value"), 4: ("given", None), 5: ("2", None)}
    assert run(True) == {1: (None, "ambiguous"), 2: (None, None), 3: (None, None), 4: ("given", None), 5: ("2", None)}


def test_plan_errors_are_rows(spark):
    df = spark.createDataFrame([(1, {"code": "x-1"}), (2, {"code": "bad"}), (3, {})], "request_id int, params map<string,string>")
    task = {"params": {"code": {"required": True, "regex": r"^x-(\d)$"}}, "request": {"url": "https://e.example/{code}/{who}", "method": " post "}}
    out = {r.request_id: r for r in R.plan_requests(df, task, {}).collect()}
    assert out[1].error == "missing template variables: who" and out[1].url is None and out[1].method == "POST"
    assert "does not match" in out[2].error and out[3].error == 'required param "code" is missing'
    ok = R.plan_requests(df.where("request_id = 1"), {**task, "request": {"url": "https://e.example/{code}?b=2&a=1", "query": {"b": "ü ~*"}}}, {}).first()
    assert ok.url == "https://e.example/1?a=1&b=%C3%BC+~%2A"
    site = {"defaults": {"cookie": "sid={sid}"}}
    given = df.where("request_id = 1").withColumn("ck", F.lit("own=1"))
    path = {**task, "request": {"url": "https://e.example/é{code}"}}
    with_own = R.plan_requests(given, path, site, cookie="ck").first()
    assert (with_own.cookie, with_own.error, with_own.url) == ("own=1", None, "https://e.example/%C3%A91")
    assert R.plan_requests(given.drop("ck"), path, site).first().error == "missing template variables: sid"


def test_image_replacement_in_lists(spark):
    lookup = spark.createDataFrame([("A", "u/a"), ("B", " "), ("c", "u/c")], "name string, url string")
    rec = spark.createDataFrame([(1, [(" A ", "o1"), ("B", "o2"), ("C", "o3"), ("", "o4")]), (2, []), (3, None)], "rec_id int, people array<struct<name:string,image:string>>")
    out = {r.rec_id: r.people for r in K.replace_in_list(rec, lookup, "people").collect()}
    assert [p.image for p in out[1]] == ["u/a", "o2", "o3", "o4"] and out[2] == [] and out[3] is None


# -- listings -----------------------------------------------------------------------------------
ITEM = "array<struct<id:string,url:string,name:string>>"


def listing(spark, rows):
    return spark.createDataFrame(rows, f"page long, attempt int, ok boolean, items {ITEM}")


def test_build_index_keeps_first_and_keyless(spark):
    rows = [
        (1, 0, True, [("7", "u7", "a"), (None, "u8", "b"), (None, None, "x")]),
        (2, 0, False, None), (2, 1, True, [(" 7 ", "other", "dup"), ("u8", None, "dup by shared key space"), ("", " ", "y"), ("9", None, "c")]),
        (3, 0, True, []), (4, 0, True, [("10", None, "after the gap")]),
    ]
    out, header, missing = L.build_index(listing(spark, rows))
    L.require_complete(header, missing)
    assert [(r.page, r.pos, r.name) for r in out.orderBy("page", "pos").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "x"), (2, 2, "y"), (2, 3, "c")]
    assert header.collect()[0].asDict() == {"count": 5, "total_pages": 2}


def test_build_index_failures(spark):
    empty = L.build_index(listing(spark, [(1, 0, True, []), (2, 0, True, [("1", None, "a")])]))
    with pytest.raises(ValueError, match="first index page"):
        L.require_complete(empty[1], empty[2])
    pages = listing(spark, [(1, 4, True, [("1", None, "late")])])
    late = L.build_index(pages, first_pass=3)  # only a later pass reaches attempt 4, so the first page was never seen
    with pytest.raises(ValueError, match="first index page"):
        L.require_complete(late[1], late[2])
    last = spark.createDataFrame([(3,)], "last_page long")
    gaps = L.check_complete(spark.createDataFrame([(1,), (3,)], "page long"), last)
    with pytest.raises(ValueError, match="page 2"):
        L.require_complete(last, gaps)


def test_retry_budget(spark):
    rows = [(1, 0, False, None), (1, 3, True, [("1", None, "a")]), (1, 5, True, [("2", None, "b")]), (2, 9, True, [("3", None, "c")])]
    got = L.pick_attempt(listing(spark, rows), retries=8).collect()
    assert [(r.page, r.attempt) for r in got] == [(1, 3)]


def test_items_under_key_shape_errors(spark):
    df = spark.createDataFrame([(1, (["a"],))], "page long, data struct<items:array<string>>")
    with pytest.raises(ValueError, match="unexpected type"):
        L.items_under_key(df)
    with pytest.raises(ValueError, match="does not contain"):
        L.items_under_key(df, "other")


def test_index_document_round_trip(spark, tmp_path):
    rows, header, _ = L.build_index(listing(spark, [(1, 0, True, [(str(i), None, f'n"{i}') for i in range(50)])]))
    path = str(tmp_path / "doc")
    I.write_index_document(rows, header, path, meta={"site": "s"})
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert doc["site"] == "s" and doc["count"] == 50 and [i["id"] for i in doc["items"]] == [str(i) for i in range(50)]
    whole = tmp_path / "one.json"
    whole.write_text(json.dumps({"people": doc["items"], "x": 1}, indent=1))
    assert I.read_index(spark, str(whole), "people").count() == 50
    with pytest.raises(ValueError, match="items key"):
        I.read_index(spark, str(whole), "")


def test_stream_index_survives_replay_and_order(spark, tmp_path):
    src = tmp_path / "in"
    schema = "page long, pos int, id string, url string, name string"
    for n, rows in enumerate([[(2, 0, "1", None, "later")], [(1, 0, "1", None, "first"), (1, 1, None, None, "k")], [(3, 0, "5", None, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    flow = IndexStream(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), lambda df: df, str(tmp_path / "out"))
    flow.run()
    flow._merge_batch(spark.createDataFrame([(3, 0, "5", None, "z")], schema), 99)  # a replayed batch
    assert sorted(r.name for r in flow.table().collect()) == ["first", "k", "z"]


# -- enrichment ---------------------------------------------------------------------------------
def test_fallback_reasons(spark):
    summary = spark.createDataFrame([("en", "A", 1, "Q1"), ("en", "B", 2, " "), ("en", "B2", 3, None)], "lang string, title string, pageid long, entity_id string")
    search = spark.createDataFrame([("en", "B", 2, "zz"), ("en", "B", 1, "B2"), ("en", "C", 1, "gone"), ("en", "D", 1, " ")], "lang string, query string, rank int, title string")
    probes = E.distinct_probes(spark.createDataFrame([(" A",), ("A",), ("B",), ("C",), ("D",), ("E",), (" ",)], "name string"), "name", "en")
    got = {r.query: (r.how, r.accepted_title, r.reason, r.s and r.s.pageid) for r in E.match_with_fallback(probes, summary, search).collect()}
    assert got == {
        "A": ("exact", "A", None, 1), "B": ("search", "B2", None, 3), "C": ("none", None, "summary_error", None),
        "D": ("none", None, "summary_error", None), "E": ("none", None, "not_found", None),
    }
    assert E.distinct_probes(spark.createDataFrame([("A",)], "name string"), "name", "").first().lang == "zh"


# -- JSON ---------------------------------------------------------------------------------------
def test_json_rules(spark):
    body = '{"a":{"z":{"v":"b1 x2"},"y":{"v":null}},"l":[1,2.5,"3",true,null],"s":"","t":" 7 ","big":12345678901234567890,"a2":1,"a2":2} tail'
    df = spark.createDataFrame([(1, body), (2, "{bad"), (3, None)], "doc_id int, body string")
    f = {
        "sorted": Field(path=("a", ALL, "v"), multiple=True, type="string"), "first": Field(path=("a", ALL, "v"), type="string"), "rx": Field(path=("a", "z", "v"), regex=r"([a-z])\d"),
        "list": Field(path=("l", ALL), multiple=True, type="string"), "empty": Field(path=("s",)), "trimmed": Field(path=("s",), trim=True), "n": Field(path=("t",), trim=True, type="int"),
        "neg": Field(path=("l", -1)), "oob": Field(path=("l", 9), default="d"), "big": Field(path=("big",), type="string"), "dup": Field(path=("a2",), type="int"),
    }
    out = {r.doc_id: r for r in extract_json(df, Extract(type="json", fields=f)).collect()}
    i = out[1]["items"][0]
    assert (i["sorted"], i["first"], i.rx, i.n, i.dup) == (["b1 x2"], None, "b", 7, 2)
    assert i["list"] == ["1", "2.5", "3", "true"] and i.trimmed is None and i.neg is None and i.big == "1.2345678901234567e+19"
    assert str(i.empty) == '""' and str(i.oob) == '"d"'
    assert out[2]["error"] == "invalid JSON" and out[3]["error"] is None


def test_number_text(spark):
    vals = ["1", "1.50", "1e3", "100.0", "1000000.0", "-1234567.5", "123456789.5", "0.0001", "0.00012", "0.00001", "1e21", "0.5", "-0.25", "9223372036854775808"]
    want = ["1", "1.5", "1000", "100", "1e+06", "-1.2345675e+06", "1.234567895e+08", "0.0001", "0.00012", "1e-05", "1e+21", "0.5", "-0.25", "9.223372036854776e+18"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in df.select(V.json_text(V.parse_json(F.col("s")))).collect()] == want


# -- classification and envelopes ---------------------------------------------------------------
def responses(spark, rows):
    schema = "request_id long, site string, task string, status int, final_url string, headers map<string,string>, body string, channel string, fetch_error string"
    return spark.createDataFrame([(n, "s", "t", st, "https://h.example/x", h, b, "http", e) for n, (st, h, b, e) in enumerate(rows)], schema)


def test_outcome_precedence(spark):
    gate = "<a class='Enter-Btn' href='?SAFEID=1'>满18岁</a>"
    r = responses(spark, [
        (200, {"CF-Mitigated": "Challenge"}, "x", "boom"), (403, {"server": "CloudFlare"}, gate, None), (403, {"server": "nginx"}, "x", None), (200, {}, gate, "boom"),
        (500, {}, "x", "boom"), (200, {}, "<script src='/cdn-cgi/challenge-platform/scripts/jsd/main.js'>", None), (503, {"SERVER": "cloudflare"}, "Just A Moment", None), (429, {}, None, None), (204, {}, None, None),
    ])
    out = {x.request_id: x.error for x in O.classify(r, [404]).collect()}
    assert out[0].type == "blocked" and out[0].matched == ["header: cf-mitigated=challenge"]
    assert out[1].reason == O.CHALLENGE_REASON and out[2].reason == "status 403" and out[3].reason == "age_verification_required"
    assert out[4].type == "fetch_error" and out[5] is None and out[7].matched == ["status: 429"] and out[8] is None
    assert out[6].matched == ["status/server: 503 cloudflare", "body: Just a moment"]
    off = {x.request_id: x.error for x in O.classify(r, challenge_mode="off").collect()}
    assert off[0].type == "fetch_error" and off[6].type == "http_error"


def test_run_task_envelopes(spark):
    r = responses(spark, [(200, {}, "<h1>T</h1><li>a</li><li></li>", None), (404, {}, "x", None)])
    req = spark.createDataFrame([(0, {"page": "x2"}, "u0", None), (1, {}, "u1", None), (5, {}, None, "bad param"), (6, {}, "u6", None)], "request_id long, params map<string,string>, url string, error string")
    task = {
        "extract": Extract(scope=S.descendant("li"), fields={"n": Field(S.self_node(), on_missing="skip_item")}, page={"h": Field(S.descendant("h1"))}, meta={"t": Field(S.descendant("h1"))}),
        "output": {"format": {"name": "{n}", "none": None}, "page_format": {"head": "<{h}>", "items": "lost"}, "items_key": "items"},
        "pagination": {"param": "page", "total_field": "t"},
    }
    out = run_task(r, task, req)
    got = {x.request_id: x for x in out.collect()}
    assert got[0].ok and got[0].data.head == "<T>" and [i.name for i in got[0].data["items"]] == ["a"]
    assert (got[0].meta["count"], got[0].meta.page, got[0].meta.page_text, got[0].meta.total, got[0].url) == (1, None, "x2", "T", "u0")
    assert [got[i].error.type for i in (1, 5, 6)] == ["http_error", "param_error", "fetch_error"]
    lines = {x.request_id: json.loads(x.value) for x in encode_results(out).collect()}
    assert lines[0]["data"]["items"] == [{"name": "a", "none": None}] and "error" not in lines[0]
    assert lines[1]["error"] == {"type": "http_error", "reason": "status 404"} and "data" not in lines[1] and "meta" not in lines[1]


def test_skipped_page_layer_is_an_output_error(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "u", "<h1>t</h1>")], "page_id long, url string, html string")
    spec = Extract(fields={"p": Field(S.descendant("p"))}, page={"h": Field(S.descendant("h1"), on_missing="skip_item")})
    out = {r.page_id: r for r in group_items(shape(extract_html(df, spec), {"v": "{p}"}), {"h": "{h}"}, "rows").collect()}
    assert out[1].error == "missing template variables: h" and out[1].data is None and out[2].data.h == "t"
    with pytest.raises(ValueError, match="a, b"):
        shape(extract_html(df, spec), {"v": "{a} {b}"})


# -- sources ------------------------------------------------------------------------------------
def test_asset_tree_later_groups_win(spark):
    body = '{"Content": {"g 1": {"Ann.jpg": "a b.jpg?t=1", "x.y.png": "p+.png", " .jpg": "n.jpg", "E.jpg": " "}, "g/2": {"Ann.png": "z.png?"}, "g 1": {"Bob.jpg": "b.jpg"}}}'
    got = A.flatten_image_tree(spark.createDataFrame([(body,)], "body string"), "https://c.example//")
    assert {r.name: r.url for r in got.collect()} == {
        "Ann": "https://c.example/Content/g%2F2/z.png", "x.y": "https://c.example/Content/g%201/p+.png", "Bob": "https://c.example/Content/g%201/b.jpg",
    }


def test_decode_bodies(spark):
    text = "é—ü"
    rows = [
        (text.encode(), "text/html"), (text.encode("cp1252"), "text/html; charset=ISO-8859-1"), ("日本".encode("shift_jis"), "text/html; charset=Shift_JIS"),
        ("中".encode("gbk"), "text/html;charset=gbk"), (b"<meta charset='windows-1252'>" + text.encode("cp1252"), None), (text.encode("cp1252"), ""), (text.encode(), "x; charset=nonsense"), (None, None),
    ]
    got = [r.body for r in decode_bodies(spark.createDataFrame(rows, "body binary, content_type string")).collect()]
    assert got == [text, text, "日本", "中", "<meta charset='windows-1252'>" + text, text, text, None]
