"""Any text is a page: no exception, and the node array always is a consistent tree."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from webtables.functions.dom import _parse_batch

PIECES = [
    "<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href='x'>", "</a>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<li>", "</ul>", "<ul>", "<br>", "</br>", "<div/>",
    "<script>", "</script>", "<!--", "-->", "<![CDATA[", "<![if x]>", "]]>", "<!DOCTYPE html>", "<html>", "<body class=q>", "</body>", "</html>", "<head>", "<title>", "</title>",
    "é", "&amp;", "&#xD800;", "<", ">", "&", "<?php ", "</", "<a b=\"", "text ", "\n", "<h1>", "<h2>", "<option>", "<select>", "<svg>", "<path/>", "</svg>", "<nobr>", "<dd>", "<dt>",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=25))
def test_tree_invariants(parts):
    body = "".join(parts).encode("utf-8", "replace").decode()
    row = _parse_batch(pa.array([None, body, body]), True).to_pylist()
    assert row[0] is None and row[1] == row[2]
    text, markup, nodes = row[1]["text"], row[1]["html"], row[1]["nodes"]
    assert [n["pre"] for n in nodes] == list(range(len(nodes)))
    assert nodes[0]["tag"] == "#document" and nodes[0]["last"] == len(nodes) - 1
    assert [n["tag"] for n in nodes[1:3]] == ["html", "head"] and sum(n["tag"] == "body" for n in nodes) == 1
    for n in nodes[1:]:
        up = nodes[n["parent"]]
        assert up["pre"] < n["pre"] <= n["last"] <= up["last"]
        assert up["t0"] <= n["t0"] <= n["d0"] <= n["d1"] <= n["t1"] <= up["t1"] <= len(text)
        assert up["i0"] <= n["o0"] <= n["i0"] <= n["i1"] <= n["o1"] <= up["i1"] <= len(markup)
        text[n["t0"] : n["t1"]].decode()
        assert markup[n["o0"] : n["o1"]].decode().startswith("<" + n["tag"])
