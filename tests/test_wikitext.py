"""Golden wikitext."""

from pyspark.sql import functions as F

from webtables.functions import wikitext as K
from webtables.operators.wikitext import WikiSpec, wiki_text_record

TEXT = """{{note|{{a}} b}}
{{Infobox thing2|name=wrong}}
{{Infobox thing
|name= '''Ada'''<ref name="r">x</ref>
|other
|alias=
| alias2 = [[Page|Nick]]
 second line

|height=about 170 cm
|height=171cm
|y=1990年|m
|m=3
|d=14
|list={{jpn|a=[[X]]|b=|Y &amp; Z}}
}}
'''Intro''' [[a|b]]<br>line {{fact|kept|2}}{{bd| 1 |2}} {{DEFAULTSORT:q}}{{other|first|second}} <i>i</i>&nbsp;&lt;


== History ==
Old.


More [[File:x.jpg]] text
=== Sub ===
sub
==Histoire==
New.
== Links ==
* {{Twitter | ada }}
*{{X|ada2}} * {{Instagram|ig/}}
* [https://a.example/x The ''label''] then [http://b.example]

== End =="""


def col(spark, c, text=TEXT):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]


def test_parts(spark):
    # Only the leading run of templates is dropped.
    assert col(spark, K.intro) == "Intro b\nline kept12 first i <"
    assert col(spark, lambda t: K.section(t, "History")) == "Old.\n\n\nMore [[File:x.jpg]] text"
    assert col(spark, lambda t: K.section_aliases(t, ["History", "Histoire"])) == "New."
    assert col(spark, lambda t: K.section_aliases(t, ["Histoire", "History"])) == "Old.\n\nMore text"
    assert col(spark, lambda t: K.section(t, "Nope")) == ""
    links = col(spark, lambda t: K.section_links(t, ["Absent", "Links"]))
    assert [(x.label, x.url, x.username) for x in links] == [
        ("Twitter", "https://twitter.com/ada", "ada"), ("Twitter", "https://twitter.com/ada2", "ada2"),
        ("The label", "https://a.example/x", None), ("http://b.example", "http://b.example", None),
    ]


def test_infobox(spark):
    fields = col(spark, lambda t: K.infobox_fields(K.infobox_body(t, "Infobox thing")))
    got = {f.key: f.value for f in fields}
    assert got == {
        "name": "'''Ada'''<ref name=\"r\">x</ref>", "alias": "", "alias2": "[[Page|Nick]]\nsecond line", "height": "171cm",
        "y": "1990年|m", "m": "3", "d": "14", "list": "{{jpn|a=[[X]]|b=|Y &amp; Z}}",
    }
    assert len(fields) == len(got)


def test_unbalanced_templates(spark):
    assert col(spark, lambda t: K.infobox_body(t, "Box"), "{{Box|a {{Box|b}}") == "Box|b"
    assert col(spark, lambda t: K.infobox_body(t, "Box"), "{{Box|a") is None
    assert col(spark, lambda t: K.infobox_body(t, "Box"), "{{Boxes|a}} {{{Box}}}") == "Box"
    assert col(spark, K.strip_leading_templates, "{{a}}{{b {{c}} }} x {{d}} y") == "x {{d}} y"
    assert col(spark, K.strip_leading_templates, " {{a}} {{b") == " {{a}} {{b"
    assert col(spark, K.strip_leading_templates, "{{a}}}} z") == "}} z"


def test_record(spark):
    spec = WikiSpec(
        infobox="Infobox thing", text_fields={"name": ["name"], "nick": ["alias", "alias2"], "list": ["list"], "none": ["zz"]},
        number_fields={"height_cm": ["size", "height"], "w": ["zz"]}, date_fields=("y", "m", "d"), composite=("all", ["height_cm", "w"]),
        sections={"resume": ["History", "Histoire"], "gone": ["Nope"]}, link_sections=["Nope"],
    )
    rows = [(1, TEXT.replace("\n", "\\n"), [" https://web.archive.org/1", "", " https://k.example "]), (2, "  ", []), (3, "plain", None)]
    out = {r.i: r.text for r in wiki_text_record(spark.createDataFrame(rows, "i int, wikitext string, external_links array<string>"), spec).collect()}
    r = out[1]
    assert r.intro.startswith("Intro b") and r.resume == "New." and r.gone is None
    assert r.profile.asDict() == {
        "name": "Ada", "nick": "Nick\nsecond line", "list": "X / Y & Z", "none": None, "birth_date": "1990-03-14", "height_cm": "171", "w": None, "all": "171 -  cm",
    }
    assert [x.url for x in r.external_links] == ["https://k.example"]
    assert out[2] is None and out[3].intro == "plain" and out[3].profile is None and out[3].external_links is None
