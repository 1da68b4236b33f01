from pyspark.sql import functions as F

from shelfwright.operators.metadata import (R_EMPTY_TITLE, R_MALFORMED, R_NO_DESCRIPTION, R_NO_TITLE,
                                            book_metadata, check_wellformed)

SIMPLE = ("<FictionBook><description><title-info><author><first-name>Ада</first-name>"
          "<last-name>Ветрова</last-name></author>\n<book-title>Тихий берег</book-title>"
          "</title-info></description></FictionBook>")

FULL = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns:l="http://www.w3.org/1999/xlink">
<description><title-info><genre>sf</genre><genre>prose</genre>
<author><first-name>Нил</first-name><last-name>Озеров</last-name></author>
<author><first-name>Only</first-name></author>
<author><last-name> !! </last-name></author>
<book-title>War &amp; Peace</book-title><book-title>  </book-title><lang>ru</lang></title-info>
<document-info><author><last-name>Doc</last-name><first-name>Maker</first-name></author>
<id> 42 </id><version>1.0</version></document-info></description>
<body><p>broken <b>body</p></body></FictionBook>"""


def meta(spark, docs):
    df = spark.createDataFrame(docs, "path string, text string")
    return {r["path"]: r for r in book_metadata(df).collect()}


def test_simple_book(spark):
    m = meta(spark, [("lib/x.fb2.zip", SIMPLE)])["lib/x.fb2.zip"]
    assert m["title"] == "Тихий берег" and m["norm_title"] == "Тихийберег"
    assert [a["id"] for a in m["authors"]] == ["Ветрова Ада"]
    assert m["filename"] == "x.fb2" and m["reject_reason"] is None


def test_full_book_last_wins_and_body_ignored(spark):
    m = meta(spark, [("a/b.fb2", FULL)])["a/b.fb2"]
    assert m["reject_reason"] is None          # broken body after </description> is not read
    assert m["title"] == "War & Peace"         # empty later title does not overwrite
    assert m["genre"] == "prose" and m["lang"] == "ru"
    assert m["ext_id"] == "42" and m["version"] == "1.0"
    # each author stands alone: first-name-only is kept, empty key dropped; document-info last
    assert [a["id"] for a in m["authors"]] == ["Озеров Нил", "Only", "Doc Maker"]


def test_reject_rules(spark):
    docs = [
        ("1.fb2", "<FictionBook><description><title-info><book-title>1984</book-title></title-info></description></FictionBook>"),
        ("2.fb2", "<FictionBook><description><title-info></title-info></description></FictionBook>"),
        ("3.fb2", "<FictionBook><body/></FictionBook>"),
        ("4.fb2", "<Other><description><title-info><book-title>B</book-title></title-info></description></Other>"),
        ("5.fb2", "<FictionBook><description><title-info><book-title>B</book-title></title-info>"),
        ("6.fb2", ""),
    ]
    m = meta(spark, docs)
    assert m["1.fb2"]["reject_reason"] == R_EMPTY_TITLE
    assert m["2.fb2"]["reject_reason"] == R_NO_TITLE
    assert m["3.fb2"]["reject_reason"] == R_NO_DESCRIPTION
    assert m["4.fb2"]["reject_reason"] == R_NO_DESCRIPTION
    assert m["5.fb2"]["reject_reason"] == R_MALFORMED
    assert m["6.fb2"]["reject_reason"] == R_MALFORMED


def test_wellformed(spark):
    docs = [("ok", SIMPLE), ("body", FULL), ("junk", SIMPLE + " trailing <<"), ("empty", ""),
            ("entity", "<a>&nbsp;</a>"), ("nodecl", "<a><b/></a>")]
    df = spark.createDataFrame(docs, "k string, t string")
    got = {r["k"]: r["ok"] for r in df.select("k", check_wellformed(F.col("t")).alias("ok")).collect()}
    assert got == {"ok": True, "body": False, "junk": True, "empty": False, "entity": False, "nodecl": True}


def book(title, prolog="", root="FictionBook", attributes="", before=""):
    p = root.rpartition(":")[0]
    tag = lambda t: f"{p}:{t}" if p else t
    return (f"{prolog}<{root}{attributes}>{before}<{tag('description')}><{tag('title-info')}><{tag('book-title')}>{title}"
            f"</{tag('book-title')}></{tag('title-info')}></{tag('description')}><body><p>broken</body></{root}>")


def test_prologs_prefixes_and_markup(spark):
    forms = {
        "bom": (book("One", "\ufeff"), "One"),
        "bom and declaration": (book("One", "\ufeff<?xml version='1.0'?>\n"), "One"),
        "blanks": (book("One", "\n" * 100_000), "One"),
        "comments": (book("One", "<!-- a > b -->\n" * 3000 + "<?pi x?>"), "One"),
        "doctype": (book("One", "<!DOCTYPE FictionBook [<!ENTITY a 'x>y'> <!ELEMENT b (c)>]>\n"), "One"),
        "prefix": (book("One", root="f:FictionBook", attributes=" xmlns:f='u'"), "One"),
        "markup": (book("War <emphasis>and</emphasis> Peace"), "Peace"),
        "markup last": (book("War <emphasis>and</emphasis>"), "War"),
        "escaped markup": (book("a &lt;b&gt; c"), "a <b> c"),
        "comment in title": (book("Two<!-- x --> parts"), "Two parts"),
        "end in comment": (book("One", before="<!-- </description> -->"), "One"),
        "end in cdata": (book("<![CDATA[x </description> & <y>]]> z"), "x </description> & <y> z"),
        "spaced end": (book("One").replace("</description>", "</description\n>"), "One"),
    }
    rows = meta(spark, [(k, x) for k, (x, _) in forms.items()])
    assert {k: (r["title"], r["reject_reason"]) for k, r in rows.items()} == {k: (t, None) for k, (_, t) in forms.items()}
    from shelfwright.plans.pipeline import parse_library, validate
    whole = {k: x.replace("<p>broken", "") for k, (x, _) in forms.items()}
    files = spark.createDataFrame([(f"d/{k}.fb2", bytearray(x.encode())) for k, x in whole.items()], "path string, content binary")
    assert all(r.reject_reason is None for r in parse_library(files).collect())
    assert all(r.ok for r in validate(files).collect())


def test_only_the_root_and_its_description_count(spark):
    m = meta(spark, [("a", book("T", root="Other")), ("b", "\ufeff"), ("c", "<!-- open"), ("d", book("<![CDATA[open"))])
    assert [m[k]["reject_reason"] for k in "abcd"] == [R_NO_DESCRIPTION, R_MALFORMED, R_MALFORMED, R_MALFORMED]


def test_any_doctype(spark):
    """Quotes, comments and instructions hide what would end a DOCTYPE; index
    and validate agree."""
    prologs = ["<!DOCTYPE FictionBook [<!ENTITY a \"x]y\">]>", "<!DOCTYPE FictionBook SYSTEM \"a>b\">",
               "<!DOCTYPE FictionBook PUBLIC '-//x' 'b[c]>\"'>", "<!DOCTYPE f [<!-- ' ]> \" --><?p ]> ' ?>]  >",
               "<!-- <!DOCTYPE f [ --><!DOCTYPE f []>", "<?p <!DOCTYPE f [ ?>\n<!DOCTYPE f><!-- > -->", "<!DOCTYPE f [" + "<!ENTITY a ']'>" * 5000 + "]>",
               "<!DOCTYPE f [<!ENTITY a '</description>'>]>"]
    broken = ["<!DOCTYPE f [", "<!DOCTYPE f", "<!DOCTYPE f [<!ENTITY a \"]>"]
    texts = [(f"{k}.fb2", bytearray(book("One", p).replace("<p>broken", "").encode())) for k, p in enumerate(prologs + broken)]
    from shelfwright.plans.pipeline import parse_library, validate
    files = spark.createDataFrame(texts, "path string, content binary")
    found = {int(r.path[:-4]): (r.title, r.reject_reason) for r in parse_library(files).collect()}
    assert found == {k: ("One", None) if k < len(prologs) else (None, R_MALFORMED) for k in range(len(texts))}
    assert {int(r.path[:-4]): r.ok for r in validate(files).collect()} == {k: k < len(prologs) for k in range(len(texts))}


def test_prefixes_and_their_scopes(spark):
    fine = ["<a xmlns:x='u'><x:b/></a>", "<x:a xmlns:x='u'/>", "<a><x:b xmlns:x='u'><x:c/></x:b></a>",
            "<a xmlns:x='u'><b xmlns:x='v'><x:c/></b><x:d/></a>", "<a xml:lang='en'>t</a>", "<a>x:b='1' &lt;x:b></a>",
            "<a b='x:c=1 y:d=\"2\"'/>", "<a><!-- <x:b/> --><![CDATA[<x:b/> x:c=\"\"]]><?x:p y:z=''?></a>",
            "<a xmlns:x='u'><b x:c='>'/></a> <x:junk y:z='", "<!DOCTYPE a [<!ENTITY e '<x:b/>'>]><a/>", "<a><b xmlns:x='/'><x:c/></b></a>",
            "<a>" * 300 + "<x:b xmlns:x='u'/>" + "</a>" * 300]
    broken = ["<a><x:b/></a>", "<x:a/>", "<a x:b='1'/>", "<a><b xmlns:x='u'/><x:c/></a>", "<a><b xmlns:x='u'>t</b><c x:d=''/></a>",
              "<a xmlns:x='u'><y:b/></a>", "<a b='>' x:c = '1'/>", "<a b='xmlns:x=' x:c='1'/>", "<a><b\n\tx:c='1'/></a>"]
    df = spark.createDataFrame(list(enumerate(fine + broken)), "k int, t string")
    got = {r.k: r.ok for r in df.select("k", check_wellformed(F.col("t")).alias("ok")).collect()}
    assert got == {k: k < len(fine) for k in range(len(got))}
    unbound = book("One").replace("<book-title>", "<book-title l:x='1'>").replace("<p>broken", "")
    m = meta(spark, [("a", unbound), ("b", unbound.replace("<FictionBook>", "<FictionBook xmlns:l='u'>")),
                     ("c", book("One").replace("<p>", "<l:p>"))])
    assert [m[k]["reject_reason"] for k in "abc"] == [R_MALFORMED, None, None]  # the body is not read
