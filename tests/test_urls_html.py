from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from stackroom.functions import html as H
from stackroom.functions import text as X
from stackroom.functions import urls as U
from stackroom.plans import load_all


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "u string").select(fn(F.col("u"))).first()[0]


WEB = [
    ("http://Example.com/Path", "https://example.com/Path"),
    ("https://example.com/docs/", "https://example.com/docs"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/docs#section", "https://example.com/docs"),
    ("https://example.com/docs?utm_source=x&b=2&a=1", "https://example.com/docs?a=1&b=2"),
    ("https://example.com/a+b%2", "https://example.com/a+b%2"),
    ("https://example.com/x;p=1?q=a+b&q=&z", "https://example.com/x?q=a+b&q=&z="),
    ("https://example.com/?q=a%1Fb&p=x%1Ey%1Ez", "https://example.com/?p=x%1Ey%1Ez&q=a%1Fb"),
]


@pytest.mark.parametrize("raw,wanted", WEB)
def test_web_uri(spark, raw, wanted):
    assert one(spark, raw, U.normalize_web_uri) == wanted
    assert one(spark, wanted, U.normalize_web_uri) == wanted


def test_composed_forms_agree(spark):
    from urllib.parse import quote

    word = "문서"
    forms = ["https://a.com/" + w for w in (word, quote(word), unicodedata.normalize("NFD", word))]
    assert {one(spark, f, U.normalize_web_uri) for f in forms} == {"https://a.com/" + word}


def test_repo_uri(spark):
    assert one(spark, "https://github.com/My-Org/My-Repo/blob/main/src/Main.py", U.normalize_repo_uri) == (
        "https://github.com/my-org/my-repo/blob/main/src/Main.py")
    assert one(spark, "https://github.com/only", U.normalize_repo_uri) == "https://github.com/only"


@pytest.mark.parametrize("href", ["/x", "y", "../z", "../../w/./v", "?q=1", "//h.org/p", "https://o.org/", "a/../b#c", "."])
def test_links_resolve_like_the_standard(spark, href):
    from urllib.parse import urljoin

    base = "https://a.com/b/c/d"
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(U.resolve_link(F.col("b"), F.col("h"))).first()[0] == urljoin(base, href)


@pytest.mark.parametrize("url,paged", [("https://a.com/page/2/", True), ("https://a.com/Page/2", True), ("https://a.com/?x=1&p=3", True),
                                       ("https://a.com/?up=3", False), ("https://a.com/pages/2", False)])
def test_pagination(spark, url, paged):
    assert one(spark, url, U.is_pagination) is paged


def test_scope_normalised_seed(spark):
    def inside(url, **kw):
        return one(spark, url, lambda c: U.in_scope(c, ["https://a.com/docs"], **kw))

    assert inside("https://a.com/docs") and inside("https://a.com/docs/x")
    assert not inside("https://a.com/docsy") and not inside("https://b.com/docs/x")
    assert inside("https://a.com/other", unrestricted=True)
    assert not inside("https://a.com/docs/private/x", exclude=["*/private/*"])
    assert inside("https://a.com/docs/v[1]", include=["*v[[]1*"]) and not inside("https://a.com/docs/w", include=["*v?"])


def test_titles_and_text(spark):
    page = ('<html><head><meta property="og:title" content=" Big &amp; small "><title>t</title></head><body>'
            "<script>x='<p>'</script><h1>Head</h1><p>one <b>two</b>three<ul><li>a</li></ul></body></html>")
    assert one(spark, page, lambda c: H.page_title(c, F.lit("f"))) == "Big & small"
    assert one(spark, "<title> T </title>", lambda c: H.page_title(c, F.lit("f"))) == "T"
    assert one(spark, "<h1>no</h1>", lambda c: H.page_title(c, F.lit("f"))) == "f"
    assert one(spark, page, H.html_to_text) == "# Head\none twothree\n- a"


@pytest.mark.parametrize("title,ext,wanted", [
    ("report.pdf", "txt", "report.pdf"), ("  ", "md", "7.md"), ('a/b:c*', None, "a_b_c"),
    ("a long title that has to be cut somewhere", "txt", "a long title that has to be.txt"),
    ("x" * 40, "txt", "x" * 30 + ".txt")])
def test_download_filename(spark, title, ext, wanted):
    df = spark.createDataFrame([(title, ext, 7)], "t string, e string, d bigint")
    assert df.select(X.download_filename(F.col("t"), F.col("e"), F.col("d"))).first()[0] == wanted


@pytest.mark.parametrize("name,wanted", [("a.PDF", ".pdf"), ("d.x/a", ""), (".bashrc", ""), ("a.tar.gz", ".gz"), ("a.", "")])
def test_suffix(spark, name, wanted):
    assert one(spark, name, X.suffix) == wanted


def test_token_counts(spark):
    counts = one(spark, "b a b c_1 é É", lambda c: X.token_counts(X.word_tokens(c)))
    assert {(t["token"], t["tf"]) for t in counts} == {("a", 1), ("b", 2), ("c_1", 1), ("é", 2)}
    assert one(spark, "", lambda c: X.token_counts(X.word_tokens(c))) == []


def test_dictionary_tokens(spark):
    df = spark.createDataFrame([("New York is in new york state", ["new york", "is in"])], "t string, e array<string>")
    assert df.select(X.dictionary_tokens(F.col("t"), F.col("e"))).first()[0] == ["new_york", "is_in", "new_york", "state"]


@pytest.mark.parametrize("raw", ["caf&eacute; &#8217;t &#x27;q&#X41;", "&euro; &amp;lt; &amp;amp; &nosuch; a & b &;", "&#0; &#150; &#128512;",
                                 "&#xD800; &#99999999;", "x&NotEqualTilde;y", "no reference"])
def test_character_references(spark, raw):
    import html

    assert one(spark, raw, H.unescape) == html.unescape(raw).replace("\xa0", " ")
    assert one(spark, f"<title>{raw}</title>", lambda c: H.page_title(c, F.lit("none"))) == html.unescape(raw).strip()


def test_titles_are_whole_lines(spark):
    line = "x" * 200
    assert one(spark, line + "\nbody", X.first_line) == line


def test_all_levels_of_a_configuration_are_checked(spark):
    from stackroom.operators.chunking import config_violations

    sizes = [list(range(400, 100, -1)), [*range(400, 250, -1), 251, 200], [100], [200, None]]
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "i int, sizes array<int>, overlap int")
    assert {r["i"] for r in config_violations(df).collect()} == {1, 3}


def test_json_keeps_every_key(spark, tmp_path):
    from stackroom.sources.readers import read_json

    (tmp_path / "a.json").write_text('{"b": [1, {"x": null}],\n "a": "\u00e9"}')
    (tmp_path / "b.json").write_text('{"other": 1.5}')
    (tmp_path / "c.json").write_text("not json")
    got = {r["path"][-6:]: r["text"] for r in read_json(spark, str(tmp_path)).collect()}
    assert got == {"a.json": '{"a":"é","b":[1,{"x":null}]}', "b.json": '{"other":1.5}', "c.json": None}


@pytest.mark.parametrize("name, times", [("content_version", 1), ("html_to_text", 2), ("page_title", 0), ("change_detection", 0)])
def test_a_page_is_parsed_once(spark, name, times):
    """The text of a page stands once for each policy in the plan of the query; change_detection reads it from what it wrote."""
    plan = load_all()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--.*?-->") == times and plan.count("og:title") == (name == "page_title")
