from __future__ import annotations

import corpus_pipeline
from fixtures import ODD

from stackroom.llm import line_dedup, url_rules


def test_lines_by_hand(spark):
    pages = [(i, "h1", f"menu\nown {i}\n\nfooter\nmenu") for i in range(10)] + [(20, "h2", "menu\nown 20"), (21, "h2", "menu"),
             (30, None, "menu\nx"), (31, None, "menu"), (32, None, "menu"), (40, "h1", None), (41, "h1", "")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string")
    got = {r["page_id"]: (r["text"], r["cut"]) for r in line_dedup.drop_boilerplate(df, "host", dropped="cut").collect()}
    assert got[3] == ("own 3\n", 3) and got[20] == ("menu\nown 20", 0)
    assert got[30] == ("x", 1) and got[31] == ("", 1) and got[40] == (None, 0) and got[41] == ("", 0)


def test_lines_ratio_is_of_the_host(spark):
    rows = [(i, "big", f"rare\n{i}" if i < 4 else f"{i}") for i in range(200)] + [(500 + i, "mid", f"rare\n{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r["page_id"]: r["cut"] for r in line_dedup.drop_boilerplate(df, "host", ratio=0.02, dropped="cut").collect()}
    assert got[0] == 0 and got[500] == 1  # 4 of 200 is the ratio itself, not above it


def test_lines_of_copies_stay_where_copies_count_once(spark):
    """A third of the source is one document; a menu stands on other pages too."""
    rows = [(i, "s", "copied\ntext of its own") for i in range(50)] + [(50 + i, "s", f"menu\nown {i}") for i in range(100)]
    rows += [(200 + i, "small", "three\ncopies") for i in range(3)] + [(300, "small", None), (301, "small", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert all(got[i] == "copied\ntext of its own" for i in range(50)) and got[200] == "three\ncopies"
    assert all(got[50 + i] == f"own {i}" for i in range(100)) and got[300] is None
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, df, ""), "").collect()}
    assert kept & set(range(50)) == {0} and 200 in kept


def test_lines_odd_rows(odd, empty):
    got = line_dedup.drop_boilerplate(odd, "source")
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert line_dedup.drop_boilerplate(empty, "source").count() == 0


URLS = ["http://a.Example.ORG/es/x", "https://example.org/es/", "http://example.org/es", "http://example.org/en/12?x=/es/",
        "http://x.org", "http://x.org/", "http://shop.com/fr/", "http://shop.com/de/1#f", "http://shop.com/it/",
        "http://badexample.org/es/", "http://www.spam-farm.net/en/", "http://nospam-farmer.net/", "http://cheap-pills.org/x",
        "https://casino-win.net", "http://files.net/a.exe", "http://org/x", "no scheme", "", None, "x://", "://q.com/fr/1",
        "HTTP://UP.COM/FR/", "http://u@h.com:80/fr/", "http://two.com/a://b.org/"]


def test_urls_by_hand(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:2])],
                               "page_id long, url string, rule string, token string").repartition(3)
    rows = url_rules.judge(df).collect()
    assert len(rows) == len(URLS) + 2
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    want = {0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/es/", "example.org/es/", "block"),
            2: ("example.org", "/es", "org/", "allow"), 3: ("example.org", "/en/12", "example.org/en/1", "block"),
            4: ("x.org", "", None, "allow"), 5: ("x.org", "/", "org/", "allow"), 6: ("shop.com", "/fr/", "com/fr/", "allow"),
            7: ("shop.com", "/de/1", "com/de/", "block"), 8: ("shop.com", "/it/", None, "allow"),
            9: ("badexample.org", "/es/", "org/", "allow"), 10: ("www.spam-farm.net", "/en/", None, "block"),
            11: ("nospam-farmer.net", "/", None, "allow"), 12: ("cheap-pills.org", "/x", "org/", "allow"),
            13: ("casino-win.net", "", None, "block"), 14: ("files.net", "/a.exe", None, "block"), 15: ("org", "/x", "org/", "allow"),
            16: ("", "", None, "allow"), 17: ("", "", None, "allow"), 18: ("", "", None, "allow"), 19: ("", "", None, "allow"),
            20: ("q.com", "/fr/1", "com/fr/", "allow"), 21: ("up.com", "/FR/", None, "allow"),
            22: ("u@h.com:80", "/fr/", None, "allow"), 23: ("two.com", "/a://b.org/", None, "allow")}
    assert {i: got[i] for i in want} == want


def test_urls_empty(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_tokens_of_rules_are_whole():
    assert url_rules.host_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en")
    assert url_rules.host_rule("allow", "org", "/").tokens == ("org",)
