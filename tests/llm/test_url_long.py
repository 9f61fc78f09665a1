from quillon.llm import url_filter


def test_very_long_urls_and_deep_rules(spark):
    rules = [*url_filter.RULES, ("a.b.c.example.org", "/x/y/z/", "block"), ("org", "/x/", "allow")]
    deep = "http://" + "l." * 400 + "a.b.c.example.org/x/y/z" + "/s" * 3000
    rows = [(1, deep), (2, "http://example.org/x" + "/q" * 2000), (3, "http://" + "d." * 2000 + "net/fr/" + "u/" * 500), (4, None), (5, "http://www.example.com/en")]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, rules), []).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in found} == {
        1: ("a.b.c.example.org/x/y/z/", "block"), 2: ("org/x/", "allow"), 3: ("net/fr/", "block"), 4: (None, "block"), 5: ("com/", "allow"),
    }
