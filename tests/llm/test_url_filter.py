import re

import pytest

from corpusloom.llm import url_filter as U

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def brute(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(r.split("/")[0], r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


URLS = [
    "http://A.Example.COM/en/71?x", "https://example.com/en/6", "http://notexample.com/en/7", "http://com/en/", "x://b.example.net/de/80#t", "ftp://example.net/de/9",
    "http://a.org/es/1", "http://a.org/ES/1", "no scheme", "", None, "http://", "http://h?q=/en/", "a://b://c/en/", "http://É.com/en/1", "http://x.com:80/en/", "http://line\nbreak.com/en/\n?x", "http://u@b.com/en/",
]


def test_hosts_paths_and_rules(spark):
    model = U.UrlModel.fit(U.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    rows = {r.page_id: r for r in U.judge(pages, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (RULES[rule] if rule else "block" if model.score(host, path) >= 0.5 else "allow")


def test_model_on_unseen_hosts(spark):
    model = U.UrlModel.fit(U.labelled_urls(spark))
    bad = ["online-casino-slots.test", "xxx-adult-videos.test", "cheap-pills-pharma.test", "spam-farm.test", "payday-loan-cash.test"]
    good = ["library.university-town.test", "docs.language.test", "museum-history.test", "news.weather.test", "garden.recipes.test"]
    assert min(model.score(h, "/") for h in bad) > max(model.score(h, "/") for h in good)
    seen = U.labelled_urls(spark).collect()
    right = sum((model.score(*brute(r.url)[:2]) >= 0.5) == r.label for r in seen)
    assert right >= 0.95 * len(seen) and len(seen) <= 200


def test_tables_without_both_labels(spark):
    for rows, verdict in (([], False), ([("http://a.test/x", 1)], True), ([("http://a.test/x", None), (None, 0)], False)):
        model = U.UrlModel.fit(spark.createDataFrame(rows, "url string, label int"))
        assert (model.score("h", "/p") >= 0.5) is verdict


@pytest.mark.parametrize("n", [0, 3])
def test_whole_table(spark, sf_dir, n):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = U.query(spark, sf_dir)
    assert out.count() == pages.count() and out.where("verdict NOT IN ('allow', 'block')").count() == 0
