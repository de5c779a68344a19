"""URL rules against a plain reading of each rule."""

import random

import pytest
from pyspark.sql import functions as F

from tidefolio.llm.queries import URL_RULES
from tidefolio.llm.url_filter import Automaton, Rule, judge_urls


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://example.net/en/a",
    "http://sub.example.net/en/", "http://example.net/en", "http://badexample.net/en/", "http://x.example.com/de/1",
    "http://a.org/fr/", "http://org/fr/?", "http://a.com/x.net/", "http://a.net:80/", "http://ÄÖ.net/é", "http://u@b.net/#://c.org/fr/",
    "http://a.com?x=http://b.net/", "http://a://b.net/", "x" * 5000 + "://net/", "http://" + "a." * 3000 + "net/" + "b" * 3000,
]


def test_against_plain_reading(spark):
    rnd = random.Random(4)
    parts = ["example", "net", "com", "org", ".", "/", "en", "de", "fr", "?", "#", "://", "A", "-", "é"]
    urls = ODD + ["http://" + "".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(400)] + ["http://a.net/"] * 3
    df = spark.createDataFrame([(i, u, "taken") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, URL_RULES, keep=["page_id"]).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}


def test_many_rules_over_several_words():
    rnd = random.Random(1)
    hosts = ["".join(rnd.choices("abc", k=rnd.randint(1, 4))) + rnd.choice([".net", ".com"]) for _ in range(150)]
    rules = [Rule("block", h, "/" + "".join(rnd.choices("xy/", k=rnd.randint(0, 3)))) for h in dict.fromkeys(hosts)]
    machine = Automaton(rules)
    assert machine.words > 10
    for _ in range(300):
        host = rnd.choice(["", "s.", "t.s."]) + rnd.choice(hosts)
        path = "/" + "".join(rnd.choices("xy/", k=rnd.randint(0, 5)))
        won = int(machine.winners([b"." + host.encode() + b"\xff" + path.encode()])[0])
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert (won < 0) == (not fits)
        if fits:
            assert len(machine.rules[won].text) == max(len(r.text) for r in fits)


@pytest.mark.parametrize(
    "host, path, url, fits",
    [
        ("ad*.net", "/", "http://ads7.net/", True), ("ad*.net", "/", "http://x/ads.net/", False), ("a?.net", "/", "http://ab.net/", True),
        ("net", "/*/spam", "http://a.net/x/y/spam1", True), ("net", "/*/spam", "http://a.net/spam", False), ("*", "/", "http://q/", True),
    ],
)
def test_globs(spark, host, path, url, fits):
    df = spark.createDataFrame([(url,)], "url string")
    assert judge_urls(df, [Rule("block", host, path)]).first().verdict == ("block" if fits else "allow")


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df, URL_RULES, keep=["page_id"]).count() == 0
    one = judge_urls(spark.createDataFrame([("http://a.net/",)], "url string"), []).first()
    assert (one.rule, one.verdict) == (None, "allow")


def test_equal_results_for_repeated_rows(spark):
    df = spark.createDataFrame([("http://a.net/",)] * 20, "url string")
    assert judge_urls(df, URL_RULES).distinct().count() == 1 and judge_urls(df, URL_RULES).filter(F.col("rule") == "net/").count() == 20
