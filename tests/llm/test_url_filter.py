import random
import re

from elastrain.llm.url_filter import filter_pages

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("a.net", "/e", "block"), ("a.net", "/e", "allow"), ("org", "", "block"),
]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_rules(spark):
    draw = random.Random(2)
    parts = ["com", "example", "www", "net", "a", "org", "É", "x:8080", ""]
    urls = [None, "", "no scheme", "://", "http://", "http://com", "HTTP://WWW.Example.com/en/x?q=1#f", "x://y://z.com/en/", "http://a.net/e\n/f"]
    for _ in range(400):
        host = ".".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
        urls.append("http://" + host + draw.choice(["", "/", "/en/", "/en", "/es/", "/e", "/en/a/b"]) + draw.choice(["", "?x=/es/", "#/en/"]))
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(5, "http://com", "h", "r")] * 2 + [(None, "http://b.net/es/", "h", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_pages(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, _, _ in rows), key=str)
    assert filter_pages(pages.where("false"), rules).count() == 0
    no_rules = filter_pages(pages, rules.where("false"), default="block").collect()
    assert len(no_rules) == len(rows) and {r.verdict for r in no_rules} == {"block"}


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://com/")], "page_id bigint, url string")
    plan = filter_pages(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
