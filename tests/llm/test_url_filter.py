import random

from pyspark.sql import functions as F

from tillroll.llm import url_filter as U

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def brute(url, listed):
    host, path = split(url)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule[0], rule[1] or ("block" if listed else "allow"), listed


def test_rules_and_list_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.net", "a.EXAMPLE.net", "badexample.net", "x.example.com", "example.com", "a.org", "org", "net", "münchen.org", "a.net:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/1", "/fr/", "/fr", "/x//en/"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=1', '#t', '?ref=x', '?b=2&a=1'])}" for _ in range(400)]
    urls += [None, "", "no scheme/en/", "x://", "://net/", "a://b://net/"]
    bad = ["http://a.org/en/x?ref=9", "http://x.example.com/fr?a=1&b=2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([(u,) for u in bad], "url string")
    canon = {r.url: r.c for r in pages.select("url", U.canonical(F.col("url")).alias("c")).collect()}
    keys = {r.c for r in listed.select(U.canonical(F.col("url")).alias("c")).collect()}
    assert canon[None] == "" and keys == {"a.org/en/x", "x.example.com/fr?a=1&b=2"}
    want = sorted(repr((i, *brute(u, canon[u] in keys))) for i, u in enumerate(urls))
    got = U.judge(pages, RULES, listed)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_large_filter_and_empty_cases(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (2, "http://b.org/x")], "page_id long, url string")
    empty = pages.limit(0)
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    got = U.judge(pages, RULES, pages.where("page_id = 2")).collect()
    assert sorted((r.page_id, r.verdict, r.rule) for r in got) == [(1, "block", "net/"), (1, "block", "net/"), (2, "block", None)]
    assert U.judge(empty, RULES, empty).count() == 0
    assert [r.verdict for r in U.judge(pages.where("page_id = 2"), (), empty).collect()] == ["allow"]


def test_filter_passes_every_listed_key_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('in ', id) AS key", "'r' AS rule", "'block' AS verdict")
    asked = spark.range(20000).selectExpr("concat(if(id < 2000, 'in ', 'out '), id) AS key")
    hits = [r.key for r in U.possible(asked, listed).collect()]
    assert sum(x.startswith("in") for x in hits) == 2000
    assert sum(x.startswith("out") for x in hits) < 400


def test_hosts_of_very_many_labels_cost_like_others(spark):
    import time
    long = "a." * 100_000 + "example.net"
    rows = [(1, f"http://{long}/en/x"), (2, f"http://{long}/de/x"), (3, "http://" + "b." * 100_000 + "org/fr/"), (4, "http://example.net/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"))
    started = time.time()
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in U.judge(pages, rules, pages.limit(0)).collect()}
    assert time.time() - started < 60
    assert got == {1: ("example.net/en/", "allow", len(long)), 2: ("net/", "block", len(long)),
                   3: ("org/fr/", "allow", 200_003), 4: ("example.net/en/", "allow", 11)}
