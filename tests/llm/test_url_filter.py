import random

from pyspark.sql import functions as F

from repograph.llm import url_filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b.org", ""), ("allow", "x.a.b.org", "/p")]


def judge(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, "allow"
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def result(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key_0 string")
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")
    return sorted((tuple(r) for r in url_filter.filter_urls(pages, listed).collect()))


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/x?q=/en/", "a://b://example.com/en/",
        "http://wWw.Example.Com/en/", "http://z.www.example.com/en/a#b", "http://notexample.com/en/", "http://x.net/es/",
        "http://x.net/ES/", "http://net/fr/?a", "http://x.net?/es/", "http://example.com:80/en/", "http://.com/", "http://a.b.org",
        "http://x.a.b.org/page", "http://é.com/é", "http://" + "a." * 5000 + "com/", "http://x.com/" + "p" * 200_000,
        "http://x.com/a\nb?c", "http://a.com/", "http://a.com/"]


def test_parts_and_verdicts(spark):
    assert result(spark, URLS) == [(i, *judge(u)) for i, u in enumerate(URLS)]


def test_random_urls(spark):
    pick = random.Random(1)
    urls = [f"http://{'.'.join(pick.choices(['www', 'example', 'com', 'net', 'a', 'b', 'x', 'org'], k=pick.randint(1, 5)))}"
            f"{pick.choice(['', '/', '/en/', '/es/a', '/fr/', '/p', '/pq'])}" for _ in range(1500)]
    assert result(spark, urls) == [(i, *judge(u)) for i, u in enumerate(urls)]


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'")
    cascade = url_filter.build_cascade(listed, universe, 3000, 1 << 20)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.lists(F.col("key")) != F.col("key").like("%7"))
    assert wrong.count() == 0


def test_empty_tables_and_bad_rules(spark):
    assert result(spark, []) == []
    assert [r[3:] for r in result(spark, ["http://a.com/"], [])] == [(None, "allow")]
    for rules, size in (([("allow", "com", "/"), ("block", "com", "/")], 1 << 20), (RULES, 4)):
        pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
        try:
            url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), max_filter_bytes=size)
        except ValueError:
            continue
        raise AssertionError("must be refused")
