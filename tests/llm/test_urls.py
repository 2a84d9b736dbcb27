import random

from pyspark.sql import functions as F

from flowloom.llm import urls

ALLOW, BLOCK = ("org/", "com/fr/"), ("example.org/es/", "example.org/en/1", "com/de/")


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rules in (("allow", ALLOW), ("block", BLOCK)):
        for rule in rules:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                if best is None or len(p) > best[0]:
                    best = (len(p), rule, verdict)
    spam = host == "spam.net" or host.endswith(".spam.net")
    return host, path, best and best[1], best[2] if best else "block" if spam else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "https://Example.org/es/1?x=/fr/", "http://a.example.org/en/12",
    "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a#b", "http://x.com/?/de/", "http://com/de/",
    "ftp://spam.net/a", "http://www.spam.net", "http://notspam.net/", "http://a://b/c", "http://org:80/", "http://.org/", "http://É.ORG/É", "x" * 3000 + "://org/" + "y" * 3000,
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = urls.judge(pages, ALLOW, BLOCK, ("spam.net",)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id % len(URLS)]), URLS[r.page_id % len(URLS)]


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(3)
    keys = [f"host{rng.randrange(10**9)}.net" for _ in range(4000)]
    listed, others = keys[:900], keys[900:]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    cascade = urls.build_cascade(frame(listed), frame(keys + [None]))
    assert len(cascade.levels) > 1
    rows = frame(keys + [None]).withColumn("holds", cascade.holds(F.col("key"))).collect()
    assert {r.key for r in rows if r.holds} == set(listed) and len(others) == 3100




def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert urls.judge(pages, (), ()).first().verdict == "allow"
    assert urls.judge(pages.limit(0), ALLOW, BLOCK, ("a",)).count() == 0
