import random
import re

from fieldspan.llm.urlfilter import RULES, judge, op8_urlfilter

SF = "/root/testdata/sf0.01"


def brute(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


ODD = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7?x=1", "a://b://c/d", "http://x.example.net/de/8#f",
       "http://notexample.com/en/1", "HTTP://COM/en/", "http://a.org?/es/", "http://a.org/es/" + "x" * 30000, "ftp://É.org/es/é",
       "http://net/de/", "http://example.com:80/en/", "x\ny://com/en/\nz"]


def test_rules_equal_brute_force(spark):
    rng = random.Random(3)
    urls = ODD + [f"http://{rng.choice(['', 'a.', 'B.c.'])}{rng.choice(['example.', 'x', ''])}{rng.choice(['com', 'net', 'org'])}/"
                  f"{rng.choice(['en', 'de', 'es'])}/{rng.randrange(10)}{rng.choice(['', '?a=1&b=2', '#x'])}" for _ in range(300)]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    out = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = brute(u)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_few_or_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in judge(df).collect()] == ["allow"] * 3
    assert judge(df.limit(0)).count() == 0


def test_trees_learn_given_labels(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h{i % 7}.com/{'buy-now/' * 4 + str(i) * 4 if i % 2 else 'about'}", "block" if i % 2 else "allow") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, l string")
    known = F.when(F.col("page_id") < 400, F.col("l"))
    got = judge(df, rules=(), label=known).where("page_id >= 400").collect()
    assert sum(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) > 190


def test_query_runs_over_all_pages(spark):
    assert op8_urlfilter(spark, SF).count() == 250
