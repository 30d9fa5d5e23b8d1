import random

from tidemark.llm import url_filter
from tidemark.llm.common import Scratch

from . import frames


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([len(path), *(path.index(c) for c in "?#" if c in path)])]
    fit = [(len(h + p), p, h, v) for h, p, v in rules
           if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[1], best[3] if best else default


def run(spark, urls, rules):
    df = frames.clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = url_filter.match(df, table, Scratch(spark, "t"), ["page_id"]).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_matches_every_rule(spark):
    rng = random.Random(7)
    labels = ["a", "b", "a-b", "com", "net", "x1", "xn--y", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/de", "/en", "/", "/a", "x"]) for _ in range(rng.randint(0, 3)))
    rules = sorted({(host(), p): (p, rng.choice(["allow", "block"])) for p in (path() for _ in range(60))}.items())
    rules = [(h, p, v) for (h, p), (_, v) in rules] + [("", "/en/a", "block")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host().upper() if i % 3 else host()}{path()}{rng.choice(['', '?q=/x://y', '#t', '?'])}" for i in range(600)]
    urls += ["http://com/de"] * 400  # a host with a third of all rows
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://ex ample.COM:80/é\nx", "http://u@com/de?x", "x" * 5000]
    got = run(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    assert run(spark, [], [("net", "/", "block")]) == {}
    assert run(spark, ["http://a.net/"], []) == {0: ("a.net", "/", None, "allow")}
