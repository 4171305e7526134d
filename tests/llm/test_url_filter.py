import random

from pyspark.sql import functions as F

from claimweave.llm import url_filter as U


def plain(url, rules, default):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        at = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


def test_rules_against_plain_search(spark):
    rng = random.Random(9)
    labels = ["a", "b", "ab", "a-b", "org", "com", "example"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: rng.choice(["", "/", "/a", "/a/b", "/en/1", "/es/x", "/en/12?q", "?q=/a", "#/a", "/é"])
    urls = [rng.choice(["http://", "HTTPS://", "x://y://"]) + rng.choice([str.upper, str])(host()) + path() for _ in range(600)]
    urls += [None, "", "no scheme/a", "://", "http://", "http://org", "http://org/", "http:///x", "http://org\n/a", "a\nb://org/x", "http://a..org/", *["http://hot.example.org/en/1"] * 900]
    rules = sorted({(host(), rng.choice(["/", "/a", "/a/b", "/en/1", "/es/", ""]), rng.choice(["allow", "block"])) for _ in range(60)} | {("org", "/", "allow")})
    single = {(h, p): v for h, p, v in rules}
    rules = [(h, p, v) for (h, p), v in single.items()]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, _key string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("", "/", "block")], U.RULE_SCHEMA)
    for parts in (1, 3, 40):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, given, default="block", parts=parts).collect()}
        want = {i: plain(u, rules, "block") for i, u in enumerate(urls)}
        assert {i: (g, want[i]) for i, g in got.items() if g != want[i]} == {}
        assert len(got) == len(urls)


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "http://org/"), (1, "http://org/"), (1, "http://org/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block")], U.RULE_SCHEMA)
    assert [r.verdict for r in U.judge(df, rules).collect()] == ["block"] * 3
    assert U.judge(df.filter(F.lit(False)), rules).count() == 0
    assert [r.rule for r in U.judge(df, rules.limit(0)).collect()] == [None] * 3
