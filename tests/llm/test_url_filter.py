import random

from bazaarlens.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def urls():
    draw = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "a.b.example.com", "xexample.com", "x.net", "net", "com", "", "com.", "é.com"]
    tails = ["", "/", "/en/", "/en", "/en/x?y#z", "?q=/en/", "#/en/", "/es/a://b", "/ES/", "/en//", "/fr/é"]
    out = [f"{draw.choice(['http', 'https', ''])}://{h}{t}" for h in hosts for t in tails]
    return [*out, None, "", "no-scheme/en/", "://", "http://" + "a." * 400 + "com/" + "x" * 5000]


def test_against_brute_force(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(urls() * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()}
    assert got == {i: brute(u, RULES) for i, u, _, _ in rows}


def test_no_rules_null_rules_and_no_pages(spark):
    kind = "host string, path string, verdict string"
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    for rules in ([], [(None, "/", "block"), ("a.com", None, "block")]):
        row = U.judge(pages, spark.createDataFrame(rules, kind)).first()
        assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "/b", None, "allow")
    assert U.judge(pages.limit(0), spark.createDataFrame(RULES, kind)).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).selectExpr("concat('k', id) AS key")
    asked = spark.range(20000).selectExpr("concat('k', id) AS key")
    bloom, blocks = U.blocked_bloom(listed, "key", 5000)
    passed = {r.key for r in U.may_contain(asked, "key", bloom, blocks).collect()}
    assert {f"k{i}" for i in range(5000)} <= passed
    assert len(passed) - 5000 < 0.02 * 15000


def test_large_filter_is_joined_by_block(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://example.com/en/1")], "page_id long, url string")
    assert U.judge(pages, rules).first().verdict == "block"
