import re
from collections import Counter

import pytest
from tessera.llm import url_filter as U

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = ["http://a.org/x", "http://org/", "http://org", "http://notorg/x", "https://Blog.Example.ORG/es/1?x=/", "https://example.org/es", "https://example.org/es/", "http://example.org/en/1",
        "http://example.org/en/123#q", "http://example.org/en/2", "http://badexample.org/en/1", "http://x.com/fr/9", "http://x.com/de/", "http://com/de/a", "http://x.com/DE/a", "http://x.com?/de/",
        "http://x.com/#/de/", "no scheme.org/es/", "", None, "://", "://example.org/es/://x", "http://www.cheap-pills.example.com/en/1", "http://spam-farm.example.com/", "http://spamfarm.com/",
        "http://x.net/free-casino.html", "http://x.net/a/xxx/b", "http://xxxx.net/", "http://spam-farm.org/", "http://user@a.org:80/x", "http://a.org:80/x", "http://É.org/Ü", "http://a\n.org/x\ny",
        "ftp://x.com/a//b///c", "http://x.com/" + "a-" * 5000 + "xxx", "http://.org/", "http://x..org//"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(t), t, v) for v, t in RULES for h, p in [(t.partition("/")[0], "/" + t.partition("/")[2])] if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(re.search(r.pattern.replace(r"\z", r"\Z"), host + path) for r in U.WORD_RULES) else "allow"


@pytest.mark.parametrize("most", [U.BROADCAST_RULES, 0])
def test_verdicts_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(U, "BROADCAST_RULES", most)
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(500 + i, URLS[0], "x", "y") for i in range(300)] + [(None, URLS[4], "a", "b"), (0, URLS[0], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, token string").repartition(3)
    got = Counter(tuple(r) for r in U.judged(df).collect())
    assert got == Counter((r[0], *brute(r[1])) for r in rows)


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("example",)] * 5 + [("org",)] * 9 + [("es",)] * 3 + [("cheap",)] * 2 + [("pills",)], "token string")
    rules = (U.host_rule("block", "example.org/es/"), U.word_rule("block", "cheap", "pills"), U.host_rule("allow", "org/"), U.word_rule("block", "never", "pills"))
    assert {r.number: r.token for r in U.index(spark, rules, tokens).collect()} == {0: "es", 1: "pills", 2: "org", 3: "never"}
    with pytest.raises(ValueError):
        U.index(spark, (U.Rule("block", ".*", ()),), tokens)


def test_empty_table(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
