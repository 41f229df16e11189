from __future__ import annotations

import pytest

from tickwarden.llm import urls

PLACES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
RULES = [urls.place_rule(v, p) for v, p in PLACES] + urls.UNWANTED_RULES
SCHEMA = "page_id long, url string, host string, token string, rule int"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(p), p, v) for v, p in PLACES for h, q in [p.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + q)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    import re
    tokens = re.split("[^a-z0-9]+", (host + path).lower())
    return host, path, None, "block" if set(tokens) & set(urls.UNWANTED) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://com", "https://com/", "http://A.Example.COM/en/x?q=/en/", "http://www.example.com/en/", "http://www.example.com/EN/",
    "http://notexample.com/en/", "http://x.www.example.com/en/1", "ftp://b.net/es/", "ftp://b.net/es", "ftp://net/fr/a#b", "http://net?x=/es/", "http://a.org#/fr/",
    "https://casino.org/", "https://casinos.org/", "https://a.org/x-Porn_y", "https://a.org/?casino", "https://tracker.net/fr/", "x://y://com/", "http://a.com:80/",
    "http://é.com/", "http://a\nb.com/\n", "http://foo_com/", "http://com.org/com/", "http://example.com/en/" + "a/" * 30000,
]


def test_verdicts_match_brute_force(spark):
    data = [(i, u, "h", "t", 3) for i, u in enumerate(URLS)] + [(None, URLS[6], "", "", 0), (7, URLS[7], "", "", 0), (7, URLS[7], "", "", 0)]
    got = urls.judge(spark.createDataFrame(data, SCHEMA), RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d[0], *brute(d[1])) for d in data), key=str)


def test_no_rows_no_rules_and_rules_without_literal(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "", "", 0)], SCHEMA)
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert urls.judge(df, []).first()["verdict"] == "allow"
    with pytest.raises(ValueError):
        urls.judge(df, [urls.Rule("x", ".*", (), "block")])


def test_rules_are_found_by_their_rarest_token(spark):
    rules = [urls.Rule("pair", "common.*rare", ("common", "rare"), "block"), urls.Rule("absent", "common", ("common", "nowhere"), "block")]
    df = spark.createDataFrame([(i, f"http://h.org/common/{'rare' if i == 3 else i}", "", "", 0) for i in range(6)], SCHEMA)
    assert [r["page_id"] for r in urls.judge(df, rules).filter("verdict = 'block'").collect()] == [3]
