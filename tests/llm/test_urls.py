import random
import re

from wavemill.llm import urls
from wavemill.llm.queries import URL_RULES, op6_url_rules


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, v in rules:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            best = max(best or (), (len(h + (p or "")), len(h), h + (p or ""), v))
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_url_rules(spark, sf_dir).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: plain(u, URL_RULES) for k, u in pages.items()}
    assert len(rows) == len(pages) and {r.verdict for r in rows} == {"allow", "block"}


def test_nested_rules_hot_host_and_odd_urls(spark):
    rng = random.Random(4)
    hosts = ["a.b.com", "b.com", "com", "x-b.com", "bb.com", "A.B.COM", "é.org", "", "b.com."]
    paths = ["", "/", "/a", "/ab", "/a/b", "/a/b/c", "/é", "/a?q=/a/b", "/a#b", "?x://y"]
    made = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}", "k") for i in range(300)]
    made += [(1000 + i, f"http://hot.b.com/a/{i}", "k") for i in range(200)]
    made += [(None, None, "k"), (None, "no scheme", "k"), (7, "", "k"), (7, "", "k"), (8, "://", "k"), (9, "x\n://b.com/a", "k")]
    rules = [("com", "", "allow"), ("b.com", "/a", "block"), ("b.com", "/a/b", "allow"), ("b.com", "/a/b", "block"), ("a.b.com", None, "block"), ("b.com", "/a/b/c", "allow"), ("hot.B.com", "/a/1", "block"), ("é.org", "/é", "block"), (None, "/", "block"), ("b.com", "/", None)]
    valid = [r for r in rules if r[0] and r[2]]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = spark.createDataFrame(made, "page_id long, url string, host string")
    for ranges in (1, 16):
        out = urls.judge(df, table, ranges=ranges).collect()
        assert len(out) == len(made)
        for r in out:
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, valid), r
    assert urls.judge(df.limit(0), table).count() == 0
    assert {r.verdict for r in urls.judge(df, table.limit(0)).collect()} == {"allow"}


def test_clashing_names_ties_and_very_long_urls(spark):
    long = "http://" + ".".join(["a"] * 60) + ".com/" + "x/" * 100_000
    made = [(1, long, "u", "v", 3), (1, long, "u", "v", 3), (2, "http://b.com/p", None, None, None)]
    df = spark.createDataFrame(made, "page_id long, url string, _best string, top string, n long")
    rules = spark.createDataFrame([("com", "/x/x", "block"), ("a.com", "/x", "allow"), ("com", "/p", "block"), ("b.com", "", "allow"), ("m", "/p/q/r", "block")], "host string, path string, verdict string")
    got = urls.judge(df, rules, ranges=3)
    assert got.columns == ["page_id", "url", "_best", "top", "n", "host", "path", "rule", "verdict"]
    # com/x/x and a.com/x are seven long each: the longer host holds; b.com and com/p are five long each
    assert sorted((r.page_id, r["_best"], r.top, r.n, r.rule, r.verdict) for r in got.collect()) == [(1, "u", "v", 3, "a.com/x", "allow"), (1, "u", "v", 3, "a.com/x", "allow"), (2, None, None, None, "b.com", "allow")]
