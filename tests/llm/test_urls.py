import random

import numpy as np
import pytest

from lattica.llm import urls

RULES = [("org/", 0), ("example.org/es/", 1), ("example.org/en/1", 1), ("com/fr/", 0), ("com/de/", 1), ("both.net/", 0), ("both.net/", 1), (None, 1), ("", 1), ("ünï.de/ä", 1)]


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]


def fits(key, host, path):
    on, slash, rest = key.partition("/")
    return (host == on or host.endswith("." + on)) and path.startswith(slash + rest)


def brute(url, lists):
    host, path = place(url)
    near = [(len(k), kind, k) for k, kind in lists if k and host and fits(k, host, path)]
    rules = [x for x in near if x[1] < 2]
    if rules:
        _, kind, key = max(rules)
        return host, path, key, ("allow", "block")[kind]
    return host, path, None, "block" if near else "allow"


def some_urls(n, rng):
    parts = ["a", "b", "example", "org", "com", "net", "EXAMPLE", "both", "spam-x", "ünï", "de", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/de/q", "/ä/ö", "//", "/a/b/c"]
    made = [f"http{rng.choice(['', 's'])}://" + ".".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(paths) + rng.choice(["", "?x=/es/", "#a://b", "?", "/z"]) for _ in range(n)]
    return made + [None, "", "://", "no scheme/es/", "http://x.org:80/es/", "a://b://c.org/d", "HTTP://" + "a." * 300 + "org/es/x", "http://org", "http://x.org/" + "y" * 5000, "http://\n.org/\nes/"]


def test_cascades_are_exact_over_their_universe():
    rng = np.random.default_rng(4)
    for n, share in ((1, 1.0), (1, 0.0), (5000, 0.001), (5000, 0.5), (5000, 0.98), (300, 1.0)):
        parts = [(rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64), rng.random(n) < share) for _ in range(3)]
        made = [urls.build(*p) for p in parts]
        all_ = urls.Cascades(*map(list, zip(*made)))
        shard = np.repeat(np.arange(3), n)
        got = all_.member(shard, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        assert (got == np.concatenate([p[2] for p in parts])).all()
        assert len(all_.bits) * 8 <= 24 + 16 * 3 + sum(8 * len(m[0]) for m in made) + 5 * 3 * n


@pytest.mark.parametrize("shard_keys,sent", [(1 << 12, 32 << 20), (4, 2000)])
def test_judge_as_brute_force(spark, monkeypatch, shard_keys, sent):
    monkeypatch.setattr(urls, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(urls, "SENT_BYTES", sent)
    rng = random.Random(6)
    given = some_urls(500, rng)
    lists = RULES + [("spam-x.com", 2), ("b.a", 2), ("a.net/es", 2)]
    df = spark.createDataFrame([(k, u, "x", "y", 1) for k, u in enumerate([*given, given[0]])] + [(None, given[3], None, None, None)], "page_id long, url string, host string, keys string, hits int").repartition(3)
    got = urls.judge(df, spark.createDataFrame(lists, "key string, kind int"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(k, *brute(u, lists)) for k, u in enumerate([*given, given[0]])] + [(None, *brute(given[3], lists))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_junk_hosts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.cheap-pills.b.com/x"), (2, "https://pillsx.org"), (3, "http://casino"), (4, None), (5, "http://spam.xxx-a.de/?")], "page_id long, url string")
    assert sorted(r["key"] for r in urls.junk_hosts(df).collect()) == ["casino", "cheap-pills.b.com", "xxx-a.de"]
    none = spark.createDataFrame([], "key string, kind int")
    assert [r["verdict"] for r in urls.judge(df, none).collect()] == ["allow"] * 5
    assert urls.judge(df.limit(0), spark.createDataFrame(RULES, "key string, kind int")).collect() == []
