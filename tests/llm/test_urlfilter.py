"""Trie and join against a slow reading of the rules."""

import random
import time

from motionlake.llm.queries import URL_RULES
from motionlake.llm.urlfilter import RuleTrie, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:k], rest[k:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow(rules, host, path):
    best = None
    for h, p, v in rules:
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h.split(".")) if h else 0, len(p), v == "block")
            if best is None or rank > best[0]:
                best = rank, h + p, v
    return (best[1], best[2]) if best else (None, "allow")


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?/en/", "http://example.com/en", "http://example.com/en/", "a://b://c.net/fr/", "http://net/es/", "http://x.net/es", "http://É.Com/", "http://u:p@example.com:80/en/", "http://xexample.com/en/", "http://m.www.example.com/en//", "http://example.com./en/", "http://a\nb.net/fr/\nq", "http:///en/"]


def test_contract_rules(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = [(k, u, "c") for k, u in enumerate(URLS)] + [(3, URLS[4], "c"), (None, URLS[8], "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    want = sorted(((i, *split(u), *slow(URL_RULES, *split(u))) for i, u, _ in rows), key=str)
    for bound in (1 << 20, 0):
        got = judge(df, rules, trie_chars=bound)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert judge(df.limit(0), rules, trie_chars=bound).count() == 0


def test_random_rules():
    r = random.Random(5)
    labels, segs = ["a", "b", "com", ""], ["", "/", "/x", "/x/", "/x/y", "/xy", "x"]
    for _ in range(300):
        rules = list({(".".join(r.choice(labels[:3]) for _ in range(r.randrange(0, 4))), r.choice(segs)): 0 for _ in range(r.randrange(6))})
        rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
        trie = RuleTrie(rules)
        for _ in range(20):
            host, path = ".".join(r.choice(labels) for _ in range(r.randrange(0, 5))), r.choice(segs) + r.choice(segs)
            assert (trie.match(host, path) or (None, "allow")) == slow(rules, host, path), (rules, host, path)


def test_random_rules_both_ways(spark):
    """Trie and join agree with the slow reading, for any verdicts, equal rules and string ids."""
    r = random.Random(8)
    segs = ["", "/", "/x", "/x/", "/x/y", "/xy", "/é/", "/x/yz", "//", "/x//y"]
    raw = [(".".join(r.choice(["a", "b", "C"]) for _ in range(r.randrange(0, 4))), r.choice(segs), r.choice(["allow", "block", "review", "hold"])) for _ in range(60)] + [(None, "/", "block"), ("a", None, "block"), ("a", "/", None)]
    best = {}
    for h, p, v in raw:
        if None not in (h, p, v):
            best.setdefault((h.lower(), p), []).append(v)
    rules = [(h, p, "block" if "block" in vs else max(vs)) for (h, p), vs in best.items()]
    urls = [None, "x", *("z://" + ".".join(r.choice(["a", "B", "c", ""]) for _ in range(r.randrange(0, 5))) + r.choice(segs) + r.choice(segs) for _ in range(300))]
    df = spark.createDataFrame([(f"p{k}", u) for k, u in enumerate(urls)] + [("p3", urls[3]), (None, urls[4])], "page_id string, url string")
    table = spark.createDataFrame(raw, "host string, path string, verdict string")
    want = sorted(((f"p{k}", *split(u), *slow(rules, *split(u))) for k, u in [*enumerate(urls), (3, urls[3])]), key=str)
    for bound in (1 << 20, 0):
        got = [tuple(x) for x in judge(df, table, trie_chars=bound).collect()]
        assert sorted((x for x in got if x[0]), key=str) == want and len(got) == len(want) + 1


def test_many_rules_on_one_host():
    trie = RuleTrie([("h.com", f"/p{k}", "block") for k in range(100_000)])
    start = time.process_time()
    for k in range(20_000):
        assert trie.match("www.h.com", f"/p{k * 5}x/y")[0] == f"h.com/p{k * 5}"
    assert time.process_time() - start < 2
