import random
import re
from collections import Counter
from itertools import combinations

from slidegrid.llm import urls


def expected(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    return host, path, rule, verdict


CASES = ["http://A.Example.ORG/es/1?x=1", "https://example.org/en/12#t", "https://badexample.org/en/12", "http://org", "http://org/", "x.com/fr/", "://x.com/fr/1", None, "", "http://x.com/de/?a", "ftp://u://v.com/fr/9",
         "http://x.net/de/", "http://com/fr", "http://É.COM/fr/é", "a\nb://q.com/de/\n?z", "http://" + "a." * 20_000 + "org/" + "b/" * 20_000, "http://example.org./es/", "http://example.org/en/1", "http://.org/x"]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(CASES)] + [(0, CASES[0], "x", 1), (None, CASES[1], None, None)], "page_id long, url string, host string, verdict int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = urls.judge(pages, labels).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        if r["page_id"] is not None:
            host, path, rule, verdict = expected(CASES[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_mined_rules_decide(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}.site.net/{'win' if i % 2 else 'read'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 100)], "doc_id long, quality int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, min_support=0.05).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(200)}


def brute_rules(baskets, least, confidence, lift):
    of, n, share = Counter(), Counter(), Counter(v for _, v in baskets)
    for tokens, verdict in baskets:
        for k in (1, 2, 3):
            for needs in combinations(sorted(tokens), k):
                of[needs] += 1
                n[needs, verdict] += 1
    rules = {key: (n[key] / of[key[0]], n[key]) for key in n if n[key] >= least and n[key] / of[key[0]] >= max(confidence, min(1.0, lift * share[key[1]] / len(baskets)))}
    less = lambda needs: (x for k in range(1, len(needs)) for x in combinations(needs, k))
    return {(a, v): r for (a, v), r in rules.items() if not any((x, v) in rules and rules[x, v][0] >= r[0] for x in less(a))}


def test_mining_equals_brute_force(spark):
    rng = random.Random(4)
    baskets = []
    for _ in range(400):
        tokens = sorted({rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))})
        block = ("a" in tokens and "b" in tokens) or "c" in tokens and rng.random() < 0.9 or rng.random() < 0.2
        baskets.append((tokens, "block" if block else "allow"))
    frame = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    for lift in (0, 1.05, 1.6):
        got = {(tuple(r["needs"]), r["verdict"]): (round(r["confidence"], 9), r["support"]) for r in urls.mine(frame, min_lift=lift).collect()}
        assert len(got) > (1 if lift else 5) and (any(len(a) > 1 for a, _ in got) or lift > 1.5)
        assert got == {k: (round(c, 9), n) for k, (c, n) in brute_rules(baskets, 10, 0.75, lift).items()}


def test_rules_of_frequent_tokens_in_long_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "COPIES", 3)
    rng = random.Random(6)
    baskets = []
    for _ in range(300):
        tokens = sorted({x for x in "cdefghijklmnopqr" if rng.random() < 0.7} | {x for x in "ab" if rng.random() < 0.9} | ({"z"} if rng.random() < 0.1 else set()))
        block = "a" in tokens and "b" in tokens and rng.random() < 0.97 or "z" in tokens
        baskets += [(tokens, "block" if block else "allow")] * rng.choice((1, 1, 5))
    assert sum(len(t) > urls.MOST_ITEMS for t, _ in baskets) > 200
    frame = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    for least in (10, 300):
        want = brute_rules(baskets, least, 0.75, 1.05)
        assert (("a", "b"), "block") in want
        got = {(tuple(r["needs"]), r["verdict"]): (round(r["confidence"], 9), r["support"]) for r in urls.mine(frame, least_baskets=least).collect()}
        assert got == {k: (round(c, 9), n) for k, (c, n) in want.items()}


def test_matching_equals_brute_force(spark):
    rng = random.Random(9)
    rules = {}
    while len(rules) < 60:
        needs = tuple(sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(1, 4))}))
        rules[needs, rng.choice(("allow", "block"))] = (rng.choice((0.8, 0.9, 1.0)), rng.choice((10, 20)))
    rows = [(list(n), v, c, k, rng.choice(n)) for (n, v), (c, k) in rules.items()]
    sets = {tuple(sorted({rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 8))})) for _ in range(300)}
    frame = spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>")
    got = {tuple(r["tokens"]): r["method"] for r in urls.match(frame, spark.createDataFrame(rows, "needs array<string>, verdict string, confidence double, support long, token string")).collect()}
    want = {}
    for s in sets:
        fits = [(-c, -k, v == "allow", n, v) for (n, v), (c, k) in rules.items() if set(n) <= set(s)]
        if fits:
            want[s] = min(fits)[-1]
    assert got == want and set(want.values()) == {"allow", "block"}


def test_labels_reach_urls_through_their_number(spark):
    rows = [(1, "http://a.net/x/7"), (2, "http://a.net/x/7"), (3, "http://b.net/no-number"), (4, "http://c.org/z/8"), (5, "http://d.net/9"), (6, "http://e.net/x/10.html"), (7, None), (8, "http://f.net/99999999999999999999")]
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (10, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = sorted((r["tokens"][0], r["verdict"]) for r in urls.baskets_of(urls.parts(spark.createDataFrame(rows, "page_id long, url string")), labels).collect())
    assert got == [("h:a", "block"), ("h:a", "block"), ("h:c", "allow"), ("h:e", "allow")]


def test_few_baskets_give_no_rules_and_long_urls_end(spark):
    long = "http://x.net/" + "/".join(f"{w}{w}" for w in "abcdefghijklmnopqrstuvwxyzäöüéèêçñßøåæïîôûù")
    rows = [(i, f"{long}/{i}") for i in range(12)] + [(100 + i, f"http://y.net/rare/{100 + i}") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, quality int")
    rules = urls.mine(urls.baskets_of(urls.parts(pages), labels)).collect()
    assert rules and all(len(r["needs"]) == 1 for r in rules)  # longer ones are no surer
    assert not any("p:rare" in r["needs"] for r in rules)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert all(got[i] == "block" for i in range(12))


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
