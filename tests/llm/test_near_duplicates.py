import random

import pytest

from slidegrid.llm import near_duplicates as nd


def brute(docs, percent=85, k=5):
    sets = []
    for _, text, *_ in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(i)
    out = []
    for i, (doc, *_) in enumerate(docs):
        ids = [docs[j][0] for j in members[find(i)] if docs[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("node", [128, 3])
def test_equals_brute_force(spark, node):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for g in range(8):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for c in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            docs.append((1000 - 12 * g - c, " ".join(copy)))
    line = " ".join(word() for _ in range(25))
    docs += [(2000 + i, line + " " + " ".join(word() for _ in range(6 + i % 9))) for i in range(40)]
    docs += [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É B c d e"), (8, "é b c d e"), (None, docs[0][1]), (None, "only here at all times"), (9, docs[0][1]), (9, docs[0][1]), (10, "a " * 20_000)]
    frame = spark.createDataFrame([(a, b, 5, "q") for a, b in docs], "doc_id long, text string, cls int, kept string")
    got = nd.near_duplicates(frame, node=node)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_distinct_documents(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y"), (3, "other words", "z"), (None, None, None)], "doc_id long, text string, lang string")
    out = nd.distinct_documents(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "A b c d e f", "y"), (3, "other words", "z"), (None, None, None)]


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distinct_documents_with_clashing_names(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(1, body, "T", "k", None), (2, body + " end", None, "k", "i"), (3, None, "T", None, "i"), (None, "other words stand here alone", "T", "k", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, Text string, _text_key string, gone_id string")
    out = nd.distinct_documents(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([docs[0], docs[2], docs[3]], key=str)
