import math
import random
import zlib
from collections import Counter

import pytest

from slidegrid.llm import suffix_model as sm


def corpus():
    rng = random.Random(2)
    phrases = ["new york city", "Once upon a time", "the quick brown fox", "rain in spain"]
    docs = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    return docs + [(900, None), (901, ""), (902, "never seen words only"), (903, "the " * 20_000), (5, docs[5][1]), (None, "new york city"), (904, "\x1cé É")]


def test_base_is_exact_and_model_is_better(spark):
    docs = corpus()
    frame = spark.createDataFrame([(a, b, 1, 2.0) for a, b in docs], "doc_id long, text string, row int, score double")
    out = sm.score_corpus(frame).collect()
    tokens = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b"<end>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in docs if i is not None and not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want.append((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6)))
    assert sorted(((*r[:5], round(r[5], 6)) for r in out), key=str) == sorted(want, key=str)
    test = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["score"] for r in test) > 0.8 * sum(r["base_score"] for r in test)


class Brute:
    """The suffix tree in dictionaries."""

    def __init__(self, texts, depth=3):
        self.n, self.depth, self.mass_of = Counter(), depth, {}
        for words in texts:
            for k in range(1, depth + 2):
                self.n.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        self.after = {}
        for s in self.n:
            self.after.setdefault(s[:-1], []).append(s[-1])
        self.total, self.distinct = sum(self.n[w,] for w in self.after.get((), [])), len(self.after.get((), []))

    def kept(self, s, x):
        n, of, less = self.n[*s, x], self.n[s], self.p(s[1:], x)
        return n if n >= 2 and n / of >= 1.2 * less and n * math.log(n / of / less) >= 3 else 0

    def mass(self, s):
        if s not in self.mass_of:
            self.mass_of[s] = sum(self.kept(s, x) for x in self.after.get(s, []))
        return self.mass_of[s]

    def p(self, s, x):
        s = s[-self.depth :]
        if not s:
            return (self.n[x,] + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        less, of = self.p(s[1:], x), self.n[s]
        if of < 2 or not self.mass(s):
            return less
        return (self.kept(s, x) + (of - self.mass(s) + 5) * less) / (of + 5)

    def score(self, words):
        return sum(math.log10(self.p(tuple(words[max(0, i - self.depth) : i]), w)) for i, w in enumerate(words))


def tokens_of(text):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), b"<end>"]


def brute(docs):
    return Brute([tokens_of(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10])


def test_distributions_sum_to_one():
    tree = brute([d for d in corpus() if d[0] is not None and d[0] < 300])
    for s in [(), (b"the",), (b"quick", b"brown"), (b"the", b"quick", b"brown"), (b"never", b"seen")]:
        mass = sum(tree.p(s, x) for x in tree.after[()])
        assert abs(mass + tree.p(s, b"unseen") - 1) < 1e-9


@pytest.mark.parametrize("chunk_tokens, depth", [(sm.CHUNK, 3), (500, 3), (2000, 1), (2000, 2)])
def test_equals_brute_force(spark, chunk_tokens, depth):
    docs = [(i, t) for i, t in corpus() if i != 903]
    tree = brute(docs)
    tree.depth = depth
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in sm.score_corpus(frame, chunk_tokens=chunk_tokens, depth=depth).collect())
    assert got == Counter((i, len(tokens_of(t)), round(tree.score(tokens_of(t)), 5)) for i, t in docs)


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = random.Random(5)
    fresh = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    once, twice = [fresh() for _ in range(30)], [fresh() for _ in range(30)]
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 10]
    docs = list(zip(ids, [*once, *twice, *twice], strict=False))
    out = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in sm.score_corpus(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert max(out[i] for i in ids[:30]) < min(out[i] for i in ids[30:90])


def test_empty(spark):
    assert sm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = sm.score_corpus(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"], one["base_score"], one["score"]) == (3, 0, 0, 0.0, 0.0)


def test_least_counts_do_not_rise_with_the_corpus(spark):
    from pyspark.sql import functions as F

    phrase = spark.range(80).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma delta").alias("text"))
    filler = spark.range(1000, 1500).select(F.col("id").alias("doc_id"), F.expr("repeat('z y ', 10000)").alias("text"))
    rows = sm.score_corpus(phrase.unionByName(filler)).where("doc_id < 80").collect()
    assert len(rows) == 80 and all(r["score"] > 0.5 * r["base_score"] for r in rows)
