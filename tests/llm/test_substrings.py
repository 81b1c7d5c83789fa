import hashlib
import random
from collections import Counter

import pytest

from slidegrid.llm import substrings


def brute(docs, width):
    split = [(i, (t or "").encode().split()) for i, t, *_ in docs]
    seen = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [2000, 2, 6])
def test_equals_brute_force(spark, most):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choices([f"w{i}" for i in range(200)] + ["é x", "the"], k=n))
    passage, long = words(30), words(400)
    docs = [(i, words(rng.randrange(5, 80)) + "\n" + (passage if i % 3 == 0 else words(9)) + "\t" + words(rng.randrange(0, 40))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a b c"), (103, long), (104, long), (105, long), (105, long), (None, long + " end"), (106, "start " + long[40:]), (107, words(5000)), (108, "x y z " * 40), (109, "x y z " * 39 + "q"), (110, docs[7][1])]
    frame = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id long, text string, row int, n_words string")
    got = substrings.removal(frame, width=12, anchor=4, most_leaves=most)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, 12)


def test_strip_keeps_columns(spark):
    body = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a  b\n" + body, "en", 9), (2, body, "en", 9), (3, "left  alone", "de", 11), (4, None, "de", None)], "doc_id long, text string, lang string, n_chars long")
    out = substrings.strip(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "en", 3), (3, "left  alone", "de", 11)]


def test_empty(spark):
    assert substrings.removal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_depths_of_internal_nodes():
    leaf = lambda right, left="": (right.encode().split(), left.encode().split())
    tree = substrings.Subtree([leaf("a b c d", "x y"), leaf("a b c e", "x z"), leaf("a b q", "x y"), leaf("a b c d", "w")])
    assert sorted(tree.depths) == [2, 3, 4]
    assert [(d, sorted(below)) for d, below in tree.nodes()] == [(4, [0, 3]), (3, [0, 1, 3]), (2, [0, 1, 2, 3])]
    # maximal repeats: a b c d (4 words), x a b c (4), y x a b read forwards (4), a b c (3)
    assert tree.repeats(4) == {0: {0, 1, 2}, 3: {0}, 1: {1}, 2: {2}}


def test_strip_with_clashing_names_and_blank_texts(spark):
    body = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "one " + body, "T", "r", "k", None), (2, body, None, "r", "k", "i"), (3, " \n\t", "T", None, "k", "i"), (None, "left  alone", "T", "r", None, "i")], "doc_id long, text string, Text string, _runs string, text_key string, id string")
    out = substrings.strip(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "one", "T", "r", "k", None), (None, "left  alone", "T", "r", None, "i")], key=str)
