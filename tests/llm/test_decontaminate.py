import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from slidegrid.llm import decontaminate as dc


def brute(docs, items, width=13, share=20):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, text, *_ in docs:
        words, hit, ids = find(text), set(), set()
        for item, phrase, *_ in items:
            p = find(phrase)
            for w in [p[k : k + width] for k in range(max(1, len(p) - width + 1))] if p else []:
                for s in range(len(words) - len(w) + 1):
                    if words[s : s + len(w)] == w:
                        hit |= set(range(s, s + len(w)))
                        ids.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [250_000, 300])
def test_equals_brute_force(spark, shard_words):
    pick = random.Random(5).choices
    vocabulary = ["the", "Of", "ÉTÉ", "x9", "cat", "dog", "a-b", "über"]
    docs = [(i, " ".join(pick(vocabulary, k=60))) for i in range(40)]
    items = [(i, " ".join(docs[i][1].split()[5 : 5 + 10 + i])) for i in range(8)] + [(90, "the"), (91, ""), (92, None), (None, "cat dog cat"), (11, "absent word here")]
    docs += [(50, None), (51, ""), (52, "the"), (3, docs[3][1]), (None, docs[4][1]), (53, "zz " * 30_000 + docs[2][1]), (54, "...")]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = dc.contamination(d, b, width=5, shard_words=shard_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables_and_clean(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d"), (2, "q r s t")], "doc_id long, text string")
    assert dc.contamination(none_d, none_b).count() == 0
    assert [r["n_hit"] for r in dc.contamination(some, none_b).collect()] == [0, 0]
    bench = spark.createDataFrame([(1, "A, b c")], "item_id long, text string")
    assert [r["doc_id"] for r in dc.clean(some, bench).collect()] == [2]


def test_clean_with_null_and_repeated_ids_and_clashing_names(spark):
    docs = [(None, "a b c d", "x", 1), (None, "q r s t", None, 2), (3, "A, b c", "x", 3), (3, "fine", "x", 4), (None, None, "x", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, Text string, bad_key long")
    out = dc.clean(frame, spark.createDataFrame([(1, "A, b c")], "item_id long, text string"))
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([docs[1], docs[3], docs[4]], key=str)


@pytest.mark.parametrize("shard_words", [250_000, 1])
def test_proximity(spark, shard_words):
    texts = ["a x b x c", "a x x x x b c", "c b a", "b c", "a", "a b x c x a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = dc.build_index(docs, shard_words=shard_words)
    names = {(r["shard"], r["doc"]): r["id"] for r in index.selectExpr("shard", "posexplode(doc_ids) as (doc, id)").collect()}
    asked = dc.windows(spark.createDataFrame([("k", "a b c")], "item_id string, text string"), 3)
    found = {names[r["shard"], r["doc"]]: sorted(r["places"]) for r in dc.search(index, asked, span=5).collect()}
    want = {}
    for i, text in enumerate(texts):
        w = text.split()
        ends = [e for e in range(len(w)) if w[e] in "abc" and {"a", "b", "c"} <= set(w[max(0, e - 4) : e + 1])]
        if ends:
            want[i] = ends
    assert found == want and len(want) == 3


def test_rows_and_row_groups_of_the_index_are_small(spark):
    """A reader holds a row group at once, and a shuffle or a group whole rows, however much a task has read."""
    docs = [(i, f"d{i} the") for i in range(20_000)] + [(30_000 + k, " ".join(f"w{(i * i + k) % 5003}" for i in range(300_000))) for k in range(4)]
    docs += [(40_000, "a b c d e f"), (40_001, "x a b c x")]
    items = [(1, docs[-4][1][:200]), (2, "a b c"), (3, "d19999 the"), (4, "d7 the")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    index = dc.build_index(d)
    longest = index.selectExpr(*[f"max(size({c})) as {c}" for c, kind in index.dtypes if kind.startswith("array")]).first()
    assert max(longest) <= 8192 and index.select("shard").distinct().count() > 1
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)) < 6 << 20
    got = {r["doc_id"]: tuple(r) for r in dc.contamination(d, b, width=5).collect()}
    few = [x for x in docs if x[0] in (0, 7, 19_999, 30_001, 30_002, 40_000, 40_001)]
    assert len(got) == len(docs) and sorted((got[i] for i, _ in few), key=str) == brute(few, items, 5)
    assert sum(x[2] > 0 for x in got.values()) == sum(x[2] > 0 for x in brute(few, items, 5))
