import os

import pytest

import corpus_pipeline
from slidegrid.llm import quality
from slidegrid.llm.common import table

from .test_decontaminate import brute as contaminated
from .test_near_duplicates import brute as grouped

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    step = lambda k, d: corpus_pipeline.STAGES[k][1](spark, d, SMALL)
    first = step(0, docs).cache()
    score = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, table(spark, SMALL, "labels")).collect()}
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {k for k, v in score.items() if v}
    second = step(1, first).cache()
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert second.columns == columns and {r["doc_id"] for r in second.collect()} == {r[0] for r in grouped(rows) if r[3]}
    third = step(2, second).cache()
    assert third.columns == columns
    words = {r["doc_id"]: r["text"].split(" ") for r in third.collect()}
    seen = {}
    for r in second.collect():
        w = r["text"].encode().split()
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((r["doc_id"], i))
    gone = {}
    for places in seen.values():
        if len(places) > 1:
            for doc, i in places:
                gone.setdefault(doc, set()).update(range(i, i + 35))
    for r in second.collect():
        w = r["text"].encode().split()
        left = [x.decode() for k, x in enumerate(w) if k not in gone.get(r["doc_id"], ())]
        assert (" ".join(words.get(r["doc_id"], [])).encode().split()) == [x.encode() for x in left]
    fourth = step(3, third).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in third.collect()], items) if r[5]}
    assert fourth.columns == columns and {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in third.collect()} - bad
    packed = step(4, fourth).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in fourth.collect() if r["text"].split()}
    for r in (first, second, third, fourth):
        r.unpersist()
