import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from slidegrid.llm import packing


def plain_best_fit(pieces, capacity, most):
    """The same rule by looking at every bin."""
    bins = []
    for k, (size, cluster, source) in enumerate(pieces):
        fits = [b for b in bins if capacity - sum(pieces[j][0] for j in b) >= size and all(pieces[j][1] != cluster for j in b) and sum(pieces[j][2] == source for j in b) < most]
        if fits:
            min(fits, key=lambda b: (capacity - sum(pieces[j][0] for j in b), bins.index(b))).append(k)
        else:
            bins.append([k])
    return bins


def test_equals_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        pieces = sorted(((rng.randrange(1, 60), rng.randrange(40), rng.choice("aaab c")) for _ in range(120)), key=lambda p: -p[0])
        assert [b.pieces for b in packing.best_fit(pieces, 100, 3)] == plain_best_fit(pieces, 100, 3)


def test_whole_table(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(1, 120))), rng.choice(["hot", "hot", "x", None])) for i in range(400)]
    rows += [(1000 + i, "Same  words here", "hot") for i in range(50)] + [(2000, None, "x"), (2001, " ", "x"), (2002, "w " * 1000, "x"), (7, rows[7][1], rows[7][2]), (None, "no id", None)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, bin int")
    out = [r.asDict() for r in packing.pack(frame, capacity=128, source_pieces=4, group=100).collect()]
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    got = Counter()
    bins = defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["n_words"]
        bins[r["group"], r["bin"]].append(r)
    assert got == +want and len({r["group"] for r in out}) > 2
    texts = {i: " ".join((t or "").lower().split()) for i, t, _ in rows}
    for held in bins.values():
        assert {r["used"] for r in held} == {sum(r["n_words"] for r in held)} and held[0]["used"] <= 128
        assert max(Counter(texts[r["doc_id"]] for r in held).values()) == 1
        assert len(held) == 1 or max(Counter(r["source"] for r in held).values()) <= 4


def test_bins_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))), rng.choice(["hot", "hot", "x", None])) for i in range(300)]
    rows += [(5, "the same row", "hot")] * 40 + [(None, "no id", None)] * 7
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = [packing.pack(f, capacity=128, group=60) for f in (frame, frame.repartition(7), frame.orderBy("text").coalesce(2))]
    plain = [Counter(tuple(r) for r in p.collect()) for p in packed]
    assert plain[0] == plain[1] == plain[2] and sum(plain[0].values()) == len(rows)
    filled = packing.fill(packed[0], 128).first()
    assert filled["words"] == sum(len(t.split()) for _, t, _ in rows) and abs(filled["share"] - filled["words"] / (128 * filled["bins"])) < 1e-12


def test_copies_over_many_blocks_and_case(spark):
    frame = spark.createDataFrame([(1, "A b"), (1, "\ta  B "), (2, "É"), (3, "é")], "doc_id long, text string").withColumn("source", F.lit("s"))
    marks = packing.pieces_of(frame, 16, None).collect()
    assert len({r["cluster"] for r in marks}) == 3 and len({r["mark"] for r in marks}) == 4
    many = spark.range(140000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    assert packing.pieces_of(many, 16, None).select("mark").distinct().count() == 140000


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
