import random

from slidegrid.operators import writeback
from slidegrid.operators.numbering import numbered


def rows(seed=4):
    rng = random.Random(seed)
    obs = [(f"o{i:03d}", f"b{rng.randrange(400)}") for i in range(150) for _ in range(rng.randrange(1, 12))]
    asked = [(f"p{i:03d}", f"b{rng.randrange(400)}") for i in range(90) for _ in range(rng.randrange(1, 12))]
    obs += [(f"o{i:03d}", "all") for i in range(150)] + obs[:40] + [("o003", None)]
    asked += [(f"p{i:03d}", "all") for i in range(0, 90, 2)] + asked[:40] + [("p_only", "nowhere"), ("p_null", None), ("p_all", "all")]
    return asked, obs


def test_equals_counting_of_pairs(spark):
    asked, obs = rows()
    want, of, to = {}, {}, {}
    for s, b in asked:
        of.setdefault(s, set()).add(b)
    for s, b in obs:
        to.setdefault(s, set()).add(b)
    for s, own in of.items():
        n, first = min((-len((own & held) - {None}), t) for t, held in to.items())
        if n:
            want[s] = (first, -n)
    a, o = spark.createDataFrame(asked, "pred_sample string, barcode string"), spark.createDataFrame(obs, "sample_id string, barcode string")
    assert {r["pred_sample"]: (r["sample_id"], r["shared"]) for r in writeback.largest_overlap(a, o).collect()} == want
    assert want["p_all"] == ("o000", 1)


def test_a_barcode_of_all_samples_gives_no_pairs(spark):
    a = spark.range(300).selectExpr("concat('p', id) AS pred_sample", "explode(array('x', 'y', 'z')) AS barcode")
    o = spark.range(320).selectExpr("concat('o', id) AS sample_id", "explode(array('x', 'y', 'z')) AS barcode")
    patterns = writeback.overlap_patterns(a, o, numbered(o.select("sample_id").distinct(), [], ["sample_id"], "k"))
    assert patterns.count() == 300 * 5  # not 300 * 320
    assert {(r["sample_id"], r["shared"]) for r in writeback.largest_overlap(a, o).collect()} == {("o0", 3)}


def test_resolution_order(spark):
    preds = spark.createDataFrame([("S1", "a"), ("s-2", "b"), ("new", "c"), ("new", "d"), ("lost", "z")], "sample_id string, barcode string")
    obs = spark.createDataFrame([("S1", "q"), ("S_2", "q"), ("X", "c"), ("Y", "c"), ("Y", "d")], "sample_id string, barcode string")
    assert {tuple(r) for r in writeback.resolve_samples(preds, obs).collect()} == {("S1", "S1", "exact"), ("s-2", "S_2", "name"), ("new", "Y", "barcodes")}
