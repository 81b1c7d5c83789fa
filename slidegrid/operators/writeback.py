"""Predictions back to spots: slices, barcodes, matching cascades, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import finite, normalised_name, ratio
from ..sources.shared import stored
from .numbering import numbered, running_sum

BARCODE_COLUMNS = ("barcode", "barcodes", "cell_barcode", "cell_id", "patch_barcode")


def offsets(counts: DataFrame, *, by=("split",), order: str = "pos", count: str = "n") -> DataFrame:
    """start and stop of each sample's rows, from the counts before it."""
    return running_sum(counts, by, [order], count, "start").withColumn("stop", F.col("start") + F.col(count))


def allocate(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """split, pos, sample_id, start, stop where counts are missing or disagree with the split's rows (split, rows).

    Known counts that sum to the rows give plain slices. Else known samples come first and the rest is dealt evenly to
    the unknown, one more to the first of them (to the last known sample if none is unknown); if the known counts
    overshoot, all samples share in proportion, unknown ones as 1, rounded half to even, and the last takes what is left.
    """
    w = W.partitionBy("split")
    known = F.col("n").isNotNull()
    base = counts.join(totals, "split").withColumns({"_known": F.coalesce(F.sum("n").over(w), F.lit(0)), "_unknown": F.count_if(~known).over(w), "_last": F.col("pos") == F.max("pos").over(w)})
    over = F.col("_known") > F.col("rows")
    order = W.partitionBy("split").orderBy(F.when(over, 0).when(known, 0).otherwise(1), "pos")
    base = base.withColumn("_place", F.row_number().over(W.partitionBy("split", known).orderBy("pos")) - 1)
    left = F.col("rows") - F.col("_known")
    even = F.floor(F.try_divide(left, F.col("_unknown"))) + (F.col("_place") < left % F.greatest(F.col("_unknown"), F.lit(1))).cast("int")
    share = F.coalesce("n", F.lit(1))
    part = F.bround(F.col("rows") * share / F.sum(share).over(w), 0)
    sized = base.withColumn("_size", F.when(over, part).when(known, F.col("n")).otherwise(even).cast("long"))
    start = F.coalesce(F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    takes_rest = F.when(over | (F.col("_unknown") == 0), F.col("_last")).otherwise(F.lit(False))
    sliced = sized.withColumn("start", F.least(start, F.col("rows"))).withColumn("stop", F.when(takes_rest, F.col("rows")).otherwise(F.least(F.col("start") + F.col("_size"), F.col("rows"))))
    return sliced.select("split", "pos", "sample_id", "start", "stop")


def slice_split(predictions: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows (split, seq, ...) with sample_id and their seq inside the sample: start <= seq < stop.

    The range becomes an equi-join: each slice lists the blocks of 4096 rows that it touches.
    """
    size = 4096
    blocks = slices.where("stop > start").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    rows = predictions.withColumn("_block", F.floor(F.col("seq") / size))
    met = rows.join(blocks.select("split", "sample_id", "start", "stop", "_block"), ["split", "_block"])
    return met.where((F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("stop"))).withColumn("sample_seq", F.col("seq") - F.col("start")).drop("_block", "start", "stop")


def attach_barcodes(sliced: DataFrame, patches: DataFrame) -> DataFrame:
    """By position; what either side has more is left out."""
    return sliced.join(patches.select("sample_id", F.col("seq").alias("sample_seq"), "barcode"), ["sample_id", "sample_seq"])


def label_matrix(predictions: DataFrame, genes: DataFrame) -> DataFrame:
    """split, seq, preds, targets (arrays) -> gene, pred, target rows; arrays of another length than the list raise."""
    n = genes.count()
    sized = predictions.withColumn("preds", F.when((F.size("preds") == n) & (F.size("targets") == n), F.col("preds")).otherwise(F.raise_error(F.lit(f"a row does not have {n} values"))))
    rows = sized.select("split", "seq", F.posexplode(F.arrays_zip("preds", "targets")).alias("pos", "v"))
    return rows.join(genes.select("pos", "gene"), "pos").select("split", "seq", "gene", F.col("v.preds").alias("pred"), F.col("v.targets").alias("target"))


def resolve_samples(predictions: DataFrame, obs: DataFrame) -> DataFrame:
    """pred_sample, sample_id, how: by equal id, else by normalised name, else by the largest number of shared barcodes (the first id among equals)."""
    asked, have = predictions.select(F.col("sample_id").alias("pred_sample")).distinct(), obs.select("sample_id").distinct()
    exact = asked.join(have, asked["pred_sample"] == have["sample_id"]).withColumn("how", F.lit("exact"))
    rest = asked.join(exact, "pred_sample", "left_anti")
    first = lambda df, *order: df.withColumn("_rn", F.row_number().over(W.partitionBy("pred_sample").orderBy(*order))).where("_rn = 1")
    named = first(rest.join(have, normalised_name(F.col("pred_sample")) == normalised_name(F.col("sample_id"))), "sample_id").select("pred_sample", "sample_id", F.lit("name").alias("how"))
    rest = rest.join(named, "pred_sample", "left_anti")
    most = largest_overlap(predictions.select(F.col("sample_id").alias("pred_sample"), "barcode").join(rest, "pred_sample"), obs).select("pred_sample", "sample_id", F.lit("barcodes").alias("how"))
    return exact.unionByName(named).unionByName(most)


def overlap_patterns(asked: DataFrame, obs: DataFrame, names: DataFrame) -> DataFrame:
    """pred_sample, word, bits, n: n barcodes of pred_sample are held by just the samples whose bits are set in this word of 64 samples.

    A barcode that all samples hold is a row for each 64 of them, and equal patterns of one pred_sample are counted together.
    names: sample_id, k (its place among all ids).
    """
    placed = obs.select("sample_id", "barcode").join(names, "sample_id")
    words = placed.groupBy("barcode", F.shiftright("k", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 AS INT))")).alias("bits"))
    met = asked.select("pred_sample", "barcode").where("barcode is not null").distinct().join(words, "barcode")
    return met.groupBy("pred_sample", "word", "bits").agg(F.count("*").alias("n"))


def largest_overlap(asked: DataFrame, obs: DataFrame) -> DataFrame:
    """pred_sample, sample_id, shared: the sample that shares most different barcodes with pred_sample, the first id among equals.

    No pairs of samples are counted one by one: a word's barcodes bound what any of its 64 samples can share, and the largest
    pattern is shared by some sample, so most words fall away; the others give all their 64 counts in one aggregate.
    """
    names = stored(numbered(obs.select("sample_id").distinct(), [], ["sample_id"], "k"))
    patterns = stored(overlap_patterns(asked, obs, names))
    least = patterns.groupBy("pred_sample").agg(F.max("n").alias("least"))
    open_ = patterns.groupBy("pred_sample", "word").agg(F.sum("n").alias("most")).join(least, "pred_sample").where(F.col("most") >= F.col("least")).select("pred_sample", "word")
    counts = patterns.join(open_, ["pred_sample", "word"]).groupBy("pred_sample", "word").agg(*[F.sum(F.when(F.getbit("bits", F.lit(b)) == 1, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(64)])
    best = F.array_max(F.array(*[F.struct(F.col(f"b{b}").alias("shared"), (-(F.col("word") * 64 + b)).alias("k")) for b in range(64)]))
    top = counts.select("pred_sample", best.alias("x")).groupBy("pred_sample").agg(F.max("x").alias("x")).select("pred_sample", F.col("x.shared").alias("shared"), (-F.col("x.k")).alias("k"))
    return top.join(names, "k").select("pred_sample", "sample_id", "shared")


def match_spots(predictions: DataFrame, obs: DataFrame) -> DataFrame:
    """sample_id, seq, obs_id, tier: how predictions (sample_id, seq, barcode) meet spots (sample_id, seq, obs_id, ...).

    A sample uses the first tier that matches anything: 1 barcode = obs_id, 2 the spots' first barcode-like column (of
    spots with one code the last). Only where spots have no such column: 3 by position if both have the same number of
    rows, 4 by position as far as both go.
    """
    held = next((c for c in BARCODE_COLUMNS if c in obs.columns), None)
    spots = obs.select("sample_id", F.col("seq").alias("obs_seq"), "obs_id", *([F.col(held).alias("_code")] if held else []))
    asked = predictions.select("sample_id", "seq", "barcode").distinct()

    def by_key(key: str, tier: int, of: DataFrame, to: DataFrame) -> DataFrame:
        last = of.groupBy("sample_id", F.col(key).alias("barcode")).agg(F.max_by("obs_id", "obs_seq").alias("obs_id"))
        return to.join(last, ["sample_id", "barcode"]).select("sample_id", "seq", "obs_id", F.lit(tier).alias("tier"))

    one = by_key("obs_id", 1, spots, asked)
    unmatched = lambda df: df.join(one.select("sample_id").distinct(), "sample_id", "left_anti")
    spots, asked = unmatched(spots), unmatched(asked)
    if held:
        return one.unionByName(by_key("_code", 2, spots, asked))
    tier = F.when(F.col("_np") == F.col("_no"), 3).otherwise(4)
    ordered = numbered(asked, ["sample_id"], ["seq", "barcode"], "_at", size="_np").join(numbered(spots, ["sample_id"], ["obs_seq", "obs_id"], "_at", size="_no"), ["sample_id", "_at"])
    return one.unionByName(ordered.select("sample_id", "seq", "obs_id", tier.alias("tier")))


def write_back(predictions: DataFrame, obs: DataFrame) -> DataFrame:
    """sample_id, obs_id, gene, pred, target, tier as floats, from rows (sample_id, seq, barcode, gene, pred, target)."""
    matched = match_spots(predictions, obs)
    return predictions.join(matched, ["sample_id", "seq"]).select("sample_id", "obs_id", "gene", F.col("pred").cast("float").alias("pred"), F.col("target").cast("float").alias("target"), "tier")


def attach_patch_metadata(spots: DataFrame, patches: DataFrame) -> DataFrame:
    """Coordinates for spots: by obs_id = barcode, then the remaining by sample-wide barcode column, then by position."""
    patches = patches.select("sample_id", F.col("seq").alias("_pseq"), F.col("barcode").alias("_b"), "coord_x", "coord_y")
    keyed = patches.withColumn("_rn", F.row_number().over(W.partitionBy("sample_id", "_b").orderBy("_pseq"))).where("_rn = 1").drop("_rn")
    one = spots.join(keyed, (spots["sample_id"] == keyed["sample_id"]) & (spots["obs_id"] == keyed["_b"])).select(spots["*"], "coord_x", "coord_y", "_pseq", F.lit(1).alias("tier"))
    rest = spots.join(one.select("sample_id", "seq"), ["sample_id", "seq"], "left_anti").select(*spots.columns)
    out = [one]
    if "barcode" in spots.columns:
        two = rest.join(keyed, (rest["sample_id"] == keyed["sample_id"]) & (rest["barcode"] == keyed["_b"])).select(rest["*"], "coord_x", "coord_y", "_pseq", F.lit(2).alias("tier"))
        out.append(two)
        rest = rest.join(two.select("sample_id", "seq"), ["sample_id", "seq"], "left_anti").select(*spots.columns)
    free = patches.join(reduce(lambda a, b: a.unionByName(b), [o.select("sample_id", "_pseq") for o in out]), ["sample_id", "_pseq"], "left_anti")
    three = numbered(rest, ["sample_id"], ["seq"], "_at").join(numbered(free, ["sample_id"], ["_pseq"], "_at"), ["sample_id", "_at"]).select(*spots.columns, "coord_x", "coord_y", "_pseq", F.lit(3).alias("tier"))
    return reduce(lambda a, b: a.unionByName(b), [*out, three]).drop("_pseq")


def coverage(written: DataFrame, obs: DataFrame) -> DataFrame:
    """matched, tier, genes, spots with any finite prediction and its share of the sample's spots."""
    spots = written.groupBy("sample_id", "obs_id").agg(F.bool_or(finite(F.col("pred"))).alias("any"), F.min("tier").alias("tier"))
    per = spots.groupBy("sample_id").agg(F.count("*").alias("matched"), F.min("tier").alias("tier"), F.count_if("any").alias("with_prediction"))
    genes = written.groupBy("sample_id").agg(F.countDistinct("gene").alias("genes"))
    whole = obs.groupBy("sample_id").agg(F.count("*").alias("spots"))
    out = whole.join(per, "sample_id", "left").join(genes, "sample_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("sample_id", "spots", zero("matched"), "tier", zero("genes"), zero("with_prediction"), ratio(F.coalesce("with_prediction", F.lit(0)), F.col("spots")).alias("fraction"))
