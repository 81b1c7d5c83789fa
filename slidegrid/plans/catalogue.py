"""The registered queries of the library's own operators, with their SQL; every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as c
from ..functions.polygons import point_in_polygon
from ..operators import catalog, genes, metrics, models, report, rules, spatial, splits, writeback
from ..operators.cover import points_in_polygons
from ..operators.nearest import knn
from ..operators.numbering import numbered
from ..sources import runs as run_documents
from ..sources import tables
from ..sources.shared import shared_name
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = v.with_views(views, sql) if views else sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


@query("SELECT sample_id, array_row, array_col, (array_col + 0.5) * 10000.0::DOUBLE AS x, (array_row + 0.5) * 10000.0::DOUBLE AS y, gene, value FROM spots", "points spots")
def q01_pool_spots(s, d):
    return v.spots(s, d).drop("obs_id")


@query("SELECT sample_id, array_row, array_col, sum(value)::BIGINT AS total_counts, round(ln(1 + sum(value)), 6) AS log1p_total_counts FROM spots GROUP BY ALL", "points spots")
def q02_spot_totals(s, d):
    return rounded(spatial.spot_totals(v.spots(s, d)), "log1p_total_counts")


@query("SELECT sample_id, array_row, array_col, count(*) AS n_genes, sum(value)::BIGINT AS total_counts, round(100.0 * sum(CASE WHEN rn <= 5 THEN value ELSE 0 END) / sum(value), 6) AS pct_counts_in_top_5, round(100.0 * sum(CASE WHEN rn <= 10 THEN value ELSE 0 END) / sum(value), 6) AS pct_counts_in_top_10 FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, array_row, array_col ORDER BY value DESC, gene) AS rn FROM spots) GROUP BY ALL", "points spots")
def q03_qc_spots(s, d):
    return rounded(genes.qc_spots(v.spots(s, d), (5, 10, 500), by=("sample_id", "array_row", "array_col")), "pct_counts_in_top_5", "pct_counts_in_top_10")


@query("SELECT gene, count(*) AS n_cells, sum(value)::BIGINT AS total_counts, round(sum(value)::DOUBLE / (SELECT count(*) FROM obs), 6) AS mean_counts, round(100 * (1 - count(*)::DOUBLE / (SELECT count(*) FROM obs)), 6) AS pct_dropout FROM spots GROUP BY gene", "points spots obs")
def q04_qc_genes(s, d):
    return rounded(genes.qc_genes(v.spots(s, d), v.obs(s, d).count()), "mean_counts", "pct_dropout")


@query(
    """, n AS (SELECT sample_id, count(*) AS n_obs FROM obs GROUP BY ALL), g AS (SELECT sample_id, gene, count(*) AS cells FROM spots GROUP BY ALL),
    j AS (SELECT gene, count(*) AS n, count_if(cells >= ceil(0.95 * n_obs)) AS e FROM g JOIN n USING (sample_id) GROUP BY gene)
    SELECT gene, true AS in_union, n = (SELECT count(*) FROM n) AND NOT regexp_matches(gene, 'NegControl|Codeword|Intergenic_Region|Control|BLANK') AS in_common,
        e = (SELECT count(*) FROM n) AND NOT regexp_matches(gene, 'BLANK|Control') AS in_filtered_common FROM j""",
    "points spots obs",
)
def q05_gene_sets(s, d):
    return genes.gene_sets(v.spots(s, d), v.obs(s, d), 0.95)


_TOP = """, n AS (SELECT sample_id, count(*) AS n_obs FROM obs GROUP BY ALL), g AS (SELECT sample_id, gene, count(*) AS cells FROM spots GROUP BY ALL),
    k AS (SELECT gene FROM g JOIN n USING (sample_id) WHERE cells >= ceil(0.1 * n_obs) GROUP BY gene HAVING count(*) = (SELECT count(*) FROM n)),
    a AS (SELECT gene, sum(ln(1 + value)) AS s, sum(ln(1 + value) * ln(1 + value)) AS ss, (SELECT count(*) FROM obs)::DOUBLE AS m FROM spots JOIN k USING (gene) GROUP BY gene)
    SELECT row_number() OVER (ORDER BY {0} DESC, gene) - 1 AS pos, gene, round({0}, 6) AS score FROM a ORDER BY {0} DESC, gene LIMIT {1}"""


@query(_TOP.format("((ss - s * s / m) / (m - 1))", 50), "points spots obs")
def q06_topk_var(s, d):
    return rounded(genes.top_k_genes(v.spots(s, d), v.obs(s, d)), "score").withColumn("pos", F.col("pos").cast("long"))


@query(_TOP.format("(s / m)", 7), "points spots obs")
def q06_topk_mean(s, d):
    return rounded(genes.top_k_genes(v.spots(s, d), v.obs(s, d), 7, "mean"), "score").withColumn("pos", F.col("pos").cast("long"))


_PLACE = "l_orderkey, l_linenumber, sample_id, gene, x, y"


@query(f"SELECT {_PLACE} FROM points WHERE x >= 0 AND x < 90000 AND y >= 0 AND y < 80000", "points")
def q07_clip_bounds(s, d):
    return spatial.clip_to_slide(v.points(s, d), v.samples(s, d)).select(*_PLACE.split(", "))


def _flagged(s, d, listed):
    return spatial.exclude_spots(v.points(s, d), v.samples(s, d), listed, keep_flag=True).select("l_orderkey", "l_linenumber", "x", "y", "excluded")


_FLAG = "SELECT l_orderkey, l_linenumber, x, y, {} AS excluded FROM points"


@query(_FLAG.format("(x < 20000 AND y < 15000) OR (x > 90000 - 0.25 * 90000 AND y > 80000 - 0.5 * 80000)"), "points")
def q08_rule_corner(s, d):
    return _flagged(s, d, [{"type": "corner", "corner": "top-left", "width": 20000, "height": 15000}, {"type": "corner", "corner": "bottom-right", "width": 0.25, "height": 0.5, "units": "frac"}])


@query(_FLAG.format("y < 0.1 * 80000 OR x > 90000 - 12000"), "points")
def q09_rule_strip(s, d):
    return _flagged(s, d, [{"type": "strip", "side": "top", "size": 0.1, "units": "frac"}, {"type": "strip", "side": "right", "size": 12000}])


@query(_FLAG.format("(x BETWEEN 30000 AND 40000 AND y BETWEEN 20000 AND 50000) OR (x BETWEEN 45000 AND 67500 AND y BETWEEN 0 AND 8000)"), "points")
def q10_rule_rect(s, d):
    return _flagged(s, d, [{"type": "rect", "xmin": 30000, "xmax": 40000, "ymin": 20000, "ymax": 50000}, {"type": "rect", "xmin": 0.5, "xmax": 0.75, "ymin": 0.0, "ymax": 0.1, "units": "frac"}])


def _ring_sql(ring) -> str:
    edges = [f"(({yi} > y) <> ({yj} > y) AND x < {xi} + (y - ({yi})) * ({xj - xi}) / ({yj - yi}::DOUBLE))" for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True) if yi != yj]
    return "((" + " + ".join(f"{e}::INTEGER" for e in edges) + ") % 2 = 1)"


@query(_FLAG.format(_ring_sql([(25000.0, 0.0), (65000.0, 0.0), (55000.0, 30000.0), (35000.0, 30000.0)])), "points")
def q11_rule_trapezoid(s, d):
    return _flagged(s, d, [{"type": "trapezoid", "orientation": "top", "top_width": 40000, "bottom_width": 20000, "height": 30000}])


_CELLS = {
    "AF": '[{"type": "corner", "corner": "top-left", "width": 0.2, "height": 0.25, "units": "frac"}, {"type": "trapezoid", "orientation": "top", "top_width": 40000, "bottom_width": 20000, "height": 30000}]',
    "NF": "{'type': 'trapezoid', 'orientation': 'bottom', 'top_width': 0.5, 'bottom_width': 0.25, 'height': 0.375, 'units': 'frac', 'center_offset': 0.1}, {'type': 'strip', 'side': 'left', 'size': 9000}",
    "NO": '[{"type": "trapezoid", "orientation": "left", "top_width": 50000, "bottom_width": 20000, "height": 25000}, {"type": "rect", "xmin": 50000, "xmax": 60000, "ymin": 0.0, "ymax": 8000}]',
    "RF": "{'type': 'trapezoid', 'orientation': 'right', 'top_width': 10000, 'bottom_width': 60000, 'height': 40000, 'center_offset': -5000}",
}


@query(
    _FLAG.format(
        "CASE l_returnflag || l_linestatus WHEN 'AF' THEN (x < 0.2 * 90000 AND y < 0.25 * 80000) OR " + _ring_sql([(25000.0, 0.0), (65000.0, 0.0), (55000.0, 30000.0), (35000.0, 30000.0)])
        + " WHEN 'NF' THEN x < 9000 OR " + _ring_sql([(31500.0, 80000.0), (76500.0, 80000.0), (65250.0, 50000.0), (42750.0, 50000.0)])
        + " WHEN 'NO' THEN (x BETWEEN 50000 AND 60000 AND y BETWEEN 0 AND 8000) OR " + _ring_sql([(0.0, 15000.0), (0.0, 65000.0), (25000.0, 50000.0), (25000.0, 30000.0)])
        + " WHEN 'RF' THEN " + _ring_sql([(90000.0, 30000.0), (90000.0, 40000.0), (50000.0, 65000.0), (50000.0, 5000.0)]) + " ELSE false END"
    ).replace("FROM points", "FROM (SELECT sample_id[1:1] AS l_returnflag, sample_id[2:2] AS l_linestatus, l_orderkey, l_linenumber, x, y FROM points)"),
    "points",
)
def q72_rules_by_sample(s, d):
    cell = reduce(lambda found, item: F.when(F.col("sample_id") == item[0], item[1]).otherwise(found), _CELLS.items(), F.lit(None))
    sheet = v.samples(s, d).withColumn("crop", cell)
    flagged = rules.exclude_by_rules(v.points(s, d), sheet, rules.rule_rows(sheet, "crop"), keep_flag=True)
    return flagged.select("l_orderkey", "l_linenumber", "x", "y", "excluded")


_RING = [(10000.0, 10000.0), (80000.0, 20000.0), (50000.0, 45000.0), (90000.0, 90000.0), (20000.0, 75000.0)]


@query(f"SELECT sample_id, gene, count(*) AS n FROM points WHERE {_ring_sql(_RING)} GROUP BY ALL", "points")
def q11_point_in_polygon(s, d):
    return v.points(s, d).where(point_in_polygon(F.col("x"), F.col("y"), _RING)).groupBy("sample_id", "gene").agg(F.count("*").alias("n"))


@query(
    f""", p AS (SELECT l_orderkey, l_linenumber, sample_id, x, y FROM points)
    SELECT l_orderkey, l_linenumber, sample_id, 'concave' AS polygon_id FROM p WHERE {_ring_sql(_RING)} UNION ALL
    SELECT l_orderkey, l_linenumber, sample_id, 'square' FROM p WHERE {_ring_sql([(30000.0, 30000.0), (60000.0, 30000.0), (60000.0, 60000.0), (30000.0, 60000.0)])}""",
    "points",
)
def q11_spatial_join(s, d):
    ring = lambda r: F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in r])
    square = [(30000.0, 30000.0), (60000.0, 30000.0), (60000.0, 60000.0), (30000.0, 60000.0)]
    polygons = v.samples(s, d).select("sample_id").withColumn("p", F.explode(F.array(F.struct(F.lit("concave").alias("polygon_id"), ring(_RING).alias("ring")), F.struct(F.lit("square").alias("polygon_id"), ring(square).alias("ring"))))).select("sample_id", "p.*")
    return points_in_polygons(v.points(s, d), polygons).select("l_orderkey", "l_linenumber", "sample_id", "polygon_id")


@query(", b AS (SELECT sample_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points WHERE gene = 'Brand#2' AND x BETWEEN 20000 AND 70000 AND y < 60000 GROUP BY ALL) SELECT l_orderkey, l_linenumber, sample_id FROM points JOIN b USING (sample_id) WHERE x BETWEEN x0 - 400 AND x1 + 400 AND y BETWEEN y0 - 400 AND y1 + 400", "points")
def q12_bbox_margin(s, d):
    cells = v.points(s, d).where("gene = 'Brand#2' AND x BETWEEN 20000 AND 70000 AND y < 60000")
    return spatial.bbox_filter(v.points(s, d), cells, 400.0).select("l_orderkey", "l_linenumber", "sample_id")


@query("SELECT l_orderkey, l_linenumber, round(0.5 * x / 2 - 0.25 * y / 2 + 100, 6) AS he_x, round(0.25 * x / 2 + 0.5 * y / 2 - 50, 6) AS he_y FROM points", "points")
def q13_affine(s, d):
    return rounded(spatial.affine_align(v.points(s, d), v.samples(s, d), x="x", y="y").select("l_orderkey", "l_linenumber", "he_x", "he_y"), "he_x", "he_y")


_METRICS = "count(*) AS n, avg((pred - target) * (pred - target)) AS mse, 1 - sum((pred - target) * (pred - target)) / nullif(sum(target * target) - sum(target) * sum(target) / count(*), 0) AS r2, corr(pred, target) AS pearson"


@query(f"SELECT gene, n, round(mse, 6) AS mse, round(r2, 6) AS r2, round(pearson, 6) AS pearson FROM (SELECT gene, {_METRICS} FROM pairs GROUP BY gene)", "pairs")
def q14_gene_metrics(s, d):
    return rounded(metrics.gene_metrics(v.pairs(s, d)), "mse", "r2", "pearson")


@query(
    f", m AS (SELECT gene, {_METRICS} FROM pairs GROUP BY gene) SELECT round(avg(pearson), 6) AS pearson_mean, round(stddev_pop(pearson), 6) AS pearson_std, "
    + ", ".join(f"round(quantile_cont({col}, {q}), 6) AS {a}_q{i}" for col, a in (("mse", "l2_error"), ("r2", "r2_score")) for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
    + " FROM m",
    "pairs",
)
def q15_metric_quartiles(s, d):
    out = metrics.summarise_metrics(metrics.gene_metrics(v.pairs(s, d)))
    return rounded(out, *out.columns)


@query("SELECT dataset, encoder, array_to_string(list(CASE WHEN corr IS NULL THEN '-' ELSE CAST(round(corr * 1e9) AS BIGINT)::VARCHAR END ORDER BY fold), ' ') AS folds, CASE WHEN count(corr) = count(*) THEN round(avg(corr), 6) END AS mean, CASE WHEN count(corr) = count(*) THEN round(stddev_pop(corr), 6) END AS std FROM runs GROUP BY ALL", "runs")
def q16_merge_folds(s, d):
    out = metrics.merge_folds(v.runs(s, d), ("dataset", "encoder"))
    text = F.array_join(F.transform("values", lambda x: F.when(x.isNull(), "-").otherwise(F.round(x * 1e9).cast("long").cast("string"))), " ")
    return rounded(out.select("dataset", "encoder", text.alias("folds"), "mean", "std"), "mean", "std")


@query(", m AS (SELECT dataset, encoder, avg(corr) AS mean FROM runs GROUP BY ALL) SELECT encoder, round(avg(mean), 6) AS pearson_mean, round(stddev_pop(mean), 6) AS pearson_std FROM m GROUP BY ALL", "runs")
def q17_nan_safe_repair(s, d):
    bad = v.runs(s, d).withColumn("corr", F.coalesce("corr", F.lit(float("nan"))))
    return rounded(metrics.repair_encoders(metrics.merge_folds(bad, ("dataset", "encoder"), nan="skip")), "pearson_mean", "pearson_std")


@query("SELECT dataset, encoder, round(pearson_mean, 6) AS pearson_mean, round(pearson_std, 6) AS pearson_std, CAST(row_number() OVER (PARTITION BY dataset ORDER BY pearson_mean DESC NULLS LAST, encoder) AS INTEGER) AS rank FROM merged", "runs merged")
def q18_encoder_rank(s, d):
    return rounded(metrics.rank_encoders(v.merged_runs(s, d)), "pearson_mean", "pearson_std")


@query("SELECT encoder, round(avg(pearson_mean), 6) AS average FROM merged GROUP BY ALL", "runs merged")
def q19_encoder_average(s, d):
    return rounded(metrics.average_encoders(v.merged_runs(s, d)), "average")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT dataset, " + ", ".join(f"round(max(CASE WHEN encoder = '{e}' THEN pearson_{k} END), 6) AS \"{e}_{k}\"" for e in _SEGMENTS for k in ("mean", "std")) + " FROM merged GROUP BY dataset", "runs merged")
def q20_wide_pivot(s, d):
    out = metrics.wide_results(v.merged_runs(s, d), list(_SEGMENTS))
    return rounded(out, *out.columns[1:])


@query("SELECT dataset, encoder, round(pearson_mean, 6) AS pearson_mean FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pearson_mean DESC NULLS LAST, encoder) AS rn FROM merged) WHERE rn = 1", "runs merged")
def q21_best_run(s, d):
    return rounded(metrics.best_row(v.merged_runs(s, d), ["dataset"], "pearson_mean", "encoder").select("dataset", "encoder", "pearson_mean"), "pearson_mean")


_KFOLD = ", g AS (SELECT DISTINCT dataset_title, patient FROM meta), f AS (SELECT *, CAST(ntile({}) OVER (ORDER BY dataset_title, patient) - 1 AS INTEGER) AS fold FROM g), s AS (SELECT CAST(unnest(range({})) AS INTEGER) AS split) SELECT split, CASE WHEN split = fold THEN 'test' ELSE 'train' END AS part, sample_id FROM meta JOIN f USING (dataset_title, patient), s"


@query(_KFOLD.format(4, 4), "meta")
def q22_group_kfold(s, d):
    return splits.group_kfold(v.meta(s, d), 4)


@query(", g AS (SELECT DISTINCT dataset_title, patient FROM meta), f AS (SELECT *, CAST(row_number() OVER (ORDER BY dataset_title, patient) - 1 AS INTEGER) AS fold FROM g) SELECT s.fold AS split, CASE WHEN s.fold = f.fold THEN 'test' ELSE 'train' END AS part, sample_id FROM meta JOIN f USING (dataset_title, patient), f s", "meta")
def q23_loo_split(s, d):
    return splits.group_kfold(v.meta(s, d), "loocv")


@query(", c AS (SELECT sample_id, CASE WHEN dataset_title IN ('ASIA', 'EUROPE') THEN 0 WHEN dataset_title LIKE 'A%' THEN 1 END AS cohort FROM meta) SELECT CAST(split AS INTEGER) AS split, CASE WHEN cohort = split THEN 'train' ELSE 'test' END AS part, sample_id FROM c, (VALUES (0), (1)) AS t(split) WHERE cohort IS NOT NULL", "meta")
def q24_cohort_split(s, d):
    cohort = F.when(F.col("dataset_title").rlike("^(ASIA|EUROPE)$"), 0).when(F.col("dataset_title").rlike("^A"), 1)
    return splits.cohort_splits(v.meta(s, d), cohort)[0]


@query("SELECT DISTINCT gene FROM panels", "panels")
def q25_gene_union(s, d):
    return v.panels(s, d).select("gene").distinct()


@query("SELECT gene FROM panels WHERE sample_id = 3 INTERSECT SELECT gene FROM panels WHERE sample_id = 7", "panels")
def q25_gene_intersect(s, d):
    p = v.panels(s, d)
    return p.where("sample_id = 3").select("gene").intersect(p.where("sample_id = 7").select("gene"))


@query("SELECT p_name AS name FROM part WHERE p_size < 25 EXCEPT SELECT p_name FROM part WHERE p_size > 45")
def q25_name_except(s, d):
    p = v.table(s, d, "part")
    return p.where("p_size < 25").select(F.col("p_name").alias("name")).subtract(p.where("p_size > 45").select("p_name"))


@query("SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS n, array_to_string(list(a.gene ORDER BY a.gene), ',') AS genes FROM panels a JOIN panels b USING (gene) GROUP BY ALL", "panels")
def q25_overlap_matrix(s, d):
    return genes.overlap_matrix(v.panels(s, d), "sample_id").withColumn("genes", F.array_join("genes", ","))


_COUNTS = ", n AS (SELECT l_suppkey AS sample_id, count(*) AS num_patches FROM lineitem GROUP BY ALL), m AS (SELECT o_custkey AS sample_id, count(DISTINCT o_orderdate) AS num_dates FROM orders GROUP BY ALL)"


def _supplier_counts(s, d, name):
    if name == "patches":
        return v.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.count("*").alias("num_patches"))
    return v.table(s, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.countDistinct("o_orderdate").alias("num_dates"))


@query(f"{_COUNTS} SELECT sample_id, patient, num_patches, num_dates FROM meta LEFT JOIN n USING (sample_id) LEFT JOIN m USING (sample_id)", "meta")
def q26_merge_counts(s, d):
    specs = {"num_patches": "patches", "num_dates": "dates", "unused": ""}
    return catalog.merge_counts(v.meta(s, d), specs, lambda name: _supplier_counts(s, d, name)).select("sample_id", "patient", "num_patches", "num_dates")


@query(f"{_COUNTS} SELECT sample_id, coalesce(m.num_dates, meta.patient)::BIGINT AS patient FROM meta LEFT JOIN m USING (sample_id)", "meta")
def q27_update_join(s, d):
    new = _supplier_counts(s, d, "dates").withColumnRenamed("num_dates", "patient")
    return catalog.update_column(v.meta(s, d).select("sample_id", F.col("patient").cast("long").alias("patient")), new, "sample_id", "patient")


@query(f"{_COUNTS} SELECT sample_id, m.num_dates, dataset_title FROM m RIGHT JOIN meta USING (sample_id)", "meta")
def q28_right_join(s, d):
    return catalog.attach_right(_supplier_counts(s, d, "dates"), v.meta(s, d)).select("sample_id", "num_dates", "dataset_title")


@query("WITH a AS (SELECT upper(trim(p_name)) AS k, min(p_type) AS label FROM part WHERE p_size <= 20 GROUP BY ALL), b AS (SELECT upper(trim(p_brand)) AS k, max(p_size) AS label FROM part WHERE p_size > 30 GROUP BY ALL) SELECT p_partkey, p_name AS gene, a.label AS kind, CAST(b.label AS VARCHAR) AS biggest FROM part LEFT JOIN a ON upper(trim(p_name)) = a.k LEFT JOIN b ON upper(trim(p_name)) = b.k")
def q29_annotate_genes(s, d):
    p = v.table(s, d, "part")
    kind = p.where("p_size <= 20").groupBy(F.lower("p_name").alias("gene")).agg(F.min("p_type").alias("label"))
    biggest = p.where("p_size > 30").groupBy(F.col("p_brand").alias("gene")).agg(F.max("p_size").cast("string").alias("label"))
    return catalog.annotate_genes(p.select("p_partkey", F.col("p_name").alias("gene")), {"kind": kind, "biggest": biggest})


@query(", g AS (SELECT dataset, encoder, fold, corr, CAST(row_number() OVER (PARTITION BY dataset, encoder ORDER BY fold) - 1 AS INTEGER) AS split FROM runs) SELECT dataset, encoder, split, round(corr, 6) AS corr, CAST(n_nationkey AS INTEGER) AS test_sample, n_name FROM g LEFT JOIN nation ON split = n_nationkey % 9", "runs")
def q30_splits_meta(s, d):
    merged = metrics.merge_folds(v.runs(s, d), ("dataset", "encoder")).drop("mean", "std")
    nations = v.table(s, d, "nation")
    parts = nations.select((F.col("n_nationkey") % 9).alias("split"), F.col("n_nationkey").alias("test_sample"))
    meta = nations.select(F.col("n_nationkey").alias("sample_id"), "n_name")
    return rounded(catalog.attach_splits(merged, catalog.attach_metadata(parts, meta)).select("dataset", "encoder", "split", "corr", "test_sample", "n_name"), "corr")


@query(r"""SELECT page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') AS number, coalesce(nullif(regexp_extract(url, '//www\.(\w+)', 1), ''), nullif(regexp_extract(url, '//(\w+)', 1), '')) AS site,
    CASE WHEN starts_with(url, 'https') THEN url ELSE 'https+' || url END AS prefixed, coalesce(nullif(substr(upper(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')), 1, 8), ''), 'R') AS tag, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe, lower(regexp_replace(url, '[-_.\s]', '', 'g')) AS plain FROM pages""")
def q31_parse_ids(s, d):
    u = F.col("url")
    return v.table(s, d, "pages").select("page_id", c.extracted(u, r"/(\d+)").alias("number"), c.first_extracted(u, r"//www\.(\w+)", r"//(\w+)").alias("site"), c.ensure_prefix(u, F.lit("https")).alias("p"), c.sanitised_tag(u).alias("tag"), c.safe_name(u).alias("safe"), c.normalised_name(u).alias("plain")).withColumn("prefixed", F.when(F.startswith(F.col("p"), F.lit("httpshttp:")), F.concat(F.lit("https+"), F.substr("p", F.lit(6)))).otherwise(F.col("p"))).drop("p")


@query("""WITH m AS (SELECT 'supplier' AS source, avg(s_acctbal) AS mean FROM supplier UNION ALL SELECT 'customer', avg(c_acctbal) FROM customer UNION ALL SELECT 'none', NULL)
    SELECT r_name AS dataset, round(CASE r_name WHEN 'AFRICA' THEN (SELECT mean FROM m WHERE source = 'supplier') * 14 WHEN 'AMERICA' THEN ((SELECT mean FROM m WHERE source = 'customer') * 7 + (SELECT mean FROM m WHERE source = 'supplier') * 15) / 2
    WHEN 'ASIA' THEN (SELECT mean FROM m WHERE source = 'customer') * 7 / 2 END, 6) AS num_training_patches_mean FROM region""")
def q32_lookup_multiplier(s, d):
    rules = s.createDataFrame([("AFRICA", "supplier", 14.0, 0), ("AMERICA", "customer", 7.0, 0), ("AMERICA", "supplier", 15.0, 1), ("ASIA", "customer", 7.0, 0), ("ASIA", "none", 15.0, 1), ("EUROPE", "none", 2.0, 0), ("EUROPE", "supplier", 2.0, 1)], "dataset string, source string, factor double, part int")
    means = v.table(s, d, "supplier").agg(F.avg("s_acctbal").alias("mean")).withColumn("source", F.lit("supplier")).unionByName(v.table(s, d, "customer").agg(F.avg("c_acctbal").alias("mean")).withColumn("source", F.lit("customer")))
    return rounded(catalog.training_patches(v.table(s, d, "region").select(F.col("r_name").alias("dataset")), rules, means), "num_training_patches_mean")


@query("SELECT 'kept' AS what, s_suppkey AS sample_id FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 7 FROM customer) UNION ALL SELECT 'not found', c_custkey * 7 FROM customer WHERE c_custkey * 7 NOT IN (SELECT s_suppkey FROM supplier)")
def q33_exclude_ids(s, d):
    ids = v.table(s, d, "customer").select((F.col("c_custkey") * 7).alias("id"))
    kept, missing = catalog.exclude_ids(v.table(s, d, "supplier").select(F.col("s_suppkey").alias("sample_id")), ids)
    return kept.withColumn("what", F.lit("kept")).unionByName(missing.withColumn("what", F.lit("not found")))


def _label_predictions(s, d):
    """Labels as predictions for documents as spots; a sample for each source."""
    docs = v.table(s, d, "documents").select("doc_id", "source", "n_chars")
    marks = v.table(s, d, "labels").join(docs, "doc_id")
    spots = docs.select(F.col("source").alias("sample_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("obs_id"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("barcode"), "n_chars")
    kind = F.when(F.substring("source", 4, 9).cast("int") % 3 == 0, F.lit("d")).when(F.substring("source", 4, 9).cast("int") % 3 == 1, F.lit("b")).otherwise(F.lit("?"))
    preds = marks.select(F.col("source").alias("sample_id"), F.col("doc_id").alias("seq"), F.concat(kind, F.col("doc_id").cast("string")).alias("barcode"), F.lit("quality").alias("gene"), F.col("quality").cast("double").alias("pred"), F.col("toxic").cast("double").alias("target"))
    return preds, spots


_MATCHED = """WITH docs AS (SELECT doc_id, source, CAST(substr(source, 4) AS INTEGER) % 3 AS k FROM documents), p AS (SELECT docs.*, quality, toxic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS np FROM labels JOIN docs USING (doc_id)),
    o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS no FROM docs),
    w AS (SELECT source, doc_id, doc_id AS obs, k + 1 AS tier, quality, toxic FROM p WHERE k < 2),
    placed AS (SELECT source, doc_id, doc_id AS obs, 1 AS tier, quality, toxic FROM p WHERE k = 0 UNION ALL SELECT p.source, p.doc_id, o.doc_id, CASE WHEN np = no THEN 3 ELSE 4 END, quality, toxic FROM p JOIN o ON p.source = o.source AND p.rn = o.rn WHERE k > 0)"""
_WRITTEN = "SELECT source AS sample_id, 'd' || obs AS obs_id, 'quality' AS gene, quality::DOUBLE AS pred, toxic::DOUBLE AS target, CAST(tier AS INTEGER) AS tier FROM"


def _written(preds, spots):
    return writeback.write_back(preds, spots).withColumns({"pred": F.col("pred").cast("double"), "target": F.col("target").cast("double")})


@query(f"{_MATCHED} {_WRITTEN} w")
def q34_write_back(s, d):
    return _written(*_label_predictions(s, d))


@query(f"{_MATCHED} {_WRITTEN} placed")
def q34_write_back_by_order(s, d):
    preds, spots = _label_predictions(s, d)
    return _written(preds, spots.drop("barcode"))


@query("""WITH o AS (SELECT o_custkey % 7 AS split, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS seq FROM orders), c AS (SELECT c_custkey % 7 AS split, c_custkey AS b, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) - 1 AS seq FROM customer)
    SELECT split AS sample_id, seq AS sample_seq, k AS o_orderkey, b AS barcode FROM o JOIN c USING (split, seq)""")
def q35_positional_match(s, d):
    o = v.table(s, d, "orders").select((F.col("o_custkey") % 7).alias("sample_id"), "o_orderkey")
    k = v.table(s, d, "customer").select((F.col("c_custkey") % 7).alias("sample_id"), F.col("c_custkey").alias("barcode"))
    return writeback.attach_barcodes(numbered(o, ["sample_id"], ["o_orderkey"], "sample_seq"), numbered(k, ["sample_id"], ["barcode"], "seq"))


_SLICES = "WITH n AS (SELECT o_custkey AS sample_id, o_custkey % 5 AS split, count(*) AS n FROM orders GROUP BY ALL), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n)"


def _order_slices(s, d):
    counts = v.table(s, d, "orders").groupBy(F.col("o_custkey").alias("sample_id"), (F.col("o_custkey") % 5).alias("split")).agg(F.count("*").alias("n"))
    return writeback.offsets(counts, order="sample_id")


@query(f"{_SLICES}, p AS (SELECT o_custkey % 5 AS split, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS seq FROM orders) SELECT o.sample_id, p.split, p.seq, p.o_orderkey, p.seq - o.start AS sample_seq FROM p JOIN o ON p.split = o.split AND p.seq >= o.start AND p.seq < o.start + o.n")
def q36_slice_by_offset(s, d):
    p = v.table(s, d, "orders").select((F.col("o_custkey") % 5).alias("split"), "o_orderkey")
    return writeback.slice_split(numbered(p, ["split"], ["o_orderkey"], "seq"), _order_slices(s, d)).select("sample_id", "split", "seq", "o_orderkey", "sample_seq")


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS p, l_partkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), o AS (SELECT DISTINCT l_returnflag || l_linestatus AS sample_id, l_partkey AS b FROM lineitem),
    n AS (SELECT p, sample_id, count(*) AS n FROM a JOIN o USING (b) GROUP BY ALL) SELECT 'n' || p AS pred_sample, sample_id, 'barcodes' AS how FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, sample_id) AS rn FROM n) WHERE rn = 1""")
def q37_overlap_resolution(s, d):
    items, owners = v.table(s, d, "lineitem"), v.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    asked = items.join(owners, "l_suppkey").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("sample_id"), F.col("l_partkey").alias("barcode"))
    return writeback.resolve_samples(asked, items.select(F.concat("l_returnflag", "l_linestatus").alias("sample_id"), F.col("l_partkey").alias("barcode")))


@query(f"{_MATCHED} SELECT d.source AS sample_id, count(*) AS spots, coalesce(any_value(m.n), 0)::BIGINT AS matched, CAST(any_value(m.tier) AS INTEGER) AS tier, CASE WHEN any_value(m.n) IS NULL THEN 0 ELSE 1 END::BIGINT AS genes, coalesce(any_value(m.n), 0)::BIGINT AS with_prediction, round(coalesce(any_value(m.n), 0)::DOUBLE / count(*), 6) AS fraction FROM documents d LEFT JOIN (SELECT source, count(DISTINCT obs) AS n, min(tier) AS tier FROM w GROUP BY ALL) m ON d.source = m.source GROUP BY d.source")
def q38_coverage(s, d):
    preds, spots = _label_predictions(s, d)
    return rounded(writeback.coverage(writeback.write_back(preds, spots), spots), "fraction")


@query("SELECT sample_id, gene, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN corr(pred, target) END, 6) AS pearson FROM pairs WHERE target <> 13 GROUP BY ALL", "pairs")
def q39_pair_corr(s, d):
    p = v.pairs(s, d).withColumn("target", F.when(F.col("target") == 13, F.lit(float("nan"))).otherwise(F.col("target")))
    return rounded(metrics.pair_correlation(p), "pearson")


@query(", w AS (SELECT a.sample_id, a.array_row, a.array_col, count(*) AS n FROM obs a JOIN obs b ON a.sample_id = b.sample_id AND abs(a.array_row - b.array_row) <= 1 AND abs(a.array_col - b.array_col) <= 1 GROUP BY ALL) SELECT o.sample_id, o.array_row, o.array_col, e.gene, round(sum(e.value)::DOUBLE / any_value(w.n), 6) AS value FROM obs o JOIN spots e ON o.sample_id = e.sample_id AND abs(o.array_row - e.array_row) <= 1 AND abs(o.array_col - e.array_col) <= 1 JOIN w ON w.sample_id = o.sample_id AND w.array_row = o.array_row AND w.array_col = o.array_col GROUP BY ALL", "points spots obs")
def q40_smooth_3x3(s, d):
    return rounded(spatial.smooth_neighbours(v.spots(s, d), v.obs(s, d)), "value")


def _patches(s, d):
    return v.obs(s, d).withColumn("seq", F.col("array_row") * 1000 + F.col("array_col"))


@query(", s AS (SELECT sample_id, gene AS seed, avg(x) AS seed_x, avg(y) AS seed_y FROM points GROUP BY ALL) SELECT sample_id, seed, CAST(array_row * 1000 + array_col AS INTEGER) AS seq, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, seed ORDER BY round((x - seed_x) * (x - seed_x) + (y - seed_y) * (y - seed_y), 3), array_row * 1000 + array_col) AS rank FROM obs JOIN s USING (sample_id)) WHERE rank <= 5", "points spots obs")
def q41_knn_patches(s, d):
    seeds = v.points(s, d).groupBy("sample_id", F.col("gene").alias("seed")).agg(F.avg("x").alias("seed_x"), F.avg("y").alias("seed_y"))
    return knn(_patches(s, d), seeds, 5).select("sample_id", "seed", "seq", "rank")


@query(", r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY x) - 1 AS INTEGER) AS x_rank, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY y) - 1 AS INTEGER) AS y_rank FROM obs) SELECT sample_id, x, y, x_rank, y_rank FROM r WHERE x_rank BETWEEN 2 AND 5 AND y_rank BETWEEN 1 AND 4", "points spots obs")
def q42_grid_block(s, d):
    return spatial.grid_block(_patches(s, d), 2, 1, 4).select("sample_id", "x", "y", "x_rank", "y_rank")


@query(", g AS (SELECT DISTINCT gene FROM spots) SELECT sample_id, array_row, array_col, gene, coalesce(value, 0)::BIGINT AS value FROM obs CROSS JOIN g LEFT JOIN spots USING (sample_id, array_row, array_col, gene)", "points spots obs")
def q43_densify(s, d):
    e = v.spots(s, d)
    return spatial.densify(e, v.obs(s, d), e).drop("obs_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, s_acctbal AS balance FROM supplier UNION ALL SELECT CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'new_' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END, c_acctbal FROM customer")
def q44_collision_merge(s, d):
    a = v.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("s_acctbal").alias("balance"))
    b = v.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_acctbal").alias("balance"))
    return catalog.collision_merge(a, b, "new_")


@query("WITH q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL) SELECT l_linestatus, count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low, max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high FROM lineitem JOIN q USING (l_linestatus) GROUP BY ALL")
def q45_box_stats(s, d):
    return rounded(metrics.box_stats(v.table(s, d, "lineitem"), "l_extendedprice", ("l_linestatus",)), "q1", "median", "q3")


@query("WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6) AS INTEGER) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL")
def q46_histogram(s, d):
    return metrics.histogram(v.table(s, d, "lineitem"), "l_quantity", 7, ("l_returnflag",)).select("l_returnflag", "bin", "n")


@query("""WITH m AS (SELECT id, min(pos) AS pos, arg_max(patient, pos) AS patient FROM (SELECT 'x' || c_mktsegment || '_' || (c_custkey % 400) AS id, c_custkey AS pos, c_nationkey::VARCHAR AS patient FROM customer) GROUP BY id),
    k AS (SELECT (s_suppkey * 3)::VARCHAR AS sample_id FROM supplier UNION SELECT 'x' || c_mktsegment || '_' || (c_custkey % 500) FROM customer UNION SELECT 'x' || c_mktsegment || '_none' FROM customer),
    e AS (SELECT sample_id, id, patient, 'exact' AS how FROM k JOIN m ON sample_id = id), f AS (SELECT sample_id, id, patient, 'suffix' AS how FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rn FROM k JOIN m ON ends_with(id, sample_id) WHERE sample_id NOT IN (SELECT sample_id FROM e)) WHERE rn = 1)
    FROM e UNION ALL FROM f UNION ALL SELECT sample_id, NULL, split_part(sample_id, '_', 1), 'own' FROM k WHERE sample_id NOT IN (SELECT sample_id FROM e UNION SELECT sample_id FROM f)""")
def q47_suffix_match(s, d):
    k = v.table(s, d, "customer")
    named = lambda n: F.concat(F.lit("x"), "c_mktsegment", F.lit("_"), (F.col("c_custkey") % n).cast("string"))
    meta = k.select(named(400).alias("id"), F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("string").alias("patient"))
    ids = v.table(s, d, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("sample_id")).union(k.select(named(500))).union(k.select(F.concat(F.lit("x"), "c_mktsegment", F.lit("_none"))))
    return catalog.suffix_match(ids, meta)


@query("SELECT dataset, best.encoder AS best_model, round(best.m, 6) AS highest_pearson_mean, round(best.s, 6) AS highest_pearson_std, encoders FROM (SELECT dataset, arg_max({'encoder': encoder, 'm': pearson_mean, 's': pearson_std}, pearson_mean) AS best, array_to_string(list(encoder ORDER BY encoder), ', ') AS encoders FROM merged GROUP BY dataset)", "runs merged")
def q48_run_summary(s, d):
    return rounded(report.run_summary(v.merged_runs(s, d), by=("dataset",)), "highest_pearson_mean", "highest_pearson_std")


@query("SELECT dataset, encoder, fold, round(avg(corr), 6) AS mean, count(corr) AS n, grouping(dataset, encoder, fold)::BIGINT AS grouping FROM runs GROUP BY GROUPING SETS ((fold), (dataset, fold), (encoder), (dataset, encoder))", "runs")
def q49_split_means(s, d):
    return rounded(report.mean_by(v.runs(s, d), [["dataset", "encoder", "fold"], ["fold"], ["dataset", "fold"], ["encoder"], ["dataset", "encoder"]]).where("grouping <> 0"), "mean")


@query(", a AS (SELECT dataset AS gene, pearson_mean AS v FROM merged WHERE encoder = 'BUILDING'), b AS (SELECT dataset AS gene, pearson_mean AS v FROM merged WHERE encoder = 'MACHINERY') SELECT gene, 'a' AS run, round(a.v, 6) AS value FROM a JOIN b USING (gene) UNION ALL SELECT gene, 'b', round(b.v, 6) FROM a JOIN b USING (gene)", "runs merged")
def q50_run_compare(s, d):
    side = lambda e: v.merged_runs(s, d).where(F.col("encoder") == e).select(F.col("dataset").alias("gene"), F.col("pearson_mean").alias("mean"))
    return rounded(report.melt_runs(report.compare_runs(side("BUILDING"), side("MACHINERY"))), "value")


@query("SELECT sample_id, count(*) AS num_patches FROM points GROUP BY ROLLUP (sample_id)", "points")
def q51_rollup_counts(s, d):
    return catalog.count_patches(v.points(s, d), total=True)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS even FROM events")
def q52_rule_json(s, d):
    parsed = v.table(s, d, "events").select("event_id", F.element_at(tables.parse_rules(F.concat(F.lit("["), F.translate("props", '"', "'"), F.lit("]"))), 1).alias("r"))
    size = F.try_element_at("r", F.lit("k"))
    return parsed.select("event_id", size.cast("double").alias("size"), (size.cast("int") % 2 == 0).alias("even"))


def _probe_inputs(s, d):
    e = v.table(s, d, "embeddings").select((F.col("vec_id") % 5).cast("string").alias("sample_id"), F.col("vec_id").alias("seq"), "embedding", F.array(F.col("label").cast("double"), F.element_at("embedding", 1).cast("double") * 2 - F.element_at("embedding", 2).cast("double")).alias("targets"))
    return e, e.select("sample_id").distinct().withColumn("patient", F.col("sample_id"))


@query()
def q53_ridge_probe(s, d):
    """Labels and ids as targets of vectors, in folds by the id."""
    e, folds = _probe_inputs(s, d)
    return rounded(models.probe(e, splits.group_kfold(folds, 3, ("patient",)), ["label", "line"], latent_dim=32), "mse", "r2", "pearson")


@query()
def q53_forest_probe(s, d):
    """The same targets by forests of all targets at once, a job a level."""
    e, folds = _probe_inputs(s, d)
    return rounded(models.probe(e, splits.group_kfold(folds, 3, ("patient",)), ["label", "line"], "rf", latent_dim=32, trees=20, at_once=20, depth=5), "mse", "r2", "pearson")


@query()
def q53_boosted_split(s, d):
    """Boosted trees on a single split: ids that leave 0 by 5 are the test rows."""
    e, _ = _probe_inputs(s, d)
    test = F.col("sample_id") == "0"
    return rounded(metrics.gene_metrics(models.probe_split(e.where(~test), e.where(test), ["label", "line"], "gbt", dimreduce=None, trees=10, rate=0.3)), "mse", "r2", "pearson")


@query("SELECT gene, round(value, 6) AS value, CAST(group_rank AS INTEGER) AS group_rank, CAST(member_rank AS INTEGER) AS member_rank FROM (SELECT sample_id || gene AS gene, m AS value, dense_rank() OVER (ORDER BY gm DESC, sample_id) AS group_rank, row_number() OVER (PARTITION BY sample_id ORDER BY m DESC, gene) AS member_rank FROM (SELECT sample_id, gene, avg(pred) AS m FROM pairs GROUP BY ALL) JOIN (SELECT sample_id, avg(pred) AS gm FROM pairs GROUP BY ALL) USING (sample_id))", "pairs")
def q54_ordered_groups(s, d):
    out = report.ordered_groups(v.pairs(s, d), "sample_id", "gene", "pred")
    return rounded(out.select(F.concat("sample_id", "gene").alias("gene"), F.col("member_mean").alias("value"), "group_rank", "member_rank"), "value")


@query("SELECT sample_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(1 - count(value)::DOUBLE / count(*), 6) AS nan_share FROM (SELECT sample_id, CASE WHEN target > 45 THEN NULL ELSE target END AS value FROM pairs) GROUP BY ALL", "pairs")
def q55_layer_stats(s, d):
    p = v.pairs(s, d).withColumn("target", F.when(F.col("target") > 45, F.lit(float("nan"))).otherwise(F.col("target")))
    return rounded(metrics.layer_stats(p, "target", ("sample_id",)), "mean", "std", "nan_share")


@query("SELECT sample_id, seq, obs_id FROM (SELECT source AS sample_id, doc_id AS seq, 'd' || doc_id AS obs_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def q56_cap_per_sample(s, d):
    return catalog.cap_per_sample(_label_predictions(s, d)[1], 3).select("sample_id", "seq", "obs_id")


@query("SELECT DISTINCT trim(w) AS gene FROM (SELECT unnest(string_split_regex(p_name || ';' || p_brand || ',' || p_name, '[,;]')) AS w FROM part) WHERE trim(w) <> ''")
def q57_split_cells(s, d):
    return genes.split_cells(v.table(s, d, "part").select(F.concat("p_name", F.lit(";"), "p_brand", F.lit(","), "p_name").alias("cell")), "cell")


@query("SELECT sample_id, gene, count(*) AS n, round(avg(l), 6) AS mean FROM (SELECT sample_id, gene, ln(1 + 10000 * value / sum(value) OVER (PARTITION BY sample_id, array_row, array_col)) AS l FROM spots) GROUP BY ALL", "points spots")
def q58_log1p_library(s, d):
    out = spatial.log1p_normalise(v.spots(s, d), library_size=True)
    return rounded(out.groupBy("sample_id", "gene").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("SELECT s_suppkey AS sample_id, kind FROM supplier, (VALUES ('matrix'), ('patch'), ('vis')) AS t(kind) WHERE NOT ((kind = 'matrix' AND s_suppkey % 2 = 0) OR (kind = 'patch' AND s_suppkey % 3 = 0))")
def q59_asset_manifest(s, d):
    sup = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    found = reduce(lambda a, b: a.union(b), [sup.where(f"sample_id % {k} = 0").withColumn("kind", F.lit(name)) for k, name in ((2, "matrix"), (3, "patch"))])
    return tables.asset_manifest(sup, ["matrix", "patch", "vis"], found)


@query("SELECT sample_id, l_orderkey, l_linenumber, gene FROM points WHERE NOT (gene LIKE '%1%' OR gene LIKE '%Brand#2%')", "points")
def q60_drop_controls(s, d):
    return genes.drop_control_features(v.points(s, d), ("1", "Brand#2")).select("sample_id", "l_orderkey", "l_linenumber", "gene")


@query(", l AS (SELECT gene, row_number() OVER (ORDER BY gene DESC) - 1 AS pos FROM (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size = 7)) SELECT sample_id, gene, pos::BIGINT AS pos, sum(value)::BIGINT AS total FROM spots JOIN l USING (gene) GROUP BY ALL", "points spots")
def q61_restrict_genes(s, d):
    listed = v.table(s, d, "part").where("p_size = 7").select(F.col("p_brand").alias("gene")).distinct()
    listed = listed.withColumn("pos", (F.row_number().over(W.orderBy(F.desc("gene"))) - 1).cast("long"))  # a gene list
    return genes.restrict_genes(v.spots(s, d), listed).groupBy("sample_id", "gene", "pos").agg(F.sum("value").alias("total"))


@query("SELECT sample_id, gene AS feature_name, x AS x_location, y AS y_location FROM spots JOIN obs USING (sample_id, array_row, array_col)", "points spots obs")
def q62_matrix_to_points(s, d):
    return spatial.matrix_to_points(v.spots(s, d), v.obs(s, d))


@query("SELECT l_returnflag AS sample_id, count(*) AS n_cells, round(avg(l_quantity), 6) AS mean_transcripts, round(sum(l_extendedprice), 2) AS total_area FROM lineitem GROUP BY ALL")
def q63_refresh_meta(s, d):
    cells = v.table(s, d, "lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_quantity").alias("transcript_counts"), F.col("l_extendedprice").alias("cell_area"))
    return rounded(catalog.refresh_meta(cells), "mean_transcripts").withColumn("total_area", F.round("total_area", 2))


@query(
    """WITH n AS (SELECT o_custkey % 50 AS split, o_custkey AS pos, count(*) AS c FROM orders GROUP BY ALL), k AS (SELECT split, pos, CASE WHEN pos % 3 = 0 THEN NULL ELSE c END AS n, sum(c) OVER (PARTITION BY split) AS rows FROM n),
    e AS (SELECT *, rows - coalesce(sum(n) OVER w, 0) AS rest, count(*) FILTER (WHERE n IS NULL) OVER w AS unknown, row_number() OVER (PARTITION BY split, n IS NULL ORDER BY pos) - 1 AS place FROM k WINDOW w AS (PARTITION BY split)),
    z AS (SELECT *, CASE WHEN n IS NOT NULL THEN n ELSE rest // unknown + CASE WHEN place < rest % unknown THEN 1 ELSE 0 END END AS size FROM e),
    f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY split ORDER BY n IS NULL, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z)
    SELECT split, pos, pos AS sample_id, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM f"""
)
def q64_allocate_slices(s, d):
    counts = v.table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("split"), F.col("o_custkey").alias("pos")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("rows"))
    known = counts.withColumn("n", F.when(F.col("pos") % 3 != 0, F.col("n"))).withColumn("sample_id", F.col("pos"))
    return writeback.allocate(known, totals)


@query("SELECT patient, array_to_string(list(sample_id ORDER BY sample_id), ',') AS members, count(*) AS n FROM meta GROUP BY ALL", "meta")
def q65_group_members(s, d):
    return splits.group_members(v.meta(s, d), "patient").withColumn("members", F.array_join("members", ","))


@query(
    """, q AS (SELECT sample_id, quantile_cont(pred, 0.25) AS q1, quantile_cont(pred, 0.5) AS median, quantile_cont(pred, 0.75) AS q3, avg(pred) AS m FROM pairs GROUP BY ALL)
    SELECT sample_id, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, substr(sample_id, 1, 1) AS flag, CAST(row_number() OVER (PARTITION BY substr(sample_id, 1, 1) ORDER BY m DESC, sample_id) AS INTEGER) AS member_rank FROM q""",
    "pairs",
)
def q66_sample_boxes(s, d):
    p = v.pairs(s, d).withColumn("flag", F.substring("sample_id", 1, 1))
    return rounded(report.sample_boxes(p, "flag", "pred").select("sample_id", "q1", "median", "q3", "flag", "member_rank"), "q1", "median", "q3")


@query("SELECT vec_id AS seq, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def q67_embed(s, d):
    """A toy model over the vectors as images: their norms."""
    import numpy as np

    rows = v.table(s, d, "embeddings").select(F.lit("s").alias("sample_id"), F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("barcode"), F.col("embedding").alias("img"))
    out = models.embed(rows, lambda: lambda m: np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True)))
    return out.select("seq", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("norm"))


@query("SELECT gene, CAST(dense_rank() OVER (ORDER BY gene) - 1 AS INTEGER) AS color_index, count(*) AS n FROM points GROUP BY gene", "points")
def q68_overlay_points(s, d):
    return report.overlay_points(v.points(s, d), "gene").groupBy("gene", "color_index").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def q69_value_counts(s, d):
    return catalog.value_counts(v.table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


_SUMMARY = "SELECT '{0}' AS \"column\", count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM lineitem"


@query(" UNION ALL ".join(_SUMMARY.format(k) for k in ("l_quantity", "l_extendedprice", "l_tax")))
def q70_numeric_summary(s, d):
    return rounded(catalog.numeric_summary(v.table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax"), "mean", "std")


@query("SELECT sample_id, x, y FROM obs WHERE array_row * 1000 + array_col < 3000", "points spots obs")
def q71_first_patches(s, d):
    return catalog.first_patches(_patches(s, d), 3000).select("sample_id", "x", "y")


_READ = "t AS (SELECT sample_id, min(y) AS top FROM obs GROUP BY ALL), g AS (SELECT sample_id, y - lag(y) OVER (PARTITION BY sample_id ORDER BY y) AS step FROM (SELECT DISTINCT sample_id, y FROM obs)), h AS (SELECT sample_id, coalesce(greatest(1, floor(median(step))), 1) AS height FROM g GROUP BY ALL)"


@query(f", {_READ} SELECT sample_id, x, y, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY floor((y - top) / height), x, array_row * 1000 + array_col) AS INTEGER) AS position FROM obs JOIN t USING (sample_id) JOIN h USING (sample_id)", "points spots obs")
def q72_reading_order(s, d):
    return spatial.reading_order(_patches(s, d)).select("sample_id", "x", "y", "position")


@query(
    """, b AS (SELECT sample_id, gene, avg(x) AS mx, avg(y) AS my FROM points GROUP BY ALL), z AS (SELECT sample_id, gene, mx, my, 40.0 AS r FROM b UNION ALL SELECT sample_id, 'whole', 45000.0, 50000.0, 43000.0 FROM (SELECT DISTINCT sample_id FROM b)),
    t AS (SELECT sample_id, gene AS polygon_id, mx - r AS x0, mx + r AS x1, my - 20 * r AS y0, my + r AS y1 FROM z)
    SELECT polygon_id, p.sample_id, count(*) AS n FROM points p JOIN t ON p.sample_id = t.sample_id AND x > x0 AND x < x1 AND y > y0 AND y < y1 AND (y - y0) / (y1 - y0) > abs(x - (x0 + x1) / 2) / ((x1 - x0) / 2) GROUP BY ALL""",
    "points",
)
def q74_polygons_of_all_sizes(s, d):
    """Triangles: a narrow one at each gene's mean place, and one that covers most of each slide."""
    p = v.points(s, d)
    tiny = p.groupBy("sample_id", F.col("gene").alias("polygon_id")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).withColumn("r", F.lit(40.0))
    large = v.samples(s, d).select("sample_id", F.lit("whole").alias("polygon_id"), F.lit(45000.0).alias("mx"), F.lit(50000.0).alias("my"), F.lit(43000.0).alias("r"))
    corner = lambda i, j: F.struct((F.col("mx") + F.col("r") * i).alias("x"), (F.col("my") + F.col("r") * j).alias("y"))
    polygons = tiny.unionByName(large).select("sample_id", "polygon_id", F.array(corner(-1, 1), corner(1, 1), corner(0, -20)).alias("ring"))
    return points_in_polygons(p, polygons).groupBy("sample_id", "polygon_id").agg(F.count("*").alias("n"))


@query(
    """, k AS (SELECT r_name AS dataset, r_regionkey::INTEGER AS k FROM region), g AS (SELECT p_size % 5 AS k, count(DISTINCT p_brand) AS n FROM part GROUP BY ALL),
    b AS (SELECT dataset, arg_max({'e': encoder, 'm': pearson_mean, 's': pearson_std}, pearson_mean) AS best, array_to_string(list(encoder ORDER BY encoder), ', ') AS encoders FROM merged GROUP BY dataset)
    SELECT 'run_' || dataset AS run, 'brands.json' AS gene_list, CASE WHEN k.k % 2 = 0 THEN g.n END AS num_genes, k.k / 2.0::DOUBLE AS alpha, 64 * (k.k + 1) AS batch_size, CASE WHEN k.k > 1 THEN 'PCA' END AS dimreduce, encoders,
    k.k % 2 = 0 AS normalize, k.k = 3 AS library_size_normalize, 256 AS latent_dim, 'ridge' AS method, dataset, best.e AS best_model, round(best.m, 6) AS highest_pearson_mean, round(best.s, 6) AS highest_pearson_std,
    round(CASE dataset WHEN 'AFRICA' THEN 14 * (SELECT avg(s_acctbal) FROM supplier) END, 6) AS num_training_patches_mean FROM b JOIN k USING (dataset) LEFT JOIN g ON g.k = k.k""",
    "runs merged",
)
def q73_run_documents(s, d):
    """Writes the runs' documents to the shared folder, in forms that differ from run to run, and summarises what is read back."""
    root, found = shared_name(s), v.merged_runs(s, d).withColumn("run", F.concat(F.lit("run_"), "dataset"))
    k = F.col("r_regionkey").cast("int")
    listed = F.when(k > 1, F.to_json(F.array("r_name"))).otherwise(F.concat(F.lit('"'), "r_name", F.lit('"')))  # a list, or one name
    text = F.concat(F.lit('{"gene_list": "brands.json", "datasets": '), listed, F.lit(', "alpha": '), (k / 2).cast("string"), F.lit(', "batch_size": "'), (64 * (k + 1)).cast("string"), F.lit('", "latent_dim": 256, "method": "ridge", "normalize": '), (k % 2 == 0).cast("string"), F.when(k == 3, ', "library_size_normalize": true').otherwise(""), F.when(k > 1, ', "dimreduce": "PCA"}').otherwise("}"))
    settings = v.table(s, d, "region").select(F.concat(F.lit("runs/run_"), "r_name", F.lit("/config.json")).alias("path"), text.alias("text"))
    brands = v.table(s, d, "part").groupBy((F.col("p_size") % 5).alias("r_regionkey")).agg(F.array_sort(F.collect_set("p_brand")).alias("genes")).where("r_regionkey % 2 = 0").join(v.table(s, d, "region"), "r_regionkey")
    lists = brands.select(F.concat(F.lit("data/"), "r_name", F.lit("/brands.json")).alias("path"), F.when(F.col("r_regionkey") == 2, F.to_json("genes")).otherwise(F.to_json(F.struct("genes"))).alias("text"))
    results = run_documents.dataset_documents(found).unionByName(run_documents.encoder_documents(found)).withColumn("path", F.concat(F.lit("runs/"), "path"))
    run_documents.write_documents(settings.unionByName(lists).unionByName(results), root)
    rules_of = s.createDataFrame([("AFRICA", "supplier", 14.0, 0)], "dataset string, source string, factor double, part int")
    means = v.table(s, d, "supplier").agg(F.lit("supplier").alias("source"), F.avg("s_acctbal").alias("mean"))
    return rounded(run_documents.summarise_runs(s, f"{root}/runs", f"{root}/data", rules_of, means), "highest_pearson_mean", "highest_pearson_std", "num_training_patches_mean")
