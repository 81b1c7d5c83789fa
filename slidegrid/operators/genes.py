"""Gene filters, sets and quality metrics over sparse long expression tables (sample_id, obs_id, gene, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import CONTROL_KEYWORDS, is_control, ratio


def drop_features(df: DataFrame, pattern: str = "Codeword", column: str = "gene") -> DataFrame:
    return df.where(~F.col(column).rlike(pattern))


def drop_control_features(df: DataFrame, keywords=CONTROL_KEYWORDS, column: str = "gene") -> DataFrame:
    return df.where(~is_control(F.col(column), keywords))


def restrict_genes(df: DataFrame, gene_list: DataFrame) -> DataFrame:
    """Only listed genes, with their position in the list."""
    return df.join(gene_list.groupBy("gene").agg(F.min("pos").alias("pos")), "gene")


def min_cells(pct: float, n_obs: Column) -> Column:
    return F.ceil(F.lit(float(pct)) * n_obs)


#: Names that the filtered list leaves out; the common list leaves out all control keywords. Fixed values.
FILTERED_KEYWORDS = ("BLANK", "Control")


def gene_sets(expression: DataFrame, obs: DataFrame, min_cells_pct: float = 0.10, *, keywords=CONTROL_KEYWORDS, panel: DataFrame | None = None) -> DataFrame:
    """gene, in_union, in_common, in_filtered_common. One pass: counts by sample and gene, then by gene.

    panel: sample_id, gene of what each sample measured; without it, a gene is in a sample where it has rows.
    """
    sizes = obs.groupBy("sample_id").agg(F.count("*").alias("n_obs"))
    seen = expression.select("sample_id", "gene", F.when(F.col("value") > 0, 1).otherwise(0).alias("cell"))
    if panel is not None:
        listed = panel.select("sample_id", "gene").distinct()
        seen = seen.join(listed, ["sample_id", "gene"], "left_semi").unionByName(listed.withColumn("cell", F.lit(0)))
    cells = seen.groupBy("sample_id", "gene").agg(F.sum("cell").alias("cells"))
    judged = cells.join(sizes, "sample_id").withColumn("enough", F.col("cells") >= min_cells(min_cells_pct, F.col("n_obs")))
    per_gene = judged.groupBy("gene").agg(F.count("*").alias("n"), F.count_if("enough").alias("n_enough"))
    samples = obs.agg(F.countDistinct("sample_id").alias("samples"))
    common = (F.col("n") == F.col("samples")) & ~is_control(F.col("gene"), keywords)
    kept = (F.col("n_enough") == F.col("samples")) & ~is_control(F.col("gene"), FILTERED_KEYWORDS)
    return per_gene.crossJoin(F.broadcast(samples)).select("gene", F.lit(True).alias("in_union"), common.alias("in_common"), kept.alias("in_filtered_common"))  # one row


def top_k_genes(expression: DataFrame, obs: DataFrame, k: int | str = "auto", criteria: str = "var", min_cells_pct: float = 0.10, *, log1p: bool = True) -> DataFrame:
    """pos, gene, score: filtered common genes with the largest variance or mean over all spots, zeros included."""
    if criteria not in ("var", "mean"):
        raise ValueError(f"criteria is {criteria!r}; var and mean are known")
    genes = gene_sets(expression, obs, min_cells_pct).where("in_filtered_common").select("gene")
    n = obs.count()
    value = F.log1p(F.col("value").cast("double")) if log1p else F.col("value").cast("double")
    sums = expression.join(genes, "gene").groupBy("gene").agg(F.sum(value).alias("s"), F.sum(value * value).alias("ss"))
    mean = F.col("s") / max(1, n)
    score = mean if criteria == "mean" else (F.col("ss") - F.col("s") * mean) / max(1, n - 1)
    limit = 50 if k == "auto" else int(k)
    best = sums.select("gene", score.alias("score")).orderBy(F.desc("score"), "gene").limit(limit)
    return best.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), "gene")) - 1).select("pos", "gene", "score")


def qc_spots(expression: DataFrame, percent_top=(50, 100, 200, 500), *, by=("sample_id", "obs_id"), fallback: int | None = None) -> DataFrame:
    """n_genes, total and the percentage of the N largest counts. N over the number of genes are dropped; if none is left, min(fallback, genes) is used, or none at all."""
    n_vars = expression.agg(F.countDistinct("gene")).first()[0]
    tops = [n for n in percent_top if n <= n_vars] or ([min(fallback, n_vars)] if fallback and n_vars else [])
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "gene"))
    ranked = expression.where("value > 0").withColumn("rn", rank) if tops else expression.where("value > 0")
    shares = [(100 * ratio(F.sum(F.when(F.col("rn") <= n, F.col("value"))), F.sum("value"))).alias(f"pct_counts_in_top_{n}") for n in tops]
    return ranked.groupBy(*by).agg(F.count("*").alias("n_genes"), F.sum("value").alias("total_counts"), *shares)


def qc_genes(expression: DataFrame, n_obs: int) -> DataFrame:
    """n_cells, total, mean over all spots and dropout percentage."""
    found = expression.where("value > 0").groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total_counts"))
    return found.select("gene", "n_cells", "total_counts", (F.col("total_counts") / n_obs).alias("mean_counts"), (100 * (1 - F.col("n_cells") / n_obs)).alias("pct_dropout"))


def overlap_matrix(sets: DataFrame, name: str = "list_name") -> DataFrame:
    """a, b, n, genes for each pair of lists that share a gene, a list with itself included."""
    distinct = sets.select(F.col(name).alias("a"), "gene").distinct()
    other = distinct.withColumnRenamed("a", "b")
    return distinct.join(other, "gene").groupBy("a", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("gene")).alias("genes"))


def unpivot_sheet(sheet: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Ragged sheet columns -> gene, kind, label. kinds: column of genes -> column of labels, or '' for none."""
    out = None
    for genes, labels in kinds.items():
        part = sheet.select(F.trim(F.col(f"`{genes}`")).alias("gene"), F.lit(genes).alias("kind"), (F.col(f"`{labels}`") if labels else F.lit(None)).cast("string").alias("label")).where("gene is not null and gene <> ''").dropDuplicates(["gene"])
        out = part if out is None else out.unionByName(part)
    return out


def split_cells(df: DataFrame, column: str, out: str = "gene") -> DataFrame:
    """Comma or semicolon separated cells -> distinct trimmed values, in order."""
    return df.select(F.explode(F.split(column, "[,;]")).alias(out)).select(F.trim(out).alias(out)).where(F.col(out) != "").distinct().orderBy(out)
