"""Benchmark packages: samples, gene lists, splits and what is missing, in one composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import genes, splits
from ..sources import tables


@dataclass
class Package:
    sets: DataFrame  # gene, in_union, in_common, in_filtered_common
    top: DataFrame  # pos, gene, score
    splits: DataFrame  # split, part, sample_id, patches_path, expr_path
    missing: DataFrame  # sample_id, kind


def build_package(expression: DataFrame, obs: DataFrame, meta: DataFrame, found: DataFrame, *, k: int | str = "auto", criteria: str = "var", min_cells_pct: float = 0.10, folds: int | str = "loocv", group=("dataset_title", "patient"), kinds=("matrix", "patch"), folder: str = ".") -> Package:
    """Lazily; `write_package` runs it. found: sample_id, kind of the files that are there."""
    return Package(
        genes.gene_sets(expression, obs, min_cells_pct),
        genes.top_k_genes(expression, obs, k, criteria, min_cells_pct),
        splits.split_assets(splits.group_kfold(meta, folds, group), folder),
        tables.asset_manifest(meta, list(kinds), found),
    )


def write_package(package: Package, folder: str, *, allow_missing: bool = False) -> None:
    """Gene lists as JSON and splits as CSV; missing files raise unless allowed."""
    if not allow_missing and (lost := package.missing.limit(5).collect()):
        raise FileNotFoundError(f"missing: {[tuple(r) for r in lost]}")
    tables.write_gene_list(package.top, f"{folder}/genes_top")
    tables.write_gene_list(package.sets.where("in_common"), f"{folder}/genes_common")
    tables.write_gene_list(package.sets.where("in_filtered_common"), f"{folder}/genes_filtered")
    tables.write_splits(package.splits, f"{folder}/splits")
