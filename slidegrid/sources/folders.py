"""Sample folders of experiment runs as a Spark data source, `sample_folders`.

A root holds slide folders, or samples directly. Children named like slides are its slides; without any, a root that holds
samples is a slide itself, and else all its children are. A slide holds one folder for each region, which is a sample if
the matrix file is in it. A partition is a slide, so listing is spread over the executors.

Filters on run, slide, roi, sample_id and root (=, in, is not null) are pushed down: those on root, run and slide leave out
partitions, the others leave out folders before their files are listed.

Cases: a root that isn't there has no rows; a sample without patches, picture or tables has nulls and an empty list; names
are compared as they are, and of several files the one named after the region counts, else the first by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.window import Window as W

from .shared import full_uri
from .shipping import ship

SCHEMA = "sample_id string, run int, slide string, roi string, root string, folder string, matrix_path string, patch_path string, vis_path string, tables array<string>"
_OF_SLIDE = ("root", "run", "slide")
_KINDS = {"matrix": "matrix_path", "patch": "patch_path", "vis": "vis_path"}


def tag_of(name: str, length: int, default: str = "R") -> str:
    return re.sub("[^A-Za-z0-9]", "", name).upper()[:length] or default


def slide_of(name: str) -> str | None:
    found = re.search(r"slide[_-]?(\d+)", name, re.IGNORECASE) or re.search(r"\bS(\d+)\b", name, re.IGNORECASE)
    return found and found[1]


def run_of(path: str, pattern: str) -> int | None:
    """The run's number in the nearest folder that names one, the slide's own included."""
    return next((int(found[1]) for part in reversed(path.split("/")) if (found := re.search(pattern, part))), None)


@dataclass
class Slide(InputPartition):
    root: str
    path: str
    run: int | None
    slide: str


class SampleFolders(DataSource):
    """Options: roots (a JSON list of URIs), matrix, run_pattern (one group), run_prefix (with {} for the number)."""

    @classmethod
    def name(cls) -> str:
        return "sample_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.matrix = options.get("matrix", "aligned_adata.h5ad")
        self.run_pattern, self.run_prefix = options.get("run_pattern", r"[Rr](\d+)"), options.get("run_prefix", "R{}")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            names = getattr(f, "attribute", ())
            if len(names) != 1 or names[0] not in ("sample_id", "roi", *_OF_SLIDE) or not isinstance(f, EqualTo | In | IsNotNull):
                yield f
            elif not isinstance(f, IsNotNull):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[names[0]] = self.wanted.get(names[0], values) & values
            elif names[0] == "run":  # the only one of them that can be null
                self.wanted.setdefault("run", _Any())

    def _fits(self, **values: object) -> bool:
        return all(values[k] is not None and values[k] in self.wanted[k] for k in values if k in self.wanted)

    def partitions(self) -> list[Slide]:
        slides = {}
        for root in sorted(self.roots):
            if not self._fits(root=root):
                continue
            children = [p for p, folder in _entries(root) if folder]
            own = [p for p in children if slide_of(_name(p)) or _name(p).lower().startswith("slide")]
            if not own:
                own = [root] if any(self._matrix_of(p) for p in children) else children
            for path in own:
                slide = Slide(root, path, run_of(path, self.run_pattern), slide_of(_name(path)) or tag_of(_name(path), 3))
                if self._fits(run=slide.run, slide=slide.slide):
                    slides.setdefault(path, slide)
        return list(slides.values())

    def read(self, partition: Slide | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        run = self.run_prefix.format(partition.run) if partition.run is not None else tag_of(_name(partition.path), 6)
        for folder, is_folder in _entries(partition.path):
            roi = _name(folder)
            sample_id = f"{run}S{partition.slide}{roi}"
            if not is_folder or not self._fits(roi=roi, sample_id=sample_id):
                continue
            files = [p for p, _ in _entries(folder)]
            if matrix := next((p for p in files if _name(p) == self.matrix), None):
                patch = _chosen(f"{folder}/patches", ".h5", f"{roi}.h5")
                vis = _chosen(f"{folder}/patches_vis", ".png", f"{roi}_patch_vis.png")
                tables = [_name(p).removesuffix(".parquet") for p in files if p.endswith(".parquet")]
                yield sample_id, partition.run, partition.slide, roi, partition.root, folder, matrix, patch, vis, tables

    def _matrix_of(self, folder: str) -> bool:
        return any(_name(p) == self.matrix for p, _ in _entries(folder))


class _Any(set):
    """Holds every value; what it is met with remains."""

    def __contains__(self, value: object) -> bool:
        return True

    def __and__(self, other: set) -> set:
        return other


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _entries(folder: str) -> list[tuple[str, bool]]:
    """(URI, whether it is a folder) of what lies in a folder, by name; empty if it isn't there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(quote(folder, safe="/:@"))
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{folder.rstrip('/')}/{x.base_name}", x.type == fs.FileType.Directory) for x in found)


def _chosen(folder: str, ending: str, exact: str) -> str | None:
    files = [p for p, _ in _entries(folder) if p.endswith(ending)]
    return next((p for p in files if _name(p) == exact), files[0] if files else None)


def sample_folders(spark: SparkSession, roots: list[str], **options: str) -> DataFrame:
    """A row for each sample below the roots; filters on it are pushed down to the listing."""
    ship(spark)
    spark.dataSource.register(SampleFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    named = json.dumps([full_uri(spark, r).rstrip("/") for r in roots])
    return spark.read.format("sample_folders").options(roots=named, **options).load()


def unique_samples(folders: DataFrame) -> DataFrame:
    """The rows, where no two have the same sample_id; else an error that names it. Put filters before it, so that they are pushed down."""
    counted = folders.withColumn("_n", F.count("*").over(W.partitionBy("sample_id")))
    checked = F.when(F.col("_n") == 1, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate sample "), "sample_id")))
    return counted.withColumn("sample_id", checked).drop("_n")


def assets_of(folders: DataFrame) -> DataFrame:
    """sample_id, kind (matrix, patch, vis), path of the files that are there: what asset_manifest compares with the expected."""
    return folders.unpivot(["sample_id"], [F.col(c).alias(k) for k, c in _KINDS.items()], "kind", "path").where("path is not null")


def read_experiments(spark: SparkSession, folders: DataFrame, table: str, schema: str | None = None) -> DataFrame:
    """The rows of one Parquet table of every sample that has it, with sample_id, in one scan.

    The list of folders comes to the driver, as any list of paths to read does; without a sample that has the table, a schema is needed.
    """
    held = folders.where(F.array_contains("tables", table)).select("sample_id", F.concat("folder", F.lit(f"/{table}.parquet")).alias("_at"))
    pairs = [tuple(r) for r in held.collect()]
    if not pairs:
        if schema is None:
            raise ValueError(f"no sample has {table}.parquet")
        return spark.createDataFrame([], f"sample_id string, {schema}")
    reader = spark.read.schema(schema) if schema else spark.read
    # without recursiveFileLookup, a table that is a folder of part files or a single file is read alike
    rows = reader.parquet(*[at for _, at in pairs])
    plain = lambda uri: F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+(?=[^/])", "$1:/")
    at = F.regexp_extract(plain(F.col("_metadata.file_path")), rf"^(.*/{re.escape(table)}\.parquet)(/[^/]*)?$", 1)
    named = spark.createDataFrame(pairs, "sample_id string, _uri string").select("sample_id", F.regexp_replace("_uri", "^([a-z]+):/+(?=[^/])", "$1:/").alias("_at"))
    return rows.withColumn("_at", at).join(named, "_at").drop("_at")
