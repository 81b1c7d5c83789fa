"""Column helpers: column lookup, null policy, ratios, and the reading of ids and names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL_KEYWORDS = ("NegControl", "Codeword", "Intergenic_Region", "Control", "BLANK")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if find_column(df, n) is None]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that the frame has, in whatever case."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def numeric_column(df: DataFrame) -> str:
    """The count column of a per-sample table: num_patches, else the only numeric one, else one named after patches or numbers."""
    if found := find_column(df, "num_patches"):
        return found
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")]
    named = numeric if len(numeric) == 1 else [c for c in numeric if re.search("patch|num", c, re.I)]
    if not named:
        raise ValueError(f"no count column among {df.columns}")
    return named[0]


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def finite(column: Column) -> Column:
    return F.coalesce(~F.isnan(column) & (F.abs(column) < float("inf")), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normalised_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r" +", "_", c.strip().lower()) for c in df.columns])


def contains_any(column: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words], F.lit(False))


def is_control(column: Column, keywords=CONTROL_KEYWORDS) -> Column:
    return contains_any(column, keywords)


def extracted(column: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it doesn't match."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def first_extracted(column: Column, *patterns: str) -> Column:
    return F.coalesce(*[extracted(column, p) for p in patterns])


def run_number(column: Column) -> Column:
    return extracted(F.split(column, "/")[0], r"[Rr](\d+)").cast("int")


def slide_number(column: Column) -> Column:
    return first_extracted(column, r"(?i)slide[_-]?(\d+)", r"\bS(\d+)\b").cast("int")


def patient_of(column: Column) -> Column:
    return F.split(column, "_")[0]


def derived_prefix(path: Column, fallback: str) -> Column:
    """`parentS<n>` from `parent/...slide<n>`, else what the fallback pattern finds in the path."""
    parent = F.element_at(F.split(path, "/"), -2)
    number = extracted(path, r"(?i)slide[_-]?(\d+)")
    return F.coalesce(F.concat(parent, F.lit("S"), number), extracted(path, fallback))


def ensure_prefix(column: Column, prefix: Column) -> Column:
    return F.when(F.startswith(column, prefix), column).otherwise(F.concat(prefix, column))


def sanitised_tag(column: Column, default: str = "R") -> Column:
    return F.coalesce(F.nullif(F.substring(F.upper(F.regexp_replace(column, "[^A-Za-z0-9]", "")), 1, 8), F.lit("")), F.lit(default))


def safe_name(column: Column) -> Column:
    return F.regexp_replace(column, "[^A-Za-z0-9_-]", "_")


def normalised_name(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"[-_.\s]", ""))


def clean_barcode(column: Column) -> Column:
    """Drop byte-literal and one-element-list wrappings and quotes."""
    out = F.regexp_replace(F.trim(column.cast("string")), r"^\[(.*)\]$", "$1")
    out = F.regexp_replace(F.trim(out), r"^b(['\"])(.*)\1$", "$2")
    return F.regexp_replace(out, r"^['\"]+|['\"]+$", "")


def derived_condition(column: Column) -> tuple[Column, Column]:
    """(disease, inflamed) from a sample code; null where the code does not tell."""
    disease = F.when(F.contains(column, F.lit("UC")), "ulcerative colitis").when(F.contains(column, F.lit("DC")), "diverticulitis")
    inflamed = F.when(column.ilike("%\\_NI%"), False).when(column.ilike("%\\_I%"), True)
    return disease, inflamed


def resolution_column(name: Column) -> Column:
    """num_patches_<25, 50 or 100>um by what the name holds."""
    size = F.when(F.contains(name, F.lit("25")), 25).when(F.contains(name, F.lit("50")), 50).otherwise(100)
    return F.concat(F.lit("num_patches_"), size.cast("string"), F.lit("um"))


def age_hours(then: Column, now: Column | None = None) -> Column:
    return (F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros(then)) / 3.6e9


def rename_existing(df: DataFrame, names: dict[str, str], **constants: object) -> DataFrame:
    """Rename the columns that exist and add constant ones."""
    return df.withColumnsRenamed(names).withColumns({k: F.lit(v) for k, v in constants.items()})


def require_non_null(df: DataFrame, *names: str) -> DataFrame:
    return require_columns(df, *names).dropna(subset=list(names))


def arrange(df: DataFrame, first: tuple[str, ...] = ("sample_id",), integers: tuple[str, ...] = (), strip: dict[str, str] | None = None) -> DataFrame:
    """Leading columns first, integer columns cast where they parse, and literal texts taken out of others."""
    changes = {c: F.col(c).try_cast("int") for c in integers} | {c: F.regexp_replace(c, re.escape(t), "") for c, t in (strip or {}).items()}
    out = df.withColumns(changes)
    return out.select(*first, *[c for c in out.columns if c not in first])
