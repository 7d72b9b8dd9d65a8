"""Table access: parquet by name, vendor CSV, and tolerant column resolution."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value besides NULL and the empty text (fixed values).
MISSING_TOKENS = ["nan", "None", "NaT"]


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_vendor_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";") -> DataFrame:
    """Delimited vendor export; rows that don't fit the schema are dropped, header names trimmed."""
    df = spark.read.schema(schema).csv(
        path, header=True, sep=sep, mode="DROPMALFORMED", quote='"', escape="\\", encoding="utf-8"
    )
    return df.toDF(*[c.strip() for c in df.columns])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed JSON array or JSON-lines file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_hardened_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A stage's CSV with quoted texts over several lines; rows that don't fit the schema are dropped, header names trimmed."""
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, mode="DROPMALFORMED", quote='"', escape="\\", encoding="utf-8", multiLine=True)
    return df.toDF(*[c.strip() for c in df.columns])


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, least: int = 1000) -> DataFrame:
    """A downloaded JSON dataset, accepted only if it holds more than some rows; raises otherwise."""
    df = read_json_records(spark, path, schema)
    n = df.limit(least + 1).count()
    if n <= least:
        raise ValueError(f"{path} holds {n} rows, {least} or fewer")
    return df


def columns_of(spark: SparkSession, directory: str) -> dict[str, list[str]]:
    """The tables of a folder and their columns."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName()[:-8] for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))
    return {n: load(spark, directory, n).columns for n in names}


def in_list(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in a table of wanted ones, as a semi-join whatever its size."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A job's setting: the session's configuration, else the environment, else the default; nobody is asked."""
    return spark.conf.get(f"tidemark.{name.lower()}", None) or os.environ.get(name.upper()) or default


def norm_null(c: Column | str) -> Column:
    """NULL for every way a text can be missing, else the text unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c).isin("", *MISSING_TOKENS), F.lit(None)).otherwise(c)


def resolve(df: DataFrame, spec: Mapping[str, tuple[Sequence[str], T.DataType]]) -> DataFrame:
    """Project df to spec's names: per name the first candidate that exists (case-insensitively),
    cast tolerantly, or a typed NULL."""
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, (candidates, kind) in spec.items():
        hit = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        src = F.lit(None) if hit is None else F.col(f"`{hit}`")
        out.append((src.try_cast(kind) if hit is not None else src.cast(kind)).alias(name))
    return df.select(*out)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add absent columns as literals; fill NULLs of present ones."""
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    )
