"""Sinks: stage tables, splits, stacked generations, ledgers and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tidemark.operators.sequences import stack_upsert


def write_stage(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A stage's table, overwritten whole; by names partition columns such as the split."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert_generation(df: DataFrame, root: str, run: str, key: Sequence[str], order: Sequence[Column]) -> str:
    """Stack a run on the last generation (later rows win) as a new generation; the one before stays for going back.

    The pointer to the current generation is written last, so a run that fails leaves the old one in place.
    """
    spark = df.sparkSession
    pointer = f"{root}/_current"
    last = spark.read.text(pointer).first()[0] if _exists(df, pointer) else None
    out = f"{root}/generation={run}-{uuid.uuid4().hex[:8]}"  # never the folder that is being read, even where a run is repeated
    new = df if last is None else stack_upsert(spark.read.parquet(last), df, key, order)
    new.write.mode("errorifexists").parquet(out)
    spark.createDataFrame([(out,)], "value string").coalesce(1).write.mode("overwrite").text(pointer)
    return out


def archive(spark, paths: Sequence[str], into: str) -> list[str]:
    """Move the folders of a finished run into an archive; nothing is deleted. Paths that don't exist are passed over."""
    jvm, conf, moved = spark._jvm, spark._jsc.hadoopConfiguration(), []
    Path = jvm.org.apache.hadoop.fs.Path
    for p in paths:
        src, dst = Path(p), Path(into, Path(p).getName())
        fs = src.getFileSystem(conf)
        if fs.exists(src):
            fs.mkdirs(Path(into))
            if fs.rename(src, dst):
                moved.append(dst.toString())
    return moved


def append_checkpoint(df: DataFrame, path: str, marker: str) -> None:
    """Append the finished rows of a batch, those with a marker; operators.incremental.resume reads them back."""
    df.where(f"{marker} IS NOT NULL").write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table, such as an audit, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def as_json(df: DataFrame) -> str:
    """A small table as a JSON list of records."""
    return json.dumps([json.loads(x) for x in df.toJSON().collect()] if hasattr(df, "toJSON") else [], indent=2)


def report(metrics: dict[str, DataFrame], digits: int = 3) -> tuple[str, str]:
    """(JSON, Markdown) of small tables by name."""
    body = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in metrics.items()}
    return json.dumps(body, indent=2, default=str), "\n\n".join(f"## {k}\n\n{markdown_table(v, digits)}" for k, v in metrics.items())


def append_ledger(df: DataFrame, path: str, key: str) -> None:
    """Mark entities as done: only keys that the ledger lacks are appended."""
    rows = df.select(key).distinct()
    if _exists(df, path):
        rows = rows.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def manifest(target: str, features: Sequence[str], split: str | int | None = None) -> str:
    """JSON that names a dataset's target, features and split."""
    return json.dumps({"target": target, "features": list(features), "n_features": len(features), "split": split}, indent=2)


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A small metrics table in Markdown."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.collect()])
