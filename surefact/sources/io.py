"""Readers and writers: tables, CSV, JSON lines and documents, reports, keyed embedding cache, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as one row."""
    return spark.read.json(path, schema=schema, multiLine=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def cached(keys: DataFrame, cache: DataFrame, embed) -> DataFrame:  # type: ignore[no-untyped-def]
    """The cache with the keys that it lacks: embed(missing) gives (name, e) for rows (name)."""
    missing = keys.select("name").distinct().join(cache.select("name"), "name", "left_anti")
    return cache.unionByName(embed(missing))


def write_document(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_matrix(spark: SparkSession, rows, path: str) -> None:  # type: ignore[no-untyped-def]
    """A small matrix of numbers as (row, e) in Parquet."""
    spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "row long, e array<double>").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    """Its rows as a numpy array; what the driver reads is what write_matrix was given."""
    import numpy as np

    return np.array([r.e for r in spark.read.parquet(path).orderBy("row").collect()])


def cache_through(spark: SparkSession, path: str, names: DataFrame, embed) -> DataFrame:  # type: ignore[no-untyped-def]
    """The embeddings (name, e) of `names` by a cache at `path`: what it lacks is embedded and appended, once for each name."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    missing = names.select("name").distinct()
    if there:
        missing = missing.join(spark.read.parquet(path).select("name"), "name", "left_anti")
    embed(missing).select("name", "e").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(names.select("name").distinct(), "name", "left_semi")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one in local mode."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else ""
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; what is left out is counted in a last line."""
    rows = df.limit(limit + 1).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    out = [line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows[:limit])]
    if len(rows) > limit:
        out.append(f"{df.count() - limit} more rows")
    return "\n".join(out)
