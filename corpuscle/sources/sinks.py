"""Sinks: atomic files, JSON lines, sharded pages, logs and manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.aggregates import revision
from corpuscle.operators.windows import pages


#: Names the version that holds; the one thing that is replaced.
POINTER = "CURRENT"


def replace_atomically(spark: SparkSession, df: DataFrame, path: str, fmt: str = "json") -> None:
    """A new version is written whole beside the old one, then a small pointer file is renamed
    over the old pointer in one step. A reader (see current) gets the old or the new whole at any
    moment, and after a crash at any point; versions that no pointer names go with the next write."""
    jvm = spark._jvm
    hadoop, root = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    name = f"version-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).save(f"{path}/{name}")
    staged = hadoop.Path(f"{path}/.{name}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(name.encode()))
    out.hsync()
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(hadoop.Path(f"{path}/{POINTER}")), over)
    for old in fs.listStatus(root):
        if old.getPath().getName().startswith("version-") and old.getPath().getName() != name:
            fs.delete(old.getPath(), True)


def current(spark: SparkSession, path: str) -> str:
    """The path of the version that holds."""
    return f"{path}/{spark.sparkContext.wholeTextFiles(f'{path}/{POINTER}').first()[1]}"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Long-format CSV or TSV with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_pages(spark: SparkSession, df: DataFrame, path: str, day: str, order: list, size: int = 20) -> DataFrame:
    """Pages by day and number, whole days replaced; then the manifest (day, pages,
    rows, revision), whose write is the commit point. Returns the manifest."""
    rows = pages(df, [day], order, size)
    body = rows.select(day, "page", "position", F.to_json(F.struct(*df.columns)).alias("body"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    body.write.mode("overwrite").partitionBy(day, "page").json(f"{path}/pages")
    summary = body.groupBy(day).agg(F.max("page").alias("pages"), F.count("*").alias("rows"))
    manifest = summary.join(revision(body, day, "body"), day)
    replace_atomically(spark, manifest, f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(current(spark, f"{path}/manifest"))


def write_index(df: DataFrame, path: str, by: list[str]) -> None:
    """Shards by priority and year."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def append_log(df: DataFrame, path: str, run_type: str) -> None:
    """Every observation, independent of deduplication."""
    df.select("doi_or_arxiv_id", "first_seen_at", F.lit(run_type).alias("run_type")).write.mode("append").json(path)


def last_manifest_before(manifests: DataFrame, date: str) -> DataFrame:
    """The newest manifest before a date."""
    return manifests.filter(F.col("run_date") < date).orderBy(F.desc("run_date")).limit(1)


def write_unless_empty(spark: SparkSession, df: DataFrame, path: str, date: str) -> bool:
    """An empty fetch leaves the bucket alone and writes a skip marker beside it."""
    if df.isEmpty():
        spark.createDataFrame([(date, "fetched_zero", 0)], "date string, reason string, fetched_total int").write.mode("overwrite").json(f"{path}.SKIPPED")
        return False
    replace_atomically(spark, df, path)
    return True


def sync_batches(df: DataFrame, push: Callable[[list[dict]], list[str]], size: int = 50) -> DataFrame:
    """(key, outcome) of rows handed to push in batches; push gives an outcome for each row. A
    batch that raises is unknown, never reported as created."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = b.to_dict("records")
            for k in range(0, len(rows), size):
                part = rows[k : k + size]
                try:
                    out = push(part)
                except Exception:  # the outcome of a broken call cannot be told
                    out = ["unknown"] * len(part)
                yield pd.DataFrame({"key": [r["key"] for r in part], "outcome": out})

    return df.mapInPandas(run, "key string, outcome string")
