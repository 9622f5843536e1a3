"""A table of day buckets that late rows are merged into, first seen wins.

A bucket is a folder of its own under a version; a manifest names each bucket's folder and counts.
A merge reads and writes only the buckets that new rows fall into, then replaces the manifest in one
step (sinks.replace_atomically): readers see all of a merge or none of it, and a merge that died is
only folders that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators.dedup import first_wins
from corpuscle.sources.sinks import current, replace_atomically

MANIFEST = "bucket string, folder string, n_rows long, counts map<string,long>"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, folder, n_rows, counts: rows by kind) of what holds now; empty before the first merge."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(current(spark, f"{root}/manifest"))


def read(spark: SparkSession, root: str, schema: T.StructType, chosen: Column | None = None) -> DataFrame:
    """Rows of the buckets that hold, or of those the condition on the manifest chooses. One row a
    bucket (a day) reaches the driver."""
    named = manifest(spark, root)
    folders = [r.folder for r in (named.filter(chosen) if chosen is not None else named).select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders])
    return rows.select(*schema.fieldNames())


def merge(spark: SparkSession, root: str, new: DataFrame, bucket: str, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Merges rows into their buckets and returns the new manifest.

    A row whose keys its bucket holds already goes; of new rows with the same keys the first by order
    stays. Rows with an empty or null key are all kept, and a merge of them again adds them again;
    rows whose bucket is no date go. The counts of a touched bucket are made anew from all its rows, by the
    column kind (null counts as an empty text). Merging the same rows again changes nothing.
    """
    was = manifest(spark, root)
    rows = new.withColumn(bucket, F.col(bucket).cast("string")).filter(F.col(bucket).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    touched = rows.select(F.col(bucket).alias("bucket")).distinct()
    old_folders = [r.folder for r in was.join(touched, "bucket", "left_semi").select("folder").collect()]
    days = [r.bucket for r in touched.collect()]  # a row a bucket
    if not days:
        return was
    held = read(spark, root, rows.schema, F.col("folder").isin(old_folders)) if old_folders else spark.createDataFrame([], rows.schema)
    by = [bucket, *keys]
    whole = F.lit(True)
    for k in keys:
        whole = whole & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    fresh = first_wins(rows.filter(whole), by, [F.col(c) for c in order]).select(*rows.columns).join(held.select(*by), by, "left_anti")
    all_ = held.unionByName(fresh.select(*rows.columns)).unionByName(rows.filter(~whole))
    version = f"data/{uuid.uuid4().hex[:12]}"
    all_.withColumn("_day", F.col(bucket)).write.partitionBy("_day").parquet(f"{root}/{version}")
    written = spark.read.schema(rows.schema).parquet(*[f"{root}/{version}/_day={d}" for d in days])
    by_kind = written.groupBy(bucket, F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
    counts = by_kind.groupBy(F.col(bucket).alias("bucket")).agg(F.sum("n").alias("n_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    entries = counts.select("bucket", F.concat(F.lit(f"{version}/_day="), "bucket").alias("folder"), "n_rows", "counts")
    now = was.join(touched, "bucket", "left_anti").unionByName(entries)
    replace_atomically(spark, now.coalesce(1), f"{root}/manifest")  # a row a bucket
    return manifest(spark, root)


def recount(spark: SparkSession, root: str, schema: T.StructType, bucket: str, kind: str, apply: bool = False) -> DataFrame:
    """(bucket, n_rows, counts, expected_rows, expected) of the buckets whose derived counts differ
    from a recount of their rows. With apply the manifest gets the recounted ones for these buckets, in
    one step; rows, folders and all other entries stay as they are. An empty bucket counts no row."""
    named = manifest(spark, root)
    rows = read(spark, root, schema)
    by_kind = rows.groupBy(F.col(bucket).alias("bucket"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
    entries = lambda c: F.array_sort(F.map_entries(c))
    made = by_kind.groupBy("bucket").agg(F.sum("n").alias("expected_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("expected"))
    both = named.join(made, "bucket", "left").withColumns({"expected_rows": F.coalesce("expected_rows", F.lit(0)), "expected": F.coalesce("expected", F.create_map().cast("map<string,bigint>"))})
    wrong = both.filter((F.coalesce("n_rows", F.lit(-1)) != F.col("expected_rows")) | ~entries(F.col("counts")).eqNullSafe(entries(F.col("expected"))))
    found = wrong.select("bucket", "n_rows", "counts", "expected_rows", "expected").collect()  # a row a bucket
    out = spark.createDataFrame(found, "bucket string, n_rows long, counts map<string,long>, expected_rows long, expected map<string,long>")
    if apply and found:
        fixed = out.join(named.select("bucket", "folder"), "bucket").select("bucket", "folder", F.col("expected_rows").alias("n_rows"), F.col("expected").alias("counts"))
        replace_atomically(spark, named.join(out.select("bucket"), "bucket", "left_anti").unionByName(fixed).coalesce(1), f"{root}/manifest")
    return out
