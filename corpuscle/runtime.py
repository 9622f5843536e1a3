"""Session helpers shared by every operator: imports on workers, scratch tables, table readers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows of one Arrow batch sent to Python; texts can be long, so far below Spark's 10,000.
ARROW_ROWS = 512


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def _archive() -> str:
    """This package as a zip file, to send to workers."""
    path = os.path.join(tempfile.mkdtemp(prefix="corpuscle-"), "corpuscle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(REPO, "corpuscle")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), REPO))
    return path


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and bound the Arrow batches they get. Where
    workers run elsewhere the package is sent to them; the driver's own paths mean nothing there."""
    context = spark.sparkContext
    if _local(spark):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if REPO not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    elif _SENT.get(context.applicationId) is None:
        _SENT[context.applicationId] = _archive()
        context.addPyFile(_SENT[context.applicationId])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


#: Applications whose workers have been sent the package.
_SENT: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one is set only where the session names none and all
    workers run on this machine; elsewhere executors could not read each other's tables there."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found and not _local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written intermediate tables of one query, in the shared folder.

    A written table cuts lineage and outlives executors. drop() removes tables that no later
    step reads; what is left goes when the driver ends.
    """

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.live.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Let Spark remove the shuffle files of steps whose results are written: it does so only
        once the driver's collector has found their plans unused."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        path = f"{self.root}/{name}" if name else self.root
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_scratch() -> None:
    for one in Scratch.live:
        with contextlib.suppress(Exception):  # the session may have ended first
            one.drop()


def shielded(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """(df under names that clash with nothing, besides the used columns under their own; the
    columns that restore df as it was)."""
    own = [df[f"`{c}`"] for c in df.columns]
    out = df.select(*[c.alias(f"__own{k}") for k, c in enumerate(own)], *[df[c].alias(c) for c in used])
    return out, [F.col(f"__own{k}").alias(c) for k, c in enumerate(df.columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
