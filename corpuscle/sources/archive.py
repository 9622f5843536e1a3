"""The day archive as Spark sources: a batch one that prunes files by range (S13) and a stream of one
bucket after the other (S12), and a sink for an outside library that accounts for every item (S22).

Files are opened on executors through pyarrow's file systems, so a path may be local (shared), hdfs://
or s3://; an archive that only Spark's readers can open goes through readers.buckets.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader, WriterCommitMessage

DAY_FILE = re.compile(r"(?:^|/)(\d{4}-\d{2}-\d{2})\.json$")
ROWS = "bucket_date string, position int, body string, corrupt boolean"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def day_files(path: str) -> list[tuple[str, str]]:
    """(bucket_date, file) of an archive, in order; other files are passed over."""
    system, root = _open(path)
    found = [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.is_file]
    scheme = path.split("://")[0] if "://" in path else "file"
    return sorted((m[1], f"{scheme}://{p}") for p in found if (m := DAY_FILE.search(p)))


def bucket_rows(day: str, path: str) -> Iterator[tuple]:
    """The papers of one file, an object with papers or a bare list, each as JSON with its position; a
    file that is neither is one row that says so. Entries that are no object are passed over."""
    system, name = _open(path)
    with system.open_input_stream(name) as f:
        raw = f.read()
    try:
        data = json.loads(raw.decode("utf-8-sig"))
        papers = data["papers"] if isinstance(data, dict) else data
        if not isinstance(papers, list):
            raise ValueError
    except (ValueError, KeyError):
        yield day, None, None, True
        return
    for k, p in enumerate(papers):
        if isinstance(p, dict):
            yield day, k, json.dumps(p, ensure_ascii=False), False


class _Day(InputPartition):
    def __init__(self, day: str, path: str):
        self.day, self.path = day, path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over comparisons of bucket_date; they decide which files become partitions."""
        made = {
            EqualTo: lambda v: lambda d: d == v, GreaterThan: lambda v: lambda d: d > v, GreaterThanOrEqual: lambda v: lambda d: d >= v,
            LessThan: lambda v: lambda d: d < v, LessThanOrEqual: lambda v: lambda d: d <= v, In: lambda v: lambda d: d in v,
        }
        for f in filters:
            if type(f) in made and f.attribute == ("bucket_date",):
                self.tests.append(made[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Day(d, p) for d, p in day_files(self.path) if all(t(d) for t in self.tests)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return bucket_rows(partition.day, partition.path) if isinstance(partition, _Day) else iter(())


class Archive(DataSource):
    """A folder of day files, a partition for each file that the filters leave."""

    @classmethod
    def name(cls) -> str:
        return "day_archive"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Listing(SimpleDataSourceStreamReader):
    """Names of day files in order; the offset is the last one named."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"bucket": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [x for x in day_files(self.path) if x[0] > start["bucket"]][: self.most]
        return iter(rows), {"bucket": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([x for x in day_files(self.path) if start["bucket"] < x[0] <= end["bucket"]])


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_listing"

    def schema(self) -> str:
        return "bucket_date string, path string"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _Listing(self.options["path"], int(self.options.get("most", 1)))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(bucket_date, position, body, corrupt). Comparisons of bucket_date prune files before
    anything is read: a range of one month opens one month's files."""
    spark.dataSource.register(Archive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("day_archive").option("path", path).load()


def stream_archive(spark: SparkSession, path: str, most: int = 1) -> DataFrame:
    """The same rows as a stream of `most` buckets a micro-batch, in order of date. Only names pass
    the driver; executors read the files. A stopped stream goes on after the last bucket it finished;
    a corrupt bucket is a row of its own and holds nothing up. Files dated before what has been
    streamed are not looked at again: they come in by a merge (see buckets.merge)."""
    spark.dataSource.register(Listing)
    names = spark.readStream.format("day_listing").option("path", path).option("most", str(most)).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket_date", pa.string()), ("position", pa.int32()), ("body", pa.string()), ("corrupt", pa.bool_())])
        for b in batches:
            for day, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bucket_rows(day, file)), kind.types)] or [pa.array([], t) for t in kind.types], schema=kind)

    return names.mapInArrow(run, ROWS)


def papers(rows: DataFrame, schema: str) -> DataFrame:
    """The papers of archive rows, under a schema; corrupt buckets go."""
    return rows.filter(~F.col("corrupt")).select("bucket_date", "position", F.from_json("body", schema).alias("p")).select("bucket_date", "position", "p.*")


# --- S22 -------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    file: str
    items: int


class _LibraryWriter(DataSourceWriter):
    """Hands items to a library in batches and writes down what became of each.

    A task's log names a batch's items before the call and their outcomes after it, so a task that
    fails half-way leaves none unaccounted: what was sent without an answer is unknown. Another
    attempt first asks the library which items it has, and creates only the others.
    """

    def __init__(self, log: str, existing: Callable[[list[str]], set[str]], create: Callable[[list[dict]], list[str]], size: int):
        self.log, self.existing, self.create, self.size, self.run = log, existing, create, size, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        system, root = _open(self.log)
        system.create_dir(f"{root}/{self.run}", recursive=True)
        name, done, n = f"{self.run}/part-{part:05d}-{attempt}.jsonl", [], 0

        def note(rows: list[dict]) -> None:
            # a file is only ever written whole, so what stands is re-written with what is new
            done.extend(rows)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in done).encode())

        def push(rows: list[dict]) -> None:
            known = self.existing([r["key"] for r in rows])
            new = [r for r in rows if r["key"] not in known]
            note([{"key": r["key"], "outcome": "exists" if r["key"] in known else "sent"} for r in rows])
            if new:
                out = self.create(new)
                note([{"key": r["key"], "outcome": o} for r, o in zip(new, out, strict=True)])

        held: list[dict] = []
        for row in iterator:
            held.append(row.asDict(recursive=True))
            n += 1
            if len(held) == self.size:
                push(held)
                held = []
        if held:
            push(held)
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._mark("committed", messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._mark("aborted", messages)

    def _mark(self, status: str, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.log)
        system.create_dir(f"{root}/{self.run}", recursive=True)
        with system.open_output_stream(f"{root}/{self.run}/{status.upper()}") as f:
            f.write(json.dumps({"status": status, "tasks": sum(m is not None for m in messages), "items": sum(m.items for m in messages if m is not None)}).encode())


def sync_library(df: DataFrame, log: str, existing: Callable[[list[str]], set[str]], create: Callable[[list[dict]], list[str]], size: int = 50) -> None:
    """Rows (key, ...) are created in an outside library, `size` a call. existing(keys) gives those it
    holds, create(items) an outcome for each. Raises if a task fails for good; outcomes() tells then
    too what became of every item that was sent."""

    class Library(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paper_library"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return _LibraryWriter(log, existing, create, size)

    df.sparkSession.dataSource.register(Library)
    df.write.format("paper_library").mode("append").save()


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """(key, outcome) of every item that any run has sent: an answer before `exists` before
    `unknown`, for what was sent and never answered."""
    rows = spark.read.schema("key string, outcome string").json(log, pathGlobFilter="*.jsonl", recursiveFileLookup=True)
    rank = F.when(F.col("outcome") == "sent", 2).when(F.col("outcome") == "exists", 1).otherwise(0)
    best = rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "outcome")).alias("b"))
    return best.select("key", F.when(F.col("b.rank") == 2, "unknown").otherwise(F.col("b.outcome")).alias("outcome"))
