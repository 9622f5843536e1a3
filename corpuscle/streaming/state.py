"""Incremental state: first-seen keys over a stream, digests, resumable windows, scoring in rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.dates import month_windows
from corpuscle.operators.joins import digest_diff


def observed_within(stream: DataFrame, at: str, keys: list[str], days: int = 14) -> DataFrame:
    """Repeats of a key within the overlapping lookback go, by observation time. Publication
    dates never decide, so no row is too late (T02)."""
    return stream.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


#: Batches of a state above which they are merged into one.
BATCHES = 16


def first_seen_stream(stream: DataFrame, keys: list[str], order: list[str], state: str, checkpoint: str) -> DataFrame:
    """The first row of each key, over all that a stream delivers and however late.

    Each micro-batch writes its own firsts under its batch number, so a replayed batch overwrites
    itself; the merge is a grouped minimum on read. Runs until the source is drained; then a state of
    many batches is compacted to one, so that it holds a row for each key. A stream that delivers
    nothing gives no row.
    """
    spark = stream.sparkSession
    empty = stream.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first")).schema

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():  # T10
            firsts = batch.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
            firsts.write.mode("overwrite").parquet(f"{state}/batch={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    compact(spark, keys, state)
    held = spark.read.schema(empty).parquet(state) if _batches(spark, state) else spark.createDataFrame([], empty)
    return held.groupBy(*keys).agg(F.min("first").alias("first")).select(*keys, "first.*")


def _batches(spark: SparkSession, state: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")) if fs.exists(path) else []


def compact(spark: SparkSession, keys: list[str], state: str, most: int = BATCHES) -> None:
    """Merges the batches of a state if they are more than `most`. The merged batch appears by one
    rename before the others go; a crash between leaves rows that the minimum on read makes harmless."""
    names = _batches(spark, state)
    if len(names) <= most:
        return
    rows = spark.read.parquet(*[f"{state}/{n}" for n in names])
    name = f"batch=-{uuid.uuid4().int % 10**9 + 1}"
    rows.groupBy(*keys).agg(F.min("first").alias("first")).write.parquet(f"{state}-{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(path(f"{state}-{name}"), path(f"{state}/{name}"))
    for n in names:
        fs.delete(path(f"{state}/{n}"), True)


def digest(current: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame, bool]:
    """(new, cleared, changed): state is rewritten only if membership has changed."""
    new, cleared = digest_diff(current, seen, key)
    return new, cleared, not (new.isEmpty() and cleared.isEmpty())


def backfill_plan(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Pending months of a range, with their partial ends."""
    span = spark.range(1).select(F.explode(month_windows(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("w"))
    return span.select("w.*", F.lit("pending").alias("status"))


def resume(plan: DataFrame, progress: DataFrame | None, run: dict, was: dict | None) -> DataFrame:
    """Months still to do; another range, mode or set of sources refuses to resume. A month
    that was in progress or failed is pending again."""
    if progress is None:
        return plan
    if run != was:
        raise ValueError("the run to resume has other parameters")
    done = progress.filter(F.col("status") == "complete").select("month")
    return plan.join(done, "month", "left_anti")


def after_attempt(df: DataFrame, ok: Column, most: int = 3) -> DataFrame:
    """An attempt ends in read, in another try, or in failed once the budget is used up."""
    tried = F.coalesce("attempts", F.lit(0)) + F.lit(1)
    status = F.when(ok, "read").when(tried >= most, "failed").otherwise("pending")
    return df.withColumns({"attempts": tried, "status": status})


class BudgetExhausted(RuntimeError):
    """The scoring service refuses further calls."""


RESULT = "key string, priority string, scorer_failed boolean, scorer_failed_reason string, scorer_failed_attempts int"


def score(df: DataFrame, call: Callable[[dict, bool], dict], tries: int = 3) -> DataFrame:
    """call(row, strict) scores a row; later tries ask strictly for JSON. A failure is a
    null priority with its reason, never a guess; an exhausted budget fails the rest of a task."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        spent = False
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                reason, used = "budget_exhausted", 0
                result = None
                while result is None and not spent and used < tries:
                    used += 1
                    try:
                        result = call(row, used > 1)
                    except BudgetExhausted:
                        spent, reason = True, "budget_exhausted"
                    except Exception as e:  # any scorer error is an outcome of this row
                        reason = f"{type(e).__name__}: {e}"
                out.append((row["key"], result["priority"], False, None, used) if result else (row["key"], None, True, reason, used))
            yield pd.DataFrame(out, columns=["key", "priority", "scorer_failed", "scorer_failed_reason", "scorer_failed_attempts"])

    return df.mapInPandas(run, RESULT)


def score_at_once(df: DataFrame, call: Callable[[dict, bool], dict], tries: int = 3, at_once: int = 8) -> DataFrame:
    """score() with up to `at_once` calls in flight in each task. Results come in the order of the
    rows. Once a call is refused for its budget none begins any more: calls in flight end as they will,
    every row after them fails without a call, and so does the rest of the task."""

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor
        from threading import Event

        import pandas as pd

        spent = Event()

        def one(row: dict) -> tuple:
            reason, used = "budget_exhausted", 0
            while used < tries and not spent.is_set():
                used += 1
                try:
                    return row["key"], call(row, used > 1)["priority"], False, None, used
                except BudgetExhausted:
                    spent.set()
                    reason = "budget_exhausted"
                except Exception as e:  # any scorer error is an outcome of this row
                    reason = f"{type(e).__name__}: {e}"
            return row["key"], None, True, reason, used

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                out = list(pool.map(one, b.to_dict("records")))
                yield pd.DataFrame(out, columns=["key", "priority", "scorer_failed", "scorer_failed_reason", "scorer_failed_attempts"])

    return df.mapInPandas(run, RESULT)


def score_in_rounds(df: DataFrame, call: Callable[[dict, bool], dict], write: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """The breaker across executors: rows are scored in hash rounds, and no round starts once
    one was refused for its budget. Rows of later rounds stay unscored and out of the seen state."""
    done = None
    for k in range(rounds):
        part = df.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        got = write(score(part, call), k)
        done = got if done is None else done.unionByName(got)
        if not got.filter(F.col("scorer_failed_reason") == "budget_exhausted").isEmpty():
            break
    return done


def resolve_aliases(dois: list[str], known: dict[str, str], ask: Callable[[str], tuple[int, str | None, list[str]]], most: int = 100) -> dict[str, str]:
    """Concept DOIs of up to `most` unknown version DOIs. ask gives (status, concept, siblings);
    404 maps to itself, siblings are learned, and the first network failure ends the step."""
    out = dict(known)
    for doi in [d for d in dois if d not in known][:most]:
        if doi in out:
            continue
        try:
            status, concept, siblings = ask(doi)
        except OSError:
            break
        out[doi] = doi if status == 404 or not concept else concept
        if concept:
            out.update({s: concept for s in siblings if s not in out})
    return out
