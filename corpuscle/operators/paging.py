"""Pages of the queue by a seek, and Q01, Q02: substring search by trigrams.

Both are built once by jobs whose parts are bounded, and asked often: a page reads one shard, a search
reads the postings of its trigrams and the rows that all of them propose.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.search import facet_filter, matches
from corpuscle.operators.windows import ranked_by_day
from corpuscle.runtime import prepare

#: Rows of a page, pages of a shard.
SIZE, SHARD = 20, 50


def write_queue(df: DataFrame, path: str, facets: list[str], size: int = SIZE, shard: int = SHARD) -> None:
    """The queue (date, title, key, ...), newest first, as page tables of one facet view: rows
    by shard; pages (page, first and last key, rows); totals of every combination of facets, nulls
    counted as their own value. Only the days' counts share a task."""
    ranked = ranked_by_day(df, "date", [F.desc("title"), F.col("key")], "place")
    page = F.ceil(F.col("place") / size).cast("int")
    rows = ranked.withColumn("page", page).withColumn("shard", F.floor((page - 1) / shard).cast("int"))
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows")
    spark = df.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    ends = written.groupBy("page").agg(F.min_by("key", "place").alias("first_key"), F.max_by("key", "place").alias("last_key"), F.count("*").alias("n"))
    ends.write.mode("overwrite").parquet(f"{path}/pages")
    df.groupBy(*facets).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/totals")


def page(spark: SparkSession, path: str, number: int, shard: int = SHARD) -> DataFrame:
    """One page, from one shard. A page that does not exist has no rows."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.filter((F.col("shard") == (number - 1) // shard) & (F.col("page") == number)).orderBy("place").drop("place", "shard", "page")


def page_after(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(page, n) of the page that follows the one that ends with a key."""
    pages = spark.read.parquet(f"{path}/pages")
    end = pages.filter(F.col("last_key") == key).select((F.col("page") + 1).alias("page"))
    return pages.join(end, "page").select("page", "n")


def totals(spark: SparkSession, path: str, **facets: str | None) -> DataFrame:
    """(total, pages) of the queue under facets, without reading its rows."""
    found = spark.read.parquet(f"{path}/totals").filter(facet_filter(facets))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


# --- trigrams ---------------------------------------------------------------------------------------

#: Shards of a year's rows and postings; characters of texts whose postings are packed together.
SHARDS, CHARACTERS = 16, 1 << 22


def _shard(c: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")


def _packed(texts: list[str], first: int = 0) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(grams, ends of their lists, lists: numbers of the texts that hold each gram), the texts numbered
    from `first`. Texts with very many kinds of characters are packed in two halves."""
    sizes = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(c) < 3:
        return
    kinds, n = np.flatnonzero(np.bincount(c)), len(texts)
    if n > 1 and len(kinds) ** 3 * n >= 1 << 63:
        yield from _packed(texts[: n // 2], first)
        yield from _packed(texts[n // 2 :], first + n // 2)
        return
    number = np.zeros(int(kinds[-1]) + 1, np.int64)
    number[kinds] = np.arange(len(kinds))
    c, owner = number[c], np.repeat(np.arange(n), sizes)
    code = (c[:-2] * len(kinds) + c[1:-1]) * len(kinds) + c[2:]
    both = np.sort((code * n + owner[:-2])[owner[:-2] == owner[2:]])
    if not len(both):
        return
    both = both[np.r_[True, both[1:] != both[:-1]]]
    code, text = both // n, both % n
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    code = code[starts]
    letters = kinds[np.stack([code // len(kinds) ** 2, code // len(kinds) % len(kinds), code % len(kinds)], axis=1)]
    whole = letters.astype("<u4").tobytes().decode("utf-32-le")
    yield [whole[k : k + 3] for k in range(0, len(whole), 3)], np.r_[starts[1:], len(text)], text + first


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (year, shard, key, text), in runs of one year and shard, to (year, shard, gram, keys)."""
    year, shard, keys, texts, size = None, None, [], [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays(keys) if keys else None
        for grams, ends, text in _packed(texts):
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), own.take(pa.array(text)))
            yield pa.RecordBatch.from_arrays([pa.array([year] * len(grams), kind), pa.array([shard] * len(grams), pa.int32()), pa.array(grams), lists], names=["year", "shard", "gram", "keys"])

    for b in batches:
        kind, at = b.column(0).type, 0
        for (y, s), run in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            n = len(list(run))
            if (y, s) != (year, shard) or size >= CHARACTERS:
                yield from packed()
                year, shard, keys, texts, size = y, s, [], [], 0
            keys.append(b.column(2).slice(at, n))
            texts += [t.decode("utf-8", "replace") for t in b.column(3).slice(at, n).cast(pa.binary()).to_pylist()]
            size, at = size + sum(map(len, texts[-n:])), at + n
    yield from packed()


def write_index(df: DataFrame, path: str, text: str = "blob", shards: int = SHARDS) -> None:
    """Q01, Q02: rows (key, year, blob, ...) by year and shard of their key, and from these, without
    another shuffle, postings (gram, keys) by the same year and shard, sorted by gram, so that a search
    prunes by partition and then by the files' statistics. A list holds the keys of some CHARACTERS of
    text, so a frequent gram has many. Rows without a key or a year cannot be found and go."""
    spark = prepare(df.sparkSession)
    rows = df.filter(F.col("key").isNotNull() & F.col("year").isNotNull()).withColumn("shard", _shard(F.col("key"), shards))
    rows.repartition("year", "shard").sortWithinPartitions("key").write.mode("overwrite").partitionBy("year", "shard").parquet(f"{path}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{path}/rows").select("year", "shard", "key", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("year", "key")}
    posted = written.mapInArrow(_postings, f"year {kinds['year']}, shard int, gram string, keys array<{kinds['key']}>")
    posted.sortWithinPartitions("year", "shard", "gram").write.mode("overwrite").partitionBy("year", "shard").parquet(f"{path}/postings")


def proposed(spark: SparkSession, path: str, query: str, years: list[int] | None = None) -> DataFrame | None:
    """(year, home, key) of the rows that hold every trigram of a query; None for a query too short
    to have one. Rows of one key count together."""
    q = query.strip().lower()
    wanted = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    if not wanted:
        return None
    posts = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(wanted))
    if years:
        posts = posts.filter(F.col("year").isin(years))
    held = posts.select("year", F.col("shard").alias("home"), F.explode("keys").alias("key"))
    return held.groupBy("year", "home", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= len(wanted)).drop("n")


def search_index(spark: SparkSession, path: str, query: str, years: list[int] | None = None, text: str = "blob", shards: int = SHARDS, **facets: str | None) -> DataFrame:
    """Q01, Q02: rows whose text holds the query as a plain substring in any case, exactly those that a
    scan finds: trigrams propose, the substring is looked for in what they propose. A query below three
    characters scans the years asked for. Shards without a proposal are pruned while the query runs, whatever
    their number (`shards` is taken for the writer's sake)."""
    rows = spark.read.parquet(f"{path}/rows").filter(facet_filter(facets))
    if years:
        rows = rows.filter(F.col("year").isin(years))
    some = proposed(spark, path, query, years)
    if some is not None:
        rows = rows.join(some.select("year", F.col("home").alias("shard"), "key"), ["year", "shard", "key"], "left_semi")
    return rows.filter(matches(F.col(text), query)).drop("shard")
