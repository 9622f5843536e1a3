"""Joins of 64-bit fingerprints at a small Hamming distance, without all pairs.

The bits are cut into blocks. Two fingerprints that differ in at most RADIUS bits agree on every
bit of at least (blocks - RADIUS) blocks, so each choice of that many blocks is a table keyed by
its bits, and each pair meets in at least one table. More blocks give more tables with longer
keys; plan() takes the fewest tables whose buckets stay small at the given count, so the work per
fingerprint is bounded at any size. A bucket that still holds more than SPLIT rows is cut into
parts, and each two parts meet in a task of their own.

Within a bucket a spanning forest of the links is emitted rather than all pairs: connectivity is
kept exactly, and a group of n near copies gives n - 1 rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.runtime import Scratch

RADIUS = 4
#: Rows of a bucket above which it is cut into parts, and the mean rows a bucket may have.
SPLIT, MEAN = 8192, 1024
#: Buckets above SPLIT are told by one row in so many, chosen by hash; this decides only how rows are
#: dealt out, never which ones count, and a key table is shuffled once instead of twice.
SHARE = 16
#: Large buckets up to which their list is broadcast: a megabyte or two.
BROADCAST_ROWS = 50_000


def plan(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables for n fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        tables = [sum(c) for c in combinations(masks, blocks - radius)]
        if n <= MEAN << min(t.bit_count() for t in tables):
            break
    return tables


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(df: DataFrame, n: int, scratch: Scratch, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """df's rows once for each table (and part), with a column bucket; rows that must meet share one."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(plan(n, radius))])
    return spread(df.withColumn("bucket", F.explode(keys)), df.columns, scratch)


def spread(rows: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """rows with the buckets above SPLIT rows cut into parts, so that each two parts share a bucket."""
    some = rows.filter(F.pmod(F.xxhash64(F.lit(5), *[F.col(c) for c in columns]), F.lit(SHARE)) == 0)
    n = F.col("count") * SHARE
    hot = some.groupBy("bucket").count().filter(n > SPLIT).select("bucket", F.ceil(n / SPLIT).alias("parts"))
    hot = scratch.write(hot, f"hot-{uuid.uuid4().hex[:8]}")
    large = hot.count()
    if not large:
        return rows
    rows = rows.join(F.broadcast(hot) if large <= BROADCAST_ROWS else hot, "bucket", "left")
    mine = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.col("parts"))
    meets: Callable[[Column], Column] = lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j))
    parts = F.when(F.col("parts").isNull(), F.array("bucket")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), meets))
    return rows.select(*columns, F.explode(parts).alias("bucket"))


def linked(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the fingerprints have another within the radius."""
    n, step = len(x), 256
    out = np.zeros(n, bool)
    for i in range(0, n, step):
        rows, rest = x[i : i + step], x[i:]
        near = np.bitwise_count(rows[:, None] ^ rest[None, :]) <= radius
        near[np.arange(len(rows)), np.arange(len(rows))] = False
        out[i : i + len(rows)] |= near.any(axis=1)
        out[i:] |= near.any(axis=0)
    return out


def forest(x: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among x; near(i, others) tells which are linked to i."""
    left, edges = np.arange(len(x)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit].tolist()
                edges += [(i, j) for j in found]
                reached += found
                left = left[~hit]
    return edges


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    got = [[b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64) for _ in names]


def by_bucket(rows: DataFrame, names: list[str], each: Callable[..., list[tuple[np.ndarray, ...]]], schema: str, some: Callable[..., np.ndarray] | None = None, at_once: bool = False) -> DataFrame:
    """Runs each(*columns) on the rows of every bucket with more than one; columns are in the order
    of names. some(bucket, *columns) tells beforehand, for all buckets at once, which rows count.
    With at_once each(bucket, *columns) gets all buckets together, in order of bucket. A task holds
    its partition's columns: slim fixed-width rows."""

    def run(batches):
        bucket, *cols = _columns(batches, ["bucket", *names])
        order = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[order], [c[order] for c in cols]
        if some is not None:
            left = some(bucket, *cols)
            bucket, cols = bucket[left], [c[left] for c in cols]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
        out = each(bucket, *cols) if at_once else []
        for s, e in zip(starts.tolist(), ends.tolist()) if not at_once else ():
            if e - s > 1:
                out += each(*[c[s:e] for c in cols])
        if out:
            fields = [f.split()[0] for f in schema.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=fields)

    return rows.repartition("bucket").mapInArrow(run, schema)
