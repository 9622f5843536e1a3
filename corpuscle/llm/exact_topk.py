"""Exact top-k inner products by norm-sorted vectors and rotated partial sums.

Vectors are quantised to integers, sorted by descending length and packed into chunks of bounded
size; queries are packed into blocks. Every block first meets the chunk of the longest vectors,
which gives each query a score that its k-th best must reach. After that a block meets a chunk
only if the product of their largest lengths can reach it (Cauchy-Schwarz). Surviving pairs are
dealt out as cells of some blocks and some chunks, so a chunk travels once for each group of blocks
and not for each block; within a cell chunks are met by descending length with the floors that the
ones before have raised, until no length can reach them. Within a chunk a candidate survives only
if its partial sum over the leading rotated components (first NARROW, then LEAD of them) plus the
product of the residual lengths can reach the floor. Survivors are scored exactly, in integers. The
rotation comes from an SVD of a bounded sample; it changes how much is pruned, never the result.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do
rows without a vec_id; an empty vector scores 0 with all; every row counts, equal ones too: a
query's candidates are all rows but itself, and a row that stands twice is two candidates and, if
chosen, two queries with equal results; ties go to the smaller vec_id; a shorter vector counts as
padded with zeros; queries with no candidate, and empty tables, have no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.runtime import Scratch, prepare

#: Vectors of a chunk, queries of a block, rows the SVD is fitted on, leading components.
CHUNK, BLOCK, SAMPLE, NARROW, LEAD = 4096, 2048, 4096, 8, 24
#: Blocks and chunks of a cell: what a task holds at once.
BLOCKS, CHUNKS = 4, 16
EVERY, TOP = 20, 20


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v: array<long>, norm) of the rows that take part."""
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _matrix(column: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), kind)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def _pack(rows: DataFrame, dim: int, kind: np.dtype, most: int) -> DataFrame:
    """Rows of a partition, in order, as (pack, first, ids, rids, vectors): first is the largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        here, k = TaskContext.get().partitionId(), 0

        def packs(last: bool):
            nonlocal held, k
            i, r, v, n = (np.concatenate(c) for c in zip(*held, strict=True))
            while len(i) > most or last and len(i):
                yield pa.RecordBatch.from_pydict({"pack": [here << 32 | k], "first": [float(n[0])], "ids": [i[:most].tobytes()], "rids": [r[:most].tobytes()], "vectors": [v[:most].tobytes()]})
                i, r, v, n, k = i[most:], r[most:], v[most:], n[most:], k + 1
            held = [(i, r, v, n)]

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim, kind), b.column(3).to_numpy()))
            if sum(len(h[0]) for h in held) > 2 * most:
                yield from packs(False)
        if held:
            yield from packs(True)

    return rows.select("vec_id", "rid", "v", "norm").mapInArrow(run, "pack long, first double, ids binary, rids binary, vectors binary")


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats while every sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


class Side:
    """Vectors of a pack with their rotated components and the lengths of what these leave out."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, v: np.ndarray, rotation: np.ndarray):
        self.ids, self.rids, self.v = ids, rids, v
        turned = v.astype(float) @ rotation
        self.leads = [min(NARROW, v.shape[1]), min(LEAD, v.shape[1])]
        self.turned = turned[:, : self.leads[1]]
        self.left = [np.sqrt((turned[:, n:] ** 2).sum(axis=1)) for n in self.leads]


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # query row, candidate's vec_id, score


def best(q: Side, c: Side, floor: np.ndarray, k: int, known: Best | None = None) -> tuple[Best, np.ndarray]:
    """Each query's k best of known and the candidates that reach its floor, and the raised floors."""
    out: list[Best] = [known] if known is not None else []
    floor = floor.copy()
    step = 256
    for s in range(0, len(q.v), step):
        rows = slice(s, s + step)
        got: list[Best] = []
        for t in range(0, len(c.v), 1024):  # by descending length
            cols = np.arange(t, min(t + 1024, len(c.v)))
            some = np.arange(s, min(s + step, len(q.v)))
            live = np.ones((len(some), len(cols)), bool)
            for lead, q_left, c_left in zip(q.leads, q.left, c.left, strict=True):
                bound = q.turned[some, :lead] @ c.turned[cols, :lead].T + q_left[some, None] * c_left[None, cols]
                live &= bound + 1e-6 * (1 + np.abs(bound)) >= floor[some, None]
                i, j = live.any(axis=1), live.any(axis=0)
                some, cols, live = some[i], cols[j], live[np.ix_(i, j)]
            live &= q.rids[some, None] != c.rids[None, cols]
            if not live.any():
                continue
            i, j = np.nonzero(live)
            if len(i) * 50 < live.size:  # few products are left: those alone
                x = np.einsum("ij,ij->i", q.v[some[i]].astype(np.int64), c.v[cols[j]].astype(np.int64))
            else:
                x = _exact(q.v[some], c.v[cols])[i, j]
            reach = x >= np.ceil(np.maximum(floor[some[i]], -(2.0**62)))
            got.append((some[i[reach]], c.ids[cols[j[reach]]], x[reach]))
            a, b, x, nth = _ranked(got)
            a, b, x, nth = (z[nth < k] for z in (a, b, x, nth))
            got = [(a, b, x)]
            full = nth == k - 1
            floor[a[full]] = np.maximum(floor[a[full]], x[full])
        out += got
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3)), floor
    a, b, x, nth = _ranked(out)
    full = nth == k - 1
    floor[a[full]] = np.maximum(floor[a[full]], x[full])
    return (a[nth < k], b[nth < k], x[nth < k]), floor


def _ranked(parts: list[Best]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, x = (np.concatenate(z) for z in zip(*parts, strict=True))
    order = np.lexsort((b, -x, a))
    a, b, x = a[order], b[order], x[order]
    return a, b, x, np.arange(len(a)) - np.searchsorted(a, a)


RESULT = "block long, nth long, query_id long, vec_id long, score long"


def top_k(rows: DataFrame, chosen: Column, scratch: Scratch, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each chosen row's k best among the others; from quantised()."""
    spark = rows.sparkSession
    prepare(spark)
    rows = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    queries = rows.filter(chosen)
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    n, dim, top, n_q = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(largest, F.lit(0)), F.count_if(chosen)).first()
    dim, kind = max(dim, 1), next(np.dtype(t) for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max or t is np.int64)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(SAMPLE).collect()]
    x = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    rotation = np.linalg.svd(x.T @ x)[0] if len(x) else np.eye(dim)

    def packed(df: DataFrame, count: int, size: int, name: str) -> DataFrame:
        parts = max(1, -(-count // size))
        spread = df.repartitionByRange(parts, F.desc("norm"), "vec_id") if parts > 1 else df.coalesce(1)
        return scratch.write(_pack(spread.sortWithinPartitions(F.desc("norm"), "vec_id"), dim, kind, size), name)

    chunks, blocks = packed(rows, n, CHUNK, "chunks"), packed(queries, n_q, BLOCK, "blocks")
    longest = chunks.agg(F.max(F.struct("first", "pack"))["pack"]).first()[0]

    def side(r: dict) -> Side:
        return Side(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rids"], np.int64), np.frombuffer(r["vectors"], kind).reshape(-1, dim), rotation)

    def table(found: list[tuple[int, Side, Best]]) -> pa.Table:
        cols = [[np.full(len(a), block), a, q.ids[a], b, x] for block, q, (a, b, x) in found]
        arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*cols, strict=True)] if cols else [pa.array([], pa.int64())] * 5
        return pa.Table.from_arrays(arrays, names=["block", "nth", "query_id", "vec_id", "score"])

    def first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row holds one block and the chunk of the longest vectors."""
        for batch in batches:
            for r in batch.to_pylist():
                q = side(r)
                c = side({"ids": r["cids"], "rids": r["crids"], "vectors": r["cvectors"]})
                yield from table([(r["pack"], q, best(q, c, np.full(len(q.ids), -np.inf), k)[0])]).to_batches()

    def cell_run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The blocks of a cell against its chunks, longest first, floors carried from chunk to chunk."""
        met = [(c["first"], side(c)) for c in sorted(right.to_pylist(), key=lambda c: (-c["first"], c["pack"]))]
        found = []
        for b in left.to_pylist():
            q, got = side(b), None
            floor = np.array([x if x is not None else -np.inf for x in b["floors"]])
            for first, c in met:
                if first * b["first"] * (1 + 1e-9) < floor.min():
                    break
                got, floor = best(q, c, floor, k, got)
            if got is not None:
                found.append((b["pack"], q, got))
        return table(found)

    one = chunks.filter(F.col("pack") == F.lit(longest)).select(F.lit(0).alias("_one"), F.col("ids").alias("cids"), F.col("rids").alias("crids"), F.col("vectors").alias("cvectors"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is up to a megabyte
    first = scratch.write(blocks.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one", "first").mapInArrow(first_run, RESULT), "first")  # one chunk
    nth = F.row_number().over(W.partitionBy("block", "nth").orderBy(F.desc("score"), "vec_id"))
    reached = first.withColumn("r", nth).filter(F.col("r") == k).select("block", "nth", "score")
    floors = reached.groupBy(F.col("block").alias("pack")).agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("_m"))  # of one block
    each = F.transform(F.sequence(F.lit(0).cast("long"), (F.length("ids") / 8).cast("long") - 1), lambda i: F.element_at("_m", i).cast("double"))
    blocks = scratch.write(blocks.join(floors, "pack", "left").withColumn("floors", each).drop("_m"), "floors")
    # pairs of packs, by their lengths alone: a stated query set in blocks against all rows in chunks
    least = F.when(F.exists("floors", lambda x: x.isNull()), F.lit(float("-inf"))).otherwise(F.array_min("floors"))
    at = F.row_number().over(W.orderBy(F.desc("first"), "pack")) - 1  # a row for each pack
    b = blocks.select("pack", "first", least.alias("least")).withColumn("g", F.floor(at / BLOCKS))
    c = chunks.filter(F.col("pack") != F.lit(longest)).select(F.col("pack").alias("chunk"), F.col("first").alias("long"), F.floor(at / CHUNKS).alias("h"))
    pairs = scratch.write(c.join(b, F.col("long") * F.col("first") * (1 + 1e-9) >= F.col("least")).select("pack", "chunk", "g", "h"), "pairs")
    cell = F.concat_ws("/", "g", "h").alias("cell")
    left = pairs.select("pack", cell).distinct().join(blocks, "pack")
    right = pairs.select(F.col("chunk").alias("pack"), cell).distinct().join(chunks, "pack")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell_run, RESULT)
    found = first.unionByName(scratch.write(found, "found"))
    prepare(spark)
    rank = F.row_number().over(W.partitionBy("block", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, F.col("vec_id") % EVERY == 0, Scratch(spark, "op5"))


#: Every product of a query and another row.
ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
