"""SimHash near-duplicates of whole documents by pivot distance tables.

Each document's 64-bit fingerprint gets a row of Hamming distances to reference fingerprints
(pivots). A pair whose distances to any pivot differ by more than the radius cannot be within it
(triangle inequality), so such pairs are discarded by their maximum coordinate difference and only
survivors are verified.

The pivots are of two kinds. Unit pivots (one bit set) and the zero pivot give, for each bit, a
coordinate d(x, unit) - d(x, zero) = 1 - 2 * bit. Within the radius at most RADIUS of these
coordinates differ, so all coordinates of some block are equal: that makes the table an equi-join
key and spares a scan of all pairs (one random pivot alone lets some 57 % of pairs of evenly spread
fingerprints pass and gives no key). All pairs of a bucket, however small, then meet the table of
random pivots: rows stand in order of the first pivot's distance, so a row's partners lie in a
window of it, and the others' largest difference decides who is verified.

Documents of one fingerprint are one class. Classes of so many documents that there can be at most
LARGEST of them are joined back by broadcast, so that no task gets all copies of one text.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal
rows get equal results; null ids take part but are never a component's id unless all its ids are
null; an empty table gives no row; texts of any length are read whole, in parts; for keep_one see
there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm import hamming
from corpuscle.llm.bpe import slices
from corpuscle.llm.components import components
from corpuscle.runtime import Scratch, prepare, shielded

#: Words of a shingle and the seed of its hash.
SHINGLE, SEED = 4, 42
#: Random reference fingerprints, from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Classes joined by broadcast, at most.
LARGEST = 10_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_AT = np.arange(8) * 256


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit set: it is set in over half the hashes of the text's shingles, repeats included."""
    digest, counts, total, kept = xxhash.xxh64_digest, np.zeros((8, 256), np.int64), 0, []
    for part in slices((text or "").encode().lower()):
        words = kept + part.split()  # shingles run on from one part into the next
        n = len(words) - width + 1
        kept = words[-(width - 1) :] if width > 1 else []
        if n < 1:
            continue
        joined = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        starts, ends = (ends - length)[:n], ends[width - 1 :]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())])
        at = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _AT
        counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
        total += n
    if not total:
        return int.from_bytes(digest(b" ".join(kept), SEED), "big") if kept else 0
    set_in = (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_in > total).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid: which text, fp: the 64 bits as a signed long) of every row."""
    prepare(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "rid", "fp"])

    return df.select(doc_id, F.xxhash64(doc_id, text).alias("rid"), text).mapInArrow(run, f"doc_id {kind}, rid long, fp long")


class Forest:
    """Links as a spanning forest: a link between what is joined already is left out."""

    def __init__(self, n: int):
        self.root, self.edges, self.moved = np.arange(n), [], False

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i) > 64 and self.moved:  # so many that all roots are brought up to date at once
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up
            self.moved = False
        some = self.root[i] != self.root[j]
        for a, b in zip(i[some].tolist(), j[some].tolist()):
            u, v = self.find(a), self.find(b)
            if u != v:
                self.root[max(u, v)] = min(u, v)
                self.edges.append((a, b))
                self.moved = True


def pivot_links(bucket: np.ndarray, fp: np.ndarray, radius: int = hamming.RADIUS) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(a, b) of a spanning forest of the links within buckets, and how many pairs came how far."""
    order = np.lexsort((fp, bucket))
    new = np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(fp[order]) != 0)] if len(order) else np.zeros(0, bool)
    bucket, x = bucket[order][new], fp[order][new].view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], bucket))
    bucket, x, table = bucket[order], x[order], np.ascontiguousarray(table[order].T)
    forest, counts = Forest(len(x)), {"met": 0, "kept": 0, "linked": 0}
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(bucket) != 0]), len(bucket)]) if len(bucket) else np.zeros(0, np.int64)
    counts["pairs"] = int((sizes * (sizes - 1) // 2).sum())
    i, lag = np.arange(len(x)), 0
    while len(i):
        lag += 1
        i = i[i + lag < len(x)]
        i = i[(bucket[i + lag] == bucket[i]) & (table[0, i + lag] - table[0, i] <= radius)]  # and no later row either
        j = i + lag
        far = np.zeros(len(i), np.int8)
        for row in table[1:]:
            np.maximum(far, np.abs(row[i] - row[j]), out=far)
        near = np.flatnonzero(far <= radius)
        linked = near[np.bitwise_count(x[i[near]] ^ x[j[near]]) <= radius]
        forest.add(i[linked], j[linked])
        for name, n in (("met", len(i)), ("kept", len(near)), ("linked", len(linked))):
            counts[name] += n
    a, b = (np.array(c, np.int64) for c in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
    return x[a].view(np.int64), x[b].view(np.int64), counts


def pivot_forest(bucket: np.ndarray, fp: np.ndarray, radius: int = hamming.RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    a, b, _ = pivot_links(bucket, fp, radius)
    return [(a, b)] if len(a) else []


def classes(fps: DataFrame, scratch: Scratch, radius: int = hamming.RADIUS) -> DataFrame:
    """(fp, first, n) of every distinct fingerprint: the first document (last if without an id, by
    doc_id, by rid) that links reach from it, itself included; and its own number of documents."""
    spark = fps.sparkSession
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    own = scratch.write(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "classes")
    rows = hamming.buckets(own.select("fp"), own.count(), scratch, radius=radius)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    each = lambda bucket, fp: pivot_forest(bucket, fp, radius)
    edges = scratch.write(hamming.by_bucket(rows, ["fp"], each, "a long, b long", at_once=True), "edges")
    prepare(spark)
    comp = components(edges, scratch).withColumnRenamed("node", "fp")
    grown = comp.join(own, "fp")
    least = grown.groupBy("component").agg(F.min("first").alias("least"))
    linked = grown.join(least, "component").select("fp", "least")
    return own.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"), "n")


def marked(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", radius: int = hamming.RADIUS) -> DataFrame:
    """(doc_id, rid, fp, first) of every row."""
    fps = scratch.write(fingerprints(df, doc_id, text), "fps")
    known = scratch.write(classes(fps, scratch, radius), "first")
    total = fps.count()
    large = known.filter(F.col("n") > max(1, total // LARGEST)).select("fp", F.col("first").alias("_large"))  # at most LARGEST
    out = fps.join(F.broadcast(large), "fp", "left")
    rest = out.filter("_large is null").drop("_large").join(known.select("fp", "first"), "fp")
    return out.filter("_large is not null").withColumnRenamed("_large", "first").unionByName(rest)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = hamming.RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    out = marked(df, scratch or Scratch(df.sparkSession, "simhash"), doc_id, text, radius)
    return out.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df without near duplicates: exactly one row of each component stays.

    It is the row with the smallest doc_id, rows without one last; of rows that share it, the one
    whose text comes first by hash, and of rows equal in both, the first by its other columns.
    """
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    found = scratch.write(marked(df, scratch).select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), ((F.col("first.rid") == F.col("rid")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).alias("stays")), "found")
    gone = found.filter(~F.col("stays")).select("_doc", "_rid").distinct()
    rows, back = shielded(df, "doc_id", "text")
    same = (F.xxhash64("doc_id", "text") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    out = rows.join(gone, same, "left_anti")
    again = scratch.write(found.filter("stays").groupBy("_doc", "_rid").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    if again.isEmpty():
        return out.select(*back)
    one = W.partitionBy("doc_id", "text").orderBy(*[c for c in rows.columns if c.startswith("__own")])
    kept = out.join(again, same, "left_semi").withColumn("_rank", F.row_number().over(one)).filter("_rank = 1")
    return out.join(again, same, "left_anti").select(*back).union(kept.select(*back))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
