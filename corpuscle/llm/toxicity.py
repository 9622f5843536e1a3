"""Toxicity by the nearest labelled examples, over an exact TF-IDF cosine.

Terms are the words and word beginnings (PREFIXES bytes) that two or more examples hold, whatever
their labels: the full vocabulary of the sample, words of both classes. A term's weight is its IDF
over all documents, as a share of the largest possible one, times its relevance G / (G + HALF), G
being the log-likelihood ratio of its presence against the label among the examples. Plain IDF
alone ranks examples by chance matches of rare words (figures in the README); the relevance keeps
every term and damps those that tell nothing. Weights below FLOOR count nothing.

Examples are a bounded, documented sample: the SAMPLE learnable labelled documents that come first
in hash order, of near copies among them one. They stand in an inverted index whose posting lists
are cut into blocks of BLOCK examples with the largest weight of each block, so a search visits
blocks by descending bound and stops when no block can reach the K-th score; its result is exact,
ties going to the earlier example. Votes are weighted by closeness, smoothed by the base rate, and
calibrated by isotonic regression on the examples' own leave-one-out votes.

Defined results: null and empty texts, and texts without a term, get the calibrated rate of the
examples without a term and no evidence; null labels teach nothing; if labels of a doc_id disagree,
toxic wins; without any learnable label, or with one class only, every score is 0; equal rows get
equal rows; long texts are counted whole, in parts; columns of the input pass through unless an
output has the same name, which then replaces it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.bpe import REMEMBERED, _mapped, slices
from corpuscle.llm.hamming import forest, linked
from corpuscle.llm.simhash_dedup import fingerprints
from corpuscle.runtime import Scratch, prepare, shielded

#: Labelled documents taken as examples, at most; examples that a term needs, at least; G at which
#: a term counts half; weight (of 1) below which it counts nothing; bytes of word beginnings.
SAMPLE, LEAST, HALF, FLOOR, PREFIXES = 8_000, 2, 20.0, 0.05, (4, 5, 6)
#: Examples of a block of the index, neighbours that vote, weight of the base rate in a vote.
BLOCK, K, PRIOR = 2048, 16, 1.0
THRESHOLD = 0.3
#: Differing bits of a SimHash up to which two examples count as copies of one text.
COPIES = 10
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(raw: bytes) -> Iterator[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: all but other ASCII than letters and digits."""
    return chain.from_iterable(part.translate(_FOLD).split() for part in slices(raw))


def beginnings(word: bytes) -> list[bytes]:
    """The terms that a word stands for besides itself; the mark keeps them apart from words."""
    return [word[:k] + b"*" for k in PREFIXES if len(word) > k]


class Vocabulary:
    """Terms by number, and the counts of a text's terms."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.seen: set[bytes] = set()
        self.memo: dict[bytes, tuple[int, ...]] = {}  # of the seen words that have a term

    def counts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(terms in order, how often each occurs)."""
        n = Counter(tokens(raw))
        if len(self.seen) > REMEMBERED:
            self.seen, self.memo = set(), {}
        new = [word for word in n if word not in self.seen]
        for word in new:
            if found := tuple(self.number[t] for t in (word, *beginnings(word)) if t in self.number):
                self.memo[word] = found
        self.seen.update(new)
        got: dict[int, int] = {}
        for word in self.memo.keys() & n.keys():
            for t in self.memo[word]:
                got[t] = got.get(t, 0) + n[word]
        at = np.array(sorted(got), np.int64)
        return at, np.array([got[t] for t in at.tolist()], np.float64)


class Index:
    """Examples as unit vectors in posting lists with a largest weight for each block.

    weight: of each term; examples: (terms in order, counts); labels: 0 or 1.
    """

    def __init__(self, weight: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        self.weight, self.y = np.asarray(weight, float), np.array(labels, float)
        self.blocks = max(1, -(-len(examples) // BLOCK))
        self.empty = np.array([not len(t) for t, _ in examples], bool)
        size = np.array([len(t) for t, _ in examples], np.int64)
        units = [self.unit(*x) for x in examples]
        term = np.concatenate([t for t, _ in examples]) if len(examples) else np.zeros(0, np.int64)
        value = np.concatenate(units) if len(examples) else np.zeros(0)
        example = np.repeat(np.arange(len(examples)), size)
        order = np.lexsort((example, term))
        term, self.example, self.value = term[order], example[order].astype(np.int32), value[order]
        cell = term * self.blocks + self.example // BLOCK
        cells = len(self.weight) * self.blocks
        self.cuts = np.searchsorted(cell, np.arange(cells + 1)).astype(np.int32)
        most = np.zeros(cells, np.float32)
        np.maximum.at(most, cell, self.value.astype(np.float32))
        self.most = most.reshape(len(self.weight), self.blocks)
        self.rate = float(self.y.mean()) if len(labels) else 0.0
        self.steps = np.array([[0.0, self.rate]])
        self.none = self.rate

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = K, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, and it; ties to the earlier example."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        w = self.unit(terms, counts)
        bound = (w @ self.most[terms]) * (1 + 1e-5)  # most is rounded to single precision
        best_s, best_e = np.zeros(0), np.zeros(0, np.int64)
        for b in np.lexsort((np.arange(self.blocks), -bound)).tolist():
            if bound[b] <= 0 or len(best_s) == k and bound[b] < best_s[-1]:
                break
            cell = terms * self.blocks + b
            start = self.cuts[cell].astype(np.int64)
            n = self.cuts[cell + 1] - start
            end = np.cumsum(n)
            at = np.repeat(start - end + n, n) + np.arange(end[-1])
            score = np.bincount(self.example[at] - b * BLOCK, np.repeat(w, n) * self.value[at], BLOCK)
            if 0 <= skip - b * BLOCK < BLOCK:
                score[skip - b * BLOCK] = 0
            some = np.flatnonzero(score > (best_s[-1] * (1 - 1e-9) if len(best_s) == k else 0))
            if len(some) > 4 * k:  # the others cannot be among the k best
                some = some[score[some] >= np.partition(score[some], -k)[-k] * (1 - 1e-9)]
            if len(some):
                s, e = np.r_[best_s, np.round(score[some], 12)], np.r_[best_e, some + b * BLOCK]
                order = np.lexsort((e, -s))[:k]
                best_s, best_e = s[order], e[order]
        return best_e, best_s

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        w = 1 / (1.02 - s)
        return float((w @ self.y[e] + PRIOR * self.rate) / (w.sum() + PRIOR))

    def calibrate(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic steps from leave-one-out votes to the share of label 1."""
        if self.empty.any():
            self.none = (self.y[self.empty].sum() + self.rate) / (self.empty.sum() + 1)
        votes = sorted((self.vote(*self.nearest(*v, skip=k)), self.y[k]) for k, v in enumerate(examples) if not self.empty[k])
        pools: list[list[float]] = []  # [sum of labels, count, lowest vote]
        for v, y in votes:
            if pools and pools[-1][2] == v:
                pools[-1][0] += y
                pools[-1][1] += 1
            else:
                pools.append([y, 1, v])
        merged: list[list[float]] = []
        for p in pools:
            merged.append(p)
            while len(merged) > 1 and merged[-2][0] * merged[-1][1] >= merged[-1][0] * merged[-2][1]:
                y, n, _ = merged.pop()
                merged[-1][0] += y
                merged[-1][1] += n
        if merged:
            self.steps = np.array([[v, (y + self.rate) / (n + 1)] for y, n, v in merged])

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        if not len(terms):
            return self.none, []
        e, s = self.nearest(terms, counts)
        raw = self.vote(e, s) if len(e) else self.rate
        step = self.steps[max(0, int(np.searchsorted(self.steps[:, 0], raw, side="right")) - 1), 1]
        return float(min(1.0, max(0.0, 0.95 * step + 0.05 * raw))), e[:3].tolist()


def relevance(c: Column, p: Column, n: int, pos: int) -> Column:
    """G / (G + HALF) of a term that c of n examples hold, p of the pos with label 1."""
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    rate = pos / n
    g = 2 * (part(p, c * rate) + part(c - p, c * (1 - rate)) + part(pos - p, (n - c) * rate) + part((n - pos) - (c - p), (n - c) * (1 - rate)))
    return F.greatest(g, F.lit(0.0)) / (F.greatest(g, F.lit(0.0)) + HALF)


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic", sample: int = SAMPLE, learnable: Column | None = None) -> tuple[Vocabulary, Index, list]:
    """(terms, index, the examples' doc_ids), fitted on docs (doc_id, text) and labels (doc_id, label).

    What reaches the driver is bounded by the texts of the sample, whatever the size of docs.
    """
    spark = prepare(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id")) if learnable is None else learnable)
    known = known.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    rows = scratch.write(rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text")), "sample")
    kept = _distinct_texts([(r["doc_id"], r["fp"]) for r in fingerprints(rows).collect()])
    kept = spark.createDataFrame([(i,) for i in kept], rows.select("doc_id").schema)
    rows = rows.join(F.broadcast(kept), "doc_id")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n or not pos or pos == n:
        return Vocabulary([]), Index(np.zeros(0), [], []), []

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, x in zip(b.column(0), b.column(1).cast(pa.binary())):
                words = set(tokens(x.as_py() or b""))
                terms = list(words.union(*map(beginnings, words)))
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()] * len(terms), pa.int32()), pa.array(terms, pa.binary())], names=["y", "t"])

    total = docs.count()
    stats = rows.select("_y", "text").mapInArrow(held, "y int, t binary").groupBy("t").agg(F.count("*").alias("c"), F.sum("y").alias("p")).filter(F.col("c") >= LEAST)
    stats = stats.withColumn("r", relevance(F.col("c"), F.col("p"), n, pos))
    largest = math.log(1 + total)
    stats = stats.filter(F.col("r") * (largest - F.log1p("c")) >= FLOOR * largest)  # no IDF can be higher
    found = stats.select("t", "r").toArrow().sort_by("t")
    vocabulary = Vocabulary(found.column("t").to_pylist())
    shared = spark.sparkContext.broadcast(vocabulary)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value.number), np.int64)
        for b in batches:
            for x in b.column(0).cast(pa.binary()):
                seen[shared.value.counts(x.as_py() or b"")[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["t", "n"])

    df = np.zeros(len(found), np.int64)
    got = docs.select("text").mapInArrow(spread, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df[got.column("t").to_numpy()] = got.column("n").to_numpy()
    weight = found.column("r").to_numpy() * np.log((1 + total) / (1 + df)) / largest
    keep = weight >= FLOOR
    vocabulary = Vocabulary([t for t, k in zip(vocabulary.number, keep.tolist(), strict=True) if k])
    weight = weight[keep]
    shared.destroy()
    del found, got, df
    shared = spark.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shared.value.counts(x.as_py() or b"") for x in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in made], pa.list_(pa.int64())), pa.array([c for _, c in made], pa.list_(pa.float64()))], names=["doc_id", "y", "t", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rows.select("doc_id", "_y", "text").mapInArrow(vectors, f"doc_id {kind}, y int, t array<long>, n array<double>").toArrow()
    examples = [(np.asarray(t.values), np.asarray(c.values)) for t, c in zip(table.column("t"), table.column("n"), strict=True)]
    ids, y = table.column("doc_id").to_pylist(), table.column("y").to_pylist()
    shared.destroy()
    # examples with the same leading term stand together, which keeps the bounds of blocks apart
    lead = [int(t[np.argmax(weight[t])]) if len(t) else -1 for t, _ in examples]
    order = sorted(range(len(ids)), key=lambda k: (lead[k], hash_order(ids[k]), ids[k]))
    examples = [examples[k] for k in order]
    index = Index(weight, examples, [y[k] for k in order])
    index.calibrate(examples)
    return vocabulary, index, [ids[k] for k in order]


def _distinct_texts(found: list[tuple]) -> list:
    """doc_ids of the bounded sample, one of each group of near copies: copies would make the chance
    words of one text look like signs of its label."""
    found = sorted(found, key=lambda r: (hash_order(r[0]), r[0]))
    x = np.array([fp for _, fp in found], np.int64).view(np.uint64)
    near = np.flatnonzero(linked(x, COPIES)) if len(x) else np.zeros(0, np.int64)
    edges = forest(x[near], lambda i, others: np.bitwise_count(x[near][others] ^ x[near][i]) <= COPIES)
    gone = {int(near[j]) for _, j in edges}  # the root of each tree is its first in hash order
    return [i for k, (i, _) in enumerate(found) if k not in gone]


def hash_order(doc_id) -> int:
    """Spreads examples over blocks, whatever the order of their ids."""
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id).encode(), 3)


def scored(df: DataFrame, vocabulary: Vocabulary, index: Index, ids: list, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and evidence (doc_ids of up to three nearest examples)."""
    prepare(df.sparkSession)
    kept = df.sparkSession.sparkContext.broadcast((vocabulary, index, ids))  # bounded by the texts of the sample
    kind, arrow = (T.StringType(), pa.string()) if any(isinstance(i, str) for i in ids) else (T.LongType(), pa.int64())

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        terms, own, names = kept.value
        scores, evidence = [], []
        for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
            s, e = own.score(*terms.counts(x.as_py() or b""))
            scores.append(s)
            evidence.append([names[k] for k in e])
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, pa.list_(arrow))]

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(kind))]
    return _mapped(df, added, make)


def drop_toxic(df: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df without the rows predicted toxic; the examples are those of df that labels mark."""
    learnt = learn(df, labels, scratch or Scratch(df.sparkSession, "toxicity"))
    rows, back = shielded(df, "text")
    return scored(rows, *learnt).filter("predicted = 0").select(*back)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learnt = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "op3"))
    out = scored(docs, *learnt)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
