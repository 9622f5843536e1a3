"""Quality classifier by co-training on two views of a page.

One classifier sees the text's content (hashed byte trigrams and make-up of the whole text), the
other page metadata (language, source, declared length, and the page's URL where one names the
document); no feature stands in both views. Both start from the labelled documents. In each round
both score all unlabelled documents, and each hands the other up to EXCHANGE documents of either
class of which it is SURE, spread by hash, with its own label for them. Their margins are
calibrated on labelled documents that neither was fitted on, and the calibrated log-odds, less the
prior that both count, are added up to the score of every document.

Fitting takes a bounded, documented sample of labelled documents (LABELLED, those that come first in
hash order); the unlabelled documents are all offered in every round, and what a round exchanges is
EXCHANGE for each view and class, a parameter of the method. Texts are read once: their features,
some half a kilobyte each, are written and read in every round.

Defined results: null and empty texts score like any other (no trigram); null metadata is a value
of its own; null labels teach nothing, and disagreeing labels of a doc_id count as 0; without two
classes every score is the share of label 1, or 0.5 without labels; several URLs of a document
count as the first; documents without a doc_id are scored and never exchanged; equal rows get equal
rows; an empty table gives no row; texts of any length are read whole, in parts; columns other than
doc_id, text, lang, source and n_chars are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpuscle.llm.bpe import slices
from corpuscle.llm.toxicity import held_out
from corpuscle.runtime import Scratch, prepare

LABELLED, EXCHANGE = 6000, 500
ROUNDS, SURE = 4, 0.95
#: Hashed trigrams; make-up; metadata features: language and source, URL.
TRIGRAMS, NAMES, URL = 512, 32, 18
#: Of a log count, as a byte; parts in which what is offered is ranked first.
FINE, PARTS = 16, 64
THRESHOLD = 0.5
STEP = 1 << 20


def content(raw: bytes) -> bytes:
    """Log counts of hashed byte trigrams, a byte each, and the make-up."""
    x, out = np.frombuffer(raw, np.uint8), np.zeros(TRIGRAMS, np.int64)
    for k in range(0, max(0, len(x) - 2), STEP):
        b = x[k : k + STEP + 2].astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
        out += np.bincount(code >> np.uint32(23), minlength=TRIGRAMS)
    return np.round(np.log1p(out) * FINE).astype(np.uint8).tobytes() + layout(raw).tobytes()


def layout(raw: bytes) -> np.ndarray:
    """Counts of the text's make-up that do not depend on which words it has."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size, space = max(1.0, n.sum()), n[9:14].sum() + n[32]
    marks = n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()
    shares = [n[65:91].sum(), n[48:58].sum(), space, marks, n[44] + n[46], n[128:].sum()]
    words = again = different = 0
    for part in slices(raw):
        w = part.split()
        words, again, different = words + len(w), again + sum(map(eq, w, w[1:])), different + len(set(w))
    words = max(1, words)
    repeats = [np.sqrt(again / words), different / words, np.sqrt(different / words)]
    return np.array([np.log1p(n.sum()), np.log1p(n[10]), np.log1p(size / (1 + space)), *(np.sqrt(x / size) for x in shares), *repeats], np.float32)


def content_view(made: list[bytes]) -> np.ndarray:
    """The first view: trigrams scaled to unit length, then the make-up."""
    raw = np.frombuffer(b"".join(made), np.uint8).reshape(len(made), -1)
    v = raw[:, :TRIGRAMS].astype(np.float32) / FINE
    v /= np.maximum(1e-6, np.sqrt((v * v).sum(axis=1, keepdims=True)))
    return np.c_[v, np.ascontiguousarray(raw[:, TRIGRAMS:]).view(np.float32)]


def _hashed(out: np.ndarray, text: str) -> None:
    out[zlib.crc32(text.encode()) % len(out)] += 1


def metadata(lang: str | None, source: str | None, n_chars: int | None, url: str | None) -> np.ndarray:
    names, page = np.zeros(NAMES, np.float32), np.zeros(URL, np.float32)
    _hashed(names, f"lang {lang}")
    _hashed(names, f"source {source}")
    if url is not None:
        page[0], page[1] = 1, url.count("?") + url.count("&")
        for part in re.findall(r"[a-z]+", url.lower()):
            _hashed(page[2:], part)
    return np.concatenate([[np.log1p(max(0, n_chars or 0))], names, page]).astype(np.float32)


def metadata_view(lang: list, source: list, n_chars: list, url: list) -> np.ndarray:
    return np.stack([metadata(*r) for r in zip(lang, source, n_chars, url, strict=True)])


class Linear:
    """Logistic regression on standardised features, by accelerated gradient steps."""

    def __init__(self, x: np.ndarray):
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w, self.b = np.zeros(x.shape[1], np.float32), 0.0
        self.slope, self.shift = 1.0, 0.0

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8).astype(np.float32)

    def fit(self, z: np.ndarray, y: np.ndarray, steps: int = 80, l2: float = 1e-2) -> None:
        n, y = len(y), y.astype(np.float32)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum())).astype(np.float32)
        v = np.ones(z.shape[1], np.float32) / np.sqrt(z.shape[1])
        for _ in range(6):  # the largest curvature gives the step
            v = z.T @ (weight * (z @ v))
            top = float(np.sqrt(v @ v)) or 1.0
            v /= top
        rate = 1 / (0.3 * top + l2)
        ahead, b_ahead = self.w.copy(), self.b
        for k in range(steps):
            gap = weight * (1 / (1 + np.exp(-np.clip(z @ ahead + b_ahead, -30, 30))) - y)
            w, b = ahead - rate * (z.T @ gap + l2 * ahead), b_ahead - min(1.0, rate) * float(gap.sum())
            ahead, b_ahead = w + k / (k + 3) * (w - self.w), b + k / (k + 3) * (b - self.b)
            self.w, self.b = w, b

    def margin(self, z: np.ndarray) -> np.ndarray:
        return z @ self.w + self.b

    def calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Log-odds of label 1 as a line in the margin (Newton steps, with Platt's targets)."""
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, c = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            g, h = np.array([((p - t) * m).sum(), (p - t).sum()]), p * (1 - p) + 1e-6
            hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
            da, dc = np.linalg.solve(hess, g)
            a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
        self.slope, self.shift = max(0.05, float(a)), float(c)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(self.scale(x)) + self.shift, -12, 12)


class Pair:
    """Both classifiers while they are trained: views and labels of the labelled documents, and what
    each has been handed since. Every fifth labelled document calibrates and is never fitted on."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fit_at, self.check = np.arange(len(y)) % 5 > 0, np.arange(len(y)) % 5 == 0
        self.able = all(len(set(y[i].tolist())) == 2 for i in (self.fit_at, self.check))
        self.views, self.y = views, y
        self.handed: list[list[tuple[np.ndarray, int]]] = [[], []]
        if self.able:
            self.models = [Linear(x[self.fit_at]) for x in views]

    def fit(self) -> None:
        for m, x, more in zip(self.models, self.views, self.handed, strict=True):
            rows = np.vstack([x[self.fit_at], *[v[None, :] for v, _ in more]])
            m.fit(m.scale(rows), np.r_[self.y[self.fit_at], [label for _, label in more]])
            m.calibrate(m.margin(m.scale(x[self.check])), self.y[self.check])


def sure(log_odds: np.ndarray) -> np.ndarray:
    """1 or 0 where a classifier is sure of that label, else -1."""
    most = np.log(SURE / (1 - SURE))
    return np.where(log_odds >= most, 1, np.where(log_odds <= -most, 0, -1))


def _urls(pages: DataFrame) -> DataFrame:
    """(doc_id, url) of the document that each page's URL names by the number after its language."""
    found = F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]{2}/([0-9]{1,18})(?:[^0-9].*)?$", 1)
    named = pages.filter(found != "").select(found.cast("long").alias("doc_id"), "url")
    return named.groupBy("doc_id").agg(F.min("url").alias("url"))


META = ["lang", "source", "n_chars", "url"]


def features(docs: DataFrame, labels: DataFrame, pages: DataFrame, label: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, made, url, y: of learnable labels, free: without any label row)."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), "lang", "source", "n_chars", "text")
    names = rows.columns[:4]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [content(x or b"") for x in b.column(4).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.binary())], names=[*names, "made"])

    made = rows.mapInArrow(run, f"{kinds}, made binary")
    learnable = F.col(label).isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(learnable, (F.col(label) > 0).cast("int"))).alias("y"), F.lit(True).alias("_known"))
    side = known.join(_urls(pages), "doc_id", "full_outer")
    out = made.join(side, "doc_id", "left")
    return out.withColumn("free", F.col("_known").isNull() & F.col("doc_id").isNotNull()).drop("_known")


def _order() -> list:
    return [F.xxhash64(F.lit(6), "doc_id"), F.col("doc_id"), F.col("made")]


def offers(rows: DataFrame, models: list[Linear], taken: list[set]) -> DataFrame:
    """Of the free rows those that one view hands the other: (view that learns, label, rank, the
    row's columns), EXCHANGE of each view and class by hash, without those it was handed before.
    Each task passes on EXCHANGE of each at most."""
    spark = rows.sparkSession
    kept = spark.sparkContext.broadcast((models, taken))
    free = rows.filter("free").select("doc_id", *META, "made", F.xxhash64(F.lit(6), "doc_id").alias("spread"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in free.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), known = kept.value
        best: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, *meta, made, spread = (c.to_pylist() for c in batch.columns)
            odds = [a.log_odds(content_view(made)), b.log_odds(metadata_view(*meta))]
            for view in (0, 1):
                says = sure(odds[1 - view])
                for label in (0, 1):
                    held = best.setdefault((view, label), [])
                    held += [(spread[k], ids[k], made[k], *(m[k] for m in meta)) for k in np.flatnonzero(says == label).tolist() if ids[k] not in known[view]]
                    held.sort(key=lambda r: r[:3])
                    del held[EXCHANGE:]
        found = [(view, label, *r) for (view, label), held in best.items() for r in held]
        if found:
            view, label, spread, ids, made, *meta = zip(*found, strict=True)
            cols = [view, label, ids, *meta, made, spread]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    schema = f"view int, label int, {kinds}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    order = ["spread", "doc_id", "made"]
    part = F.pmod(F.xxhash64("doc_id", "made"), F.lit(PARTS)).alias("part")  # so that no task ranks what all tasks pass on
    first = F.row_number().over(W.partitionBy("view", "label", "part").orderBy(*order))
    rank = F.row_number().over(W.partitionBy("view", "label").orderBy(*order))
    some = free.mapInArrow(run, schema).select("*", part).withColumn("rank", first).filter(F.col("rank") <= EXCHANGE)
    return some.withColumn("rank", rank).filter(F.col("rank") <= EXCHANGE).drop("part")


def train(rows: DataFrame, scratch: Scratch) -> Pair:
    """The pair after ROUNDS rounds over rows from features(). What reaches the driver is bounded by
    LABELLED and EXCHANGE."""
    known = sorted(rows.filter("y is not null").orderBy(*_order()).limit(LABELLED).collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["made"]))
    views = [content_view([r["made"] for r in known]), metadata_view(*([r[c] for r in known] for c in META))] if known else [np.zeros((0, 1))] * 2
    pair = Pair(views, np.array([r["y"] for r in known], np.int64))
    if not pair.able:
        return pair
    taken: list[set] = [set(), set()]
    for _ in range(ROUNDS):
        pair.fit()
        for r in sorted(offers(rows, pair.models, taken).collect(), key=lambda r: (r["view"], r["label"], r["rank"])):
            x = content_view([r["made"]])[0] if r["view"] == 0 else metadata(*(r[c] for c in META))
            pair.handed[r["view"]].append((x, r["label"]))
            taken[r["view"]].add(r["doc_id"])
    pair.fit()
    return pair


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame, scratch: Scratch, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, content, metadata, score, predicted) of every document."""
    spark = prepare(docs.sparkSession)
    rows = scratch.write(features(docs, labels, pages.select("url"), label), "features")
    pair = train(rows, scratch)
    if not pair.able:
        out = rows.select("doc_id", F.lit(0.0).alias("content"), F.lit(0.0).alias("metadata"), F.lit(pair.share).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    kept = spark.sparkContext.broadcast(pair.models)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = kept.value
        for batch in batches:
            if batch.num_rows:
                *meta, made = (c.to_pylist() for c in batch.columns[1:])
                odds = [a.log_odds(content_view(made)), b.log_odds(metadata_view(*meta))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(float)) for x in odds)], names=["doc_id", "content", "metadata"])

    odds = F.col("content") + F.col("metadata") - F.lit(float(np.log(pair.share / (1 - pair.share))))
    out = rows.select("doc_id", *META, "made").mapInArrow(run, f"doc_id {kind}, content double, metadata double").withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "pages"))
    out = score(docs, labels, pages.select("url"), Scratch(spark, "op6"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content", "metadata", "score", "predicted")
