"""Interaction audit of five document filters by direct replay of all their 120 orders.

One pass over the texts gives every document five flags (which filters it fails). Each document's
flags are then crossed with a broadcast table of the 120 orders, its first failing step in each is
computed, the five steps are exploded and counted by part, order and step. The crossed rows hold
two small numbers and never meet a shuffle: partial sums of each task do, 600 rows a part.

"Identical to an earlier document" is told by a 256-bit digest of the whole text: texts that occur
once need no join, the others are joined to their smallest doc_id from a written table, so that a
text with very many copies is split like any skewed join.

Defined results: a null text is empty, and empty texts are identical to each other; a null part is
the empty string; a row without a doc_id is never a copy and makes none, and has no labels; rows
equal in doc_id and text are all first if any is; a document labelled twice counts as toxic or good
if any label says so; parts without documents have no rows, so an empty table gives none; columns
other than the used ones are ignored; the words of one text are held in a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.runtime import Scratch, table

FILTERS = "ABCDE"
#: Least words, least share of distinct words, largest share of capitals (both in per cent).
WORDS, DISTINCT, CAPITALS = 200, 50, 3


def _upper(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))


def flags(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of every row; a flag is true where its filter fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    read = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return read.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (n < WORDS).alias("A"), (100 * distinct < DISTINCT * n).alias("B"),
        (100 * _upper(F.col("text")) > CAPITALS * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    )


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, bits: the flag of the filter of each step) of the 120 permutations."""
    return spark.createDataFrame([("".join(FILTERS[k] for k in p), [1 << k for k in p]) for p in permutations(range(5))], "filter_order string, bits array<int>")


def flagged(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "lang") -> DataFrame:
    """(part, failed: the flags as bits, good, toxic) of every row."""
    own = scratch.write(flags(docs, part), "flags")
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    all_ = own.join(scratch.write(copies, "copies"), "digest", "left").join(scratch.write(marks, "marks"), "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("smallest"), F.lit(False))
    bits = [F.when(F.col(c) if c != "E" else copy, 1 << k).otherwise(0) for k, c in enumerate(FILTERS)]
    return all_.select("part", sum(bits[1:], bits[0]).alias("failed"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def replay(rows: DataFrame) -> DataFrame:
    """Counts of every part, order and step of (part, failed, good, toxic)."""
    crossed = rows.crossJoin(F.broadcast(orders(rows.sparkSession)))  # 120 rows, whatever the input
    first = F.lit(6)
    for k in reversed(range(5)):
        first = F.when(F.col("failed").bitwiseAND(F.col("bits")[k]) > 0, k + 1).otherwise(first)
    steps = crossed.select("*", first.alias("first")).select("*", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    removed = F.col("first") == F.col("step")
    counted = steps.groupBy("part", "filter_order", "step", "bit").agg(
        count(F.col("first") > F.col("step"), "kept"), count(removed, "removed"),
        count((F.col("first") < F.col("step")) & (F.col("failed").bitwiseAND(F.col("bit")) > 0), "redundant"),
        count(F.col("failed") == F.col("bit"), "unique_fails"), count(removed & F.col("good"), "good_lost"), count(removed & F.col("toxic"), "toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return replay(flagged(docs, labels, scratch or Scratch(docs.sparkSession, "audit"), part))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
crossed AS (
  SELECT part, good, toxic, f, o, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: f[o[s]])), 6) AS first FROM flags, orders),
counted AS (
  SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, k AS step, o[k] AS letter,
    count(*) FILTER (first > k) AS kept, count(*) FILTER (first = k) AS removed, count(*) FILTER (first < k AND f[o[k]]) AS redundant,
    count(*) FILTER (f[o[k]] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (first = k AND good = 1) AS good_lost, count(*) FILTER (first = k AND toxic = 1) AS toxic_lost
  FROM crossed, letters GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
