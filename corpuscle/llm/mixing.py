"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slots are numbered; the golden-ratio point of a slot, frac(0.5 + i * 0.618...), falls into one
interval of the sources' cumulative targets, which gives the slot its source. A slot's rank among
its source's slots names the block of equal tokens it takes from that source's shuffled stream:
the source's documents in hash order, repeated as often as a target may need.

A source whose target is below FINE blocks would come out far from it, or with nothing, in whole
blocks of all sources. It takes its target to the word, in blocks of its own at even slots, the
last of them partial.

Prefix sums and ranks are made in two levels (about the square root of a source's rows each), so
no task holds a whole source, however large. Points meet sources by grid cell, an equi-join.

Defined results: a null text has size 0; a null source is a source of its own, last in order; the
order of a document depends on its doc_id alone, so reruns agree; equal rows may take different
shares of what the mix takes; an input without words takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.runtime import Scratch, shielded

GOLDEN = 0.6180339887498949
#: Slots for each source on average, and the most tokens of a block.
SLOTS, LARGEST_BLOCK = 4096, 1 << 20
#: Blocks of its target below which a source is cut finer.
FINE = 256
#: Slots that are ranked together.
CHUNK = 1 << 14
#: Rows of (document, copies) up to which they are broadcast: some 20 MB at most.
BROADCAST_ROWS = 250_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, sid, source_size, n, target) of every source: weights repeat in order of source;
    targets share `share` of all sizes by weight, none above `most` times its source's size."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    own = own.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    own = own.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    # the sources that reach their cap are the first in order of cap / weight; the rest share by weight
    rest = W.orderBy(F.col("cap") / F.col("w"), "sid")
    before = rest.rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    own = own.withColumn("open", F.sum("w").over(rest.rowsBetween(W.currentRow, W.unboundedFollowing)))
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everyone) - F.col("capped")) / F.col("open")
    own = own.withColumn("level", level)
    reached = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(everyone)
    target = F.least(F.col("cap"), F.col("w") * F.coalesce(reached["level"], F.lit(math.inf)))
    return own.select("source", "sid", "source_size", "n", target.alias("target"))


def schedule(sources: DataFrame, n_sources: int, total: float, block: int) -> DataFrame:
    """(sid, block_no, slot): which slot takes each block that the mix takes."""
    spark = sources.sparkSession
    slots = max(1, round(total / block))
    cells = max(1024, 4 * n_sources)
    upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    high = F.sum("target").over(upto) / F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    bounds = sources.filter("target > 0").select("sid", high.alias("high"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0.0)))
    last = F.lead("sid").over(W.orderBy("sid")).isNull()
    bounds = bounds.withColumn("high", F.when(last, F.lit(2.0)).otherwise(F.col("high")))
    to = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), to)))
    point = F.lit(0.5) + F.col("slot") * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    placed = points.join(bounds, "cell").filter("u >= low and u < high").select("sid", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["sid", "chunk"])
    return ranked.select("sid", (F.col("before") + F.col("rank")).alias("block_no"), "slot")


def _planned(sources: DataFrame, n_sources: int, total: float, block: int) -> DataFrame:
    """The schedule, with the own blocks of the sources that have a limit in place of theirs."""
    coarse = schedule(sources, n_sources, total, block).join(sources.filter("limit is null").select("sid"), "sid", "left_semi")
    n = F.ceil(F.col("limit") / F.col("block"))
    own = sources.filter("limit > 0").select("sid", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block_no"))
    slot = F.floor((F.col("block_no") + 0.5) * max(1, round(total / block)) / F.col("n"))
    return coarse.union(own.select("sid", "block_no", slot.alias("slot")))


def positions(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with its source's columns, a unique key (sid, part, nth) and the word at which the
    document begins in its source's shuffled stream."""
    at = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    parts = F.ceil(F.sqrt("n")).cast("long")
    docs = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    docs = docs.withColumn("part", F.floor(at * parts / F.lit(float(1 << 32))))
    sums = docs.groupBy("sid", "part").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("sid", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("sid", "part").orderBy("_order", "doc_id", "size")
    docs = docs.withColumn("nth", F.row_number().over(inner))
    docs = docs.withColumn("begin", F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return docs.join(sums, ["sid", "part"]).withColumn("begin", F.col("begin") + F.col("_base")).drop("_base")


def mix(df: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, rid, source, size, source_size, target, taken) of every row of df."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = df.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "source", n_words(F.col("text")).alias("size"), order.alias("_order"))
    sized = scratch.write(sized, "sized")
    sources = scratch.write(targets(sized, weights, share, most), "sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = int(min(LARGEST_BLOCK, max(1, math.ceil(total / (SLOTS * max(1, n_sources))))))
    fine = F.col("target") < FINE * block
    sources = sources.withColumn("block", F.when(fine, F.greatest(F.lit(1), F.ceil(F.col("target") / FINE))).otherwise(block).cast("long"))
    sources = sources.withColumn("limit", F.when(fine, F.ceil(F.col("target") - 1e-9)))
    docs = positions(sized, sources)
    key = ["sid", "part", "nth", "doc_id", "rid", "source", "size", "source_size", "target"]
    rounds = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))
    laps = docs.withColumn("lap", rounds).withColumn("begin", F.col("begin") + F.col("lap") * F.col("source_size"))
    end = F.col("begin") + F.col("size")
    blocks = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((end - 1) / F.col("block")))
    pieces = laps.withColumn("end", end).withColumn("block_no", F.explode(F.when(F.col("size") > 0, blocks).otherwise(F.array(F.lit(-1).cast("long")))))
    part = F.least("end", (F.col("block_no") + 1) * F.col("block"), "limit") - F.greatest("begin", F.col("block_no") * F.col("block"))
    pieces = pieces.withColumn("words", F.greatest(F.lit(0), part))
    plan = _planned(sources, n_sources, total, block) if total > 0 else df.sparkSession.range(0).selectExpr("int(id) sid", "id block_no", "id slot")
    got = pieces.join(plan, ["sid", "block_no"], "left")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).cast("long")
    return got.groupBy(*key).agg(taken.alias("taken")).drop("sid", "part", "nth")


def mixed(df: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """The rows of df that the mix takes, each once for every lap in which any of its words is
    taken; boundary documents stay whole. Rows without words go."""
    scratch = scratch or Scratch(df.sparkSession, "mix")
    copies = mix(df, scratch, **how).groupBy("rid").agg(F.ceil(F.avg(F.ceil(F.try_divide("taken", "size")))).cast("int").alias("_copies"))
    copies = scratch.write(copies.filter("_copies > 0").withColumnRenamed("rid", "_rid"), "copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    rows, back = shielded(df, "doc_id", "text")
    out = rows.withColumn("_rid", F.xxhash64("doc_id", "text")).join(copies, "_rid")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*back)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs, Scratch(spark, "op8"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same steps over whole tables at once.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
own AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source),
caps AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((sid - 1) % 3)] AS w, 2.0::DOUBLE * source_size AS cap FROM own),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
src AS (
  SELECT source, sid, source_size, least(cap, w * coalesce((SELECT arg_min(level, cap / w) FROM levels WHERE level * w <= cap), 'inf'::DOUBLE)) AS target FROM levels),
size_of AS (SELECT greatest(1, ceil(sum(target) / ({SLOTS} * count(*))))::BIGINT AS b, sum(target) AS total FROM src),
bounds AS (
  SELECT sid, sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high,
         lead(sid) OVER (ORDER BY sid) IS NULL AS final FROM src WHERE target > 0),
edges AS (SELECT sid, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low, CASE WHEN final THEN 2 ELSE high END AS high FROM bounds),
slots AS (
  SELECT i, p - floor(p) AS u FROM (SELECT i, 0.5::DOUBLE + i * {GOLDEN}::DOUBLE AS p FROM range((SELECT round(total / b)::BIGINT FROM size_of)) r(i))),
plan AS (SELECT sid, count(*) AS n FROM slots JOIN edges ON u >= low AND u < high GROUP BY sid),
pos AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.sid,
         coalesce(sum(s.size) OVER (PARTITION BY c.sid ORDER BY s.o, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM sized s JOIN src c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, coalesce(n, 0) * b) - a)
        + greatest(0, least(a + size + source_size, coalesce(n, 0) * b) - a - source_size))::BIGINT AS taken
FROM pos LEFT JOIN plan USING (sid) CROSS JOIN size_of
"""
