"""Ranks, pages, neighbours, top-k and deterministic samples. Every order ends in a total tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.identity import anchor
from corpuscle.functions.routing import priority_rank

PAGE = 20


def pages(df: DataFrame, by: list[str], order: list[Column], size: int = PAGE) -> DataFrame:
    """Position and page of each row within its day."""
    out = df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out.withColumn("page", F.ceil(F.col("position") / size).cast("int"))


def anchors(df: DataFrame, day: str, key: str, position: str) -> DataFrame:
    """A fragment name for each row; collisions within a day get a hash of the key, and
    equal ones among those an ordinal."""
    out = df.withColumn("_a", anchor(F.col(key)))
    n = F.count("*").over(W.partitionBy(day, "_a"))
    out = out.withColumn("_b", F.when(n > 1, F.concat("_a", F.lit("--"), F.substring(F.sha1(F.col(key).cast("binary")), 1, 8))).otherwise(F.col("_a")))
    nth = F.row_number().over(W.partitionBy(day, "_b").orderBy(position))
    return out.withColumn("anchor", F.when(nth > 1, F.concat("_b", F.lit("-"), nth.cast("string"))).otherwise(F.col("_b"))).drop("_a", "_b")


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def day_top_paper(df: DataFrame, day: str, priority: str, position: str) -> DataFrame:
    """The first High of a day, else its first Medium."""
    rank = priority_rank(F.col(priority))
    return first_of(df.filter(F.col(priority).isin("High", "Medium")), [day], [rank, F.col(position)]).drop("rank")


def neighbours(df: DataFrame, date: str) -> DataFrame:
    """Each distinct date with the one before and after. Dates are few; they share a window."""
    w = W.orderBy(date)
    return df.select(date).filter(F.col(date).isNotNull()).distinct().select(date, F.lag(date).over(w).alias("prev_date"), F.lead(date).over(w).alias("next_date"))


def allocation(sizes: DataFrame, stratum: str, n: int, least: int = 2) -> DataFrame:
    """(stratum, size, k): `least` each, the rest in proportion by largest remainder, capped by
    what a stratum has; one pass over remainders, ties in order of stratum. A row per stratum."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.withColumn("base", F.least(F.lit(least), F.col("size"))).withColumn("room", F.col("size") - F.col("base"))
    s = s.withColumn("left", F.greatest(F.lit(0), F.lit(n) - F.sum("base").over(every)))
    s = s.withColumn("whole", F.sum(F.when(F.col("room") > 0, F.col("size")).otherwise(0)).over(every))
    # quota = left * size / whole, as an exact quotient and remainder
    share = F.when((F.col("room") > 0) & (F.col("whole") > 0), F.col("left") * F.col("size")).otherwise(0)
    s = s.withColumn("_share", share.cast("long"))
    quotient = F.when(F.col("whole") > 0, F.expr("try_divide(_share - _share % whole, whole)").cast("long")).otherwise(0)
    s = s.withColumn("floor", F.least(quotient, F.col("room"))).withColumn("rest", F.col("left") - F.sum("floor").over(every))
    over = F.col("_share") - F.col("floor") * F.col("whole")
    open_ = F.col("room") > F.col("floor")
    s = s.withColumn("_open", open_).withColumn("nth", F.row_number().over(W.orderBy(F.desc("_open"), over.desc(), stratum)))
    k = F.col("base") + F.when(F.col("left") > 0, F.col("floor") + (open_ & (F.col("nth") <= F.col("rest"))).cast("int")).otherwise(0)
    return s.select(stratum, "size", k.cast("long").alias("k"))


def hash_order(*parts: Column) -> Column:
    """A fixed, seedable order that another engine reproduces."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Of each stratum the rows that come first in hash order, as many as allocation() says."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    ranked = df.withColumn("_nth", F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(F.col(key), F.lit(seed)), key)))
    return ranked.join(allocation(sizes, stratum, n), stratum).filter("_nth <= k").drop("_nth", "size", "k")


def journal_sample(df: DataFrame, journal: str, key: str, date: str, known: DataFrame | None = None, few: int = 2, many: int = 5, small: int = 200) -> DataFrame:
    """Five works of a journal-month of at most 200, else two; known works are passed over and
    a top-up walks on in the same order."""
    sized = df.join(df.groupBy(journal).agg(F.count("*").alias("volume")), journal)
    if known is not None:
        sized = sized.join(known, key, "left_anti")
    nth = F.row_number().over(W.partitionBy(journal).orderBy(hash_order(F.lit(date), F.col(journal), F.col(key)), key))
    return sized.withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("volume") <= small, many).otherwise(few))


def walk(df: DataFrame, journal: str, key: str, date: str, known: DataFrame | None = None, have: DataFrame | None = None, few: int = 2, many: int = 5, small: int = 200, headroom: int = 10, cap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(picks, report): a draw of each journal-month by a walk over one fixed permutation of its
    positions (column position, from 1; at most `cap` can be reached).

    A journal-month of at most `small` works has a target of `many`, else of `few`, and wants what of it
    it does not have yet (have: journal, k). The walk looks at the first target + headroom places of
    the permutation, passes over known works (known: key) and over a key met before, and stops once it
    has what it wants. As the permutation depends on date and journal alone, a top-up that knows the
    earlier picks walks on behind them. The report tells month_works, target_picks, the picks' positions
    in order of the walk, skipped_known up to the stop, and truncated_pool.
    """
    volume = df.groupBy(journal).agg(F.count("*").alias("month_works"))
    reach = F.least(F.col("month_works"), F.lit(cap))
    sizes = volume.join(have.select(journal, F.greatest("k", F.lit(0)).alias("k")), journal, "left") if have is not None else volume.withColumn("k", F.lit(0))
    target = F.least(F.when(F.col("month_works") <= small, many).otherwise(few), reach).cast("int")
    sizes = sizes.select(journal, "month_works", target.alias("target_picks"), F.greatest(target - F.coalesce("k", F.lit(0)), F.lit(0)).cast("int").alias("wanted"), (F.col("month_works") > cap).alias("truncated_pool"))
    place = W.partitionBy(journal).orderBy(hash_order(F.lit(date), F.col(journal), F.col("position")), "position")
    steps = df.filter(F.col("position") <= cap).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= max(few, many) + headroom)
    steps = steps.join(sizes, journal).filter(F.col("nth") <= F.col("target_picks") + headroom)
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    again = (own != "") & (F.row_number().over(W.partitionBy(journal, key).orderBy("nth")) > 1)
    met = F.lit(False)
    if known is not None:
        steps = steps.join(known.select(F.col(key).alias("_key")).distinct().withColumn("_met", F.lit(True)), (own != "") & (F.col(key) == F.col("_key")), "left").drop("_key")
        met = F.coalesce("_met", F.lit(False))
    steps = steps.withColumn("_skip", met | again).drop("_met")
    steps = steps.withColumn("_before", F.coalesce(F.sum((~F.col("_skip")).cast("int")).over(W.partitionBy(journal).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seen = steps.filter(F.col("_before") < F.col("wanted"))  # up to the stop
    picks = seen.filter(~F.col("_skip"))
    place = F.when(~F.col("_skip"), F.struct("nth", "position"))
    walked = seen.groupBy(journal).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["position"]).alias("positions"), F.sum(F.col("_skip").cast("int")).alias("skipped_known"))
    report = sizes.join(walked, journal, "left").select(journal, "month_works", "target_picks", F.coalesce("positions", F.array().cast("array<long>")).alias("positions"), F.coalesce("skipped_known", F.lit(0)).cast("int").alias("skipped_known"), "truncated_pool")
    return picks.select(*df.columns, "nth"), report


def export_order(date: str, priority: str, direction: str, tie: str) -> list[Column]:
    """Newest first, then priority, then direction."""
    return [F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), priority_rank(F.col(priority)), F.coalesce(F.col(direction), F.lit("")), F.col(tie)]


def weekly_picks(df: DataFrame, direction: str, priority: str, citations: str, tie: str, n: int) -> DataFrame:
    """Of High and Medium, High first, then citations, for each direction."""
    rows = df.filter(F.col(priority).isin("High", "Medium"))
    return first_of(rows, [direction], [priority_rank(F.col(priority)), F.coalesce(F.col(citations), F.lit(0)).desc(), F.col(tie)], n)


def queue(df: DataFrame) -> DataFrame:
    """Newest first, titles descending."""
    return df.orderBy(F.desc("date"), F.desc("title"), "key")


def enrichment_queue(df: DataFrame, attempts: int) -> DataFrame:
    """The latest, High first, as many as there are attempts."""
    return df.orderBy(F.desc("first_seen_at"), priority_rank(F.col("priority")), "key").limit(attempts)


def review_next(df: DataFrame, most: int = 3) -> DataFrame:
    """What is being read first, then the newest High; rows with attempts left."""
    reading = (F.col("status") == "reading").cast("int").desc()
    return df.filter(F.col("status").isin("pending", "reading") & (F.coalesce("attempts", F.lit(0)) < most)).orderBy(reading, F.desc("date"), priority_rank(F.col("priority")), "id").limit(1)


def recent_runs(runs: DataFrame, healthy: list[str], n: int = 7) -> DataFrame:
    """The newest runs of healthy status: the filter comes before the limit."""
    return runs.filter(F.col("run_status").isin(healthy)).orderBy(F.desc("run_date")).limit(n)


def work_at(df: DataFrame, journal: str, order: list[Column], position: int) -> DataFrame:
    """The work at a position (1 to 10,000) of a journal-month."""
    if not 1 <= position <= 10_000:
        return df.limit(0)
    return first_of(df, [journal], order, position, "_n").filter(F.col("_n") == position).drop("_n")


def position_index(df: DataFrame, journal: str, order: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """(rows, index) for access by position: rows are dealt by range of journal and order into parts
    and numbered within each (_part, _at); the index holds for each journal and part the number of rows
    before it and in it, a row for each of the two. No journal-month is sorted in one task."""
    cut = df.repartitionByRange(parts, F.col(journal), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    return cut, cut.groupBy(journal, "_part").agg(F.count("*").alias("n"))


def with_positions(rows: DataFrame, index: DataFrame, journal: str, order: list[str]) -> DataFrame:
    """Rows with their position (from 1) in the journal-month. rows must be written, so that parts
    stay what the index counted."""
    before = F.sum("n").over(W.partitionBy(journal).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    base = index.select(journal, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = rows.withColumn("_at", F.row_number().over(W.partitionBy(journal, "_part").orderBy(*order)))
    return own.join(base, [journal, "_part"]).withColumn("position", F.col("_before") + F.col("_at")).drop("_at", "_before")


def works_at(rows: DataFrame, index: DataFrame, journal: str, order: list[str], wanted: DataFrame) -> DataFrame:
    """(journal, position) wanted, with the works there: the index tells the part, and only rows of
    such parts are numbered. Positions that do not exist give nothing."""
    before = F.sum("n").over(W.partitionBy(journal).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spans = index.withColumn("_before", F.coalesce(before, F.lit(0)))
    where = wanted.select(journal, "position").distinct().join(spans, journal).filter((F.col("position") > F.col("_before")) & (F.col("position") <= F.col("_before") + F.col("n")))
    where = where.select(journal, "_part", "position", (F.col("position") - F.col("_before")).alias("_want"))
    read = rows.join(where.select(journal, "_part").distinct(), [journal, "_part"], "left_semi")
    own = read.withColumn("_at", F.row_number().over(W.partitionBy(journal, "_part").orderBy(*order)))
    return own.join(where, [journal, "_part"]).filter(F.col("_at") == F.col("_want")).drop("_at", "_want", "_part")


def weekly_list(df: DataFrame, week: str) -> DataFrame:
    """What was read or checked in a week: High first, in any case, then by source date."""
    late = (F.lower("priority") != "high").cast("int")
    return df.filter((F.col("week") == week) & F.col("status").isin("read", "checked")).orderBy(late, "source_date", "id")


def ranked_by_day(df: DataFrame, date: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rank over all rows, newest day first, then in the order given. Only the days' counts share
    a task; each day's rows are ranked by themselves."""
    day = F.coalesce(F.col(date).cast("string"), F.lit(""))
    counts = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_day", F.coalesce(before, F.lit(0)).alias("_before"))
    own = df.withColumn("_day", day).withColumn("_nth", F.row_number().over(W.partitionBy("_day").orderBy(*order)))
    return own.join(counts, "_day").withColumn(rank, (F.col("_before") + F.col("_nth")).cast("int")).drop("_day", "_nth", "_before")
