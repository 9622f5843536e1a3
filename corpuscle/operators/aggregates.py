"""Grouped counts, facets, roll-ups and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.dates import year_and_month
from corpuscle.functions.text import canonical_tag, tag_family
from corpuscle.operators.joins import previous_year

#: Fixed values.
PRIORITIES = ["High", "Medium", "Low", "Exclude"]
KNOWN_DIRECTIONS = ["ai_bioprinting", "am_biomedical", "fea_surrogate", "hip_implant"]
EMERGING_COUNT, EMERGING_RATIO, PRIMARY_SCORER = 5, 2, "v3"


def distribution(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by (year, direction, priority, scorer_version) and by year_month, and invalid
    rows by their first reason: date, then direction, then priority."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = papers.withColumn("_ym", year_and_month(F.col("bucket_date")))
    reason = F.when(F.col("_ym").isNull(), "date").when(blank("direction"), "direction").when(blank("priority"), "priority")
    rows = rows.withColumn("reason", reason).select("*", "_ym.year", "_ym.year_month")
    good = rows.filter("reason is null")
    yearly = good.groupBy("year", "direction", "priority", "scorer_version").agg(F.count("*").alias("n"))
    monthly = good.groupBy("year_month").agg(F.count("*").alias("n"))
    return yearly, monthly, rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def tag_counts(papers: DataFrame, include_all: bool = False, aliases: dict[str, list[str]] | None = None, dropped: list[str] | None = None) -> DataFrame:
    """Counts by (year, direction, canonical tag), of primary-scorer rows of High or Medium."""
    rows = papers.filter(F.col("scorer_version") == PRIMARY_SCORER)
    if not include_all:
        rows = rows.filter(F.col("priority").isin("High", "Medium"))
    tags = rows.select(year_and_month(F.col("bucket_date"))["year"].alias("year"), "direction", F.explode("tags").alias("raw"))
    return tags.withColumn("tag", canonical_tag(F.col("raw"), aliases, dropped)).filter("tag is not null and year is not null").groupBy("year", "direction", "tag").agg(F.count("*").alias("n"))


def emerging(counts: DataFrame, least: int = EMERGING_COUNT, ratio: int = EMERGING_RATIO) -> DataFrame:
    """Tags counted often enough and at least `ratio` times as often as the year before."""
    out = previous_year(counts, ["direction", "tag"]).filter((F.col("n") >= least) & (F.col("n") >= ratio * F.col("prev")))
    return out.withColumn("delta", F.col("n") - F.col("prev")).select("year", "direction", "tag", "n", "prev", "delta").orderBy("year", "direction", F.desc("n"), "tag")


def family_showdown(counts: DataFrame) -> DataFrame:
    """Counts of the two method families by year."""
    fam = tag_family(F.col("tag"))
    one = lambda f: F.coalesce(F.sum(F.when(fam == f, F.col("n"))), F.lit(0)).alias(f.lower())
    return counts.groupBy("year").agg(one("FEM"), one("PINN"))


def priority_ratio(yearly: DataFrame) -> DataFrame:
    """Share of High and Medium for each direction and year; null where a direction has none."""
    grid = yearly.select("direction").distinct().crossJoin(yearly.select("year").distinct())  # of the two axes
    got = yearly.groupBy("direction", "year").agg(F.sum(F.when(F.col("priority").isin("High", "Medium"), F.col("n")).otherwise(0)).alias("hm"), F.sum("n").alias("total"))
    return grid.join(got, ["direction", "year"], "left").withColumn("ratio", F.round(F.try_divide("hm", "total"), 6))


def stacked(yearly: DataFrame, known: list[str] = KNOWN_DIRECTIONS) -> DataFrame:
    """A column for each known direction, others as OTHER, of the primary scorer."""
    rows = yearly.filter(F.col("scorer_version") == PRIMARY_SCORER)
    axis = F.when(F.col("direction").isin(known), F.col("direction")).otherwise("OTHER")
    return rows.withColumn("_d", axis).groupBy("year").pivot("_d", [*known, "OTHER"]).agg(F.sum("n")).na.fill(0)


def bucket_counts(papers: DataFrame, by_each_direction: bool = False) -> DataFrame:
    """The counts block of each bucket. Rows without a direction count under their display
    name or, with by_each_direction, once for each of their directions."""
    single = F.coalesce(F.nullif("direction", F.lit("")), F.nullif("direction_name", F.lit("")))
    each = F.when(F.coalesce(F.col("direction"), F.lit("")) != "", F.array("direction")).otherwise(F.coalesce("directions", F.array().cast("array<string>")))
    keys = each if by_each_direction else F.array_compact(F.array(single))
    rows = papers.withColumn("_dir", keys)

    def counted(value: Column, name: str) -> DataFrame:
        c = rows.select("bucket_date", value.alias("k")).filter("k is not null and k <> ''").groupBy("bucket_date", "k").agg(F.count("*").alias("n"))
        return c.groupBy("bucket_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    out = papers.groupBy("bucket_date").agg(F.count("*").alias("total"), F.count_if(F.col("scored")).alias("scored"))
    for value, name in ((F.col("source"), "by_source"), (F.explode("_dir"), "by_direction"), (F.col("priority"), "priority_counts")):
        out = out.join(counted(value, name), "bucket_date", "left")
    return out


def priority_counts(papers: DataFrame, by: str, priority: str = "priority") -> DataFrame:
    """Counts by priority with zeros for the four known ones; Unscored only where it occurs."""
    got = papers.filter(F.coalesce(F.col(priority), F.lit("")) != "").groupBy(by, priority).agg(F.count("*").alias("n"))
    dims = papers.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, PRIORITIES))).alias(priority))
    return dims.join(got, [by, priority], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def corpus_stats(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """A10: rows, distinct works and suppressed copies."""
    a, b = raw.agg(F.count("*").alias("raw")), unique.agg(F.count("*").alias("unique"))
    return a.join(b).withColumn("suppressed", F.col("raw") - F.col("unique"))


def facet_cube(df: DataFrame, by: list[str], facets: list[str]) -> DataFrame:
    """Counts by `by` for every subset of facets; a row counts under a facet only where its
    value is not blank. member marks the facets that a row is grouped by."""
    named = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in facets]
    rows = df.select(*by, *named)
    out = rows.groupingSets([[*by, *[f for k, f in enumerate(facets) if m >> k & 1]] for m in range(1 << len(facets))], *by, *facets).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"_g_{f}") for f in facets])
    for f in facets:
        out = out.filter((F.col(f"_g_{f}") == 1) | (F.col(f) != ""))
    return out.drop(*[f"_g_{f}" for f in facets])


def weekly_totals(papers: DataFrame, priority: str = "priority", date: str = "date") -> DataFrame:
    """Counts by day and priority, with day totals and grand totals (null columns)."""
    return papers.rollup(date, priority).agg(F.count("*").alias("n"))


def month_rollup(days: DataFrame, date: str = "date", n: str = "n") -> DataFrame:
    """Day counts by month."""
    return days.groupBy(F.substring(date, 1, 7).alias("month")).agg(F.sum(n).alias("n"))


def tier_matrix(verdicts: DataFrame) -> DataFrame:
    """Verdicts by tier."""
    return verdicts.groupBy("tier", "verdict").agg(F.count("*").alias("n"))


def audit_rollup(rows: DataFrame, measures: list[str], categories: list[str]) -> DataFrame:
    """(column, value, n, mean): means of measures and histograms of categories, in one pass."""
    cats = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(None).cast("double").alias("m")) for c in categories]
    nums = [F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col(c).cast("double").alias("m")) for c in measures]
    return rows.select(F.inline(F.array(*cats, *nums))).groupBy("column", "value").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"))


def flag_counts(rows: DataFrame, by: Column, **flags: Column) -> DataFrame:
    """How many rows of each group have each flag."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in flags.items()])


def usage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of token counts; nulls count 0."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def count_audit(stored: DataFrame, rows: DataFrame, key: str, stored_n: str) -> DataFrame:
    """Stored counts that differ from a recount, absent ones included."""
    counted = rows.groupBy(key).agg(F.count("*").alias("recounted"))
    both = stored.select(key, F.col(stored_n).alias("stored")).join(counted, key, "full_outer")
    return both.withColumn("recounted", F.coalesce("recounted", F.lit(0))).filter(~F.col("stored").eqNullSafe(F.col("recounted")))


def corpus_cutoff(papers: DataFrame) -> DataFrame:
    """The last first_seen_at, else the last bucket at midnight."""
    seen = F.max(F.nullif("first_seen_at", F.lit("")))
    return papers.agg(F.coalesce(seen, F.concat(F.max("bucket_date"), F.lit("T00:00:00Z"))).alias("generated_at"))


def pivot_counts(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """A column of counts for each value."""
    return df.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def revision(pages: DataFrame, by: str, content: str) -> DataFrame:
    """A hash of a group's contents, whatever their order; a hash for each content first, so
    no text is gathered."""
    one = pages.select(by, F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    return one.groupBy(by).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256), 1, 16).alias("revision"))


def retention(df: DataFrame, by: str, routed: Column) -> DataFrame:
    """Share of fetched rows that were routed."""
    return df.groupBy(by).agg(F.count("*").alias("fetched"), F.count_if(routed).alias("routed")).withColumn("retention", F.round(F.col("routed") / F.col("fetched"), 6))
