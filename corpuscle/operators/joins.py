"""Lookups. Sides are broadcast only by the planner's own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.rights import safe_visual


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, defaults: dict[str, object]) -> DataFrame:
    """Columns of a dimension, with a default where it has no row or a null."""
    side = dim.select(F.col(dim_key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in defaults])
    own = lambda c: F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None)
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    rest = [F.coalesce(own(c), F.col(f"_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()]
    return out.select(*[c for c in df.columns if c not in defaults], *rest)


def precedence_union(parts: list[DataFrame], key: str) -> DataFrame:
    """A key's row from the first part that has it, even if a later filter rejects that row."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "_rank")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("m")).select(key, "m.*")


def list_matches(listed: DataFrame, corpus: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A list with, for each entry, the earliest corpus row of its key, or nulls."""
    rest = [c for c in corpus.columns if c != key]
    first = corpus.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return listed.join(first, key, "left").select(*listed.columns, "m.*", F.col("m").isNotNull().alias("present"))


def without_backfill(papers: DataFrame, log: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(papers that only daily runs have observed, count of the others)."""
    other = log.filter(F.col("run_type") != "daily").select(F.col("doi_or_arxiv_id").alias(key)).distinct()
    return papers.join(other, key, "left_anti"), papers.join(other, key, "left_semi").agg(F.count("*").alias("suppressed"))


def runs_with_papers(runs: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers on the run of the day on which they were first seen."""
    return runs.join(papers.withColumn("run_date", F.substring("first_seen_at", 1, 10)), "run_date")


def previous_year(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Each count with that of the year before; a missing year counts 0."""
    before = counts.select(*keys, (F.col("year") + 1).alias("year"), F.col(n).alias("prev"))
    return counts.join(before, [*keys, "year"], "left").withColumn("prev", F.coalesce("prev", F.lit(0)))


def merge_reports(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New fields win; positions are the old ones, then the new; skipped_known is the larger."""
    o = old.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key])
    none = F.array().cast(old.schema["positions"].dataType)
    was = F.coalesce("_positions", none)
    rest = [c for c in new.columns if c not in (key, "positions", "skipped_known")]
    return new.join(o, key, "left").select(
        key,
        *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in old.columns else F.col(c) for c in rest],
        F.concat(was, F.array_except(F.coalesce("positions", none), was)).alias("positions"),
        F.greatest("skipped_known", "_skipped_known").alias("skipped_known"),
    )


def borrow_unique(df: DataFrame, group: str, column: str) -> DataFrame:
    """Fills an empty column from its group if the group holds exactly one distinct value."""
    filled = F.nullif(F.col(column), F.lit(""))
    one = df.filter(F.coalesce(F.col(group), F.lit("")) != "").groupBy(group).agg(F.min(filled).alias("_a"), F.max(filled).alias("_b"))
    out = df.join(one.filter("_a = _b").select(group, "_a"), group, "left")
    return out.withColumn(column, F.coalesce(filled, F.col("_a"), F.lit(""))).select(df.columns)


def match_media(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Refs (name) with the file of the same base name, else of the same stem."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/]*)$", 1))
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]*$", "")
    exact = files.groupBy(base(F.col("path")).alias("_base")).agg(F.min("path").alias("_exact"))
    loose = files.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_loose"))
    out = refs.withColumns({"_base": base(F.col("name")), "_stem": stem(F.col("name"))}).join(exact, "_base", "left").join(loose, "_stem", "left")
    return out.select(*refs.columns, F.coalesce("_exact", "_loose").alias("path"))


def config_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Added and removed entries, and for entries in both what each list gained and lost."""
    o = old.select(F.col(key), F.lit(True).alias("_old"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = o.join(new.select(key, F.lit(True).alias("_new"), *fields), key, "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    less = lambda a, b: F.array_except(F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>")))
    parts: list[Column] = [x for f in fields for x in (less(f, f"_{f}").alias(f"{f}_added"), less(f"_{f}", f).alias(f"{f}_removed"))]
    return both.select(key, status.alias("status"), *parts)


def digest_diff(current: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new, cleared) keys."""
    return current.join(seen, key, "left_anti"), seen.join(current, key, "left_anti")


def attach_visuals(papers: DataFrame, registry: DataFrame, key: str = "key") -> DataFrame:
    """Papers with a column visual: the record that the registry (key, visual) holds under the
    public identity, after canonicalisation and only if it may be shown. Papers without a key get none."""
    side = registry.select(F.col(key).alias("_k"), F.when(safe_visual(F.col("visual")), F.col("visual")).alias("visual"))
    side = side.filter("visual is not null and _k <> ''").groupBy("_k").agg(F.first("visual").alias("visual"))
    return papers.join(side, F.col(key) == F.col("_k"), "left").drop("_k")


def marked_records(marks: DataFrame, manifest: DataFrame, records: DataFrame, most: int = 25) -> DataFrame:
    """Marks (idkey, anchor, date) with the page of their record, or null. The manifest (date,
    anchor, page, page_count: a row for each anchor) names the pages of the anchor and of its numbered
    forms; if it names none, the day's first `most` pages are looked through."""
    valid = marks.withColumn("_m", F.monotonically_increasing_id()).filter(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    base = F.regexp_extract("anchor", r"^(.*?)(?:--.*)?$", 1)
    m = manifest.select(F.col("date").alias("_date"), F.explode(F.array_distinct(F.array("anchor", base))).alias("_a"), F.col("anchor").alias("_whole"), "page")
    named = valid.join(m, (F.col("date") == F.col("_date")) & (F.col("anchor") == F.col("_a"))).select("idkey", "anchor", "date", "page")
    days = manifest.groupBy(F.col("date").alias("_date")).agg(F.max("page_count").alias("pages"))
    lost = valid.select("idkey", "anchor", "date").distinct().join(named, ["idkey", "anchor", "date"], "left_anti").join(days, F.col("date") == F.col("_date")).filter("pages > 0")
    scanned = lost.select("idkey", "anchor", "date", F.explode(F.sequence(F.lit(1), F.least("pages", F.lit(most)).cast("int"))).alias("page"))
    found = named.unionByName(scanned).join(records.select(F.col("identity_key").alias("idkey"), "date", "page"), ["idkey", "date", "page"]).groupBy("idkey", "anchor", "date").agg(F.min("page").alias("page"))
    return marks.join(found, ["idkey", "anchor", "date"], "left")


def query_terms(config: DataFrame, columns: list[str]) -> DataFrame:
    """(source, terms): the different terms that any direction asks of each source, sorted."""
    each = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("terms")) for c in columns])
    terms = config.select(F.inline(each)).select("source", F.explode("terms").alias("term")).filter("term is not null")
    return terms.groupBy("source").agg(F.array_sort(F.collect_set("term")).alias("terms"))
