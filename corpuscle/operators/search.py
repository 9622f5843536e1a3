"""The read API: substring search, facets, paging and reading lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.routing import priority_rank


def search_record(df: DataFrame) -> DataFrame:
    """the lean projection that metadata search reads, and a blob of all it matches."""
    authors = F.concat_ws(", ", F.slice("authors", 1, 3))
    out = df.select(
        "key", "date", "year", "direction", "priority", "relevance",
        F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("title"),
        F.when(F.size("authors") > 3, F.concat(authors, F.lit(" et al."))).otherwise(authors).alias("authors"),
        F.coalesce("venue", F.lit("")).alias("venue"),
        F.coalesce("direction_name", F.lit("")).alias("direction_name"),
        F.slice("tags", 1, 2).alias("tags"),
        F.coalesce(F.get("terms", F.lit(0)), F.lit("")).alias("term"),
    )
    return out.withColumn("blob", F.lower(F.concat_ws(" ", "title", "authors", "venue", "direction_name", "term", F.concat_ws(" ", "tags"))))


def deep_blob(df: DataFrame) -> DataFrame:
    """what deep search adds for each identity."""
    return df.select("key", "year", F.lower(F.concat_ws(" ", F.substring(F.coalesce("abstract", F.lit("")), 1, 500), "summary")).alias("deep"))


def card(df: DataFrame) -> DataFrame:
    """the public card of a paper."""
    named = F.filter("corresponding_authors", lambda a: F.coalesce(a["name"], F.lit("")) != "")
    flag = lambda f: F.coalesce(F.try_element_at("flags", F.lit(f)), F.lit(False))
    return df.select("key", "title", F.slice("authors", 1, 5).alias("authors"), (F.size("authors") > 5).alias("authors_truncated"), named.alias("corresponding_authors"), *[flag(f).alias(f) for f in ("is_review", "is_clinical", "has_code", "has_data")])


def matches(blob: Column, query: str) -> Column:
    """Q01: a plain substring, in any case."""
    return blob.contains(query.strip().lower()) if query.strip() else F.lit(True)


def facet_filter(facets: dict[str, str | None]) -> Column:
    """Q03: every facet that has a value must equal it."""
    out = F.lit(True)
    for name, value in facets.items():
        if value:
            out = out & (F.col(name).cast("string") == value)
    return out


def search(df: DataFrame, query: str = "", page: int = 1, size: int = 50, deep: DataFrame | None = None, deep_year: int | None = None, **facets: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows of the first `page` pages, total): newest first, then priority, then
    title. Facets are direction, priority, relevance and year."""
    rows = df.filter(facet_filter(facets))
    blob = F.col("blob")
    if deep is not None:
        side = deep if deep_year is None else deep.filter(F.col("year") == deep_year)
        rows = rows.join(side.select("key", "deep"), "key", "left")
        blob = F.concat("blob", F.lit(" "), F.coalesce("deep", F.lit("")))
    found = rows.filter(matches(blob, query))
    order = [F.desc("date"), priority_rank(F.col("priority")), F.col("title"), F.col("key")]
    return found.orderBy(*order).limit(page * size), found.agg(F.count("*").alias("total"))


def queue_page(df: DataFrame, offset: int, size: int, **facets: str | None) -> DataFrame:
    """One page of the queue."""
    return df.filter(facet_filter(facets)).orderBy(F.desc("date"), F.desc("title"), "key").offset(offset).limit(size)


def with_marks(df: DataFrame, marks: DataFrame, states: list[str], tags: list[str]) -> DataFrame:
    """Q04, Q05: states are alternatives, `none` stands for unmarked rows; any of the tags narrows."""
    out = df.join(marks.select("key", "state", F.col("tags").alias("mark_tags")), "key", "left")
    keep = F.lit(True)
    if states:
        keep = F.coalesce(F.nullif("state", F.lit("")), F.lit("none")).isin(states)
    if tags:
        keep = keep & F.coalesce(F.arrays_overlap("mark_tags", F.array(*map(F.lit, tags))), F.lit(False))
    return out.filter(keep)


def reading_list(marks: DataFrame, tab: str, tag: str | None = None, query: str = "") -> DataFrame:
    """A tab's marks with the tag whose text has every term; newest first."""
    rows = marks.filter(F.col("state") == tab) if tab != "all" else marks.filter(F.col("state") != "")
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    blob = F.lower(F.concat_ws(" ", "title", "note", "direction"))
    rows = rows.filter(F.forall(F.array(*[F.lit(t) for t in query.lower().split()]).cast("array<string>"), lambda t: blob.contains(t)))
    return rows.orderBy(F.desc("at"), "key")


def tag_usage(marks: DataFrame) -> DataFrame:
    """Tags by use."""
    return marks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


#: Texts of a paper, of its lists and of its score, as an export names them.
PAPER_TEXTS = ["doi", "arxiv_id", "title", "url", "source", "date", "date_precision", "venue", "abstract", "first_author_affiliation", "direction", "direction_name", "scorer_version"]
SCORE_TEXTS = ["priority", "relevance_level", "read_action", "validation_kind", "relevance_to_user", "why_not_core"]
EXPORT = [
    "doi", "arxiv_id", "title", "url", "source", "date", "date_precision", "year", "venue", "abstract", "authors", "first_author_affiliation", "corresponding_authors", "direction", "direction_name",
    "priority", "relevance_level", "read_action", "validation_kind", "relevance_to_user", "why_not_core", "flags", "tags", "key_terms", "summary_zh", "summary_en", "scorer_version",
    "radar_source_date", "radar_export_date", "radar_export_version",
]


def export_record(df: DataFrame, source_date: Column, export_date: Column, version: str) -> DataFrame:
    """papers (with the struct llm, which may be null) as the 30 flat columns of an export; a
    missing text is empty, a missing list or map has no member, a missing year stays null."""
    kinds = {f.name: f.dataType for f in df.schema.fields} | {f"llm.{f.name}": f.dataType for f in df.schema["llm"].dataType.fields}

    def whole(name: str, empty: Column) -> Column:
        return F.coalesce(F.col(name), empty.cast(kinds[name])) if name in kinds else empty

    made = {c: whole(c, F.lit("")) for c in PAPER_TEXTS} | {c: whole(f"llm.{c}", F.lit("")) for c in SCORE_TEXTS}
    made |= {c: whole(c, F.array()) for c in ("authors", "corresponding_authors")} | {c: whole(f"llm.{c}", F.array()) for c in ("tags", "key_terms")}
    made |= {c: whole(f"llm.{c}", F.create_map()) for c in ("flags", "summary_zh", "summary_en")}
    made |= {"year": F.col("year"), "radar_source_date": source_date, "radar_export_date": export_date, "radar_export_version": F.lit(version)}
    return df.select(*[made[c].alias(c) for c in EXPORT])
