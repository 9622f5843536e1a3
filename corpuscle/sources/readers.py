"""Tolerant readers of buckets, lists and configuration, and offline forms of the web sources."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuscle.functions.identity import arxiv_base_id, text
from corpuscle.schema import PAPER

BUCKET = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\.json$"


def buckets(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, schema: str = PAPER) -> DataFrame:
    """(bucket_date, position, paper fields) of every day file in a folder, within the
    closed range. A file is an object with papers, a bare list, or garbage, which gives no rows.
    Positions are taken once, here."""
    paths = day_paths(spark, path, start, end) if start or end else [path]
    if not paths:
        return spark.createDataFrame([], "bucket_date string, position int, " + schema)
    files = spark.read.option("wholetext", True).text(paths, pathGlobFilter="*.json")
    files = files.select(F.regexp_extract(F.input_file_name(), BUCKET, 1).alias("bucket_date"), "value").filter("bucket_date <> ''")
    rows = "array<struct<" + ", ".join(_fields(schema)) + ">>"
    lean = F.btrim("value", F.lit(" \t\r\n﻿"))
    object_ = F.from_json("value", f"struct<papers:{rows}>")["papers"]
    listed = F.from_json("value", rows)
    papers = F.when(lean.startswith("["), listed).when(lean.startswith("{"), object_)
    good = F.coalesce(F.is_variant_null(F.try_parse_json("value")), F.lit(True)) == F.lit(False)
    out = files.filter(good).select("bucket_date", F.posexplode(papers).alias("position", "p"))
    return out.filter("p is not null").select("bucket_date", "position", "p.*")


def day_paths(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> list[str]:
    """The day files of a folder within the closed range, in order. Names alone tell, so files out of
    the range are never opened; a folder holds a file a day."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    days = sorted((m[1], p.toString()) for p in found if (m := re.search(BUCKET, p.getName())))
    return [p for day, p in days if (not start or day >= start) and (not end or day <= end)]


def _fields(schema: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields]


def corrupt_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The day files that do not parse."""
    files = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.json")
    return files.select(F.regexp_extract(F.input_file_name(), BUCKET, 1).alias("bucket_date"), F.try_parse_json("value").alias("v")).filter("bucket_date <> '' and v is null").select("bucket_date")


def read_config(path: str) -> dict:
    """A YAML file on the driver; a configuration is small."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def listed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doi, tier, topic) of tab-separated or bare lines; blanks and comments are skipped."""
    rows = spark.read.text(path).select(text(F.col("value")).alias("v")).filter("v <> '' and not startswith(v, '#')")
    part = F.split("v", "\t")
    cell = lambda k: text(F.get(part, F.lit(k)))
    return rows.select(cell(0).alias("doi"), cell(1).alias("tier"), cell(2).alias("topic"))


def arxiv_rows(raw: DataFrame, *own: str) -> DataFrame:
    """Normalised rows of the preprint feed: the version stays in id, newlines become spaces; columns
    named besides pass through first."""
    flat = lambda c: text(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    return raw.select(*own, F.lit("arxiv").alias("source"), F.col("entry_id").alias("id"), text(F.col("doi")).alias("doi"), arxiv_base_id(F.col("entry_id")).alias("arxiv_id"), flat(F.col("title")).alias("title"), flat(F.col("summary")).alias("abstract"), "authors", F.substring("published", 1, 10).alias("date"), "categories")


def inverted_index_text(index: Column) -> Column:
    """Words of an inverted index in order of position, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def openalex_rows(raw: DataFrame) -> DataFrame:
    """Normalised works: concepts above 0.3, corresponding authors, the first affiliation."""
    person = lambda a: F.struct(a["author"]["display_name"].alias("name"), F.coalesce(F.get(a["raw_affiliation_strings"], F.lit(0)), F.get(a["institutions"], F.lit(0))["display_name"], F.lit("")).alias("affiliation"))
    people = F.coalesce("authorships", F.array().cast(raw.schema["authorships"].dataType))
    return raw.select(
        F.lit("openalex").alias("source"), F.regexp_extract("id", r"(W[0-9]+)$", 1).alias("id"),
        F.regexp_replace(F.coalesce("doi", F.lit("")), "^https://doi.org/", "").alias("doi"), text(F.col("title")).alias("title"),
        inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.transform(people, lambda a: a["author"]["display_name"]).alias("authors"),
        F.coalesce(person(F.get(people, F.lit(0)))["affiliation"], F.lit("")).alias("first_author_affiliation"),
        F.transform(F.filter(people, lambda a: F.coalesce(a["is_corresponding"], F.lit(False))), person).alias("corresponding_authors"),
        F.col("publication_date").alias("date"), F.col("publication_year").alias("year"), "cited_by_count",
        F.transform(F.filter("concepts", lambda c: c["score"] > 0.3), lambda c: c["display_name"]).alias("concepts"),
    )


ARTICLE = (
    "struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,AffiliationInfo:array<struct<Affiliation:string>>>>>>>>"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def pubmed_rows(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Articles of an efetch answer, one XML text per row; bad ones are skipped. The author
    whose affiliation says so or has an address corresponds, else the last of several, inferred."""
    art = raw.select(F.from_xml(F.col(xml), ARTICLE, {"mode": "PERMISSIVE"}).alias("a")).select("a.MedlineCitation.*").filter("PMID is not null and Article is not null")
    a, date = F.col("Article"), F.col("Article.Journal.JournalIssue.PubDate")
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(date["Month"], 1, 3))), F.lit(0)), F.try_to_number(date["Month"], F.lit("99")), F.lit(1))
    name = lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])
    place = lambda x: F.coalesce(F.get(x["AffiliationInfo"], F.lit(0))["Affiliation"], F.lit(""))
    people = F.coalesce(a["AuthorList"]["Author"], F.array())
    own = F.transform(F.filter(people, lambda x: F.lower(place(x)).contains("corresponding author") | place(x).contains("@")), lambda x: F.struct(name(x).alias("name"), place(x).alias("affiliation"), F.lit(False).alias("inferred")))
    last = F.transform(F.slice(people, -1, 1), lambda x: F.struct(name(x).alias("name"), place(x).alias("affiliation"), F.lit(True).alias("inferred")))
    year = F.regexp_extract(F.coalesce(date["Year"], F.lit("")), "[0-9]{4}", 0)
    return art.select(
        F.lit("pubmed").alias("source"), F.col("PMID").alias("id"), F.col("PMID").alias("pmid"), text(a["ArticleTitle"]).alias("title"),
        F.array_join(F.coalesce(a["Abstract"]["AbstractText"], F.array()), " ").alias("abstract"), F.transform(people, name).alias("authors"),
        F.when(F.size(own) > 0, own).when(F.size(people) > 1, last).otherwise(F.slice(last, 1, 0)).alias("corresponding_authors"),
        a["Journal"]["Title"].alias("venue"), F.nullif(year, F.lit("")).cast("int").alias("year"),
        F.when(year != "", F.format_string("%s-%02d-%02d", year, month.cast("int"), F.coalesce(F.try_to_number(date["Day"], F.lit("99")), F.lit(1)).cast("int"))).otherwise("").alias("date"),
    )


class RateLimited(RuntimeError):
    """A service asks for a longer wait than a fetch may take."""


def fetch_json(get: Callable[[dict], tuple[int, dict, dict]], params: dict, tries: int = 5, longest: int = 60, sleep: Callable[[float], None] = time.sleep) -> dict:
    """get(params) gives (status, headers, body). 5xx and short 429 are tried again with
    doubling waits; a longer Retry-After and other 4xx raise."""
    for k in range(tries):
        status, headers, body = get(params)
        if status < 400:
            return body
        wait = float(headers.get("Retry-After", 2**k)) if status == 429 else 2.0**k
        if status == 429 and wait > longest:
            raise RateLimited(f"Retry-After {wait:.0f}")
        if status < 500 and status != 429:
            raise RuntimeError(f"status {status}")
        if k + 1 < tries:
            sleep(wait)
    raise RuntimeError(f"status {status} after {tries} tries")


def cursor_pages(get: Callable[[dict], dict], params: dict, size: int = 200, most: int = 60) -> tuple[list[dict], bool]:
    """All results behind a cursor, and whether a live cursor was left at the cap."""
    rows, cursor = [], "*"
    for _ in range(most):
        body = get({**params, "per-page": size, "cursor": cursor})
        rows += body.get("results", [])
        cursor = (body.get("meta") or {}).get("next_cursor")
        if not cursor or not body.get("results"):
            return rows, False
    return rows, bool(cursor)


class _PagedReader(DataSourceReader):
    def __init__(self, queries: list[str], fetch: Callable[[str], list[dict]]):
        self.queries, self.fetch = queries, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, row in enumerate(self.fetch(partition.value)):
            yield partition.value, k, json.dumps(row, sort_keys=True)


def register_fetcher(spark: SparkSession, name: str, fetch: Callable[[str], list[dict]]) -> None:
    """A web source as Spark reads it, under a format name: one partition for
    each query of the option `queries` (a JSON list). Tests hand in a fetcher without a network."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "query string, position int, body string"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _PagedReader(json.loads(self.options.get("queries", "[]")), fetch)

    spark.dataSource.register(Paged)


def resolve_batches(df: DataFrame, key: str, resolve: Callable[[list[str]], dict[str, str]], size: int = 50) -> DataFrame:
    """(key, value) of the distinct keys that a batched lookup resolves; others are absent."""

    def run(batches):
        import pandas as pd

        for b in batches:
            keys = b[key].tolist()
            for k in range(0, len(keys), size):
                found = resolve(keys[k : k + size])
                if found:
                    yield pd.DataFrame({"key": list(found), "value": list(found.values())})

    return df.select(key).filter(F.coalesce(F.col(key), F.lit("")) != "").distinct().mapInPandas(run, "key string, value string")


