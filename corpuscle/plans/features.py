"""Further queries of the library, on figures, safe cuts, stores, pages, search and samples, each with its
SQL. They stand beside those of the catalog and use its stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import dates, figures, identity, media, quality, rights, routing
from corpuscle.functions import text as texts
from corpuscle.operators import aggregates, dedup, joins, paging, search, windows
from corpuscle.plans.catalog import _PAPERS, _papers, query
from corpuscle.runtime import shared_dir, table
from corpuscle.sources import buckets, readers, sinks
from corpuscle.streaming import keyed, state


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# --- figures and cuts -------------------------------------------------------------------------------


@query(r"""
WITH w AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([A-Za-z]+)">', 1) AS ws FROM pages),
n AS (SELECT page_id, ws, list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-Z]')) AS shown FROM w)
SELECT page_id, len(shown)::INTEGER AS n_candidates,
  'https://arxiv.org/' || coalesce(list_filter(shown, lambda x: length(x) = 3)[1], shown[1]) || '.png' AS image_url,
  coalesce(list_filter(shown, lambda x: length(x) = 3)[1], shown[1]) || ' measured' || CASE WHEN len(list_filter(shown, lambda x: length(x) = 3)) > 0 THEN ', a graphical abstract' ELSE '' END AS caption FROM n""")
def figure_candidates(spark, d):
    """navigation entries of pages as figures: capitals are legends, words of three letters are
    graphical abstracts, others are plain figures."""
    html = F.regexp_replace("html", r'<li><a href="/([A-Z][A-Za-z]*)">[^<]*</a></li>', r'<figure><img src="/$1.png" alt="legend"/><figcaption>$1 measured</figcaption></figure>')
    html = F.regexp_replace(html, r'<li><a href="/([a-z][A-Za-z]{2})">[^<]*</a></li>', r'<figure><img src="/$1.png" alt=""/><figcaption>$1 measured, a graphical abstract</figcaption></figure>')
    html = F.regexp_replace(html, r'<li><a href="/([a-z][A-Za-z]*)">[^<]*</a></li>', r'<figure><img src="/$1.png" alt=""/><figcaption>$1 measured</figcaption></figure>')
    page = F.concat(F.lit("https://arxiv.org/html/2401."), F.lpad(F.col("page_id").cast("string"), 5, "0"))
    out = figures.select_html(table(spark, d, "pages").select("page_id", html.alias("html"), page.alias("url")), "html", "url")
    first = F.get("candidates", F.lit(0))
    return out.select("page_id", F.size("candidates").alias("n_candidates"), first["image_url"].alias("image_url"), first["caption"].alias("caption"))


@query(r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_reduce(list_prepend({'i': 0, 'o': '', 'd': 0, 'l': 0, 'k': 0}, list_transform(range(1, 201), lambda i: {'i': i::INTEGER, 'o': '', 'd': 0, 'l': 0, 'k': 0})),
  lambda a, x: CASE WHEN a.k > 0 THEN {'i': x.i, 'o': a.o, 'd': a.d, 'l': a.l, 'k': a.k - 1}
    WHEN substr(t, x.i, 2) IN ('\(', '\[') AND substr(t, x.i - 1, 1) <> '\' AND a.o = '' THEN {'i': x.i, 'o': substr(t, x.i, 2), 'd': a.d, 'l': a.l, 'k': 1}
    WHEN substr(t, x.i, 2) IN ('\)', '\]') AND a.o <> '' THEN {'i': x.i, 'o': CASE WHEN a.o = translate(substr(t, x.i, 2), ')]', '([') THEN '' ELSE a.o END, 'd': a.d, 'l': a.l, 'k': 1}
    WHEN substr(t, x.i, 1) = '$' AND (x.i = 1 OR substr(t, x.i - 1, 1) <> '\') AND a.o = '' THEN {'i': x.i, 'o': CASE WHEN substr(t, x.i, 2) = '$$' THEN '$$' ELSE '$' END, 'd': a.d, 'l': a.l, 'k': CASE WHEN substr(t, x.i, 2) = '$$' THEN 1 ELSE 0 END}
    WHEN substr(t, x.i, 1) = '$' AND (x.i = 1 OR substr(t, x.i - 1, 1) <> '\') AND starts_with(a.o, '$') AND substr(t, x.i, length(a.o)) = a.o THEN {'i': x.i, 'o': '', 'd': a.d, 'l': a.l, 'k': length(a.o)::INTEGER - 1}
    WHEN a.o <> '' OR (x.i > 1 AND substr(t, x.i - 1, 1) = '\') THEN {'i': x.i, 'o': a.o, 'd': a.d, 'l': a.l, 'k': 0}
    WHEN regexp_matches(substr(t, x.i, 1), '\s') AND a.d = 0 THEN {'i': x.i, 'o': a.o, 'd': a.d, 'l': x.i - 1, 'k': 0}
    WHEN substr(t, x.i, 1) = '{' THEN {'i': x.i, 'o': a.o, 'd': a.d + 1, 'l': a.l, 'k': 0}
    WHEN substr(t, x.i, 1) = '}' AND a.d > 0 THEN {'i': x.i, 'o': a.o, 'd': a.d - 1, 'l': a.l, 'k': 0}
    ELSE {'i': x.i, 'o': a.o, 'd': a.d, 'l': a.l, 'k': 0} END) AS e FROM c),
h AS (SELECT doc_id, t, CASE WHEN e.o = '' AND e.d = 0 AND NOT (regexp_matches(substr(t, 200, 1), '[\p{L}\p{N}]') AND regexp_matches(substr(t, 201, 1), '[\p{L}\p{N}]')) THEN 200 ELSE e.l END AS cut FROM s)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, CASE WHEN cut > 0 THEN cut ELSE 200 END), '\s+$', '') END AS short FROM h""")
def safe_truncation(spark, d):
    """documents as captions of 200 characters, cut outside formulas and braces."""
    return table(spark, d, "documents").select("doc_id", texts.truncate_safely(F.col("text"), 200).alias("short"))


@query(f"""
WITH p AS ({_PAPERS}) SELECT id, CASE WHEN fine THEN 'available' END AS status, CASE WHEN fine THEN 'Mesh of ' || title END AS caption, CASE WHEN fine AND id % 7 > 0 THEN 'Part ' || title END AS alt, CASE WHEN fine AND id % 11 > 0 THEN 800 END AS width, CASE WHEN fine THEN 'image/png' END AS media_type
FROM (SELECT *, id % 3 < 2 AND id % 5 > 0 AND id % 13 > 0 AS fine FROM p)""")
def public_visuals(spark, d):
    """customers as figures: a third is not open, others are credited or of the wrong type."""
    p, k = _papers(spark, d), F.col("id")
    r = F.struct(
        F.lit("available").alias("status"), F.lit("pmc").alias("provider"), F.lit("https://pmc-oa-opendata.s3.amazonaws.com/a/f1.png").alias("image_url"), F.lit("https://example.org/a").alias("source_url"),
        F.when(k % 3 < 2, "CC BY 4.0").otherwise("CC BY-NC 4.0").alias("license"), F.concat(F.when(k % 5 > 0, "Mesh of ").otherwise("Photo by Jane Doe: "), "title").alias("caption"),
        F.when(k % 7 > 0, F.concat(F.lit("Part  "), "title")).otherwise("See caption.").alias("alt"), F.lit("Library").alias("source_label"), F.when(k % 13 > 0, "image/PNG").otherwise("image/jpeg").alias("media_type"),
        F.when(k % 11 > 0, 800).otherwise(0).alias("width"), F.lit(600).alias("height"), F.lit("2026-01-01").alias("checked_at"),
    )
    return p.select("id", rights.public_visual(r).alias("v")).select("id", *[F.col(f"v.{c}").alias(c) for c in ("status", "caption", "alt", "width", "media_type")])


# --- stores -----------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT *, 0 AS k FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 4 >= 2),
f AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS bucket, o_custkey, arg_min(o_orderpriority, (k, o_orderkey)) AS p FROM a GROUP BY ALL)
SELECT bucket, count(*) AS n_rows, count(*) FILTER (p = '1-URGENT') AS urgent FROM f GROUP BY 1""")
def merged_buckets(spark, d):
    """Customers of each month as a bucket, the first order seen of each; a second run brings
    rows that overlap the first's and late ones."""
    rows = table(spark, d, "orders").select(F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("bucket_date"), F.col("o_custkey").cast("string").alias("key"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    root = _folder(spark, "merged")
    for part in (rows.filter("o_orderkey % 4 < 3"), rows.filter("o_orderkey % 4 >= 2")):
        out = buckets.merge(spark, root, part, "bucket_date", ["key"], ["o_orderkey"], "priority")
    return out.select("bucket", "n_rows", F.coalesce(F.try_element_at("counts", F.lit("1-URGENT")), F.lit(0)).alias("urgent"))


@query("""
WITH m AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS bucket, o_orderpriority AS p FROM orders)
SELECT bucket, CASE WHEN month(bucket::DATE) = 1 THEN 7 ELSE count(*) END AS n_rows, count(*) AS expected_rows, count(*) FILTER (p = '1-URGENT') AS urgent FROM m WHERE month(bucket::DATE) IN (1, 2) GROUP BY bucket""")
def repaired_counts(spark, d):
    """Months of orders as buckets; each January's rows and each February's kinds are miscounted, found
    and mended. What stands afterwards is right, or the query fails."""
    rows = table(spark, d, "orders").select(F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("bucket_date"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("priority"))
    root = _folder(spark, "recount")
    held = buckets.merge(spark, root, rows, "bucket_date", ["key"], ["key"], "priority")
    month = F.substring("bucket", 6, 2)
    wrong = held.withColumn("n_rows", F.when(month == "01", 7).otherwise(F.col("n_rows"))).withColumn("counts", F.when(month == "02", F.create_map(F.lit("none"), F.lit(1).cast("long"))).otherwise(F.col("counts")))
    sinks.replace_atomically(spark, wrong, f"{root}/manifest")
    found = buckets.recount(spark, root, rows.schema, "bucket_date", "priority", apply=True)
    if not buckets.recount(spark, root, rows.schema, "bucket_date", "priority").isEmpty():
        raise RuntimeError("counts are wrong after the repair")
    return found.select("bucket", "n_rows", "expected_rows", F.coalesce(F.try_element_at("expected", F.lit("1-URGENT")), F.lit(0)).alias("urgent"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def keyed_first_seen(spark, d):
    """Events as a file stream; the first of each user and type, by keyed state."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_type", "event_id")
    root = _folder(spark, "keyed")
    keyed.run_available(keyed.first_seen(stream, ["user_id", "event_type"], ["event_id"]), f"{root}/rows", f"{root}/checkpoint")
    return keyed.held(spark, f"{root}/rows", stream.schema)


@query("""
WITH k AS (SELECT c_custkey FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 < 4 THEN CASE WHEN c_custkey % 2 = 0 THEN 'High' ELSE 'Low' END END AS priority,
  c_custkey % 7 = 0 OR c_custkey % 5 = 4 AS scorer_failed, CASE WHEN c_custkey % 7 = 0 THEN 'ValueError: no JSON' WHEN c_custkey % 5 = 4 THEN 'KeyError: ''priority''' END AS reason, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 4 THEN 3 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM k""")
def scored_at_once(spark, d):
    """Customers scored eight at a time: some answers are no JSON, some lack the priority, some
    come only when asked strictly."""

    def call(row: dict, strict: bool) -> dict:
        k = int(row["key"])
        if k % 7 == 0:
            raise ValueError("no JSON")
        if k % 3 == 0 and k % 5 < 4 and not strict:
            raise ValueError("prose")
        return {} if k % 5 == 4 else {"priority": "High" if k % 2 == 0 else "Low"}

    out = state.score_at_once(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")), call)
    return out.select("key", "priority", "scorer_failed", F.col("scorer_failed_reason").alias("reason"), F.col("scorer_failed_attempts").alias("attempts"))


@query("SELECT doi_or_arxiv_id, run_type, count(*) AS n, min(first_seen_at) AS first_at FROM (SELECT 'k' || user_id AS doi_or_arxiv_id, strftime(ts, '%Y-%m-%d') AS first_seen_at, CASE WHEN value > 100 THEN 'daily' ELSE 'backfill' END AS run_type FROM events) GROUP BY ALL")
def discovery_log(spark, d):
    """Events as observations of users, appended by run type; repeats count."""
    rows = table(spark, d, "events").select(F.concat(F.lit("k"), "user_id").alias("doi_or_arxiv_id"), F.date_format("ts", "yyyy-MM-dd").alias("first_seen_at"), "value")
    path = _folder(spark, "log")
    sinks.append_log(rows.filter("value > 100"), path, "daily")
    sinks.append_log(rows.filter("value <= 100 or value is null"), path, "backfill")
    log = spark.read.schema("doi_or_arxiv_id string, first_seen_at string, run_type string").json(path)
    return log.groupBy("doi_or_arxiv_id", "run_type").agg(F.count("*").alias("n"), F.min("first_seen_at").alias("first_at"))


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, count(*) AS n FROM orders GROUP BY 1) SELECT a.run_date, max(b.run_date) AS before FROM m a LEFT JOIN m b ON b.run_date < a.run_date WHERE a.run_date LIKE '1996-12-%' GROUP BY 1")
def manifest_before(spark, d):
    """Days with orders as runs; the last manifest before each day of a month."""
    runs = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date")).agg(F.count("*").alias("n"))
    path = _folder(spark, "manifests")
    runs.write.parquet(path)
    held, out = spark.read.parquet(path), None
    for day in range(1, 32):
        date = f"1996-12-{day:02d}"
        one = sinks.last_manifest_before(held, date).select(F.lit(date).alias("run_date"), F.col("run_date").alias("before"))
        out = one if out is None else out.unionByName(one)
    return out.join(held.select("run_date"), "run_date", "left_semi")


@query("SELECT o_orderkey, o_orderpriority AS priority, year(o_orderdate)::INTEGER AS year FROM orders WHERE o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1997")
def index_shard(spark, d):
    """Orders by priority and year; one shard is read."""
    path = _folder(spark, "index")
    sinks.write_index(table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")), path, ["priority", "year"])
    return spark.read.schema("o_orderkey long, priority string, year int").json(path).filter("priority = '2-HIGH' and year = 1997")


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def table_round_trip(spark, d):
    """Customers through a comma-separated table, then a tab-separated one."""
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), _folder(spark, "tables")
    for name, sep in (("csv", ","), ("tsv", "\t")):
        sinks.write_table(rows, f"{path}/{name}", sep)
        rows = spark.read.schema(rows.schema).option("header", True).option("sep", sep).csv(f"{path}/{name}")
    return rows


# --- pages, search, positions, walks ----------------------------------------------------------------


@query(f"""
WITH p AS ({_PAPERS}), r AS (SELECT *, row_number() OVER (ORDER BY date DESC, title DESC, id) AS n FROM p)
SELECT id, ((n - 1) // 20 + 1)::INTEGER AS page FROM r WHERE (n - 1) // 20 + 1 IN (1, 2, 30) OR n > (SELECT (count(*) - 1) // 20 * 20 FROM p)""")
def queue_seek(spark, d):
    """Customers as a queue; the first pages, one far in, and the last."""
    path = _folder(spark, "queue")
    paging.write_queue(_papers(spark, d).select("date", "title", F.col("id").alias("key"), "priority"), path, ["priority"])
    last = (paging.totals(spark, path).first()[0] + paging.SIZE - 1) // paging.SIZE
    out = None
    for number in sorted({1, 2, 30, last}):
        one = paging.page(spark, path, number).select(F.col("key").alias("id"), F.lit(number).alias("page"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, q.q AS query FROM documents, (VALUES ('icense'), ('the th'), ('$$$'), ('éé'), ('nowhere to be found')) q(q) WHERE contains(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), q.q)")
def trigram_search(spark, d):
    """Q01, Q02: documents found by substrings, by languages as years; one query is too short for a trigram."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path, out = _folder(spark, "trigrams"), None
    paging.write_index(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), (F.col("doc_id") % 3 + 2020).cast("int").alias("year"), low.alias("blob")), path)
    for q in ("icense", "the th", "$$$", "éé", "nowhere to be found"):
        one = paging.search_index(spark, path, q).select(F.col("key").cast("long").alias("doc_id"), F.lit(q).alias("query"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_custkey, n AS position, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = o_custkey % 9 + 1")
def positions_asked(spark, d):
    """Of each customer the order at a position of its own, by a two-level index."""
    rows, path = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), _folder(spark, "positions")
    windows.position_index(rows, "o_custkey", ["o_orderdate", "o_orderkey"], 8)[0].write.parquet(path)
    cut = spark.read.parquet(path)
    index = cut.groupBy("o_custkey", "_part").agg(F.count("*").alias("n"))
    wanted = rows.select("o_custkey", (F.col("o_custkey") % 9 + 1).alias("position"))
    return windows.works_at(cut, index, "o_custkey", ["o_orderdate", "o_orderkey"], wanted).select("o_custkey", "position", "o_orderkey")


@query("""
WITH r AS (SELECT c_nationkey AS j, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer), s AS (SELECT j, count(*) AS m FROM r GROUP BY 1),
t AS (SELECT j, m, least(CASE WHEN m <= 60 THEN 5 ELSE 2 END, m, 50) AS target, greatest(least(CASE WHEN m <= 60 THEN 5 ELSE 2 END, m, 50) - j % 3, 0) AS wanted FROM s),
w AS (SELECT r.*, row_number() OVER (PARTITION BY j ORDER BY sha256('2026-09-25|' || j || '|' || p), p) AS nth FROM r WHERE p <= 50),
u AS (SELECT w.*, target, wanted, k % 4 = 0 AS met FROM w JOIN t USING (j) WHERE nth <= target + 10),
b AS (SELECT *, coalesce(sum((NOT met)::INT) OVER (PARTITION BY j ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT j AS journal, k AS key, p AS position, nth::INTEGER AS nth FROM b WHERE before < wanted AND NOT met""")
def reading_walk(spark, d):
    """Nations as journals, customers as works; a quarter is known, some journals have picks already."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("journal"), F.col("c_custkey").alias("key"))
    path = _folder(spark, "walk")
    windows.position_index(c, "journal", ["key"], 8)[0].write.parquet(path)
    cut = spark.read.parquet(path)
    placed = windows.with_positions(cut, cut.groupBy("journal", "_part").agg(F.count("*").alias("n")), "journal", ["key"]).select("journal", "key", "position")
    have = c.groupBy("journal").agg(F.first(F.col("journal") % 3).cast("int").alias("k"))
    picks, _ = windows.walk(placed, "journal", "key", "2026-09-25", c.filter("key % 4 = 0").select("key"), have, small=60, cap=50)
    return picks.select("journal", "key", "position", "nth")


# --- smaller parts ----------------------------------------------------------------------------------


@query(r"""
SELECT event_id, 'arxiv' AS source, CASE WHEN event_id % 3 = 0 THEN '10.1/' || user_id ELSE '' END AS doi, '2401.' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS arxiv_id, event_type || ' of a mesh' AS title, strftime(ts, '%Y-%m-%d') AS date FROM events""")
def feed_rows(spark, d):
    """Events as entries of the preprint feed: versions stay in ids, line ends become spaces."""
    number = F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0")
    raw = table(spark, d, "events").select(
        "event_id", F.concat(F.lit("http://arxiv.org/abs/2401."), number, F.lit("v2")).alias("entry_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.1/"), "user_id", F.lit(" "))).alias("doi"),
        F.concat("event_type", F.lit(" of\n  a mesh")).alias("title"), F.lit("x").alias("summary"), F.array().cast("array<string>").alias("authors"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.array().cast("array<string>").alias("categories"),
    )
    out = readers.arxiv_rows(raw, "event_id")
    return out.select("event_id", "source", "doi", "arxiv_id", "title", "date")


@query("""
SELECT 'W' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '10.1/' || c_custkey ELSE '' END AS doi, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Lab ' || c_nationkey ELSE 'Institute' END AS affiliation,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_corresponding, CASE WHEN c_custkey % 10 > 3 THEN 'deep,mesh' ELSE 'mesh' END AS concepts FROM customer""")
def work_rows(spark, d):
    """Customers as works: concepts above 0.3, who corresponds, the first affiliation."""
    k = F.col("c_custkey")
    author = F.struct(
        F.struct(F.col("c_name").alias("display_name")).alias("author"), F.when(k % 2 == 0, F.array(F.concat(F.lit("Lab "), "c_nationkey"))).otherwise(F.array().cast("array<string>")).alias("raw_affiliation_strings"),
        F.array(F.struct(F.lit("Institute").alias("display_name"))).alias("institutions"), F.when(k % 3 == 0, True).alias("is_corresponding"),
    )
    concept = lambda name, score: F.struct(F.lit(name).alias("display_name"), score.cast("double").alias("score"))
    raw = table(spark, d, "customer").select(
        F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1/"), k)).alias("doi"), F.concat(F.lit(" "), "c_name").alias("title"), F.create_map(F.lit("a"), F.array(F.lit(0))).alias("abstract_inverted_index"),
        F.array(author).alias("authorships"), F.lit("2024-01-01").alias("publication_date"), F.lit(2024).alias("publication_year"), F.lit(1).alias("cited_by_count"), F.array(concept("deep", k % 10 / 10), concept("mesh", F.lit(0.9))).alias("concepts"),
    )
    return readers.openalex_rows(raw).select("id", "doi", "title", F.col("first_author_affiliation").alias("affiliation"), F.size("corresponding_authors").alias("n_corresponding"), F.concat_ws(",", "concepts").alias("concepts"))


@query("SELECT doc_id, (contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'license')::INT + contains(lower(coalesce(text, '')), 'nicht')::INT)::INTEGER AS hits FROM documents")
def keyword_hits(spark, d):
    """each keyword once, however often it stands in the text."""
    return table(spark, d, "documents").select("doc_id", texts.keyword_hits(F.col("text"), ["the", "License", "nicht"]).alias("hits"))


@query(f"""
WITH p AS ({_PAPERS}), r AS (SELECT strftime(DATE '2024-01-01' + INTERVAL (d) DAY, '%Y-%m-%d') AS run_date FROM range(0, 90, 3) t(d))
SELECT r.run_date, count(*) AS n FROM r JOIN p ON p.date = r.run_date GROUP BY 1""")
def papers_of_runs(spark, d):
    """Runs every third day, with the papers first seen on their date."""
    runs = spark.range(0, 90, 3).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("run_date"))
    seen = _papers(spark, d).withColumn("first_seen_at", F.concat("date", F.lit("T10:00:00Z")))
    return joins.runs_with_papers(runs, seen).groupBy("run_date").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'own' ELSE coalesce(n_name, '') END AS venue FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20")
def filled_venues(spark, d):
    """suppliers' missing venues from nations; a venue of one's own stays, unknown nations leave none."""
    names = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("found"))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 4 == 0, "own").otherwise("").alias("venue"))
    out = joins.lookup(rows, names.withColumnRenamed("s_nationkey", "n_nationkey"), "s_nationkey", "n_nationkey", {"found": ""})
    return out.select("s_suppkey", F.when(F.col("venue") != "", F.col("venue")).otherwise(F.col("found")).alias("venue"))


@query(f"""
WITH p AS ({_PAPERS}), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 3 WHEN 'Exclude' THEN 4 ELSE 2 END, id) AS n FROM p)
SELECT id, n::INTEGER AS n FROM r WHERE n <= 7""")
def capped_run(spark, d):
    """Of each day's papers the first seven cards: High, Medium, unscored, Low, Exclude."""
    p = F.col("priority")
    rank = F.when(p == "High", 0).when(p == "Medium", 1).when(p == "Low", 3).when(p == "Exclude", 4).otherwise(2)
    return windows.first_of(_papers(spark, d), ["date"], [rank, F.col("id")], 7, "n").select("id", "n")


@query(f"WITH p AS ({_PAPERS}) SELECT id, CASE WHEN doi <> '' THEN 'doi:' || doi ELSE '' END AS identity, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi END AS url FROM p")
def identities(spark, d):
    """public identities and where they lead."""
    key = identity.identity_key(F.col("doi"), F.lit(""))
    return _papers(spark, d).select("id", key.alias("identity"), F.nullif(identity.paper_url(key), F.lit("")).alias("url"))


@query("SELECT c_custkey, substr(c_name, 1, length(c_name) - instr(reverse(c_name), ' ')) AS first_name, reverse(split_part(reverse(c_name), ' ', 1)) AS last_name, o_date BETWEEN '1996-02-01' AND '1996-02-29' AS inside FROM (SELECT c_custkey, 'Dr ' || replace(c_name, '#', ' ') AS c_name, strftime(DATE '1996-01-01' + INTERVAL (c_custkey % 90) DAY, '%Y-%m-%d') AS o_date FROM customer)")
def author_names(spark, d):
    """customers as authors, and a window of publication dates."""
    name = texts.author_name(F.concat(F.lit("Dr "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int")).cast("string")
    return table(spark, d, "customer").select("c_custkey", name["first"].alias("first_name"), name["last"].alias("last_name"), dates.in_window(day, "1996-02-01", "1996-02-29").alias("inside"))


@query("""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket_date, o_orderstatus AS source, CASE WHEN o_custkey % 3 > 0 THEN 'd' || o_custkey % 4 ELSE '' END AS direction, CASE WHEN o_custkey % 6 = 0 THEN 'Named' END AS name, o_orderpriority AS p FROM orders)
SELECT bucket_date, count(*) AS total, count(*) FILTER (p <> '5-LOW') AS scored, count(*) FILTER (source = 'F') AS finished, count(*) FILTER (direction = 'd1') AS d1, count(*) FILTER (direction = '' AND name = 'Named') AS named, count(*) FILTER (p = '1-URGENT') AS urgent FROM o GROUP BY 1""")
def bucket_blocks(spark, d):
    """The counts block of months of orders; some have a direction, some only its name, some neither."""
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("bucket_date"), F.col("o_orderstatus").alias("source"), F.when(c % 3 > 0, F.concat(F.lit("d"), (c % 4).cast("string"))).otherwise("").alias("direction"),
        F.when(c % 6 == 0, "Named").alias("direction_name"), F.array().cast("array<string>").alias("directions"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderpriority") != "5-LOW").alias("scored"),
    )
    n = lambda block, key: F.coalesce(F.try_element_at(block, F.lit(key)), F.lit(0))
    out = aggregates.bucket_counts(rows)
    return out.select("bucket_date", "total", "scored", n("by_source", "F").alias("finished"), n("by_direction", "d1").alias("d1"), n("by_direction", "Named").alias("named"), n("priority_counts", "1-URGENT").alias("urgent"))


@query("""
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS b, CASE WHEN o_custkey % 3 > 0 THEN ['d' || o_custkey % 4] WHEN o_custkey % 6 = 0 THEN ['d1', 'd2'] ELSE [] END AS ds FROM orders)
SELECT b AS bucket_date, count(*) AS total, coalesce(sum(list_contains(ds, 'd1')::INT), 0)::BIGINT AS d1, coalesce(sum(list_contains(ds, 'd2')::INT), 0)::BIGINT AS d2 FROM p GROUP BY 1""")
def bucket_blocks_each(spark, d):
    """Rows without a direction count once for each of their directions."""
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("bucket_date"), F.col("o_orderstatus").alias("source"), F.when(c % 3 > 0, F.concat(F.lit("d"), (c % 4).cast("string"))).alias("direction"),
        F.lit("").alias("direction_name"), F.when(c % 6 == 0, F.array(F.lit("d1"), F.lit("d2"))).alias("directions"), F.col("o_orderpriority").alias("priority"), F.lit(True).alias("scored"),
    )
    n = lambda key: F.coalesce(F.try_element_at("by_direction", F.lit(key)), F.lit(0))
    return aggregates.bucket_counts(rows, by_each_direction=True).select("bucket_date", "total", n("d1").alias("d1"), n("d2").alias("d2"))


@query("WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), k AS (SELECT c_custkey, c_custkey IN (SELECT user_id FROM b) AS other FROM customer) SELECT count(*) FILTER (NOT other) AS kept, min(c_custkey) FILTER (NOT other) AS first_kept, count(*) FILTER (other) AS suppressed FROM k")
def without_backfill(spark, d):
    """Customers that runs other than daily ones (errors of users) have observed go, and are counted."""
    log = table(spark, d, "events").select(F.col("user_id").alias("doi_or_arxiv_id"), F.when(F.col("event_type") == "error", "backfill").otherwise("daily").alias("run_type"))
    kept, gone = joins.without_backfill(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), log, "key")
    return kept.agg(F.count("*").alias("kept"), F.min("key").alias("first_kept")).join(gone)


@query("""
WITH o AS (SELECT c_nationkey AS venue, list(DISTINCT c_custkey % 13) AS a FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1), n AS (SELECT c_nationkey AS venue, list(DISTINCT c_custkey % 17) AS b FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1)
SELECT n.venue, len(list_distinct(list_concat(coalesce(a, []), b))) AS n_positions, greatest(CASE WHEN a IS NOT NULL THEN 4 END, n.venue % 7)::INTEGER AS skipped_known FROM n LEFT JOIN o ON o.venue = n.venue""")
def merged_reports(spark, d):
    """Two reports of nations, the later one without every third: positions unite, skipped ones are not
    counted twice."""
    c, j = table(spark, d, "customer"), F.col("c_nationkey").alias("venue")
    old = c.filter("c_nationkey % 4 > 0").groupBy(j).agg(F.collect_set((F.col("c_custkey") % 13).cast("int")).alias("positions")).select("venue", "positions", F.lit(4).alias("skipped_known"))
    new = c.filter("c_nationkey % 3 > 0").groupBy(j).agg(F.collect_set((F.col("c_custkey") % 17).cast("int")).alias("positions")).select("venue", "positions", (F.col("venue") % 7).cast("int").alias("skipped_known"))
    return joins.merge_reports(old, new, "venue").select("venue", F.size("positions").cast("long").alias("n_positions"), "skipped_known")


@query("""
WITH r AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size % 2 = 0 THEN 'm/F' || p_size || '.jpg' ELSE 'm/F' || p_size || '.png' END AS path FROM r""")
def matched_media(spark, d):
    """parts' pictures by name, else by stem; sizes above 40 have no file."""
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    refs = p.select("p_partkey", F.concat(F.lit("F"), size, F.when(F.col("p_partkey") % 3 == 0, ".jpg").when(F.col("p_partkey") % 3 == 1, ".gif").otherwise(".tif")).alias("name"))
    files = p.filter("p_size <= 40").select("p_size").distinct().select(F.concat(F.lit("m/F"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".jpg").otherwise(".png")).alias("path"))
    return joins.match_media(refs, files).select("p_partkey", "path")


@query("""
WITH a AS (SELECT c_nationkey AS d, list(DISTINCT c_mktsegment) AS kw FROM customer WHERE c_nationkey < 20 AND c_acctbal > 8000 GROUP BY 1), b AS (SELECT s_nationkey AS d, ['BUILDING', 'new'] AS kw FROM supplier WHERE s_nationkey > 4 GROUP BY 1)
SELECT coalesce(a.d, b.d) AS direction, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'kept' END AS status, CASE WHEN a.d IS NULL OR b.d IS NULL THEN 0 ELSE len(list_filter(b.kw, lambda x: NOT list_contains(a.kw, x))) END AS n_added, CASE WHEN a.d IS NULL OR b.d IS NULL THEN 0 ELSE len(list_filter(a.kw, lambda x: NOT list_contains(b.kw, x))) END AS n_removed FROM a FULL JOIN b ON a.d = b.d""")
def config_changes(spark, d):
    """Nations as directions, segments as keywords, before and after; lists are compared where a
    direction stands in both."""
    old = table(spark, d, "customer").filter("c_nationkey < 20 and c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("direction")).agg(F.collect_set("c_mktsegment").alias("kw"))
    new = table(spark, d, "supplier").filter("s_nationkey > 4").select(F.col("s_nationkey").alias("direction")).distinct().withColumn("kw", F.array(F.lit("BUILDING"), F.lit("new")))
    out = joins.config_diff(old, new, "direction", ["kw"])
    n = lambda c: F.when(F.col("status") == "kept", F.size(c)).otherwise(0).cast("long")
    return out.select("direction", "status", n("kw_added").alias("n_added"), n("kw_removed").alias("n_removed"))


@query(f"""
WITH p AS ({_PAPERS}), m AS (SELECT id, CASE id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'to-read' WHEN 2 THEN '' END AS state, CASE WHEN id % 3 = 0 THEN ['mesh'] ELSE ['other'] END AS tags FROM p WHERE id % 4 < 3)
SELECT p.id, coalesce(nullif(m.state, ''), 'none') AS shown FROM p LEFT JOIN m USING (id) WHERE coalesce(nullif(m.state, ''), 'none') IN ('read', 'none') AND p.direction = 'BUILDING' AND (m.tags IS NULL OR NOT list_contains(m.tags, 'other'))""")
def marked_rows(spark, d):
    """Q04, Q05: a direction's papers that are read or unmarked; two passes, one of them narrowed by a tag."""
    p, k = _papers(spark, d).select(F.col("id").alias("key"), "direction"), F.col("key")
    marks = p.filter("key % 4 < 3").select("key", F.when(k % 4 == 0, "read").when(k % 4 == 1, "to-read").otherwise("").alias("state"), F.when(k % 3 == 0, F.array(F.lit("mesh"))).otherwise(F.array(F.lit("other"))).alias("tags"))
    rows = p.filter(search.facet_filter({"direction": "BUILDING"}))
    tagged = search.with_marks(rows, marks, ["read", "none"], ["mesh"])
    bare = search.with_marks(rows, marks, ["none"], []).filter("mark_tags is null")
    return tagged.unionByName(bare).select(k.alias("id"), F.coalesce(F.nullif("state", F.lit("")), F.lit("none")).alias("shown"))


@query(f"""
WITH p AS ({_PAPERS}) SELECT id FROM p WHERE id % 3 > 0 AND contains(lower(title || ' ' || direction), 'build') AND contains(lower(title || ' ' || direction), '00') AND source = 's1'""")
def reading_tab(spark, d):
    """Marks of a tab with a tag whose text has every term."""
    k = F.col("id")
    marks = _papers(spark, d).select(k.alias("key"), "title", F.lit("").alias("note"), "direction", F.when(k % 3 > 0, "to-read").otherwise("read").alias("state"), F.array("source").alias("tags"), F.col("date").alias("at"))
    return search.reading_list(marks, "to-read", "s1", " Build  00 ").select(F.col("key").alias("id"))


@query(f"WITH p AS ({_PAPERS}) SELECT id, CASE WHEN id % 6 = 0 THEN 'Unscored' WHEN priority IS NULL THEN 'Low' ELSE priority END AS shown, CASE WHEN id % 6 = 0 THEN 'Unscored' ELSE priority END AS counted FROM p")
def shown_priorities(spark, d):
    """priorities as they are shown and as the public view counts them; every sixth paper failed."""
    failed = F.col("id") % 6 == 0
    return _papers(spark, d).select("id", routing.display_priority(F.col("priority"), failed).alias("shown"), routing.public_priority(F.col("priority"), failed).alias("counted"))


@query(r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, role FROM conversations), w AS (SELECT *, (length(trim(t)) < 10 OR regexp_matches(t, '^\s*The'))::INT AS a, (length(role) < 10 OR role = 'assistant')::INT AS b FROM t)
SELECT conv_id, turn, role, CASE WHEN 2 * a + b = 0 THEN 'substantive' WHEN 2 * a + b >= 3 THEN 'vague_or_empty' ELSE 'partly_vague' END AS verdict FROM w""")
def summary_substance(spark, d):
    """a turn twice and its role as the fields of a summary."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", quality.substance([F.col("text"), F.col("text"), F.col("role")], ["The"]).alias("verdict"))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'xx' END AS own, lower(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, contains(b, 'nicht')::INT + contains(b, 'und')::INT AS de, contains(b, 'the')::INT + contains(b, 'with')::INT AS en, contains(b, 'les')::INT + contains(b, 'dans')::INT AS fr FROM t),
m AS (SELECT *, CASE own WHEN 'de' THEN de WHEN 'en' THEN en WHEN 'fr' THEN fr ELSE 0 END AS mine, greatest(CASE WHEN own <> 'de' THEN de ELSE -1 END, CASE WHEN own <> 'en' THEN en ELSE -1 END, CASE WHEN own <> 'fr' THEN fr ELSE -1 END) AS other FROM n)
SELECT doc_id, CASE WHEN own = 'xx' OR (mine = 0 AND other = 0) THEN 'questionable' WHEN mine >= other THEN 'appropriate' WHEN mine = 0 THEN 'likely_misrouted' WHEN mine >= other * 0.5 THEN 'appropriate' ELSE 'questionable' END AS verdict FROM m""")
def routing_verdicts(spark, d):
    """made-up directions of documents against their words."""
    k = F.col("doc_id") % 4
    own = F.when(k == 0, "de").when(k == 1, "en").when(k == 2, "fr").otherwise("xx")
    words = {"de": ["nicht", "und"], "en": ["the", "with"], "fr": ["les", "dans"]}
    return table(spark, d, "documents").select("doc_id", quality.routing_verdict(own, F.col("text"), words)["verdict"].alias("verdict"))


@query(r"""
SELECT conv_id, turn, role, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html FROM conversations""")
def escaped_turns(spark, d):
    """turns as HTML text."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", texts.escape_html(F.coalesce("text", F.lit(""))).alias("html"))


@query("SELECT doc_id, concat_ws(' ', nullif(lang, ''), nullif(source, ''), 'x', CAST(n_chars AS VARCHAR)) AS flat FROM documents")
def flattened(spark, d):
    """documents' fields as nested lists and objects, flattened to one text."""
    inner = F.to_json(F.struct(F.struct("lang").alias("a"), F.array(F.struct("source")).alias("b"), F.array(F.lit(""), F.lit("x")).alias("c"), F.struct(F.struct("n_chars").alias("n")).alias("d")))
    return table(spark, d, "documents").select("doc_id", texts.flatten(F.parse_json(inner)).alias("flat"))


@query("SELECT event_type AS day, event_type <> 'error' AS written, CASE WHEN event_type <> 'error' THEN count(*) ELSE 0 END AS n FROM events GROUP BY 1")
def skipped_buckets(spark, d):
    """Each event type as a bucket; one type's fetch is empty and leaves a marker instead."""
    rows, path, out = table(spark, d, "events").select("event_id", "event_type"), _folder(spark, "skips"), None
    for day in sorted(r.event_type for r in rows.select("event_type").distinct().collect()):
        own = rows.filter((F.col("event_type") == day) & F.lit(day != "error"))
        written = sinks.write_unless_empty(spark, own, f"{path}/{day}", day)
        held = spark.read.schema(own.schema).json(sinks.current(spark, f"{path}/{day}")) if written else own
        one = held.agg(F.lit(day).alias("day"), F.lit(written).alias("written"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT c_nationkey AS key, 'venue ' || c_nationkey AS value FROM customer WHERE c_nationkey % 4 > 0")
def resolved_batches(spark, d):
    """Nations of customers resolved three at a time; every fourth is unknown."""
    resolve = lambda keys: {k: f"venue {k}" for k in keys if int(k) % 4}
    out = readers.resolve_batches(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("venue_id")), "venue_id", resolve, 3)
    return out.select(F.col("key").cast("int").alias("key"), "value")


@query("SELECT 'k' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'available' WHEN s_suppkey % 3 = 0 THEN 'blocked' ELSE 'not_found' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'first' WHEN s_suppkey % 3 = 0 THEN 'second' ELSE NULL END AS provider FROM supplier")
def resolved_visuals(spark, d):
    """suppliers' figures by the first of two providers that has one."""
    first = lambda r: {"status": "available", "provider": "first"} if int(r["key"][1:]) % 2 == 0 else None
    second = lambda r: {"status": "blocked", "provider": "second"} if int(r["key"][1:]) % 3 == 0 else None
    return media.resolve_visuals(table(spark, d, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("key")), [first, second], "key string, status string, provider string")


@query("SELECT key, min_by(title, (run, pos)) AS title FROM (SELECT 'c' || o_custkey AS key, o_orderstatus AS run, o_orderkey AS pos, o_orderpriority AS title FROM orders) GROUP BY 1")
def migrated_firsts(spark, d):
    """Order statuses as run files in order of time; the first of each key wins."""
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("key"), F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"))
    return dedup.first_wins(rows, "key", [F.col("run"), F.col("pos")], keep_empty=False).select("key", "title")
