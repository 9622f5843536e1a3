"""The library's own queries on the driver's tables, each with its SQL.

The tables hold no papers, so each query applies an operator to a stand-in, named in its comment:
order dates stand for publication dates, market segments for directions, order priorities for
priorities, order statuses for scorer versions, words of part names for tags.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import dates, identity, quality, rights, routing
from corpuscle.functions import text as texts
from corpuscle.operators import aggregates, dedup, joins, search, windows
from corpuscle.runtime import shared_dir, table
from corpuscle.sources import readers
from corpuscle.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- identity and scalars -------------------------------------------------------------------------


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\.|m\.)?', ''), '#.*$', ''), '\?.*$', ''), '(index)?\.html?$', ''), '/+$', '') AS page_key FROM pages""")
def canonical_url_key(spark, d):
    """F01, F03, F06 on page URLs."""
    return table(spark, d, "pages").select("page_id", identity.page_key(F.col("url")).alias("page_key"))


@query(r"""
WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' HTTPS://doi.org/10.1000/A' || o_custkey WHEN 1 THEN 'doi:10.48550/arXiv.' || o_custkey || 'v2' WHEN 2 THEN '' END AS doi,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://arxiv.org/abs/' || o_custkey || 'v3' END AS arxiv_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey::VARCHAR END AS pmid FROM orders),
n AS (SELECT *, regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://dx\.doi\.org/|https?://doi\.org/|doi:)', '') AS d,
  regexp_replace(regexp_replace(lower(coalesce(arxiv_id, '')), '^https?://arxiv\.org/abs/', ''), 'v[0-9]+$', '') AS a FROM k)
SELECT o_orderkey, CASE WHEN d LIKE '10.48550/arxiv.%' THEN 'arxiv:' || regexp_replace(substr(d, 16), 'v[0-9]+$', '') WHEN d <> '' THEN 'doi:' || d WHEN a <> '' THEN 'arxiv:' || a WHEN pmid IS NOT NULL THEN 'pmid:' || pmid ELSE '' END AS canonical_key FROM n""")
def canonical_keys(spark, d):
    """Identifiers made from order and customer keys."""
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    doi = F.when(o % 4 == 0, F.concat(F.lit(" HTTPS://doi.org/10.1000/A"), c)).when(o % 4 == 1, F.concat(F.lit("doi:10.48550/arXiv."), c, F.lit("v2"))).when(o % 4 == 2, "")
    arxiv = F.when(o % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), c, F.lit("v3")))
    return table(spark, d, "orders").select("o_orderkey", identity.canonical_key(doi, arxiv, F.when(o % 5 == 0, c), F.lit("")).alias("canonical_key"))


@query("""
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate::DATE AS dd FROM orders)
SELECT o_orderkey, CASE WHEN d LIKE '%-01-01' THEN 'year' WHEN d LIKE '%-01' THEN 'month' ELSE 'day' END AS prec,
  printf('%d-W%02d', isoyear(dd), weekofyear(dd)) AS week, strftime(date_trunc('week', dd), '%Y-%m-%d') AS monday, strftime(date_trunc('week', dd) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday, year(dd)::INTEGER AS year, substr(d, 1, 7) AS year_month FROM t""")
def date_facts(spark, d):
    """order dates as publication dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    bounds, ym = dates.week_bounds(F.col("o_orderdate")), dates.year_and_month(day)
    return table(spark, d, "orders").select("o_orderkey", dates.date_precision(day).alias("prec"), dates.iso_week(F.col("o_orderdate")).alias("week"), bounds["monday"].cast("string").alias("monday"), bounds["sunday"].cast("string").alias("sunday"), ym["year"].alias("year"), ym["year_month"].alias("year_month"))


@query("""
WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders),
m AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))::DATE AS m, a, z FROM b)
SELECT strftime(m, '%Y-%m') AS month, strftime(greatest(m, a), '%Y-%m-%d') AS from_date, strftime(least(last_day(m), z), '%Y-%m-%d') AS to_date FROM m""")
def month_windows(spark, d):
    """Months of the whole range of order dates, with partial ends."""
    span = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    return span.select(F.explode(dates.month_windows(F.col("a"), F.col("z"))).alias("w")).select("w.month", F.col("w.from_date").cast("string").alias("from_date"), F.col("w.to_date").cast("string").alias("to_date"))


@query(r"""
SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_-]', '-', 'g') AS anchor, 'noid:' || substr(sha1(strftime(DATE '2024-01-01', '%Y-%m-%d') || '|' || c_custkey || '|' || c_mktsegment || '|' || c_name), 1, 16) AS fallback,
  'sha256:' || substr(sha256(c_name), 1, 16) AS content, CASE WHEN length(c_name) > 15 THEN substr(c_name, 1, 15) || '…' ELSE c_name END AS short FROM customer""")
def name_facts(spark, d):
    """customers as titles."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", identity.anchor(F.col("c_name")).alias("anchor"), identity.fallback_identity(F.lit("2024-01-01"), key, F.col("c_mktsegment"), F.col("c_name")).alias("fallback"), texts.content_hash(F.col("c_name")).alias("content"), texts.truncate(F.col("c_name"), 15).alias("short"))


# --- deduplication and merging --------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first_seen(spark, d):
    """The first event of each user and type."""
    return dedup.first_wins(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_latest_wins(spark, d):
    """Each customer's latest order; a tie keeps the earlier key."""
    return dedup.latest_wins(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'arxiv' WHEN 'assistant' THEN 'openalex' ELSE 'pubmed' END AS source,
  CASE WHEN (conv_id + turn) % 3 < 2 THEN '' ELSE text END AS abstract, CASE WHEN (conv_id * 7 + turn) % 4 = 1 THEN 'x' ELSE '' END AS doi FROM conversations),
l AS (SELECT conv_id, list(struct_pack(turn := turn, source := source, abstract := abstract, doi := doi) ORDER BY turn, source, abstract, doi) AS rows FROM r GROUP BY conv_id),
f AS (SELECT conv_id, rows[1].turn AS turn, list_reduce(rows, lambda a, x: CASE WHEN (a.abstract = '' AND x.abstract <> '') OR (a.source = 'arxiv' AND x.source IN ('openalex', 'pubmed') AND x.doi <> '') THEN x ELSE a END) AS w FROM l)
SELECT conv_id, turn, w.turn AS winner, w.source AS source FROM f""")
def merge_preference_fold(spark, d):
    """Turns of a conversation as copies of one paper."""
    role = F.when(F.col("role") == "user", "arxiv").when(F.col("role") == "assistant", "openalex").otherwise("pubmed")
    rows = table(spark, d, "conversations").select("conv_id", "turn", role.alias("source"), F.when((F.col("conv_id") + F.col("turn")) % 3 < 2, "").otherwise(F.col("text")).alias("abstract"), F.when((F.col("conv_id") * 7 + F.col("turn")) % 4 == 1, "x").otherwise("").alias("doi"), F.col("turn").alias("winner"))
    return dedup.preference_fold(rows, "conv_id", "turn", ["source", "abstract", "doi", "winner"], dedup.paper_preference).select("conv_id", "turn", "winner", "source")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
def anti_join_seen(spark, d):
    """Customers that no large order has seen."""
    seen = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return dedup.anti_join_seen(table(spark, d, "customer"), seen, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH m AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM m WHERE n = 1 AND event_type <> 'error'""")
def marks_merge(spark, d):
    """Users as papers, events as marks, errors as clears."""
    return dedup.latest_mark(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", "event_type", "error").select("user_id", "event_id", "event_type")


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100 AND ts < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100 AND ts >= TIMESTAMP '2024-01-16')
SELECT user_id, 'new' AS change FROM b WHERE user_id NOT IN (SELECT user_id FROM a) UNION ALL SELECT user_id, 'cleared' FROM a WHERE user_id NOT IN (SELECT user_id FROM b)""")
def digest_diff(spark, d):
    """Larger buyers of the second half of the month against the first."""
    rows, cut = table(spark, d, "events").filter("event_type = 'purchase' and value > 100"), F.lit("2024-01-16").cast("timestamp_ntz")
    new, cleared = joins.digest_diff(rows.filter(F.col("ts") >= cut).select("user_id").distinct(), rows.filter(F.col("ts") < cut).select("user_id").distinct(), "user_id")
    return new.withColumn("change", F.lit("new")).unionByName(cleared.withColumn("change", F.lit("cleared")))


@query("""
WITH u AS (SELECT 0 AS k, c_custkey AS id, 'n' || c_nationkey AS name FROM customer UNION ALL SELECT 1, s_suppkey * 37, 'n' || s_nationkey FROM supplier)
SELECT k, id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM u) WHERE n = 1""")
def source_union(spark, d):
    """Customers, then suppliers under ids of which many are new, the first of each id."""
    parts = [table(spark, d, t).select(F.lit(k).alias("k"), (F.col(f"{p}key") * (36 * k + 1)).alias("id"), F.concat(F.lit("n"), f"{t[0]}_nationkey").alias("name")) for k, (t, p) in enumerate((("customer", "c_cust"), ("supplier", "s_supp")))]
    return dedup.first_wins(parts[0].unionByName(parts[1]), "id", [F.col("k")])


@query("""
WITH k AS (SELECT DISTINCT p_name AS key FROM part), old AS (SELECT p_name AS key, min(p_partkey) AS seq FROM part WHERE p_name < 'm' GROUP BY p_name),
new AS (SELECT key, (SELECT max(seq) FROM old) + row_number() OVER (ORDER BY key) AS seq FROM k WHERE key >= 'm'),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT key, seq::BIGINT AS seq FROM u ORDER BY seq DESC LIMIT 60""")
def bounded_state(spark, d):
    """Part names as keys: those below m have been seen before, in order of part."""
    keys = table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    old = table(spark, d, "part").filter("p_name < 'm'").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("seq"))
    return dedup.bounded_state(old, keys, 60)


# --- routing --------------------------------------------------------------------------------------

DIRECTIONS = {
    "prose": {"display_name": "Prose", "strong_keywords": ["was", "und"], "must_pair_with": [["from", "this"], ["les", "dans"]]},
    "notices": {"display_name": "Notices", "strong_keywords": ["license", "rights"], "must_pair_with": [["general", "public"]]},
    "spanish": {"display_name": "Spanish", "strong_keywords": ["para", "los"], "must_pair_with": [["que", "del"]]},
}
EXCLUDED = ["idiot", "moron"]
KEPT = ["the", "les"]
#: What hard_exclusion leaves out and what keeps a text nevertheless.
LEFT_OUT, ANCHORED = ["license", "idiot", "moron"], ["apache", "nicht"]


def _has(term: str) -> str:
    return f"list_contains(ws, '{term}')"


def _points(cfg: dict) -> str:
    parts = [f"CASE WHEN {_has(k)} THEN 2 ELSE 0 END" for k in cfg["strong_keywords"]]
    parts += [f"CASE WHEN {' AND '.join(map(_has, p))} THEN 3 ELSE 0 END" for p in cfg["must_pair_with"]]
    return " + ".join(parts)


_OUT = f"({' OR '.join(map(_has, EXCLUDED))}) AND NOT ({' OR '.join(map(_has, [a for a in routing.ANCHORS if ' ' not in a]))} OR regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])hip implant($|[^\\p{{L}}\\p{{N}}_])'))"


@query(f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS b, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
s AS (SELECT doc_id, {_OUT} AS out, {', '.join(f'{_points(c)} AS {k}' for k, c in DIRECTIONS.items())} FROM t)
SELECT doc_id, CASE WHEN out OR greatest({', '.join(DIRECTIONS)}) < 2 THEN '' {' '.join(f"WHEN {k} = greatest({', '.join(DIRECTIONS)}) THEN '{k}'" for k in DIRECTIONS)} END AS direction,
  CASE WHEN out THEN 0 ELSE {' + '.join(f'({k} >= 2)::INTEGER' for k in DIRECTIONS)} END AS n_directions, out AS excluded FROM s""")
def route_documents(spark, d):
    """Document texts as abstracts, a small configuration."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("abstract"))
    out = routing.route(docs, DIRECTIONS, EXCLUDED)
    return out.select("doc_id", F.coalesce("direction", F.lit("")).alias("direction"), F.size("directions").alias("n_directions"), F.col("routing_reason").isNotNull().alias("excluded"))


@query(f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS b, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents)
SELECT doc_id, ({' OR '.join(map(_has, LEFT_OUT))}) AND NOT ({' OR '.join(map(_has, ANCHORED))}) AS excluded FROM t""")
def hard_exclusion(spark, d):
    """excluded words without an anchor."""
    return table(spark, d, "documents").select("doc_id", routing.is_excluded(F.lower(F.coalesce("text", F.lit(""))), LEFT_OUT, ANCHORED).alias("excluded"))


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Exclude' END AS pri, doc_id % 2 = 0 AND doc_id % 3 = 0 AS both_in FROM documents)
SELECT doc_id, CASE WHEN both_in AND pri = 'Low' THEN 'Medium' WHEN both_in AND pri = 'Medium' THEN 'High' ELSE pri END AS priority, CASE WHEN both_in AND pri IN ('Low', 'Medium') THEN pri END AS priority_pre_boost, both_in AND pri IN ('Low', 'Medium') AS priority_boosted FROM p""")
def crossover_boost(spark, d):
    """Directions and priorities by doc_id."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ["High", "Medium", "Low", "Exclude"])), (i % 4 + 1).cast("int")).alias("priority"), F.array_compact(F.array(F.when(i % 2 == 0, "rl_world_model"), F.when(i % 3 == 0, "fea_surrogate"))).alias("directions"))
    return routing.crossover_boost(routing.crossover_boost(rows)).select("doc_id", "priority", "priority_pre_boost", "priority_boosted")


# --- aggregates -----------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", day.alias("bucket_date"), F.col("c_mktsegment").alias("direction"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("scorer_version"), "o_totalprice", "c_nationkey")


_ORDERS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS bucket_date, c_mktsegment AS direction, o_orderpriority AS priority, o_orderstatus AS scorer_version, o_totalprice, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT substr(bucket_date, 1, 4)::INTEGER AS year, direction, priority, scorer_version, count(*) AS n FROM ({_ORDERS}) GROUP BY ALL")
def distribution_yearly(spark, d):
    """A01."""
    return aggregates.distribution(_orders(spark, d))[0]


@query(f"SELECT substr(bucket_date, 1, 7) AS year_month, count(*) AS n FROM ({_ORDERS}) GROUP BY ALL")
def distribution_monthly(spark, d):
    """A01."""
    return aggregates.distribution(_orders(spark, d))[1]


@query(f"SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'date' WHEN o_orderkey % 5 = 0 THEN 'direction' ELSE 'priority' END AS reason, count(*) AS n FROM ({_ORDERS}) WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 GROUP BY ALL")
def distribution_invalid(spark, d):
    """Rows made invalid by key, counted by their first reason."""
    bad = {"bucket_date": 7, "direction": 5, "priority": 3}
    rows = _orders(spark, d).withColumns({c: F.when(F.col("o_orderkey") % m != 0, F.col(c)) for c, m in bad.items()})
    return aggregates.distribution(rows)[2]


ALIASES = {"large": ["large", "big", "gizmo"], "gear": ["gear", "rod"]}
DROPPED = ["old"]
_TAGS = """
WITH t AS (SELECT year(l_shipdate)::INTEGER AS year, l_linestatus AS direction, unnest(string_split(p_name, ' ')) AS raw FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_quantity >= 10),
c AS (SELECT year, direction, CASE raw WHEN 'gizmo' THEN 'large' WHEN 'rod' THEN 'gear' ELSE raw END AS tag, count(*) AS n FROM t WHERE raw <> 'old' GROUP BY ALL)
"""


def _tags(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("bucket_date"), F.col("l_linestatus").alias("direction"), F.split("p_name", " ").alias("tags"),
        F.when(F.col("l_returnflag") != "R", "v3").otherwise("v1").alias("scorer_version"), F.when(F.col("l_quantity") >= 25, "High").when(F.col("l_quantity") >= 10, "Medium").otherwise("Low").alias("priority"),
    )
    return aggregates.tag_counts(rows, aliases=ALIASES, dropped=DROPPED)


@query(_TAGS + "SELECT * FROM c")
def tag_frequency(spark, d):
    """A02, F16."""
    return _tags(spark, d)


@query(_TAGS + ", g AS (SELECT year, direction, tag, n * (year - 1994) * (year - 1994) AS n FROM c) SELECT a.year, a.direction, a.tag, a.n, coalesce(b.n, 0) AS prev, a.n - coalesce(b.n, 0) AS delta FROM g a LEFT JOIN g b ON b.year = a.year - 1 AND b.direction = a.direction AND b.tag = a.tag WHERE a.n >= 5 AND a.n >= 2 * coalesce(b.n, 0)")
def emerging_terms(spark, d):
    """Counts that grow with the square of the years."""
    age = F.col("year") - 1994
    return aggregates.emerging(_tags(spark, d).withColumn("n", F.col("n") * age * age))


@query("""
WITH t AS (SELECT year(o_orderdate)::INTEGER AS year, CASE o_orderkey % 5 WHEN 0 THEN 'Finite Element Method' WHEN 1 THEN 'Fourier neural operator' WHEN 2 THEN 'PINN' ELSE 'other' END AS tag FROM orders)
SELECT year, count(*) FILTER (WHERE tag LIKE 'Finite%') AS fem, count(*) FILTER (WHERE tag LIKE 'Fourier%' OR tag = 'PINN') AS pinn FROM t GROUP BY year""")
def family_showdown(spark, d):
    """Tags by order key."""
    k = F.col("o_orderkey") % 5
    tag = F.when(k == 0, "Finite Element Method").when(k == 1, "Fourier neural operator").when(k == 2, "PINN").otherwise("other")
    return aggregates.family_showdown(table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), tag.alias("tag"), F.lit(1).alias("n")).groupBy("year", "tag").agg(F.sum("n").alias("n")))


@query(f"""
WITH o AS (SELECT substr(bucket_date, 1, 4)::INTEGER AS year, direction, priority FROM ({_ORDERS})),
g AS (SELECT year, direction, count(*) FILTER (WHERE priority IN ('1-URGENT', '2-HIGH')) AS hm, count(*) AS total FROM o GROUP BY ALL)
SELECT y.year, x.direction, hm::BIGINT AS hm, total::BIGINT AS total, round(hm::DOUBLE / total, 6) AS ratio FROM (SELECT DISTINCT year FROM o) y CROSS JOIN (SELECT DISTINCT direction FROM o) x LEFT JOIN g ON g.year = y.year AND g.direction = x.direction""")
def priority_ratio(spark, d):
    """Urgent and high orders as High and Medium."""
    rows = _orders(spark, d).withColumn("priority", F.when(F.col("priority") == "1-URGENT", "High").when(F.col("priority") == "2-HIGH", "Medium").otherwise("Low"))
    return aggregates.priority_ratio(aggregates.distribution(rows)[0])


@query(f"""
SELECT substr(bucket_date, 1, 4)::INTEGER AS year, count(*) FILTER (WHERE direction = 'BUILDING') AS BUILDING, count(*) FILTER (WHERE direction = 'MACHINERY') AS MACHINERY, count(*) FILTER (WHERE direction NOT IN ('BUILDING', 'MACHINERY')) AS OTHER
FROM ({_ORDERS}) WHERE scorer_version = 'F' GROUP BY 1""")
def stacked_directions(spark, d):
    """Two known segments, others as OTHER; finished orders as the primary scorer's."""
    rows = _orders(spark, d).withColumn("scorer_version", F.when(F.col("scorer_version") == "F", "v3").otherwise("v1"))
    return aggregates.stacked(aggregates.distribution(rows)[0], ["BUILDING", "MACHINERY"])


@query(f"""
WITH o AS (SELECT priority, substr(bucket_date, 1, 4) AS year, CASE WHEN direction = 'BUILDING' THEN '' ELSE direction END AS direction, CASE WHEN scorer_version = 'P' THEN '' ELSE scorer_version END AS relevance FROM ({_ORDERS}))
SELECT priority, year, direction, relevance, count(*) AS n FROM o GROUP BY GROUPING SETS ((priority, year), (priority, year, direction), (priority, year, relevance), (priority, year, direction, relevance))
HAVING (grouping(direction) = 1 OR direction <> '') AND (grouping(relevance) = 1 OR relevance <> '')""")
def facet_cube(spark, d):
    """By priority and year; direction and relevance as facets, some blank."""
    blank = lambda c, v: F.when(F.col(c) == v, "").otherwise(F.col(c))
    rows = _orders(spark, d).select("priority", F.substring("bucket_date", 1, 4).alias("year"), blank("direction", "BUILDING").alias("direction"), blank("scorer_version", "P").alias("relevance"))
    return aggregates.facet_cube(rows, ["priority", "year"], ["direction", "relevance"])


@query(f"SELECT substr(bucket_date, 1, 7) AS month, sum(n)::BIGINT AS n FROM (SELECT bucket_date, count(*) AS n FROM ({_ORDERS}) GROUP BY 1) GROUP BY 1")
def month_rollup(spark, d):
    """A13."""
    return aggregates.month_rollup(_orders(spark, d).groupBy(F.col("bucket_date").alias("date")).agg(F.count("*").alias("n")))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY ROLLUP (date, event_type)")
def weekly_totals(spark, d):
    """Events by day and type, with totals."""
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_type")
    return aggregates.weekly_totals(rows, "event_type")


@query("""
WITH p AS (SELECT c_mktsegment AS segment, CASE c_custkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Unscored' END AS priority FROM customer),
g AS (SELECT segment, priority, count(*) AS n FROM p WHERE priority IS NOT NULL GROUP BY ALL),
z AS (SELECT segment, priority FROM (SELECT DISTINCT segment FROM p) CROSS JOIN (VALUES ('High'), ('Medium'), ('Low'), ('Exclude')) v(priority))
SELECT coalesce(z.segment, g.segment) AS segment, coalesce(z.priority, g.priority) AS priority, coalesce(n, 0) AS n FROM z FULL JOIN g ON z.segment = g.segment AND z.priority = g.priority""")
def priority_counts(spark, d):
    """Zero-filled counts by priority; Unscored only where it occurs."""
    k = F.col("c_custkey") % 5
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.when(k == 0, "High").when(k == 1, "Low").when(k == 2, "Unscored").alias("priority"))
    return aggregates.priority_counts(rows, "segment")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS stored FROM orders), c AS (SELECT l_orderkey, count(*) AS recounted FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS key, stored, coalesce(recounted, 0) AS recounted FROM o FULL JOIN c ON o_orderkey = l_orderkey WHERE stored IS DISTINCT FROM coalesce(recounted, 0)""")
def derived_count_audit(spark, d):
    """A made-up count of lines on each order against a recount."""
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 9).alias("n"))
    return aggregates.count_audit(stored, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key", "n")


@query("SELECT o_orderstatus AS source, count(*) AS fetched, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS routed, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE / count(*), 6) AS retention FROM orders GROUP BY 1")
def source_retention(spark, d):
    """Statuses as sources, urgent orders as routed."""
    return aggregates.retention(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "source"), "source", F.col("o_orderpriority") == "1-URGENT")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, substr(sha256(array_to_string(list_sort(list(sha256(o_orderkey::VARCHAR))), chr(10))), 1, 16) AS revision FROM orders GROUP BY 1")
def day_revisions(spark, d):
    """A revision of each day's orders."""
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").cast("string").alias("body"))
    return aggregates.revision(rows, "day", "body")


# --- windows, order, samples ----------------------------------------------------------------------


@query(f"SELECT o_orderkey, bucket_date, position::INTEGER AS position, ceil(position / 20.0)::INTEGER AS page FROM (SELECT o_orderkey, substr(bucket_date, 1, 7) AS bucket_date, row_number() OVER (PARTITION BY substr(bucket_date, 1, 7) ORDER BY priority, o_orderkey) AS position FROM ({_ORDERS}))")
def day_pages(spark, d):
    """Months as days, so that a bucket has many pages."""
    return windows.pages(_orders(spark, d).withColumn("bucket_date", F.substring("bucket_date", 1, 7)), ["bucket_date"], [F.col("priority"), F.col("o_orderkey")]).select("o_orderkey", "bucket_date", "position", "page")


@query(f"SELECT bucket_date, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY bucket_date ORDER BY priority, o_orderkey) AS n FROM ({_ORDERS}) WHERE priority IN ('1-URGENT', '2-HIGH')) WHERE n = 1")
def day_top_paper(spark, d):
    """Urgent and high orders as High and Medium."""
    rows = _orders(spark, d).withColumn("priority", F.when(F.col("priority") == "1-URGENT", "High").when(F.col("priority") == "2-HIGH", "Medium").otherwise("Low"))
    return windows.day_top_paper(rows, "bucket_date", "priority", "o_orderkey").select("bucket_date", "o_orderkey")


@query("SELECT d AS date, lag(d) OVER (ORDER BY d) AS prev_date, lead(d) OVER (ORDER BY d) AS next_date FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)")
def prev_next_date(spark, d):
    """W04."""
    return windows.neighbours(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")), "date")


@query("""
WITH c AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag, 1 AS one FROM part), g AS (SELECT p_brand, tag, count(*) AS n FROM c GROUP BY ALL)
SELECT p_brand, tag, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, tag) AS rank FROM g) WHERE rank <= 5""")
def top_tags_per_group(spark, d):
    """Words of part names by brand."""
    counts = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).groupBy("p_brand", "tag").agg(F.count("*").alias("n"))
    return windows.first_of(counts, ["p_brand"], [F.desc("n"), F.col("tag")], 5)


@query("""
WITH s AS (SELECT c_nationkey AS source, count(*) AS size FROM customer GROUP BY 1), a AS (SELECT *, least(2, size) AS base, size - least(2, size) AS room FROM s),
b AS (SELECT *, greatest(0, 150 - sum(base) OVER ()) AS "left", sum(CASE WHEN room > 0 THEN size ELSE 0 END) OVER () AS whole FROM a),
c AS (SELECT *, least(CASE WHEN room > 0 THEN ("left" * size) // whole ELSE 0 END, room) AS fl FROM b),
e AS (SELECT *, "left" - sum(fl) OVER () AS rest, room > fl AS o, (CASE WHEN room > 0 THEN "left" * size ELSE 0 END) - fl * whole AS rem FROM c),
f AS (SELECT *, row_number() OVER (ORDER BY o DESC, rem DESC, source) AS nth FROM e)
SELECT source, size, (base + fl + (o AND nth <= rest)::INTEGER)::BIGINT AS k FROM f""")
def stratified_allocation(spark, d):
    """150 customers over nations."""
    return windows.allocation(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.count("*").alias("size")), "source", 150)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('2026-01-01|' || source || '|' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS v FROM documents) WHERE n <= CASE WHEN v <= 200 THEN 5 ELSE 2 END")
def deterministic_sample(spark, d):
    """Sources as journals."""
    return windows.journal_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "2026-01-01").select("source", "doc_id")


@query(f"""
WITH w AS (SELECT *, printf('%d-W%02d', isoyear(bucket_date::DATE), weekofyear(bucket_date::DATE)) AS week FROM ({_ORDERS}) WHERE priority IN ('1-URGENT', '2-HIGH'))
SELECT week, direction, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY week, direction ORDER BY priority, o_totalprice DESC, o_orderkey) AS rank FROM w) WHERE rank <= 3""")
def weekly_top_picks(spark, d):
    """By ISO week and segment; prices as citations."""
    rows = _orders(spark, d).filter(F.col("priority").isin("1-URGENT", "2-HIGH")).withColumn("week", dates.iso_week(F.col("bucket_date").cast("date")))
    return windows.first_of(rows, ["week", "direction"], [F.col("priority"), F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("week", "direction", "o_orderkey", "rank")


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, direction ORDER BY bucket_date DESC, o_orderkey) AS n FROM ({_ORDERS}) WHERE priority IN ('1-URGENT', '2-HIGH'))
SELECT o_orderkey, bucket_date, direction, row_number() OVER (ORDER BY bucket_date DESC, priority, direction, o_orderkey)::INTEGER AS rank FROM l WHERE n = 1""")
def export_candidates(spark, d):
    """The latest order of each nation and segment, of two priorities, ranked."""
    rows = _orders(spark, d).withColumn("key", F.concat_ws(":", "c_nationkey", "direction"))
    rows = rows.withColumn("priority", F.when(F.col("priority") == "1-URGENT", "High").when(F.col("priority") == "2-HIGH", "Medium").otherwise("Low"))
    last = dedup.latest_wins(rows.filter(routing.min_priority(F.col("priority"), "Medium")), "key", "bucket_date", "o_orderkey")
    ranked = windows.ranked_by_day(last, "bucket_date", windows.export_order("bucket_date", "priority", "direction", "o_orderkey")[1:])
    return ranked.select("o_orderkey", "bucket_date", "direction", "rank")


# --- joins and search -----------------------------------------------------------------------------


@query("""
WITH i AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, text FROM documents),
x AS (SELECT item_id, lower(text) AS k, CASE item_id % 3 WHEN 0 THEN 'must_read' WHEN 1 THEN 'useful' ELSE 'peripheral' END AS tier FROM i),
c AS (SELECT lower(line) AS k, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(list_append(string_split(text, chr(10)), text)) AS line FROM documents) GROUP BY 1),
j AS (SELECT x.*, c.doc_id, CASE c.doc_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' WHEN 3 THEN 'Exclude' END AS p FROM x LEFT JOIN c USING (k))
SELECT item_id, doc_id, CASE WHEN doc_id IS NULL THEN 'missing_' || tier WHEN tier = 'must_read' THEN CASE WHEN p IN ('High', 'Medium') THEN 'correct_must_read' ELSE 'under_scored' END
  WHEN tier = 'useful' THEN CASE WHEN p IN ('Medium', 'Low') THEN 'correct_useful' WHEN p = 'Exclude' THEN 'under_scored' ELSE 'over_scored' END
  ELSE CASE WHEN p IN ('Low', 'Exclude') THEN 'correct_peripheral' ELSE 'over_scored' END END AS verdict FROM j""")
def reference_list_verdicts(spark, d):
    """Benchmark items and documents as listed papers, whole texts of documents and their whole
    lines as the corpus."""
    k = F.lower("text").alias("k")
    tier = F.element_at(F.array(*map(F.lit, ["must_read", "useful", "peripheral"])), (F.col("item_id") % 3 + 1).cast("int"))
    own = table(spark, d, "documents").select((F.lit(1_000_000) + F.col("doc_id")).alias("item_id"), "text")
    listed = table(spark, d, "benchmark").select("item_id", "text").unionByName(own).select("item_id", k, tier.alias("tier"))
    found = joins.list_matches(listed, table(spark, d, "documents").select(F.explode(F.array_append(F.split("text", "\n"), F.col("text"))).alias("text"), "doc_id").select(k, "doc_id"), "k", ["doc_id"])
    i = F.col("doc_id") % 4
    p = F.when(i == 0, "High").when(i == 1, "Medium").when(i == 2, "Low").when(i == 3, "Exclude")
    verdict = F.when(F.col("present"), quality.present_verdict(F.col("tier"), p)).otherwise(quality.missing_verdict(F.col("tier")))
    return found.select("item_id", "doc_id", verdict.alias("verdict"))


@query("""
WITH m AS (SELECT doc_id, source, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'license') AND lang = 'en')
SELECT doc_id, rank::INTEGER AS rank, (SELECT count(*) FROM m) AS total FROM (SELECT *, row_number() OVER (ORDER BY source DESC, doc_id) AS rank FROM m) WHERE rank <= 50""")
def search_filter(spark, d):
    """Whole texts as blobs, sources as dates."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("date"), F.col("lang").alias("direction"), F.lit("High").alias("priority"), F.lit("").alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("blob"))
    rows, total = search.search(docs, " License ", direction="en")
    rank = F.row_number().over(windows.W.orderBy(F.desc("date"), "key"))
    return rows.select(F.col("key").alias("doc_id"), rank.alias("rank")).join(F.broadcast(total))


@query(r"""
WITH k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a' || c_nationkey ELSE '' END AS arxiv, 'd' || (c_custkey // 2) AS doi FROM customer),
g AS (SELECT doi, min(nullif(arxiv, '')) AS a, max(nullif(arxiv, '')) AS b FROM k GROUP BY 1)
SELECT c_custkey, k.doi, coalesce(nullif(arxiv, ''), CASE WHEN a = b THEN a END, '') AS arxiv FROM k JOIN g ON g.doi = k.doi""")
def borrowed_ids(spark, d):
    """Pairs of customers share a DOI; an id is borrowed where the group has exactly one."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("d"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("doi"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("a"), "c_nationkey")).otherwise("").alias("arxiv"))
    return joins.borrow_unique(rows, "doi", "arxiv")


@query("""
WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey % 3 = 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def precedence_union(spark, d):
    """A nation's row from the first of two files that has it."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return joins.precedence_union([n.filter("k % 2 = 0"), n.filter("k % 3 = 0").withColumn("v", F.lower("v"))], "k")


@query("SELECT c_custkey, coalesce(n_name, '?') AS nation, coalesce(r_name, '?') AS region FROM customer LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def dimension_lookup(spark, d):
    """Nations as configured directions, with a default."""
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return joins.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey", "n_nationkey", {"nation": "?", "region": "?"}).select("c_custkey", "nation", "region")


# --- audits, gates, cost --------------------------------------------------------------------------


@query("""
SELECT d.doc_id, round(100.0 * ((trim(coalesce(text, '')) <> '')::INTEGER + (coalesce(lang, '') <> '')::INTEGER + (quality IS NOT NULL)::INTEGER + (toxic IS NOT NULL)::INTEGER) / 4, 1) AS completeness,
  CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 AND contains(lower(text), 'nicht') THEN CASE WHEN contains(lower(text), 'das') THEN 'mild_mismatch' ELSE 'clear_mismatch' END WHEN quality = 0 AND contains(lower(text), 'das') AND NOT contains(lower(text), 'nicht') THEN 'clear_mismatch' ELSE 'consistent' END AS consistency
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def quality_audit(spark, d):
    """labels as scores."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    fields = [quality.filled(F.col("text")), quality.filled(F.col("lang")), F.col("quality").isNotNull(), F.col("toxic").isNotNull()]
    priority = F.when(F.col("quality") == 1, "High").when(F.col("quality") == 0, "Low").otherwise("")
    return rows.select("doc_id", quality.completeness(fields).alias("completeness"), quality.consistency(priority, F.col("text"), F.lit(""), ["nicht"], ["das"]).alias("consistency"))


@query("SELECT lang AS value, 'lang' AS \"column\", count(*) AS n, NULL::DOUBLE AS mean FROM documents GROUP BY 1 UNION ALL SELECT source, 'source', count(*), NULL FROM documents GROUP BY 1 UNION ALL SELECT NULL, 'n_chars', count(*), round(avg(n_chars), 6) FROM documents")
def audit_rollup(spark, d):
    """A mean and two histograms in one pass."""
    return aggregates.audit_rollup(table(spark, d, "documents"), ["n_chars"], ["lang", "source"])


@query("""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'view') AS routed, count(*) FILTER (WHERE event_type = 'purchase') AS hm, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup' AND user_id < 5) AS s FROM events GROUP BY 1),
f AS (SELECT *, list_filter([CASE WHEN fetched < 50 THEN 'low_fetch_count' END, CASE WHEN routed = 0 THEN 'zero_routed' END, CASE WHEN hm = 0 AND routed > 0 THEN 'zero_high_medium' END, CASE WHEN failed > 0 THEN 'scorer_failed' END, CASE WHEN s = 0 THEN 'signup_returned_zero' END], lambda x: x IS NOT NULL) AS flags FROM e)
SELECT day, array_to_string(flags, ',') AS flags, CASE WHEN failed > 0 AND failed >= greatest(hm, 1) THEN 'scorer_failed' ELSE '' END AS reasons FROM f""")
def health_gate(spark, d):
    """events by day as runs; errors as failed scores."""
    n = lambda t, more=F.lit(True): F.count_if((F.col("event_type") == t) & more)
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("fetched"), n("view").alias("routed"), n("purchase").alias("hm"), n("error").alias("failed"), n("signup", F.col("user_id") < 5).alias("s"))
    flags = quality.quality_flags(F.col("fetched"), F.col("routed"), F.col("hm"), F.col("failed"), {"signup": F.col("s")})
    return days.withColumn("f", flags).select("day", F.array_join("f", ",").alias("flags"), F.array_join(quality.health_reasons(F.lit("success"), F.col("f"), F.col("failed"), F.col("hm")), ",").alias("reasons"))


@query("""
SELECT event_id, coalesce(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-07-15 00:00:00') >= CASE event_type WHEN 'view' THEN 180 WHEN 'click' THEN 180 WHEN 'error' THEN 1 WHEN 'signup' THEN 30 END * 86400, TRUE) AS stale FROM events""")
def ttl_refresh(spark, d):
    """Event types as statuses of visual records."""
    t = F.col("event_type")
    status = F.when(t == "view", "available").when(t == "click", "blocked").when(t == "error", "error").when(t == "signup", "not_found")
    return table(spark, d, "events").select("event_id", dates.should_refresh(status, F.date_trunc("second", "ts"), F.lit("2024-07-15").cast("timestamp")).alias("stale"))


@query("""
WITH e AS (SELECT event_id, event_type, CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 'peak' ELSE 'off_peak' END AS win, user_id * 100 AS prompt, CASE WHEN event_id % 2 = 0 THEN user_id * 40 END AS hit, user_id * 10 AS completion FROM events)
SELECT win AS "window", count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum(CASE WHEN hit IS NULL THEN prompt ELSE prompt - hit END * 3 + coalesce(hit, 0) + completion * 9)::DOUBLE / 1000000, 4) AS cost FROM e GROUP BY 1""")
def cost_by_window(spark, d):
    """Calls with made-up token counts by price window."""
    u, even = F.col("user_id"), F.col("event_id") % 2 == 0
    rows = table(spark, d, "events").select(dates.price_window(F.col("ts")).alias("window"), (u * 100).alias("prompt"), F.when(even, u * 40).alias("hit"), F.when(even, u * 60).alias("miss"), (u * 10).alias("completion"))
    rates = (1.0, 3.0, 9.0)
    sums = rows.groupBy("window").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum(F.coalesce("hit", F.lit(0))).alias("_h"), F.sum(F.coalesce("miss", "prompt")).alias("_m"))
    return sums.select("window", "calls", "prompt", "completion", F.round((F.col("_h") * rates[0] + F.col("_m") * rates[1] + F.col("completion") * rates[2]) / 1_000_000, 4).alias("cost"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' Introduction, method, result, discussion; conclusion' ELSE '' END AS s FROM documents), l AS (SELECT doc_id, s, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM t)
SELECT doc_id, length(s) >= 6000 AND len(ls) > 0 AND len(list_filter(ls, lambda x: substr(x, 1, 1) IN ('•', '→', '■', '○', '►'))) * 4 <= len(ls)
  AND (contains(lower(s), 'introduction')::INT + contains(lower(s), 'method')::INT + contains(lower(s), 'result')::INT + contains(lower(s), 'conclusion')::INT + contains(lower(s), 'discussion')::INT + contains(lower(s), 'experiment')::INT + contains(lower(s), 'we propose')::INT + contains(lower(s), 'we present')::INT + contains(lower(s), 'et al.')::INT) >= 5 AS article, len(ls) AS n_lines FROM l""")
def article_likeness(spark, d):
    """every second document names the sections of an article."""
    s = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " Introduction, method, result, discussion; conclusion").otherwise(""))
    lines = F.size(F.filter(F.split(s, "\n"), lambda x: F.btrim(x) != "")).cast("long")
    return table(spark, d, "documents").select("doc_id", texts.looks_like_article(s).alias("article"), lines.alias("n_lines"))


@query(r"""
WITH k AS (SELECT c_custkey, c_custkey % 2 = 1 AS nc, c_custkey % 3 = 0 AS nd, c_custkey % 4 < 2 AS sa, c_custkey % 5 AS form FROM customer)
SELECT c_custkey, CASE WHEN form = 4 THEN CASE WHEN sa THEN 'CC BY-SA' ELSE 'CC BY' END WHEN form = 3 THEN CASE WHEN nd THEN 'CC0' ELSE 'Licence of nation ' || c_custkey END ELSE 'CC BY' || CASE WHEN nc THEN '-NC' ELSE '' END || CASE WHEN nd THEN '-ND' WHEN sa THEN '-SA' ELSE '' END END AS label,
  CASE WHEN form = 4 THEN CASE WHEN sa THEN 'CC BY-SA' ELSE 'CC BY' END ELSE '' END AS from_url, form IN (0, 2) AND (nc OR nd) AS restricted FROM k""")
def license_labels(spark, d):
    """licences put together from parts by customer key: three spellings, others' names, exact URLs."""
    k = F.col("c_custkey")
    nc, nd, sa, form = k % 2 == 1, k % 3 == 0, k % 4 < 2, k % 5
    sep = F.element_at(F.array(F.lit("-"), F.lit("_"), F.lit(" "), F.lit("-"), F.lit("-")), (form + 1).cast("int"))
    name = F.concat_ws("|", F.lit("CC"), F.lit("by"), F.when(nc, "NC"), F.when(nd, "nd"), F.when(sa, "SA"), F.lit("v4.0"))
    url = F.concat(F.lit("https://creativecommons.org/licenses/"), F.when(sa, "by-sa").otherwise("by"), F.lit("/4.0/"))
    other = F.when(nd, "CC0").otherwise(F.concat(F.lit("Licence of nation "), k.cast("string")))
    raw = F.when(form == 4, url).when(form == 3, other).otherwise(F.replace(name, F.lit("|"), sep))
    return table(spark, d, "customer").select("c_custkey", rights.license_label(raw).alias("label"), rights.license_url(raw).alias("from_url"), rights.is_restricted(raw).alias("restricted"))


@query("SELECT item_id, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''), ' ') AS text FROM benchmark")
def inverted_index_text(spark, d):
    """An inverted index made from each item, and its text again."""
    words = F.filter(F.split(F.regexp_replace("text", "\n", " "), " "), lambda x: x != "")
    spots = table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    index = spots.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("i"))
    return index.select("item_id", readers.inverted_index_text(F.col("i")).alias("text"))


# --- operators on made-up papers ------------------------------------------------------------------
#
# Customers stand for papers here: names for titles, segments for directions, nations for sources.

_PAPERS = """
SELECT c_custkey AS id, c_name AS title, c_mktsegment AS direction, 's' || (c_nationkey % 4) AS source, CASE c_custkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' WHEN 3 THEN 'Exclude' END AS priority,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '10.1/' || (c_custkey // 2) END AS doi, strftime(DATE '2024-01-01' + INTERVAL (c_custkey % 90) DAY, '%Y-%m-%d') AS date, c_custkey % 4 AS attempts, round(c_acctbal)::BIGINT AS cites FROM customer"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.when(k % 5 == 0, "High").when(k % 5 == 1, "Medium").when(k % 5 == 2, "Low").when(k % 5 == 3, "Exclude")
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("direction"), F.concat(F.lit("s"), F.col("c_nationkey") % 4).alias("source"), names.alias("priority"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("10.1/"), F.floor(k / 2).cast("string"))).alias("doi"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).cast("string").alias("date"),
        (k % 4).alias("attempts"), F.round("c_acctbal").cast("long").alias("cites"),
    )


@query(f"WITH p AS ({_PAPERS}) SELECT id, CASE WHEN doi <> '' THEN 'doi:' || doi ELSE source || ':' || id END AS key FROM p WHERE id % 3 <> 0 UNION ALL SELECT id, 'arxiv:' || id FROM p WHERE id % 3 = 0")
def dedup_keys(spark, d):
    """A canonical key for every third paper, the legacy key for others; DOIs with prefixes."""
    p = _papers(spark, d)
    canonical = F.when(F.col("id") % 3 == 0, F.concat(F.lit("arxiv:"), F.col("id").cast("string"))).otherwise("")
    doi = F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/doi:"), F.upper("doi"))).otherwise("")
    return p.select("id", identity.dedup_key(canonical, doi, F.col("source"), F.col("id")).alias("key"))


@query(f"WITH p AS ({_PAPERS}) SELECT id, date, title, row_number() OVER (ORDER BY date DESC, title DESC, id)::INTEGER AS rank FROM p QUALIFY rank <= 40")
def queue_order(spark, d):
    """The first 40 of the queue, as two pages of 20."""
    p = _papers(spark, d).withColumn("key", F.col("id"))
    pages = [search.queue_page(p, o, 20).withColumn("page", F.lit(k)) for k, o in enumerate((0, 20))]
    order = F.row_number().over(windows.W.partitionBy("page").orderBy(F.desc("date"), F.desc("title"), "key"))
    return pages[0].unionByName(pages[1]).select("id", "date", "title", (F.col("page") * 20 + order).cast("int").alias("rank"))


@query(f"WITH p AS ({_PAPERS}) SELECT id FROM (SELECT *, row_number() OVER (ORDER BY date DESC, CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 WHEN 'Exclude' THEN 3 ELSE 99 END, id) AS n FROM p) WHERE n <= 30")
def enrichment_queue(spark, d):
    """Thirty attempts."""
    return windows.enrichment_queue(_papers(spark, d).withColumns({"first_seen_at": F.col("date"), "key": F.col("id")}), 30).select("id")


@query(f"WITH p AS ({_PAPERS}), q AS (SELECT *, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'reading' ELSE 'read' END AS status FROM p) SELECT id FROM q WHERE status IN ('pending', 'reading') AND attempts < 3 ORDER BY (status = 'reading') DESC, date DESC, CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 WHEN 'Exclude' THEN 3 ELSE 99 END, id LIMIT 1")
def review_next(spark, d):
    """O06."""
    k = F.col("id") % 3
    return windows.review_next(_papers(spark, d).withColumn("status", F.when(k == 0, "pending").when(k == 1, "reading").otherwise("read"))).select("id")


@query("WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, min(o_orderstatus) AS run_status FROM orders GROUP BY 1) SELECT run_date, run_status FROM r WHERE run_status IN ('O', 'P') ORDER BY run_date DESC LIMIT 7")
def recent_runs(spark, d):
    """Days as runs; open and partial ones are healthy."""
    runs = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date")).agg(F.min("o_orderstatus").alias("run_status"))
    return windows.recent_runs(runs, ["O", "P"])


@query(f"WITH p AS ({_PAPERS}) SELECT id, row_number() OVER (ORDER BY (coalesce(priority, '') <> 'High'), date, id)::INTEGER AS rank FROM p WHERE id % 6 IN (1, 2) AND source = 's1'")
def weekly_list(spark, d):
    """Sources as weeks; read and checked papers of one."""
    k = F.col("id") % 6
    rows = _papers(spark, d).select("id", F.coalesce("priority", F.lit("")).alias("priority"), F.col("date").alias("source_date"), F.col("source").alias("week"), F.when(k == 1, "read").when(k == 2, "checked").otherwise("pending").alias("status"))
    rank = F.row_number().over(windows.W.orderBy((F.lower("priority") != "high").cast("int"), "source_date", "id"))
    return windows.weekly_list(rows, "s1").select("id", rank.alias("rank"))


@query(f"WITH p AS ({_PAPERS}), u AS (SELECT DISTINCT doi FROM p WHERE doi <> ''), e AS (SELECT count(*) AS n FROM p WHERE doi = '') SELECT (SELECT count(*) FROM p) AS raw, (SELECT count(*) FROM u) + n AS \"unique\", (SELECT count(*) FROM p) - (SELECT count(*) FROM u) - n AS suppressed FROM e")
def corpus_stats(spark, d):
    """Pairs of papers share a DOI; those without one stay."""
    p = _papers(spark, d)
    return aggregates.corpus_stats(p, dedup.first_wins(p, "doi", [F.col("id")]))


@query(f"WITH p AS ({_PAPERS}) SELECT CASE id % 3 WHEN 0 THEN 'must_read' WHEN 1 THEN 'useful' ELSE 'peripheral' END AS tier, coalesce(priority, 'none') AS verdict, count(*) AS n FROM p GROUP BY ALL")
def tier_matrix(spark, d):
    """Priorities as verdicts."""
    k = F.col("id") % 3
    return aggregates.tier_matrix(_papers(spark, d).select(F.when(k == 0, "must_read").when(k == 1, "useful").otherwise("peripheral").alias("tier"), F.coalesce("priority", F.lit("none")).alias("verdict")))


@query(f"WITH p AS ({_PAPERS}), f AS (SELECT substr(date, 1, 7) AS month, priority IS NOT NULL AND id % 4 = 0 AS silent, id % 9 = 0 AS failed FROM p) SELECT month, count(*) AS n, count(*) FILTER (WHERE silent) AS silent, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE silent OR failed) AS candidate FROM f GROUP BY 1")
def silent_by_month(spark, d):
    """Every fourth scored paper has an empty body, every ninth failed."""
    p = _papers(spark, d).withColumn("body", F.when(F.col("id") % 4 == 0, " ").otherwise("said"))
    silent = quality.is_silent(F.col("priority"), F.col("body"), F.col("body"), F.when(F.col("id") % 4 != 0, F.array(F.lit("t"))))
    failed = F.col("id") % 9 == 0
    return aggregates.flag_counts(p, F.substring("date", 1, 7).alias("month"), silent=silent, failed=failed, candidate=quality.is_candidate(silent, failed, False))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def tag_usage(spark, d):
    """Words of names as tags of marks."""
    return search.tag_usage(table(spark, d, "part").select(F.split("p_name", " ").alias("tags")))


@query(f"WITH p AS ({_PAPERS}) SELECT 'bucket' AS told_by, max(date) || 'T00:00:00Z' AS generated_at FROM p UNION ALL SELECT 'first_seen', max(date || 'T12:34:' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || 'Z') FROM p")
def corpus_cutoff(spark, d):
    """Where no paper says when it was first seen, the last bucket counts, else the last first sight."""
    p, out = _papers(spark, d), None
    seen = F.concat("date", F.lit("T12:34:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit("Z"))
    for name, first in (("bucket", F.lit("")), ("first_seen", seen)):
        one = aggregates.corpus_cutoff(p.select(first.alias("first_seen_at"), F.col("date").alias("bucket_date"))).select(F.lit(name).alias("told_by"), "generated_at")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH p AS ({_PAPERS}) SELECT direction, count(*) FILTER (WHERE source = 's0') AS s0, count(*) FILTER (WHERE source = 's1') AS s1, count(*) FILTER (WHERE source = 's2') AS s2 FROM p GROUP BY 1")
def violation_rollup(spark, d):
    """Segments as categories, three of four sources as severities."""
    return aggregates.pivot_counts(_papers(spark, d).select("direction", "source"), "direction", "source", ["s0", "s1", "s2"])


@query(f"WITH p AS ({_PAPERS}), k AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'available' WHEN id % 3 = 1 THEN 'blocked' ELSE 'error' END AS status, id % 2 = 0 AS fresh FROM p WHERE doi <> '') SELECT doi, id FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY fresh DESC, CASE status WHEN 'available' THEN 2 WHEN 'blocked' THEN 1 ELSE 0 END DESC, cites DESC) AS n FROM k WHERE fresh OR status = 'available') WHERE n = 1")
def fresh_records(spark, d):
    """Pairs that share a DOI as aliases of one record; citations as moments of the check."""
    k = F.col("id") % 3
    rows = _papers(spark, d).filter("doi <> ''").withColumns({"status": F.when(k == 0, "available").when(k == 1, "blocked").otherwise("error"), "fresh": F.col("id") % 2 == 0})
    return dedup.fresh_record(rows, "doi", "status", "cites", "fresh").select("doi", "id")


@query(f"WITH p AS ({_PAPERS}) SELECT direction, min(id) AS first_position, count(*) AS seeds FROM p WHERE priority = 'High' GROUP BY 1 ORDER BY 2 LIMIT 3")
def seed_journals(spark, d):
    """Segments as journals."""
    return dedup.distinct_by_appearance(_papers(spark, d).filter("priority = 'High'"), "direction", "id", 3)


@query(f"WITH p AS ({_PAPERS}) SELECT id, attempts + 1 AS attempts, CASE WHEN id % 5 = 0 THEN 'read' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM p")
def retry_budget(spark, d):
    """Every fifth attempt succeeds."""
    return state.after_attempt(_papers(spark, d).select("id", "attempts"), F.col("id") % 5 == 0).select("id", "attempts", "status")


@query(f"WITH p AS ({_PAPERS}) SELECT id, list_filter(['Priority_' || priority, 'Direction_' || direction, 'Source_' || source, 't' || (id % 3), CASE WHEN id % 2 = 0 THEN 'has_code' END], lambda x: x IS NOT NULL) AS tags FROM p")
def library_tags(spark, d):
    """F29."""
    flags = F.create_map(F.lit("has_code"), F.col("id") % 2 == 0, F.lit("has_data"), F.lit(False))
    tags = F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    return _papers(spark, d).select("id", texts.library_tags(F.col("priority"), F.col("direction"), F.col("source"), tags, flags).alias("tags"))


@query(f"WITH p AS ({_PAPERS}) SELECT id AS key, title, list_slice(['a', 'b', 'c', 'd', 'e', 'f'], 1, least(5, id % 7)::INTEGER) AS authors, id % 7 > 5 AS authors_truncated, id % 2 = 0 AS is_review FROM p")
def public_cards(spark, d):
    """up to six authors, of whom five are shown."""
    p = _papers(spark, d).select(F.col("id").alias("key"), "title", F.slice(F.array(*map(F.lit, "abcdef")), F.lit(1), (F.col("id") % 7).cast("int")).alias("authors"), F.array().cast("array<struct<name:string>>").alias("corresponding_authors"), F.create_map(F.lit("is_review"), F.col("id") % 2 == 0).alias("flags"))
    return search.card(p).select("key", "title", "authors", "authors_truncated", "is_review")


@query(f"WITH p AS ({_PAPERS}) SELECT doi, '' AS arxiv_id, title, source, date, direction, CASE WHEN id % 5 < 4 THEN priority ELSE '' END AS priority, '2026-01-01' AS radar_export_date, '1' AS radar_export_version, 30 AS columns FROM p")
def export_records(spark, d):
    """the flat record of 30 columns, some of which are shown."""
    p = _papers(spark, d).withColumn("llm", F.when(F.col("priority").isNotNull(), F.struct("priority"))).withColumn("year", F.lit(2024)).drop("priority")
    out = search.export_record(p, F.col("date"), F.lit("2026-01-01"), "1")
    return out.select("doi", "arxiv_id", "title", "source", "date", "direction", "priority", "radar_export_date", "radar_export_version", F.lit(len(out.columns)).alias("columns"))


@query(f"WITH p AS ({_PAPERS}), r AS (SELECT DISTINCT 'doi:' || doi AS k FROM p WHERE doi <> '' AND id % 4 < 2 AND id % 5 = 0) SELECT id, k IS NOT NULL AS shown FROM p LEFT JOIN r ON 'doi:' || doi = k AND doi <> ''")
def visual_join(spark, d):
    """Every fifth paper has a record; those of even pairs may be shown, others are credited."""
    p = _papers(spark, d).withColumn("key", identity.identity_key(F.col("doi"), F.lit("")))
    text = F.when(F.col("id") % 4 < 2, "Mesh of the part").otherwise("Photo by Jane Doe")
    fields = {"status": F.lit("available"), "provider": F.lit("pmc"), "image_url": F.lit("https://pmc-oa-opendata.s3.amazonaws.com/a/f1.jpg"), "source_url": F.lit("https://example.org/a"), "license": F.lit("CC BY 4.0"), "caption": text, "alt": F.lit(""), "source_label": F.lit(""), "media_type": F.lit("image/jpeg"), "width": F.lit(800), "height": F.lit(600)}
    registry = p.filter("id % 5 = 0 and key <> ''").select("key", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("visual"))
    return joins.attach_visuals(p, registry).select("id", F.col("visual").isNotNull().alias("shown"))


@query("""
WITH m AS (SELECT c_custkey AS id, c_mktsegment AS date, c_custkey % 60 // 20 + 1 AS page, c_custkey % 10 AS r FROM customer)
SELECT id, CASE WHEN r IN (0, 1, 2) THEN page END AS page FROM m WHERE r < 4""")
def marked_pages(spark, d):
    """Segments stand for days; a page is known by anchor, by numbered anchor, or found by
    looking; marks without a record have none."""
    c = table(spark, d, "customer")
    day = F.concat(F.lit("2024-01-0"), F.ascii(F.substring("c_mktsegment", 1, 1)) % 9 + 1)
    rows = c.select(F.col("c_custkey").alias("id"), F.concat(day, F.lit("")).alias("date"), F.floor(F.col("c_custkey") % 60 / 20 + 1).cast("int").alias("page"), (F.col("c_custkey") % 10).alias("r"))
    name = F.concat(F.lit("a"), F.col("id").cast("string"))
    manifest = rows.filter("r <> 2").select("date", F.when(F.col("r") == 1, F.concat(name, F.lit("--x"))).otherwise(name).alias("anchor"), "page", F.lit(3).alias("page_count"))
    records = rows.filter("r <> 3").select(name.alias("identity_key"), "date", "page")
    marks = rows.filter("r < 4").select("id", name.alias("idkey"), name.alias("anchor"), "date")
    return joins.marked_records(marks, manifest, records).select("id", F.col("page").cast("long").alias("page"))


@query("SELECT source, list_sort(list(DISTINCT term)) AS terms FROM (SELECT 'brand' AS source, p_brand AS term FROM part UNION ALL SELECT 'word', unnest(string_split(p_name, ' ')) FROM part) GROUP BY 1")
def query_terms(spark, d):
    """Part types as directions; brands and words as terms of two sources."""
    config = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("brand"), F.flatten(F.collect_set(F.split("p_name", " "))).alias("word"))
    return joins.query_terms(config, ["brand", "word"])


@query(r"""
WITH t AS (SELECT doc_id, doc_id % 3 AS k, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM documents),
r AS (SELECT *, regexp_matches(lower(s), '©|\bcopyright(ed)?\b|all rights reserved|\bwith (kind )?permission\b|\bcourtesy( ?:| of\b)') AS told FROM t)
SELECT doc_id, CASE WHEN k = 1 THEN told OR regexp_matches(s, '^[\p{L}\p{N}_]') ELSE told END AS credited FROM r""")
def caption_rights(spark, d):
    """documents as captions: as they are, as what a photo is by, and as what a method is by."""
    said = F.when(F.col("doc_id") % 3 == 1, "Photo by ").when(F.col("doc_id") % 3 == 2, "Figure by using ").otherwise("")
    return table(spark, d, "documents").select("doc_id", rights.third_party_rights(F.concat(said, F.coalesce("text", F.lit("")))).alias("credited"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::DATE <= DATE '1997-06-01' WHEN 1 THEN o_orderdate::DATE <= DATE '1997-06-01' WHEN 2 THEN FALSE WHEN 3 THEN date_trunc('month', o_orderdate)::DATE <= DATE '1997-06-01' WHEN 4 THEN TRUE ELSE FALSE END AS started FROM orders""")
def license_starts(spark, d):
    """order dates as starts: as parts, as a moment, both but a day apart, a month, none, junk."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    parts = lambda *p: F.concat(F.lit('{"date-parts":[['), F.concat_ws(",", *[x.cast("string") for x in p]), F.lit("]]"))
    moment = lambda x: F.concat(F.lit('"date-time":"'), x.cast("string"), F.lit('T00:00:00Z"}'))
    full = parts(F.year(day), F.month(day), F.day(day))
    start = F.when(k == 0, F.concat(full, F.lit("}"))).when(k == 1, F.concat(F.lit("{"), moment(day))).when(k == 2, F.concat(full, F.lit(","), moment(F.date_add(day, 1))))
    start = start.when(k == 3, F.concat(parts(F.year(day), F.month(day)), F.lit("}"))).when(k == 5, '{"date-parts":[["x"]]}')
    return table(spark, d, "orders").select("o_orderkey", rights.license_started(start, F.lit("1997-06-01 00:00:00").cast("timestamp")).alias("started"))


# --- streaming ------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def stream_first_seen(spark, d):
    """Events as a file stream, drained."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = f"{shared_dir(spark)}/first-seen-{uuid.uuid4().hex[:12]}"
    return state.first_seen_stream(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{root}/state", f"{root}/checkpoint").select("user_id", "event_type", "event_id")
