"""Exact-key deduplication and merging. An empty key means "never merge", not a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_keyed(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and rows that bypass every merge."""
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return df.filter(has), df.filter(~has)


def first_wins(df: DataFrame, key: str | list[str], order: list[Column], keep_empty: bool = True) -> DataFrame:
    """The row of each key that is first in order; rows without a key all stay
    (or, for D05 and D07, go)."""
    keys = [key] if isinstance(key, str) else key
    keyed, free = split_keyed(df, keys[0]) if len(keys) == 1 else (df, df.limit(0))
    out = keyed.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return out.unionByName(free) if keep_empty and len(keys) == 1 else out


def latest_wins(df: DataFrame, key: str, date: str, position: str, title: str | None = None) -> DataFrame:
    """The greatest date replaces, a tie keeps the earlier row; the title stands in for an
    empty key."""
    out = df
    if title:
        own = F.coalesce(F.col(key).cast("string"), F.lit(""))
        out = out.withColumn("_key", F.when(own != "", own).otherwise(F.concat(F.lit("title:"), F.lower(F.coalesce(F.col(title), F.lit(""))))))
    by = "_key" if title else key
    order = [F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), F.col(position)]
    return out.withColumn("_nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_nth = 1").drop("_nth", *(["_key"] if title else []))


def preference_fold(df: DataFrame, key: str, position: str, fields: list[str], replaces, note: str = "source") -> DataFrame:
    """An order-dependent fold of each key's rows. The first row stands until a newcomer for
    which replaces(standing, newcomer) holds; the other's note joins also_seen_in. The result
    stands at the first row's position.

    A key's rows are the copies of one work, a handful each; the fold needs them together.
    """
    keyed, free = split_keyed(df, key)
    names = list(dict.fromkeys([position, *fields, note]))
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    folded = keyed.groupBy(key).agg(rows.alias("_rows"))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        wins = replaces(acc["row"], x)
        other = F.when(wins, acc["row"][note]).otherwise(x[note])
        seen = F.array_distinct(F.array_append(acc["seen"], other))
        return F.struct(F.when(wins, x).otherwise(acc["row"]).alias("row"), seen.alias("seen"))

    first = F.get("_rows", F.lit(0))
    out = F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.struct(first.alias("row"), none.alias("seen")), step)
    folded = folded.withColumn("_out", out)
    got = folded.select(key, first[position].alias(position), *[F.col("_out.row")[f].alias(f) for f in names if f != position], F.col("_out.seen").alias("also_seen_in"))
    return got.unionByName(free.select(key, *names).withColumn("also_seen_in", none))


def paper_preference(standing: Column, new: Column) -> Column:
    """The rules of D01 for papers: an abstract beats none, and a published copy with a DOI beats a
    preprint."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    gains_text = blank(standing["abstract"]) & ~blank(new["abstract"])
    published = (standing["source"] == "arxiv") & new["source"].isin("openalex", "pubmed") & ~blank(new["doi"])
    return F.coalesce(gains_text | published, F.lit(False))


def latest_mark(df: DataFrame, key: str, at: str, device: str, state: str, tombstone: str) -> DataFrame:
    """Of each key the row with the greatest (at, device); tombstones go only then, so a later
    clear is not undone by an older mark."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, device)).alias("m"))
    return last.select(key, *[F.col(f"m.{c}") for c in rest]).filter(~F.col(state).eqNullSafe(F.lit(tombstone)))


def fresh_record(df: DataFrame, key: str, status: str, checked_at: str, fresh: str) -> DataFrame:
    """Among fresh records the best status, then the latest; else the latest available one."""
    rank = F.when(F.col(status) == "available", 2).when(F.col(status) == "blocked", 1).otherwise(0)
    usable = F.col(fresh) | (F.col(status) == "available")
    order = [F.col(fresh).desc(), rank.desc(), F.col(checked_at).desc()]
    return df.filter(usable).withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def bounded_state(state: DataFrame, new_keys: DataFrame, limit: int) -> DataFrame:
    """(key, seq) of seen keys: earlier ones in their order, new ones appended in
    order of key, the oldest dropped beyond the limit. The state is bounded by the limit."""
    fresh = new_keys.select("key").filter(F.coalesce(F.col("key"), F.lit("")) != "").distinct().join(state, "key", "left_anti")
    top = state.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    newest = fresh.orderBy(F.desc("key")).limit(limit)  # others would be dropped at once
    nth = F.row_number().over(W.orderBy("key"))
    skipped = fresh.agg(F.count("*").alias("n")).join(top)
    added = newest.withColumn("nth", nth).join(F.broadcast(skipped)).select("key", (F.col("top") + F.greatest(F.col("n") - limit, F.lit(0)) + F.col("nth")).cast("long").alias("seq"))
    every = state.select("key", F.col("seq").cast("long").alias("seq")).unionByName(added)
    return every.orderBy(F.desc("seq")).limit(limit)


def distinct_by_appearance(df: DataFrame, key: str, position: str, limit: int) -> DataFrame:
    """Keys in order of first appearance, with their counts."""
    keyed, _ = split_keyed(df, key)
    return keyed.groupBy(key).agg(F.min(position).alias("first_position"), F.count("*").alias("seeds")).orderBy("first_position", key).limit(limit)


def migrate(df: DataFrame, key: str, run_ts: str, position: str, date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, log of every observation, counters): the first run wins a key, rows
    without a date are dropped and counted."""
    log = df.select(F.col(key).alias("doi_or_arxiv_id"), F.col(run_ts).alias("first_seen_at"))
    dated = F.coalesce(F.col(date), F.lit("")) != ""
    kept = first_wins(df.filter(dated), key, [F.col(run_ts), F.col(position)])
    stats = df.agg(F.count("*").alias("observed"), F.count_if(~dated).alias("missing_date"), F.count_distinct(F.when(dated, F.nullif(F.col(key), F.lit("")))).alias("keys"))
    return kept, log, stats


def anti_join_seen(df: DataFrame, seen: DataFrame, keys: list[str], seen_key: str = "key") -> DataFrame:
    """Rows none of whose keys is in the seen set; empty keys always pass."""
    out = df
    for k in keys:
        known = seen.select(F.col(seen_key).alias("_k")).filter(F.coalesce(F.col("_k").cast("string"), F.lit("")) != "").distinct()
        out = out.join(known, F.col(k) == F.col("_k"), "left_anti")
    return out
