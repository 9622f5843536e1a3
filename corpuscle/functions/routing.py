"""Keyword routing: a configuration becomes Column expressions when the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.identity import text

#: Words that keep a paper despite an excluded term, and the points of a match.
ANCHORS = ["bioprinting", "biofabrication", "bioink", "femoral", "hip implant", "stem", "implant", "biomechanics", "biomedical", "bone", "osseointegration", "scaffold"]
KEYWORD_POINTS, PAIR_POINTS, MIN_SCORE = 2.0, 3.0, 2.0
#: The two directions whose meeting raises a priority, and by how much.
CROSSOVER = ["rl_world_model", "fea_surrogate"]
BUMP = {"Low": "Medium", "Medium": "High"}
REASON = "RL × FEA/surrogate crossover"


def whole_word(term: str) -> str:
    """a pattern for a term between characters that are no letter, digit or underscore; the
    same in Java's and RE2's syntax."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(term.lower())}($|[^\p{{L}}\p{{N}}_])".replace("\\ ", " ").replace("\\-", "-")


def word_set(low: Column) -> Column:
    """The different words of a lower-case text, split where whole_word sees an edge."""
    return F.array_distinct(F.split(low, r"[^\p{L}\p{N}_]+"))


def contains(body: Column, term: str, words: Column | None = None) -> Column:
    """a term as a whole word or phrase. With the text's word_set a plain word needs no pattern,
    and other terms are looked for as they are before their edges are."""
    low = term.lower()
    if words is not None and re.fullmatch("[a-z0-9_]+", low):
        return F.array_contains(words, low)
    return body.contains(low) & body.rlike(whole_word(term))


def body(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def any_of(low: Column, terms: list[str], words: Column | None = None) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | contains(low, t, words)
    return out


def is_excluded(low: Column, excluded: list[str], anchors: list[str] | None = None, words: Column | None = None) -> Column:
    """an excluded term is there and no anchor is."""
    return any_of(low, excluded, words) & ~any_of(low, ANCHORS if anchors is None else anchors, words)


def score_direction(low: Column, keywords: list[str], pairs: list[list[str]], words: Column | None = None) -> tuple[Column, Column]:
    """points and the matches, keywords first, in order of configuration."""
    points, found = F.lit(0.0), []
    for k in keywords:
        hit = contains(low, k, words)
        points = points + F.when(hit, KEYWORD_POINTS).otherwise(0.0)
        found.append(F.when(hit, F.lit(k)))
    for pair in pairs:
        hit = F.lit(True)
        for t in pair:
            hit = hit & contains(low, t, words)
        points = points + F.when(hit, PAIR_POINTS).otherwise(0.0)
        found.append(F.when(hit, F.lit(" + ".join(pair))))
    return points, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def route(df: DataFrame, directions: dict[str, dict], excluded: list[str], min_score: float = MIN_SCORE) -> DataFrame:
    """Adds directions (best first, ties in order of configuration), direction,
    direction_name, routing_matches and routing_reason."""
    out = df.withColumn("_low", body(F.col("title"), F.col("abstract"))).withColumn("_words", word_set(F.col("_low")))
    scored = []
    for k, (key, cfg) in enumerate(directions.items()):
        points, found = score_direction(F.col("_low"), cfg.get("strong_keywords", []), cfg.get("must_pair_with", []), F.col("_words"))
        name = F.lit(cfg.get("display_name", key))
        scored.append(F.struct((-points).alias("order"), F.lit(k).alias("k"), F.lit(key).alias("key"), name.alias("name"), found.alias("found")))
    out = out.withColumn("_out", is_excluded(F.col("_low"), excluded, words=F.col("_words")))
    ranked = F.array_sort(F.filter(F.array(*scored), lambda s: s["order"] <= -min_score))
    out = out.withColumn("_s", F.when(~F.col("_out"), ranked).otherwise(F.slice(ranked, 1, 0)))
    return out.withColumns(
        {
            "directions": F.transform("_s", lambda s: s["key"]),
            "direction": F.get("_s", F.lit(0))["key"],
            "direction_name": F.get("_s", F.lit(0))["name"],
            "routing_matches": F.map_from_entries(F.transform("_s", lambda s: F.struct(s["key"], s["found"]))),
            "routing_reason": F.when(F.col("_out"), "excluded by hard rule"),
        }
    ).drop("_low", "_words", "_out", "_s")


def crossover_boost(df: DataFrame, directions: str = "directions", priority: str = "priority", boosted: str = "priority_boosted") -> DataFrame:
    """One step up for papers in both crossover directions; once only."""
    both = F.size(F.array_intersect(F.coalesce(F.col(directions), F.array().cast("array<string>")), F.array(*map(F.lit, CROSSOVER)))) == len(CROSSOVER)
    already = F.coalesce(F.col(boosted), F.lit(False)) if boosted in df.columns else F.lit(False)
    due = F.coalesce(both & ~already & F.col(priority).isin(*BUMP), F.lit(False))
    up = F.create_map(*[x for kv in BUMP.items() for x in map(F.lit, kv)])
    was = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("priority_pre_boost", "boost_reason")}
    return df.withColumns(
        {
            priority: F.when(due, F.try_element_at(up, F.col(priority))).otherwise(F.col(priority)),
            "priority_pre_boost": F.when(due, F.col(priority)).otherwise(was["priority_pre_boost"]),
            "boost_reason": F.when(due, REASON).otherwise(was["boost_reason"]),
            boosted: already | due,
        }
    )


def min_priority(priority: Column, least: str) -> Column:
    """High is within any threshold, Low only within Low's."""
    order = ["High", "Medium", "Low", "Exclude"]
    return F.coalesce(priority.isin(order[: order.index(least) + 1]), F.lit(False))


def priority_rank(priority: Column, unknown: int = 99) -> Column:
    out = F.when(priority == "High", 0).when(priority == "Medium", 1).when(priority == "Low", 2).when(priority == "Exclude", 3)
    return out.otherwise(unknown)


def run_priority(priority: Column, failed: Column) -> Column:
    """Null priority as a run counts it: failures apart, anything unknown is Low."""
    return F.when(F.coalesce(failed, F.lit(False)), F.lit(None)).when(priority.isin("High", "Medium", "Low", "Exclude"), priority).otherwise("Low")


def public_priority(priority: Column, failed: Column) -> Column:
    """As the public view counts it: failures are Unscored, blanks are not counted."""
    return F.when(F.coalesce(failed, F.lit(False)), "Unscored").otherwise(F.nullif(text(priority), F.lit("")))


def display_priority(priority: Column, failed: Column) -> Column:
    """as it is shown: failures are Unscored, anything unknown is Low."""
    return F.when(F.coalesce(failed, F.lit(False)), "Unscored").otherwise(run_priority(priority, F.lit(False)))


def export_priority(priority: Column) -> Column:
    """As the export filters it: missing is Low."""
    return F.coalesce(F.nullif(text(priority), F.lit("")), F.lit("Low"))
