"""Audit rules on scored papers and run manifests, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.identity import text
from corpuscle.functions.text import keyword_hits

#: Least characters of a summary, statuses and flags of a healthy run.
SUMMARY_CHARS = 10
HEALTHY = ["success", "partial_success"]
WARNING_SUFFIX = "(_failed|_truncated|_returned_zero)$"


def filled(c: Column, kind: str = "string") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind in ("array", "map") else text(c) != ""


def completeness(fields: list[Column]) -> Column:
    """share of fields that are filled, in percent to one decimal; fields are booleans."""
    return F.round(100.0 * sum((f.cast("int") for f in fields), F.lit(0)) / len(fields), 1)


def is_silent(priority: Column, relevance: Column, motivation: Column, tags: Column, reason: Column | None = None) -> Column:
    """a priority over an empty body; with reason, only where it is filled."""
    out = (text(priority) != "") & (text(relevance) == "") & (text(motivation) == "") & ~filled(tags, "array")
    return out if reason is None else out & (text(reason) != "")


def is_candidate(silent: Column, failed: Column, resume: bool) -> Column:
    """F32: silent rows, and failed ones unless resuming."""
    return silent if resume else silent | F.coalesce(failed, F.lit(False))


def consistency(priority: Column, relevance: Column, why_not: Column, negative: list[str], positive: list[str]) -> Column:
    """whether the reasoning's cues go with the priority."""
    both = F.concat(F.coalesce(relevance, F.lit("")), F.lit("\n"), F.coalesce(why_not, F.lit("")))
    neg, pos = keyword_hits(both, negative) > 0, keyword_hits(both, positive) > 0
    p = text(priority)
    high, low = p.isin("High", "Medium"), p.isin("Low", "Exclude")
    out = F.when(p == "", "unknown").when((high & neg & ~pos) | (low & pos & ~neg), "clear_mismatch").when(high & neg & pos, "mild_mismatch")
    return out.when((text(relevance) == "") & (text(why_not) == ""), "unknown").otherwise("consistent")


def substance(fields: list[Column], boilerplate: list[str]) -> Column:
    """three or more weak fields are vague, none is substantive."""
    def weak(c: Column) -> Column:
        out = F.length(text(c)) < SUMMARY_CHARS
        for pattern in boilerplate:
            out = out | text(c).rlike("^(?:" + pattern + ")")
        return out.cast("int")

    n = sum((weak(c) for c in fields), F.lit(0))
    return F.when(n == 0, "substantive").when(n >= 3, "vague_or_empty").otherwise("partly_vague")


def routing_verdict(assigned: Column, haystack: Column, directions: dict[str, list[str]], enough: float = 0.5) -> Column:
    """(verdict, suggested) of the assigned direction against the best other one; of equal
    others the first in order of configuration."""
    scores = [F.struct(keyword_hits(haystack, ks).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, ks) in enumerate(directions.items())]
    own = F.coalesce(text(assigned), F.lit(""))
    mine = F.coalesce(F.array_max(F.transform(F.filter(F.array(*scores), lambda s: s["d"] == own), lambda s: s["n"])), F.lit(0))
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["d"] != own))
    other, name = F.coalesce(best["n"], F.lit(0)), F.coalesce(best["d"], F.lit(""))
    known = own.isin(*directions)
    verdict = (
        F.when(~known | ((mine == 0) & (other == 0)), "questionable").when(mine >= other, "appropriate")
        .when(mine == 0, "likely_misrouted").when(mine >= other * enough, "appropriate").otherwise("questionable")
    )
    suggest = F.when(~known & (other > 0), name).when(known & (mine < other) & ((mine == 0) | (mine < other * enough)), name).otherwise("")
    return F.struct(verdict.alias("verdict"), suggest.alias("suggested"))


def present_verdict(tier: Column, priority: Column) -> Column:
    """a listed paper that the corpus holds, judged by its tier and priority."""
    must = F.when(priority.isin("High", "Medium"), "correct_must_read").otherwise("under_scored")
    useful = F.when(priority.isin("Medium", "Low"), "correct_useful").when(priority == "Exclude", "under_scored").otherwise("over_scored")
    peripheral = F.when(priority.isin("Low", "Exclude"), "correct_peripheral").otherwise("over_scored")
    return F.when(tier == "must_read", must).when(tier == "useful", useful).when(tier == "peripheral", peripheral).otherwise("no_ground_truth")


def missing_verdict(tier: Column) -> Column:
    """a listed paper that the corpus lacks."""
    return F.when(tier.isin("must_read", "useful", "peripheral"), F.concat(F.lit("missing_"), tier)).otherwise("missing")


def miss_reason(doi: Column, topic: Column, keywords: list[str], last_year: int = 2014) -> Column:
    """the smallest year in the DOI is before the window, or whether the topic would route."""
    years = F.transform(F.regexp_extract_all(doi, F.lit(r"(?<![0-9])(19[5-9][0-9]|20[01][0-9])(?![0-9])"), 1), lambda y: y.cast("int"))
    old = F.coalesce(F.array_min(years) <= last_year, F.lit(False))
    match = F.when(keyword_hits(topic, keywords) > 0, "direction_match_possible").otherwise("direction_mismatch_likely")
    return F.when(old, "out_of_window").when((text(topic) != "") & F.lit(bool(keywords)), match).otherwise("unknown")


def health_reasons(status: Column, flags: Column, failed: Column, scored: Column) -> Column:
    """what blocks a run from being published; scorer failures only from half of the batch."""
    f = F.coalesce(flags, F.array().cast("array<string>"))
    blocked = F.array_contains(f, "scorer_failed") & (F.coalesce(failed, F.lit(0)) > 0) & (failed >= F.greatest(F.coalesce(scored, F.lit(0)), F.lit(1)))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(status.isin(HEALTHY), F.lit(False)), F.concat(F.lit("run_status="), F.coalesce(F.nullif(status, F.lit("")), F.lit("missing")))),
            F.when(F.array_contains(f, "fetched_zero"), "fetched_zero"),
            F.when(blocked, "scorer_failed"),
        )
    )


def health_warnings(status: Column, flags: Column, reasons: Column, named: list[str]) -> Column:
    """what is logged and does not block, by name or suffix."""
    wanted = lambda x: (x.isin(named) | x.rlike(WARNING_SUFFIX)) & ~F.array_contains(reasons, x) & (x != "fetched_zero")
    partial = F.when(status == "partial_success", F.array(F.lit("run_status=partial_success"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(partial, F.filter(F.coalesce(flags, F.array().cast("array<string>")), wanted)))


def quality_flags(fetched: Column, routed: Column, high_medium: Column, failed: Column, by_source: dict[str, Column], errors: Column | None = None, truncated: Column | None = None, least: int = 50) -> Column:
    """what is odd about a run's counts, in a fixed order."""
    flags = [
        F.when((fetched > 0) & (fetched < least), "low_fetch_count"),
        F.when((routed == 0) & (fetched > 0), "zero_routed"),
        F.when((high_medium == 0) & (routed > 0), "zero_high_medium"),
        F.when(failed > 0, "scorer_failed"),
        *[F.when(n == 0, f"{name}_returned_zero") for name, n in by_source.items()],
        *([F.when(truncated, "openalex_truncated")] if truncated is not None else []),
    ]
    out = F.array_compact(F.array(*flags))
    return out if errors is None else F.concat(out, F.transform(errors, lambda e: F.concat(e, F.lit("_failed"))))
