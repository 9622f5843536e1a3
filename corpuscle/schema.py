"""Schemas of papers and their companions."""

from __future__ import annotations

PRIORITIES = ("High", "Medium", "Low", "Exclude")
SUMMARY = "struct<motivation:string,method:string,result:string,validation:string>"
LLM = (
    "struct<priority:string,relevance_level:string,read_action:string,validation_kind:string,relevance_to_user:string,why_not_core:string,"
    "flags:map<string,boolean>,tags:array<string>,key_terms:array<struct<en:string,zh:string>>,summary_zh:" + SUMMARY + ",summary_en:" + SUMMARY + ","
    "scorer_failed:boolean,scorer_failed_reason:string,scorer_failed_attempts:int,priority_boosted:boolean,priority_pre_boost:string,boost_reason:string,priority_reason:string>"
)
PAPER = (
    "source string, id string, doi string, arxiv_id string, pmid string, openalex_id string, title string, abstract string, authors array<string>, "
    "first_author_affiliation string, corresponding_authors array<struct<name:string,affiliation:string,inferred:boolean>>, "
    "venue string, venue_id string, venue_issn_l string, venue_type string, year int, date string, date_precision string, url string, "
    "cited_by_count long, concepts array<string>, categories array<string>, raw_type string, also_seen_in array<string>, "
    "directions array<string>, direction string, direction_name string, routing_reason string, routing_matches map<string,array<string>>, "
    "llm " + LLM + ", schema_version string, scorer_version string, first_seen_at string"
)
MARK = "device string, key string, state string, at string, note string, title string, date string, direction string, priority string, tags array<string>"
MANIFEST = "run_date string, run_status string, quality_flags array<string>, counts struct<scorer_failed:long,priority_counts:map<string,long>>"
