"""Identifier normalisation and identity keys as Column expressions.

Missing, null and blank values are one thing throughout: an empty string, which never merges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a strip removes.
SPACE = " \t\n\r\x0b\x0c"
#: Resolver prefixes of a DOI, first match stripped.
DOI_PREFIX = r"^(https?://dx\.doi\.org/|https?://doi\.org/|doi:)"
REGISTRY = {"figshare": "10.6084/m9.figshare.", "zenodo": "10.5281/zenodo."}


def text(c: Column) -> Column:
    """Stripped text; null becomes empty."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(SPACE))


def normalize_doi(c: Column) -> Column:
    """trim, lower-case, strip one resolver prefix, trim again."""
    return F.btrim(F.regexp_replace(F.lower(text(c)), DOI_PREFIX, ""), F.lit(SPACE))


def audit_doi(c: Column) -> Column:
    """prefix, percent-decoding and trailing punctuation removed; lower-case. A plus sign stays."""
    bare = F.regexp_replace(text(c), "(?i)" + DOI_PREFIX, "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    return F.lower(F.regexp_replace(decoded, r"[.,;)\]>]+$", ""))


def arxiv_base_id(c: Column) -> Column:
    """id without URL, scheme, .pdf and version; lower-case."""
    bare = F.regexp_replace(F.lower(text(c)), r"^(https?://(www\.|export\.)?arxiv\.org/(abs|pdf)/|arxiv:)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"\.pdf$", ""), r"v[0-9]+$", "")


def canonical_doi(doi: Column, aliases: Column | None = None) -> Column:
    """Versioned figshare DOIs lose .vN; others follow the alias map, default self."""
    own = normalize_doi(doi)
    figshare = F.regexp_replace(own, r"\.v[0-9]+$", "")
    other = own if aliases is None else F.coalesce(F.try_element_at(aliases, own), own)
    return F.when(own.startswith(REGISTRY["figshare"]), figshare).otherwise(other)


def openalex_work_id(openalex_id: Column, source: Column, own_id: Column) -> Column:
    """W and digits, upper-case, from openalex_id or from an OpenAlex row's own id."""
    found = [F.regexp_extract(F.upper(text(c)), r"(?:^|/)(W[0-9]+)$", 1) for c in (openalex_id, own_id)]
    return F.coalesce(F.nullif(found[0], F.lit("")), F.when(text(source) == "openalex", F.nullif(found[1], F.lit(""))), F.lit(""))


def canonical_key(doi: Column, arxiv_id: Column, pmid: Column, work_id: Column, aliases: Column | None = None) -> Column:
    """the first of an arXiv DOI, another DOI, an arXiv id, a PubMed id, an OpenAlex id."""
    d = canonical_doi(doi, aliases)
    from_doi = F.regexp_extract(d, r"^10\.48550/arxiv\.(.+)$", 1)
    keys = [
        F.when(from_doi != "", F.concat(F.lit("arxiv:"), F.regexp_replace(from_doi, r"v[0-9]+$", ""))),
        F.when(d != "", F.concat(F.lit("doi:"), d)),
        F.when(arxiv_base_id(arxiv_id) != "", F.concat(F.lit("arxiv:"), arxiv_base_id(arxiv_id))),
        F.when(text(pmid).rlike("^[0-9]+$"), F.concat(F.lit("pmid:"), text(pmid))),
        F.when(work_id != "", F.concat(F.lit("openalex:"), work_id)),
    ]
    return F.coalesce(*keys, F.lit(""))


def legacy_key(doi: Column, source: Column, own_id: Column) -> Column:
    """The key of an older seen-state: a DOI without its resolver prefixes, one of each kind in
    turn, else the source and its id."""
    bare = F.lower(text(doi))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        bare = F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare)
    return F.when(bare != "", F.concat(F.lit("doi:"), bare)).otherwise(F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(own_id.cast("string"), F.lit(""))))


def dedup_key(canonical: Column, doi: Column, source: Column, own_id: Column) -> Column:
    """The canonical key, or the legacy one where there is none."""
    return F.coalesce(F.nullif(canonical, F.lit("")), legacy_key(doi, source, own_id))


def identity_key(doi: Column, arxiv_id: Column) -> Column:
    """the public identity, of raw values."""
    return F.when(text(doi) != "", F.concat(F.lit("doi:"), text(doi))).when(text(arxiv_id) != "", F.concat(F.lit("arxiv:"), text(arxiv_id))).otherwise("")


def fallback_identity(date: Column, position: Column, source: Column, title: Column) -> Column:
    """an identity for rows without one."""
    parts = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (date, position, source, title)])
    return F.concat(F.lit("noid:"), F.substring(F.sha1(parts.cast("binary")), 1, 16))


def anchor(key: Column) -> Column:
    """a key as a fragment name; W02 resolves collisions within a day."""
    return F.regexp_replace(key, r"[^A-Za-z0-9_-]", "-")


def paper_url(key: Column) -> Column:
    """where an identity resolves."""
    rest = F.regexp_extract(key, r"^[a-z]+:(.*)$", 1)
    return F.when(key.startswith("doi:"), F.concat(F.lit("https://doi.org/"), rest)).when(key.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), rest)).otherwise("")


def page_key(url: Column) -> Column:
    """F01, F03 and F06 on web pages: scheme, mobile or www host, fragment, tracking query and
    trailing marks removed, lower-case."""
    bare = F.regexp_replace(F.lower(text(url)), r"^https?://(www\.|m\.)?", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    bare = F.regexp_replace(bare, r"\?.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(index)?\.html?$", ""), r"/+$", "")
