"""Text helpers: tags, truncation, names, escaping, tolerant flattening, layout checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.identity import SPACE, text

#: Canonical tag and its variants, tags that are dropped, and two method families.
TAG_ALIASES = {
    "selective laser melting": ["slm", "lpbf", "laser powder bed fusion", "selective laser melting"],
    "physics-informed NN": ["pinn", "physics-informed neural network", "physics-informed neural networks"],
    "surrogate modeling": ["surrogate model", "surrogate modeling"],
    "Gaussian process": ["gaussian process", "gaussian process regression"],
    "additive manufacturing": ["additive manufacturing", "3d printing"],
}
DROPPED_TAGS = ["review", "no ai", "clinical study", "clinical outcomes"]
FEM_TAGS = ["finite element analysis", "finite element method", "finite element", "finite element simulation", "finite element model", "finite element modeling"]
PINN_TAGS = ["pinn", "physics-informed neural network", "physics-informed neural networks", "physics-informed nn"]
#: Words that mark an article's body, and signs that lead a menu line.
BODY_MARKERS = ["introduction", "method", "result", "conclusion", "discussion", "experiment", "we propose", "we present", "et al.", "引言", "方法", "结果", "结论", "实验"]
BULLETS = "•→■○►"


#: The scalars of a JSON text; names of members are told by their colon.
_SCALAR = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false'


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once. Within lambdas Spark evaluates an expression as often
    as it is written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flatten(v: Column) -> Column:
    """all text in a variant (text, object, list or null, nested to any depth), joined by one
    space; empty texts are left out, numbers are written, an object's members come in order of names."""
    found = F.filter(F.regexp_extract_all(F.to_json(v), F.lit(_SCALAR), 0), lambda x: ~x.endswith(":"))
    inside = lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string")
    texts = F.transform(found, lambda x: F.when(x.startswith('"'), inside(x)).when(x.isin("true", "false"), F.initcap(x)).otherwise(x))
    return F.coalesce(F.array_join(F.filter(texts, lambda x: x != ""), " "), F.lit(""))


def truncate(c: Column, n: int) -> Column:
    """n characters, with an ellipsis if any is cut off."""
    s = F.coalesce(c, F.lit(""))
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n)), F.lit("…"))).otherwise(s)


def truncate_words(c: Column, n: int) -> Column:
    """at most n characters, cut before a word and before an open $...$ formula."""
    s = F.regexp_replace(text(c), r"\s+", " ")
    head = F.regexp_replace(F.substring(s, 1, n), r"\s+\S*$", "")
    odd = F.regexp_count(head, F.lit(r"\$")) % 2 == 1
    head = F.when(odd, F.regexp_replace(head, r"\s*\$[^$]*$", "")).otherwise(head)
    return F.when(F.length(s) > n, F.concat(head, F.lit("…"))).otherwise(s)


def truncate_safely(c: Column, n: int) -> Column:
    """at most n characters, cut at the last white space outside formulas and braces; a text
    without such a place is cut hard. Formulas stand in `\\(...\\)`, `\\[...\\]`, `$...$` or `$$...$$`,
    none of which a backslash escapes; braces count outside formulas only. The end of the n characters
    is a place to cut too, unless it parts a word. Null is empty; shorter texts stay as they are.

    One pass over the characters keeps the open delimiter, the depth of braces and the last place."""
    s = F.coalesce(c, F.lit(""))
    kept = lambda state, **new: F.struct(*[new.get(k, state[k]).cast(t).alias(k) for k, t in (("open", "string"), ("depth", "int"), ("last", "int"), ("skip", "int"))])

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("last"), F.lit(0).alias("skip"))
    word = lambda x: x.rlike(r"[\p{L}\p{N}]")

    def place(chars: Column) -> Column:
        at = lambda i: F.coalesce(F.get(chars, i - 1), F.lit(""))

        def step(state: Column, i: Column) -> Column:
            one, two, plain, free = at(i), F.concat(at(i), at(i + 1)), at(i - 1) != "\\", state["open"] == ""
            begins, ends = two.isin("\\(", "\\["), two.isin("\\)", "\\]")
            closes = state["open"] == F.translate(two, ")]", "([")
            dollars = F.when(two == "$$", 2).otherwise(1)
            closed = (one == "$") & plain & state["open"].startswith("$") & ((state["open"] == "$") | (two == "$$"))
            depth = state["depth"] + F.when(one == "{", 1).when((one == "}") & (state["depth"] > 0), -1).otherwise(0)
            return (
                F.when(state["skip"] > 0, kept(state, skip=state["skip"] - 1))
                .when(begins & plain & free, kept(state, open=two, skip=F.lit(1)))
                .when(ends & ~free, kept(state, open=F.when(closes, "").otherwise(state["open"]), skip=F.lit(1)))
                .when((one == "$") & plain & free, kept(state, open=F.repeat(F.lit("$"), dollars), skip=dollars - 1))
                .when(closed, kept(state, open=F.lit(""), skip=F.length(state["open"]) - 1))
                .when(plain & free & one.rlike(r"(?U)\s") & (state["depth"] == 0), kept(state, last=i - 1))
                .when(plain & free, kept(state, depth=depth)).otherwise(state)
            )

        end = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)
        parted = word(at(F.lit(n))) & word(at(F.lit(n + 1)))
        return F.aggregate(F.array(end), F.lit(0), lambda _, e: F.when((e["open"] == "") & (e["depth"] == 0) & ~parted, n).otherwise(e["last"]))

    # the characters are made once and handed on
    cut = F.get(F.transform(F.array(F.regexp_extract_all(F.substring(s, 1, n + 2), F.lit("(?s)."), 0)), place), F.lit(0))
    head = F.substring(s, F.lit(1), F.when(cut > 0, cut).otherwise(n))
    return F.when(F.length(s) > n, F.regexp_replace(head, r"(?U)\s+$", "")).otherwise(s)


def canonical_tag(raw: Column, aliases: dict[str, list[str]] | None = None, dropped: list[str] | None = None) -> Column:
    """F16: null for blank and dropped tags, the canonical spelling of an alias, else as written."""
    aliases, dropped = aliases or TAG_ALIASES, dropped or DROPPED_TAGS
    tag, low = text(raw), F.lower(text(raw))
    lookup = F.create_map(*[x for k, vs in aliases.items() for v in vs for x in (F.lit(v), F.lit(k))])
    return F.when((tag != "") & ~low.isin(dropped), F.coalesce(F.try_element_at(lookup, low), tag))


def tag_family(tag: Column) -> Column:
    """FEM, PINN or null."""
    low = F.lower(text(tag))
    return F.when(low.isin(FEM_TAGS), "FEM").when(low.contains("neural operator") | low.isin(PINN_TAGS), "PINN")


def keyword_hits(haystack: Column, keywords: list[str]) -> Column:
    """how many keywords occur, each once, in any case."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    return sum((low.contains(k.lower()).cast("int") for k in keywords), F.lit(0))


def author_name(c: Column) -> Column:
    """first and last name at the last space, or a single name."""
    name = text(c)
    return F.struct(F.regexp_extract(name, r"^(.*) (\S+)$", 1).alias("first"), F.when(name.contains(" "), F.regexp_extract(name, r" (\S+)$", 1)).otherwise(name).alias("last"))


def library_tags(priority: Column, direction: Column, source: Column, tags: Column, flags: Column) -> Column:
    """prefixed facets, the paper's tags, and the names of its true flags."""
    facets = [F.when(text(c) != "", F.concat(F.lit(p), text(c))) for p, c in (("Priority_", priority), ("Direction_", direction), ("Source_", source))]
    true = F.map_keys(F.map_filter(F.coalesce(flags, F.create_map().cast("map<string,boolean>")), lambda _, v: F.coalesce(v, F.lit(False))))
    return F.array_distinct(F.concat(F.array_compact(F.array(*facets)), F.coalesce(tags, F.array().cast("array<string>")), F.array_sort(true)))


def content_hash(c: Column) -> Column:
    """sixteen hex digits of SHA-256; a missing content says so."""
    return F.when(c.isNull(), "sha256:missing").otherwise(F.concat(F.lit("sha256:"), F.substring(F.sha2(c.cast("binary"), 256), 1, 16)))


def looks_like_article(c: Column) -> Column:
    """6,000 characters or more, at most a quarter of the lines led by a bullet, and at least
    five body markers."""
    s = F.coalesce(c, F.lit(""))
    lines = F.filter(F.transform(F.split(s, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    led = F.size(F.filter(lines, lambda x: x.rlike(f"^[{BULLETS}]")))
    return (F.length(s) >= 6000) & (F.size(lines) > 0) & (led * 4 <= F.size(lines)) & (keyword_hits(s, BODY_MARKERS) >= 5)


def identifier_tokens(c: Column) -> Column:
    """parts of a snake_case or CamelCase identifier, lower-case."""
    split = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda x: x != "")


def has_bigram(tokens: Column, first: str, second: str) -> Column:
    """two tokens stand side by side."""
    return F.exists(F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.size(tokens))), lambda p: (p["0"] == first) & (p["1"] == second))


def escape_markdown(c: Column) -> Column:
    """one line, with the marks that carry meaning escaped."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\s+", " "), r"([\\`*_\[\]<>|#])", r"\\$1")


def escape_html(c: Column) -> Column:
    """the five characters that markup reserves."""
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def slug(c: Column, n: int = 80) -> Column:
    """a name that any file system takes."""
    return F.substring(F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, n)
