"""choosing figures of articles: outer figures of HTML pages and of JATS articles in order of
preference.

A small parser turns a page or an article into its outer figures, each with its whole text, its
caption and its graphics (with size, and whether each stands in a panel). What may be shown and in
which order is said in Columns over these arrays, one row a page throughout, so nothing is shuffled.

Defined results: a null, empty or broken document has no figure; a figure without a graphic has none
to show; ties keep the document's order; figures within figures belong to the outermost one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.identity import text
from corpuscle.functions.rights import ARXIV_WORK, MDPI_IMAGE, SVG, compact, is_restricted, license_url, reviewable_caption, third_party_rights
from corpuscle.functions.text import bound

#: Words of file names and labels of pictures that are no figure of a paper.
DECORATIVE = ["avatar", "avatars", "banner", "banners", "cover", "covers", "favicon", "headshot", "headshots", "icon", "icons", "logo", "logos", "portrait", "portraits"]
AUXILIARY = ["colorbar", "colorbars", "colourbar", "colourbars", "legend", "legends"]
COLOR_BAR = r"(?:^|[^a-z0-9])(?:only[_-]?)?(?:cbar|colou?r[\s_-]*bars?)(?:$|[^a-z0-9])"
KEY_FILE = r"^(?:(?:plot|chart|figure|color|colour)[_-]?)?keys?(?:[_-]?\d+)?$"
KEY_LABEL = r"^(?:(?:plot|chart|figure|color|colour) )?(?:legend|key|colou?r bars?)s?$"
LEGAL = r"(?:^|/)legal-mentions/"
PANEL = r"(?:^|[\s_.-])(?:subfig(?:ure)?|figure_panel|panel)(?:$|[\s_.-])"
RASTER = r"\.(?:gif|jpe?g|png|webp)$"
PMC_BUCKET, PMC_HOST = "s3://pmc-oa-opendata/", "pmc-oa-opendata.s3.amazonaws.com"
MDPI_IMAGES = "https://mdpi-res.com/d_attachment"
#: A strip beside a larger graphic: least ratio of its sides, largest short side, long side and
#: area, least short side and area ratio of the other.
STRIP = {"ratio": 4.0, "short": 64, "long": 512, "area": 16_000, "beside": 128, "times": 2, "area_times": 4}

GRAPHIC = "struct<kind:string,src:string,alt:string,class:string,width:string,height:string,panel:boolean>"
FIGURES = f"array<struct<class:string,caption:string,body:string,graphics:array<{GRAPHIC}>>>"
JATS_FIGURES = "array<struct<id:string,kind:string,label:string,caption:string,body:string,href:string>>"
JATS = f"struct<root:string,dois:array<string>,publishers:array<string>,licenses:array<struct<said:string,hrefs:array<string>>>,figures:{JATS_FIGURES}>"


class _Outer(HTMLParser):
    """Outer figures of a page: a frame of the open elements within one, by class and id."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[str] = []
        self.captions = 0
        self.words: tuple[list, list] = ([], [])

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "figure":
            if not self.open:
                self.found.append({"class": a.get("class", ""), "graphics": []})
                self.words = ([], [])
            self.open.append(f"{a.get('class', '')} {a.get('id', '')}")
        elif self.open and tag == "figcaption":
            self.captions += 1
        elif self.open and tag in ("img", "object"):
            label = a.get("alt", "") if tag == "img" else " ".join(" ".join(a.get(n, "").split()) for n in ("title", "aria-label") if a.get(n, "").strip())
            src = a.get("src" if tag == "img" else "data", "")
            kind = tag if tag == "img" or a.get("type", "").lower().startswith("image/") or src.lower().split("?")[0].endswith(".svg") else ""
            if src and kind:
                self.found[-1]["graphics"].append({"kind": kind, "src": src, "alt": label, "class": a.get("class", ""), "width": a.get("width", ""), "height": a.get("height", ""), "panel": " ".join(self.open).lower()})

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.captions:
            self.captions -= 1
        elif tag == "figure" and self.open:
            self.open.pop()
            if not self.open:
                self.close_figure()

    def handle_data(self, data):
        if self.open:
            self.words[0].append(data)
            if self.captions:
                self.words[1].append(data)

    def close_figure(self):
        self.found[-1] |= {"body": " ".join("".join(self.words[0]).split()), "caption": " ".join("".join(self.words[1]).split())}
        self.captions = 0


def outer_figures(html: Column) -> Column:
    """The outer figures of a page, as FIGURES; panel still names the frames around a graphic."""

    @F.pandas_udf(FIGURES.replace("panel:boolean", "panel:string"))
    def parse(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[dict]:
            p = _Outer()
            p.feed(page or "")
            return [f for f in p.found if "body" in f]

        return pages.map(one)

    return parse(html)


def url_path(url: Column) -> Column:
    """The decoded path of a URL or of a relative reference, in lower case."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    return bound(path, lambda p: F.lower(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)))


def base_name(url: Column) -> Column:
    return F.element_at(F.split(url_path(url), "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def url_join(base: Column, ref: Column) -> Column:
    """A reference resolved against a page's URL; dot segments of its path are removed."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*/)?", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    tail = F.regexp_extract(ref, r"([?#].*)?$", 1)
    path = F.regexp_replace(ref, r"[?#].*$", "")
    full = bound(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(bound(folder, lambda f: F.when(f == "", "/").otherwise(f)), p)))

    def clean(full: Column) -> Column:
        parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(p))))
        return F.concat(F.array_join(parts, "/"), F.when(full.rlike(r"/\.{1,2}$"), "/").otherwise(""))

    joined = F.concat(site, bound(full, clean), tail)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).otherwise(joined)


def tokens(*hints: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *hints)), F.lit("[a-z0-9]+"), 0)


def is_decorative(*hints: Column) -> Column:
    """Branding and people, told by words."""
    both = lambda t, a, b: F.array_contains(t, a) & F.array_contains(t, b)
    return bound(tokens(*hints), lambda t: F.arrays_overlap(t, F.array(*map(F.lit, DECORATIVE))) | both(t, "author", "photo") | both(t, "journal", "cover"))


def is_auxiliary(asset: Column, *hints: Column) -> Column:
    """Legends, keys and colour bars: by the file's name, or by a description that says nothing else."""
    named = lambda path: path.rlike(LEGAL) | F.arrays_overlap(tokens(path), F.array(*map(F.lit, AUXILIARY))) | path.rlike(COLOR_BAR) | stem(F.element_at(F.split(path, "/"), -1)).rlike(KEY_FILE)
    out = bound(url_path(F.coalesce(asset, F.lit(""))), named)
    for h in hints:
        out = out | F.array_join(tokens(F.coalesce(h, F.lit(""))), " ").rlike(KEY_LABEL)
    return out


def side(c: Column) -> Column:
    """A width or height as a number, null if it says none."""
    n = F.regexp_extract(F.lower(F.btrim(c)), r"^(\d+(?:\.\d+)?)(?:px|pt)?$", 1).try_cast("double")
    return F.when((n > 0) & (n <= 100_000), n)


def is_strip(g: Column, others: Column) -> Column:
    """A small long strip beside a much larger graphic of the same figure. The strip itself is never
    that much larger than itself, so it needs no leaving out."""
    w, h = side(g["width"]), side(g["height"])
    short, long_ = F.least(w, h), F.greatest(w, h)
    thin = (long_ / short >= STRIP["ratio"]) & (short <= STRIP["short"]) & (long_ <= STRIP["long"]) & (w * h <= STRIP["area"])

    def larger(o: Column) -> Column:
        ow, oh = side(o["width"]), side(o["height"])
        return F.coalesce((F.least(ow, oh) >= F.greatest(F.lit(STRIP["beside"]), short * STRIP["times"])) & (ow * oh >= w * h * STRIP["area_times"]), F.lit(False))

    return F.coalesce(thin & w.isNotNull() & h.isNotNull(), F.lit(False)) & F.exists(others, larger)


def _on(url: Column, hosts: list[str]) -> Column:
    """The URL over https if it is of one of the hosts, else empty."""

    def over(u: Column) -> Column:
        host = F.lower(F.regexp_extract(u, r"^https?://(?:[^@/?#]*@)?([^:/?#]*)", 1))
        return F.when(u.rlike("(?i)^https?://") & host.isin(hosts), F.regexp_replace(u, "(?i)^https?://", "https://")).otherwise("")

    return bound(url, over)


def _best(graphics: Column) -> Column:
    """Of graphics that may be shown the first that is no panel, else the first."""
    return bound(graphics, lambda all_: F.coalesce(F.get(F.filter(all_, lambda g: ~g["panel"]), F.lit(0)), F.get(all_, F.lit(0))))


def _ranked(candidates: Column) -> Column:
    """Candidates (rank, nth, ...) in order, without their rank."""
    return F.transform(F.array_sort(candidates), lambda c: c["pick"])


def html_candidates(figures: Column, page_url: Column) -> Column:
    """Pictures that a page's figures offer, in order: (image_url, caption, alt, media_type). Raster
    images come before vector ones, a graphical abstract before other figures; tables, legends,
    decorations and what credits someone else are left out, and a panel stands for its figure only
    where nothing shows the whole."""
    panel = lambda g: g["panel"].rlike(PANEL)
    work = F.regexp_replace(F.lower(F.regexp_extract(page_url, rf"(?i)^https://arxiv\.org/html/({ARXIV_WORK})(?:v[1-9]\d*)?/?$", 1)), r"v\d+$", "")

    def offered(f: Column, nth: Column, vector: bool) -> Column:
        graphics = F.filter(f["graphics"], lambda g: url_path(g["src"]).rlike(RASTER) | (g["kind"] == "object"))
        kind = F.filter(graphics, lambda g: g["kind"] == ("object" if vector else "img"))

        def of_own_work(url: Column) -> Column:
            fine = url.rlike(rf"(?i)^https://arxiv\.org/html/{ARXIV_WORK}v[1-9]\d*/.+\.svg$") & ~url.rlike(r"[%\\?#]") & ~F.substring(url, 9, 1 << 20).rlike(r"//|/\.{1,2}(?:/|$)")
            own = F.regexp_replace(F.lower(F.regexp_extract(url, rf"(?i)^https://arxiv\.org/html/({ARXIV_WORK}v[1-9]\d*)/", 1)), r"v\d+$", "")
            return F.when(fine & (own == work) & (work != ""), url).otherwise("")

        def first_own(*urls: Column) -> Column:
            plain, folder = (bound(u, of_own_work) for u in urls)
            return bound(plain, lambda u: F.when(u != "", u).otherwise(folder))

        def at(g: Column) -> Column:
            if not vector:
                return _on(url_join(page_url, g["src"]), ["arxiv.org"])
            # else as if the page were a folder
            return first_own(url_join(page_url, g["src"]), url_join(F.concat(F.rtrim(page_url, F.lit("/")), F.lit("/")), g["src"]))

        named = F.transform(kind, lambda g: F.struct(at(g).alias("image_url"), g["alt"].alias("alt"), g["class"].alias("class"), g["width"].alias("width"), g["height"].alias("height"), panel(g).alias("panel")))
        hints = (lambda g: []) if vector else (lambda g: [g["alt"], g["class"]])
        words = (lambda g: [f["caption"]]) if vector else (lambda g: [g["alt"], f["caption"]])
        shown = F.filter(named, lambda g: (g["image_url"] != "") & (url_path(g["image_url"]).rlike(r"\.svg$" if vector else RASTER)) & ~is_auxiliary(g["image_url"], *hints(g)) & ~is_strip(g, graphics) & ~is_decorative(base_name(g["image_url"]), *words(g)))
        said = [f["body"], F.array_join(F.transform(F.filter(f["graphics"], lambda g: g["kind"] == "img"), lambda g: g["alt"]), " ")]
        fine = ~F.array_contains(F.split(F.lower(f["class"]), r"\s+"), "ltx_table") & reviewable_caption(f["caption"]) & ~third_party_rights(said[0])
        fine = fine & ~F.exists(F.filter(f["graphics"], lambda g: g["kind"] == "img"), lambda g: third_party_rights(g["alt"]))
        if vector:
            labels = F.transform(kind, lambda g: g["alt"])
            fine = fine & ~F.exists(labels, third_party_rights) & ~F.exists(F.concat(F.array(f["body"]), labels), lambda s: s.rlike(r"(?i)\badopted\s+from\b"))
        abstract = F.lower(F.concat_ws(" ", f["class"], f["caption"])).contains("graphical abstract")
        pick = lambda best: F.struct(best["image_url"].alias("image_url"), f["caption"].alias("caption"), (f["caption"] if vector else best["alt"]).alias("alt"), F.lit(SVG if vector else "").alias("media_type"))
        made = lambda best: F.when(best.isNotNull() & fine, F.struct(F.lit(vector).alias("vector"), (~abstract).alias("rank"), nth.alias("nth"), pick(best).alias("pick")))
        return bound(_best(shown), made)

    each = F.concat(F.transform(figures, lambda f, k: offered(f, k, False)), F.transform(figures, lambda f, k: offered(f, k, True)))
    return _ranked(F.filter(each, lambda c: c.isNotNull()))


def _name(tag: object) -> str:
    return str(tag).rpartition("}")[2]


def _said(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _all(node, name: str) -> Iterator:
    return (n for n in node.iter() if _name(n.tag) == name) if node is not None else iter(())


def _child(node, *names: str):
    for name in names:
        node = next((c for c in node if _name(c.tag) == name), None) if node is not None else None
    return node


def _href(node) -> str:
    return next((v for k, v in node.attrib.items() if _name(k) == "href"), "")


def _article(xml: str | None) -> dict | None:
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    meta = _child(root, "front", "article-meta")
    under = lambda node, name: [c for c in (node if node is not None else []) if _name(c.tag) == name]
    figures = []
    for f in _all(root, "fig"):
        graphics = [h for tag in ("graphic", "inline-graphic") for g in _all(f, tag) if (h := _href(g))]
        figures.append({"id": f.get("id") or "", "kind": f.get("fig-type") or "", "label": _said(next(_all(f, "label"), None)), "caption": _said(next(_all(f, "caption"), None)), "body": _said(f), "href": graphics[0] if graphics else ""})
    return {
        "root": _name(root.tag), "dois": [_said(n).lower() for n in under(meta, "article-id") if (n.get("pub-id-type") or "").lower() == "doi" and _said(n)],
        "publishers": [_said(n).lower() for n in under(_child(root, "front", "journal-meta", "publisher"), "publisher-name") if _said(n)],
        "licenses": [{"said": _said(n), "hrefs": [v for m in n.iter() for k, v in m.attrib.items() if _name(k) == "href"]} for n in under(_child(meta, "permissions"), "license")],
        "figures": figures,
    }


def jats(xml: Column) -> Column:
    """What the selectors read of a JATS article, as JATS; null if it does not parse. A figure's graphic
    stands before inline graphics of its caption."""

    @F.pandas_udf(JATS)
    def parse(articles: pd.Series) -> pd.DataFrame:
        got = [_article(x) for x in articles]
        names = ["root", "dois", "publishers", "licenses", "figures"]
        return pd.DataFrame([[a[n] if a else None for n in names] for a in got], columns=names, dtype=object)

    return parse(xml)


def _figures(article: Column) -> Column:
    return F.coalesce(article["figures"], F.array().cast(JATS_FIGURES))


def _jats_offered(f: Column, asset: Column, words: Column, numbered: bool, named: bool) -> tuple[Column, Column, Column]:
    """(may be shown, rank, label) of a JATS figure whose asset has this name."""
    fine = reviewable_caption(f["caption"]) & ~third_party_rights(f["body"]) & ~is_auxiliary(asset, f["label"]) & ~is_decorative(F.lower(f["kind"]), F.lower(f["id"]), asset, f["label"], f["caption"])
    low = F.lower(words)
    abstract = low.contains("graphical abstract") | low.contains("graphical-abstract")
    if named:
        abstract = abstract | asset.startswith("ga") | asset.startswith("fx")
    rank = -(abstract.cast("int") * 2)
    if numbered:
        rank = rank - (F.lower(f["kind"]).isin("unnumbered", "undfig") | F.lower(f["id"]).startswith("undfig")).cast("int")
    return fine, rank, F.when(f["label"] != "", f["label"]).when(abstract, "Graphical abstract").otherwise("Figure")


def pmc_candidates(article: Column, media: Column) -> Column:
    """(image_url, caption, label) of the figures whose file stands among the media (URLs of the open
    bucket), in order of preference. A file is matched by its name, else by its name without a suffix."""
    https = F.transform(media, lambda m: _on(F.when(m.startswith(PMC_BUCKET), F.concat(F.lit(f"https://{PMC_HOST}/"), F.regexp_replace(F.substring(m, len(PMC_BUCKET) + 1, 1 << 20), r"\?.*$", ""))).otherwise(m), [PMC_HOST]))
    safe = F.filter(https, lambda u: url_path(u).rlike(RASTER) & ~url_path(u).startswith("/deprecated/"))

    def offered(f: Column, nth: Column) -> Column:
        name = base_name(f["href"])
        exact, near = F.filter(safe, lambda u: base_name(u) == name), F.filter(safe, lambda u: stem(base_name(u)) == stem(name))
        url = F.when(f["href"] != "", F.coalesce(F.try_element_at(exact, F.lit(-1)), F.get(near, F.lit(0))))
        fine, rank, label = _jats_offered(f, base_name(url), F.concat_ws(" ", f["kind"], f["id"], base_name(url), f["label"], f["caption"]), True, True)
        return F.when(url.isNotNull() & fine, F.struct(rank.alias("rank"), nth.alias("nth"), F.struct(url.alias("image_url"), f["caption"].alias("caption"), label.alias("label")).alias("pick")))

    return _ranked(F.filter(F.transform(_figures(article), offered), lambda c: c.isNotNull()))


def jats_license(article: Column) -> Column:
    """The label of the one Creative Commons licence that all of an article's licences declare; empty if
    any restricts, links elsewhere or differs, or if there is none."""
    urls = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(?i)https?://[^\s<>\"']+"), 0), lambda u: F.regexp_replace(u, r"[.,;:)\]}]+$", ""))

    def label(one: Column) -> Column:
        declared = F.when(F.size(one["hrefs"]) > 0, F.concat(one["hrefs"], urls(one["said"]))).otherwise(F.when(F.size(urls(one["said"])) == 1, urls(one["said"])))
        labels = F.array_distinct(F.transform(declared, lambda u: license_url(u, allow_http=True)))
        return F.when(~is_restricted(one["said"]) & (F.size(labels) == 1), F.get(labels, F.lit(0))).otherwise("")

    all_ = F.array_distinct(F.transform(article["licenses"], label))
    return F.when(F.size(all_) == 1, F.coalesce(F.get(all_, F.lit(0)), F.lit(""))).otherwise("")


def mdpi_candidates(article: Column, doi: Column, slug: Column, name: Column, license_name: Column) -> Column:
    """(candidates, rejection): the article must be the one of the DOI, of this publisher and under the
    licence; then two pictures of each figure whose plain file name belongs to the article's name. The
    article's own addresses are never used."""
    rejection = (
        F.when(article.isNull() | article["root"].isNull(), "invalid_xml")
        .when((article["root"] != "article") | (F.array_distinct(article["dois"]) != F.array(F.lower(doi))) | (F.size(article["publishers"]) == 0) | ~F.forall(article["publishers"], lambda p: p.isin("mdpi", "mdpi ag")), "identity_mismatch")
        .when((jats_license(article) == "") | (jats_license(article) != license_name), "license_not_reusable").otherwise("")
    )

    def offered(f: Column, nth: Column) -> Column:
        graphic = F.lower(F.regexp_extract(text(f["href"]), r"(?i)^([^/?#:]+-g\d{3})\.(?:tiff?|png|jpe?g)$", 1))
        own = F.regexp_replace(graphic, r"-g\d{3}$", "") == F.lower(name)
        fine, rank, label = _jats_offered(f, graphic, F.concat_ws(" ", f["kind"], f["id"], f["label"], f["caption"]), False, False)
        base = F.concat(F.lit(f"{MDPI_IMAGES}/"), slug, F.lit("/"), name, F.lit("/article_deploy/html/images/"), graphic)
        made = F.transform(F.array(F.lit("-550.jpg"), F.lit(".png")), lambda end, k: F.struct(rank.alias("rank"), nth.alias("nth"), k.alias("k"), F.struct(F.concat(base, end).alias("image_url"), f["caption"].alias("caption"), label.alias("label")).alias("pick")))
        return F.when((graphic != "") & own & fine, F.filter(made, lambda m: F.regexp_replace(m["pick"]["image_url"], "^https://mdpi-res.com", "").rlike(MDPI_IMAGE)))

    found = _ranked(F.flatten(F.filter(F.transform(_figures(article), offered), lambda c: c.isNotNull())))
    return F.struct(F.when(rejection == "", found).otherwise(F.slice(found, 1, 0)).alias("candidates"), rejection.alias("rejection"))


def select_html(df: DataFrame, html: str, page_url: str, out: str = "candidates") -> DataFrame:
    """df with the candidates of each page. The parsed figures are a step of their own, so that a page
    is parsed once."""
    return df.withColumn("_figures", outer_figures(F.col(html))).withColumn(out, html_candidates(F.col("_figures"), F.col(page_url))).drop("_figures")
