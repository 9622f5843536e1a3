"""cuts at safe boundaries, public records, and choosing figures of articles."""

import random

from pyspark.sql import functions as F

from corpuscle.functions import figures, rights
from corpuscle.functions import text as texts

PAGE = "https://arxiv.org/html/2608.12345"


def picked(spark, *pages, page=PAGE):
    """Of each page the candidates; all pages in one job, as a plan of such size takes long to compile."""
    rows = spark.createDataFrame([(k, html, page) for k, html in enumerate(pages)], "k int, html string, url string")
    got = {r.k: r.candidates for r in figures.select_html(rows, "html", "url").select("k", "candidates").collect()}
    return [[(c.image_url.removeprefix("https://arxiv.org/html/"), c.caption, c.alt, c.media_type) for c in got[k] or []] for k in range(len(pages))]


def names(spark, *pages):
    return [[c[0] for c in found] for found in picked(spark, *pages)]


def figure(img, caption="Figure 1: Measured and computed loads.", cls="ltx_figure"):
    return f'<figure class="{cls}">{img}<figcaption>{caption}</figcaption></figure>'


# --- F15 --------------------------------------------------------------------------------------------


def cut(s, n):
    """Plain version: walks over marks, as a person would read them."""
    if s is None or len(s) <= n:
        return s or ""
    inside, depth, last, i = "", 0, 0, 0
    while i < n:
        two, escaped = s[i : i + 2], i > 0 and s[i - 1] == "\\"
        if two in ("\\(", "\\[") and not escaped and not inside:
            inside, i = two, i + 2
        elif two in ("\\)", "\\]") and inside:
            inside, i = ("" if two == inside.replace("(", ")").replace("[", "]") else inside), i + 2
        elif s[i] == "$" and not escaped and not inside:
            inside = "$$" if two == "$$" else "$"
            i += len(inside)
        elif s[i] == "$" and not escaped and inside in ("$", "$$") and s[i : i + len(inside)] == inside:
            i, inside = i + len(inside), ""
        else:
            if not escaped and not inside:
                depth += {"{": 1, "}": -1 if depth else 0}.get(s[i], 0)
                if s[i].isspace() and not depth:
                    last = i
            i += 1
    if not inside and not depth and not (s[n - 1].isalnum() and s[n].isalnum()):
        last = n
    return s[: last or n].rstrip()


def test_cuts_fall_outside_formulas_and_braces(spark):
    rng = random.Random(7)
    parts = ["a", "word", " ", "  ", "\n", "$", "$$", "\\(", "\\)", "\\[", "\\]", "{", "}", "\\", "\\{", "é", "中", "😀", ".", "1"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, " lead", "x" * 50, "alpha \\(a b c d e f g h\\) omega and more"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    for n in (1, 7, 20):
        assert [r.o for r in df.select(texts.truncate_safely(F.col("s"), n).alias("o")).collect()] == [cut(s, n) for s in rows]


def test_long_caption_keeps_its_formula_whole(spark):
    formula = r"$\frac{\tau_{measured}}{\gamma_{applied}}$"
    caption = "Measured shear of the printed lattice. " * 30 + formula + " beyond"
    got = spark.range(1).select(texts.truncate_safely(F.lit(caption), 1200).alias("o")).first().o
    assert caption.startswith(got) and caption[len(got)] == " " and got.count("$") % 2 == 0 and got.count("{") == got.count("}")


# --- F45 --------------------------------------------------------------------------------------------


FIELDS = ["status", "provider", "image_url", "source_url", "license", "caption", "alt", "source_label", "media_type", "width", "height", "checked_at"]
GOOD = ["available", "pmc", "https://pmc-oa-opendata.s3.amazonaws.com/PMC1.1/g1.jpg", "https://example.org/a", "CC BY 4.0", "Loads of the frame " * 40, "see caption", " Library ", "image/jpeg", 800, 600, "2026-01-01T00:00:00Z"]


def shown(spark, *changes):
    rows = [tuple(new.get(f, v) for f, v in zip(FIELDS, GOOD)) for new in changes]
    kinds = ", ".join(f"{f} {'int' if f in ('width', 'height') else 'string'}" for f in FIELDS)
    return [r.v for r in spark.createDataFrame(rows, kinds).coalesce(1).select(rights.public_visual(F.struct(*FIELDS)).alias("v")).collect()]


def test_public_record_is_compact_or_null(spark):
    bad = [{"status": "blocked"}, {"license": "CC BY-NC 4.0"}, {"caption": "Reproduced with permission from X"}, {"image_url": "https://example.org/a.jpg"}, {"alt": "Image courtesy of Y"}, {"media_type": "image/png"}]
    v, w, *rest = shown(spark, {}, {"alt": "Frame  under load", "width": 0, "media_type": None}, *bad)
    assert len(v.caption) <= 600 and GOOD[5][len(v.caption)] == " " and v.alt is None and v.source_label == "Library" and v.provider is None and (v.width, v.media_type) == (800, "image/jpeg")
    assert w.asDict() | {"caption": ""} == {"status": "available", "image_url": GOOD[2], "source_url": GOOD[3], "license": "CC BY 4.0", "caption": "", "source_label": "Library", "alt": "Frame under load", "checked_at": GOOD[11], "width": None, "height": 600, "provider": None, "media_type": None}
    assert rest == [None] * len(bad)


# --- F46: pages -------------------------------------------------------------------------------------


def test_legend_beside_the_plot_is_no_figure(spark):
    panels = '<figure class="ltx_figure_panel"><img src="x/plot.png" width="476" height="263"/></figure><figure class="ltx_figure_panel"><img src="x/legend.png" width="476" height="31"/></figure>'
    only = '<figure class="ltx_figure_panel"><object type="image/svg+xml" data="2606.13245v1/m.svg"></object></figure><figure class="ltx_figure_panel"><img src="x/legend.png" width="476" height="31"/></figure>'
    assert names(spark, figure(panels), figure(only) + figure('<img src="next.png"/>')) == [["x/plot.png"], ["next.png"]]


def test_whole_image_before_panels_and_first_panel_without_one(spark):
    panel = lambda n: f'<figure class="ltx_figure ltx_figure_panel"><img src="{n}.png"/></figure>'
    pages = [figure(panel("a") + panel("b") + '<img src="whole.png"/>'), figure(panel("a") + panel("b")), figure('<img src="single.png"/>', cls="ltx_figure_panel")]
    assert names(spark, *pages) == [["whole.png"], ["a.png"], ["single.png"]]


def test_vector_images_come_after_every_raster_and_only_of_the_own_work(spark):
    svg = lambda work: figure(f'<object type="image/svg+xml" data="{work}/w.svg" width="600" height="400"></object>')
    page = svg("2608.12345v2") + svg("2601.00001v1") + figure('<img src="r.png"/>')
    got = picked(spark, page, figure('<object type="image/svg+xml" data="2608.12345v2/../w.svg"></object>'))
    assert [[(p[0], p[3]) for p in found] for found in got] == [[("r.png", ""), ("2608.12345v2/w.svg", "image/svg+xml")], []]


def test_decorations_tables_strips_and_credits_are_left_out(spark):
    img = lambda name, **kw: figure(f'<img src="{name}"/>', **kw)
    strip = '<img src="x1.png" width="49" height="199"/><object type="image/svg+xml" data="f.svg" width="405" height="348"></object>'
    cases = {
        figure('<img src="main_logo.png" alt="Project logo"/>') + figure('<img src="author-photo.jpg" alt="Author photo"/>') + figure('<img src="r.png" class="ltx_img_portrait"/>'): ["r.png"],
        img("cell.png", cls="ltx_table ltx_figure") + img("colour_bar.png") + img("plot-key.png") + img("key-result.png"): ["key-result.png"],
        figure(strip): [], figure('<img src="x1.png" width="49" height="199"/>'): ["x1.png"],
        img("a.png", caption="Adapted from Some Publisher.") + figure('<img src="b.png" alt="Photo courtesy of Z"/>') + img("c.png", caption="Figure 3") + img("d.png", caption=""): [],
        figure('<p>Redrawn from Some Publisher.</p><img src="a.png"/>'): [], img("a.png") + img("b.png", caption="Graphical abstract of the work"): ["b.png", "a.png"],
    }
    assert names(spark, *cases) == list(cases.values())


def test_references_resolve_and_other_hosts_fail(spark):
    rows = [("a.png", "https://h.org/x/a.png"), ("/a.png", "https://h.org/a.png"), ("../b/./c.png", "https://h.org/b/c.png"), ("//o.org/q", "https://o.org/q"), ("http://z/q?x", "http://z/q?x"), ("a?b=/../c", "https://h.org/x/a?b=/../c"), ("../../../e", "https://h.org/e"), ("..", "https://h.org/")]
    got = spark.createDataFrame([(r,) for r, _ in rows], "r string").coalesce(1).select(figures.url_join(F.lit("https://h.org/x/page?q#f"), F.col("r")).alias("u")).collect()
    assert [r.u for r in got] == [u for _, u in rows]
    odd = [None, "", "<figure>", "no figure", "<figcaption>x</figcaption></figure>"]
    assert names(spark, figure('<img src="https://elsewhere.org/a.png"/>') + figure('<img src="a.tiff"/>') + figure('<img src="http://arxiv.org/html/up.png"/>'), *odd) == [["up.png"], *[[]] * 5]
    assert picked(spark, figure('<img src="a.png"/>'), page=None) == [[]]


# --- F46: articles ----------------------------------------------------------------------------------


def article(body, doi="10.3390/met1", publisher="MDPI", license='<license><ext-link xlink:href="http://creativecommons.org/licenses/by/4.0/"/></license>'):
    return (
        f'<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><publisher><publisher-name>{publisher}</publisher-name></publisher></journal-meta><article-meta>'
        f'<article-id pub-id-type="doi">{doi}</article-id><permissions>{license}</permissions></article-meta></front><body>{body}</body></article>'
    )


def fig(name, caption="Stress of the welded joint.", label="Figure 1", attrs="", more=""):
    return f'<fig {attrs}><label>{label}</label><caption><p>{caption}</p></caption>{more}<graphic xlink:href="{name}"/></fig>'


def from_pmc(spark, *cases):
    rows = [(k, xml, [f"s3://pmc-oa-opendata/PMC1.1/{f}" if "/" not in f else f for f in files]) for k, (xml, files) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, xml string, media array<string>")
    out = df.select("k", figures.pmc_candidates(figures.jats(F.col("xml")), F.col("media")).alias("c")).collect()
    return [[(c.image_url.rpartition("/")[2], c.label) for c in r.c or []] for r in sorted(out, key=lambda r: r.k)]


def test_open_archive_figures_in_order_of_preference(spark):
    body = fig("g1.jpg", "Adapted with permission from Some Publisher.") + fig("g2", label="Figure 2") + fig("ga1.jpg", label="") + fig("g4.jpg", attrs='fig-type="undfig"', label="") + fig("logo.png") + fig("g6.jpg", caption="")
    inline = '<fig><label>Figure 1</label><caption><p>Response <inline-graphic xlink:href="s.png"/> field.</p></caption><graphic xlink:href="full.png"/></fig>'
    credited = '<fig><caption><p>Fields.</p></caption><attrib>Photo courtesy of Z</attrib><graphic xlink:href="g1.jpg"/></fig>'
    got = from_pmc(
        spark, (article(body), ["g1.jpg", "g2.png", "ga1.jpg", "g4.jpg", "logo.png", "g6.jpg"]), (article(inline), ["s.png", "full.png"]), (article(fig("g1.jpg")), ["https://publisher.example/g1.jpg", "g1.svg"]),
        (article(fig("g1.jpg")), ["g1.jpg"]), (article(credited), ["g1.jpg"]), ("<broken", ["g1.jpg"]), (None, []),
    )
    assert got == [[("ga1.jpg", "Graphical abstract"), ("g4.jpg", "Figure"), ("g2.png", "Figure 2")], [("full.png", "Figure 1")], [], [("g1.jpg", "Figure 1")], [], [], []]


def from_mdpi(spark, *cases):
    c = F.col
    rows = [(k, xml, "10.3390/MET1", lic) for k, (xml, lic) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, xml string, doi string, lic string")
    out = df.select("k", figures.mdpi_candidates(figures.jats(c("xml")), c("doi"), F.lit("metals"), F.lit("metals-12-01476"), c("lic")).alias("o")).collect()
    return [([x.image_url.rpartition("/")[2] for x in r.o.candidates], r.o.rejection) for r in sorted(out, key=lambda r: r.k)]


def test_publisher_article_must_be_the_one_and_open(spark):
    body = fig("metals-12-01476-g001.tif", "Reproduced with permission from X.") + fig("metals-12-01476-g002.tif") + fig("https://evil.example/metals-12-01476-g003.tif") + fig("other-1-g004.tif") + fig("metals-12-01476-g000.tif")
    fine = ["metals-12-01476-g002-550.jpg", "metals-12-01476-g002.png"]
    by, nc, sa = (f"http://creativecommons.org/licenses/{k}/4.0/" for k in ("by", "by-nc", "by-sa"))
    link = lambda u: f'<ext-link xlink:href="{u}"/>'
    licenses = {
        f"<license><license-p>Distributed as CC-BY ({by}).</license-p></license>": True, f"<license>{link(by)}</license><license>{link(nc)}</license>": False, f"<license><license-p>{by} {sa}</license-p></license>": False,
        "<license><license-p>CC BY 4.0</license-p></license>": False, f"<license><license-p>{by.replace('.org', '.org.evil.example')}</license-p></license>": False, f"<license><license-p>See https://publisher.example/l and {by}</license-p></license>": False,
        f"<license><license-p>No derivatives; {link(by)}</license-p></license>": False, f"<license>{link(by)}{link(nc)}</license>": False, "": False, f"<license>{link(by)}</license><license>{link(by)}</license>": True,
    }
    cases = [(article(body), "CC BY"), (article(body, doi="10.3390/met2"), "CC BY"), (article(body, publisher="Other"), "CC BY"), ("<x", "CC BY"), (article(body), "CC0")]
    got = from_mdpi(spark, *cases, *[(article(body, license=xml), "CC BY") for xml in licenses])
    assert got[:5] == [(fine, ""), ([], "identity_mismatch"), ([], "identity_mismatch"), ([], "invalid_xml"), ([], "license_not_reusable")]
    assert got[5:] == [(fine, "") if ok else ([], "license_not_reusable") for ok in licenses.values()]
