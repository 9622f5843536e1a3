"""The library's operators: tables of cases, laws, and every catalogue query against its SQL."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import dates, identity, media, quality, rights, routing
from corpuscle.functions import text as texts
from corpuscle.operators import aggregates, dedup, joins, search, source_audit, windows
from corpuscle.plans import catalog, features  # noqa: F401  (features adds its queries)
from corpuscle.sources import readers, sinks
from corpuscle.streaming import state

SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def col(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in sorted(rows.select("k", f(F.col("v"))).collect())]


# --- identity ---------------------------------------------------------------------------------------


def test_doi_forms(spark):
    raw = [" 10.1/AB ", "https://doi.org/10.1/ab", "http://dx.doi.org/10.1/Ab\n", "doi:10.1/ab", "DOI: 10.1/ab", "", "  ", None]
    assert col(spark, identity.normalize_doi, raw) == ["10.1/ab"] * 5 + [""] * 3
    raw = ["https://doi.org/10.1/a%2Fb).", "10.1/a+b;", None, "10.1/a%ZZ"]
    assert col(spark, identity.audit_doi, raw) == ["10.1/a/b", "10.1/a+b", "", "10.1/a%zz"]


def test_arxiv_forms(spark):
    raw = ["2401.00001v3", "arXiv:2401.00001", "https://arxiv.org/abs/2401.00001v1", "http://arxiv.org/pdf/2401.00001.pdf", "https://arxiv.org/pdf/2401.00001v2.pdf", "hep-th/9901001v2", "", None]
    assert col(spark, identity.arxiv_base_id, raw) == ["2401.00001"] * 5 + ["hep-th/9901001", "", ""]


def test_key_precedence_and_aliases(spark):
    aliases = F.create_map(F.lit("10.5281/zenodo.2"), F.lit("10.5281/zenodo.1"))
    rows = [
        ("10.48550/arXiv.2401.1v2", "9999.1", "1", "arxiv:2401.1"), ("10.1/X", "9999.1", "1", "doi:10.1/x"), ("", "2401.1v9", "1", "arxiv:2401.1"),
        (None, None, "77", "pmid:77"), (None, None, "x7", ""), ("10.5281/zenodo.2", None, None, "doi:10.5281/zenodo.1"), ("10.6084/m9.figshare.5.v3", None, None, "doi:10.6084/m9.figshare.5"),
    ]
    df = spark.createDataFrame(rows, "doi string, arxiv string, pmid string, want string")
    got = df.select("want", identity.canonical_key(F.col("doi"), F.col("arxiv"), F.col("pmid"), F.lit(""), aliases).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    assert one(spark, identity.canonical_key(F.lit(""), F.lit(""), F.lit(""), identity.openalex_work_id(F.lit("https://openalex.org/w12"), F.lit(""), F.lit("")))) == "openalex:W12"
    assert one(spark, identity.identity_key(F.lit(" 10.1/X"), F.lit("a"))) == "doi:10.1/X" and one(spark, identity.paper_url(F.lit("arxiv:1"))) == "https://arxiv.org/abs/1"


# --- dates and text ---------------------------------------------------------------------------------


def test_dates(spark):
    assert col(spark, dates.date_precision, ["", None, "2024-01-01", "2024-03-01", "2024-03-05"]) == ["year", "year", "year", "month", "day"]
    assert one(spark, dates.iso_week(F.lit("2027-01-01").cast("date"))) == "2026-W53"
    got = one(spark, dates.month_windows(F.lit("2024-01-15").cast("date"), F.lit("2024-03-02").cast("date")))
    assert [(w.month, str(w.from_date), str(w.to_date)) for w in got] == [("2024-01", "2024-01-15", "2024-01-31"), ("2024-02", "2024-02-01", "2024-02-29"), ("2024-03", "2024-03-01", "2024-03-02")]
    assert one(spark, dates.month_windows(F.lit("2024-02-01").cast("date"), F.lit("2024-01-01").cast("date"))) == []
    assert [x and x.year for x in col(spark, dates.year_and_month, ["2024-01-05", "2024-13-05", "x", None])] == [2024, None, None, None]
    inside = lambda c: dates.in_window(c, F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date"))
    assert col(spark, inside, ["2024-01-07T10:00", "2024-01-08", "bad", None]) == [True, False, False, False]
    assert col(spark, lambda c: dates.price_window(c.cast("timestamp")), ["2024-01-05 03:59:59", "2024-01-05 04:00:00", "2024-01-05 06:00:00", "2024-01-06 02:00:00"]) == ["peak", "off_peak", "peak", "off_peak"]
    assert one(spark, dates.token_cost(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1_000_000), F.lit(0), (1.0, 3.0, 9.0))) == 3.0


def test_text(spark):
    assert col(spark, texts.canonical_tag, [" SLM ", "review", "", None, "3D bioprinting", "Pinn"]) == ["selective laser melting", None, None, None, "3D bioprinting", "physics-informed NN"]
    assert col(spark, texts.tag_family, ["Finite Element", "DeepONet neural operator", "PINN", "x"]) == ["FEM", "PINN", "PINN", None]
    assert [tuple(x) for x in col(spark, texts.author_name, ["Ada M. Byron", "Plato", None])] == [("Ada M.", "Byron"), ("", "Plato"), ("", "")]
    assert col(spark, lambda c: texts.flatten(F.parse_json(c)), ['"a"', '["a","","b"]', '{"x":"a","y":"b"}', "null", None]) == ["a", "a b", "a b", "", ""]
    assert col(spark, texts.identifier_tokens, ["citationGraph_v2", "HTTPServer"]) == [["citation", "graph", "v2"], ["http", "server"]]
    assert col(spark, lambda c: texts.truncate_words(c, 12), ["alpha $x + y$ omega", "short"]) == ["alpha…", "short"]
    assert one(spark, texts.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;" and one(spark, texts.escape_markdown(F.lit("a*b\n[c]"))) == r"a\*b \[c\]"
    article = "introduction method result conclusion discussion\n" + "text line\n" * 700
    assert col(spark, texts.looks_like_article, [article, article + "• nav\n" * 400, article[:3000], None]) == [True, False, False, False]


# --- routing, priorities, audits --------------------------------------------------------------------

CONFIG = {"a": {"display_name": "A", "strong_keywords": ["bioink"], "must_pair_with": [["bone", "print"]]}, "b": {"strong_keywords": ["mesh", "solver"]}}


def test_routing(spark):
    rows = [(1, "Bioink", "bone print"), (2, "mesh solver", None), (3, "Bioink mesh", ""), (4, "no clinical bioinks", ""), (5, "clinical", "mesh"), (6, "clinical", "mesh bone"), (7, None, None), (8, "中文bioink中", "")]
    got = {r.k: r for r in routing.route(spark.createDataFrame(rows, "k int, title string, abstract string"), CONFIG, ["clinical"]).collect()}
    assert {k: r.directions for k, r in got.items()} == {1: ["a"], 2: ["b"], 3: ["a", "b"], 4: [], 5: [], 6: ["b"], 7: [], 8: []}
    assert got[1].routing_matches == {"a": ["bioink", "bone + print"]} and got[1].direction_name == "A" and got[5].routing_reason and got[7].direction is None


def test_boost_is_idempotent_and_leaves_exclude(spark):
    both = ["rl_world_model", "fea_surrogate"]
    df = spark.createDataFrame([(1, both, "Low"), (2, both, "High"), (3, both, "Exclude"), (4, both[:1], "Low"), (5, None, "Low"), (6, both, None)], "k int, directions array<string>, priority string")
    once = routing.crossover_boost(df)
    twice = routing.crossover_boost(once)
    assert {r.k: r.priority for r in once.collect()} == {1: "Medium", 2: "High", 3: "Exclude", 4: "Low", 5: "Low", 6: None}
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_four_readings_of_a_null_priority(spark):
    df = spark.createDataFrame([("High", False), (None, True), (None, False), ("odd", False), ("", None)], "p string, f boolean")
    got = [tuple(r) for r in df.select(routing.run_priority(F.col("p"), F.col("f")), routing.public_priority(F.col("p"), F.col("f")), routing.display_priority(F.col("p"), F.col("f")), routing.export_priority(F.col("p"))).collect()]
    assert got == [("High", "High", "High", "High"), (None, "Unscored", "Unscored", "Low"), ("Low", None, "Low", "Low"), ("Low", "odd", "Low", "odd"), ("Low", None, "Low", "Low")]


def test_audit_rules(spark):
    verdict = lambda a, h: tuple(one(spark, quality.routing_verdict(F.lit(a), F.lit(h), {"x": ["aa", "bb"], "y": ["cc", "dd", "ee"]})))
    assert verdict("x", "aa") == ("appropriate", "") and verdict("x", "cc") == ("likely_misrouted", "y") and verdict("x", "zz") == ("questionable", "")
    assert verdict("x", "aa cc dd") == ("appropriate", "") and verdict("x", "aa cc dd ee") == ("questionable", "y") and verdict("?", "cc") == ("questionable", "y")
    assert one(spark, quality.substance([F.lit(x) for x in ("long enough text", "", None, "short")], [])) == "vague_or_empty"
    assert one(spark, quality.consistency(F.lit("High"), F.lit("not relevant"), F.lit(None), ["not relevant"], ["core"])) == "clear_mismatch"
    assert one(spark, quality.is_silent(F.lit("Low"), F.lit(""), F.lit(None), F.lit(None).cast("array<string>")))
    assert one(spark, quality.miss_reason(F.lit("10.1/j.x.2008.11.3"), F.lit(""), [])) == "out_of_window"
    assert one(spark, quality.health_reasons(F.lit("success"), F.array(F.lit("scorer_failed")), F.lit(1), F.lit(69))) == []
    assert one(spark, quality.health_reasons(F.lit(None), F.array(F.lit("scorer_failed"), F.lit("fetched_zero")), F.lit(5), F.lit(5))) == ["run_status=missing", "fetched_zero", "scorer_failed"]
    assert one(spark, quality.health_warnings(F.lit("partial_success"), F.array(F.lit("arxiv_failed"), F.lit("odd")), F.array().cast("array<string>"), [])) == ["run_status=partial_success", "arxiv_failed"]


def test_rights(spark):
    assert col(spark, rights.license_label, ["CC BY 4.0", "cc-by-nc-sa", "https://creativecommons.org/publicdomain/zero/1.0/", "Elsevier", None]) == ["CC BY", "CC BY-NC-SA", "CC0", "Elsevier", ""]
    assert col(spark, rights.license_url, ["https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by/4.0/?x=1", "http://creativecommons.org/licenses/by/4.0/"]) == ["CC BY", "", ""]
    assert col(spark, rights.third_party_rights, ["Reprinted with permission", "© 2020 X", "Created with BioRender", "Mesh of the stem model", None]) == [True, True, True, False, False]
    assert col(spark, rights.reviewable_caption, ["Figure 3.", "see caption", "Stress in the stem", "", None]) == [False, False, True, False, False]


# --- dedup and joins --------------------------------------------------------------------------------


def test_fold_equals_a_loop(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["", *[f"k{j}" for j in range(40)]]), rng.choice(["arxiv", "openalex", "pubmed"]), rng.choice(["", "text"]), rng.choice(["", "10.1/x"])) for k in range(500)]
    df = spark.createDataFrame(data, "pos int, key string, source string, abstract string, doi string").withColumn("win", F.col("pos")).repartition(5)
    got = sorted(map(tuple, dedup.preference_fold(df, "key", "pos", ["source", "abstract", "doi", "win"], dedup.paper_preference).select("key", "pos", "win", "also_seen_in").collect()))
    want, standing = [], {}
    for p, key, s, a, d in data:
        if not key:
            want.append((key, p, p, []))
        elif key not in standing:
            standing[key] = [p, p, s, a, d, []]
        else:
            t = standing[key]
            wins = (not t[3] and a) or (t[2] == "arxiv" and s in ("openalex", "pubmed") and d)
            lost = t[2] if wins else s
            if lost not in t[5]:
                t[5].append(lost)
            if wins:
                t[1:5] = [p, s, a, d]
    want += [(k, t[0], t[1], t[5]) for k, t in standing.items()]
    assert got == sorted(want)


def test_rows_without_identity_never_merge(spark):
    df = spark.createDataFrame([(1, "", "b"), (2, None, "a"), (3, "k", "c"), (4, "k", "")], "pos int, key string, seen string")
    assert sorted(r.pos for r in dedup.first_wins(df, "key", [F.col("seen"), F.col("pos")]).collect()) == [1, 2, 4]
    assert sorted(r.pos for r in dedup.anti_join_seen(df, spark.createDataFrame([("k",), ("",)], "key string"), ["key"]).collect()) == [1, 2]


def test_a_clear_is_not_undone(spark):
    marks = [("p", "a", "2024-01-01", "read"), ("p", "b", "2024-01-02", ""), ("q", "a", "2024-01-01", "read"), ("q", "b", "2024-01-01", "to-read")]
    df = spark.createDataFrame(marks, "key string, device string, at string, state string")
    assert [(r.key, r.state) for r in dedup.latest_mark(df, "key", "at", "device", "state", "").collect()] == [("q", "to-read")]


def test_bounded_state_keeps_order(spark):
    old = spark.createDataFrame([("z", 1), ("y", 2), ("x", 3)], "key string, seq long")
    new = spark.createDataFrame([("b",), ("a",), ("x",), ("",), (None,)], "key string")
    assert [r.key for r in dedup.bounded_state(old, new, 4).orderBy("seq").collect()] == ["y", "x", "a", "b"]


def test_joins(spark):
    old = spark.createDataFrame([("v", [1, 2], 3, "old")], "venue string, positions array<int>, skipped_known int, name string")
    new = spark.createDataFrame([("v", [2, 5], 1, None), ("w", None, 2, "new")], "venue string, positions array<int>, skipped_known int, name string")
    got = {r.venue: (r.positions, r.skipped_known, r.name) for r in joins.merge_reports(old, new, "venue").collect()}
    assert got == {"v": ([1, 2, 5], 3, "old"), "w": ([], 2, "new")}
    refs, files = spark.createDataFrame([("a.jpg",), ("b.gif",), ("c.png",)], "name string"), spark.createDataFrame([("m/a.jpg",), ("m/b.jpg",)], "path string")
    assert {r.name: r.path for r in joins.match_media(refs, files).collect()} == {"a.jpg": "m/a.jpg", "b.gif": "m/b.jpg", "c.png": None}
    a, b = (spark.createDataFrame(x, "d string, kw array<string>") for x in ([("x", ["p", "q"]), ("y", [])], [("x", ["q", "r"]), ("z", ["s"])]))
    assert {r.d: (r.status, r.kw_added, r.kw_removed) for r in joins.config_diff(a, b, "d", ["kw"]).collect()} == {"x": ("kept", ["r"], ["p"]), "y": ("removed", [], []), "z": ("added", ["s"], [])}
    log = spark.createDataFrame([("k1", "daily"), ("k2", "backfill")], "doi_or_arxiv_id string, run_type string")
    kept, n = joins.without_backfill(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"), log, "key")
    assert sorted(r.key for r in kept.collect()) == ["k1", "k3"] and n.first()[0] == 1


# --- aggregates and windows -------------------------------------------------------------------------


def test_emerging_needs_twice_the_year_before(spark):
    counts = spark.createDataFrame([(2023, "d", "t", 3), (2024, "d", "t", 8), (2023, "d", "u", 10), (2024, "d", "u", 11), (2024, "d", "v", 5), (2022, "d", "w", 1), (2024, "d", "w", 6)], "year int, direction string, tag string, n long")
    assert [(r.year, r.tag, r.delta) for r in aggregates.emerging(counts).collect()] == [(2023, "u", 10), (2024, "t", 5), (2024, "w", 6), (2024, "v", 5)]


def test_bucket_counts(spark):
    rows = [("2024-01-01", "arxiv", "a", None, ["a"], "High", True), ("2024-01-01", "arxiv", "", "Shown", ["a", "b"], None, False), ("2024-01-01", "pubmed", None, None, None, "Low", True)]
    df = spark.createDataFrame(rows, "bucket_date string, source string, direction string, direction_name string, directions array<string>, priority string, scored boolean")
    r = aggregates.bucket_counts(df).first()
    assert (r.total, r.scored, r.by_source, r.by_direction, r.priority_counts) == (3, 2, {"arxiv": 2, "pubmed": 1}, {"a": 1, "Shown": 1}, {"High": 1, "Low": 1})
    assert aggregates.bucket_counts(df, True).first().by_direction == {"a": 2, "b": 1}


def test_allocation_equals_a_loop(spark):
    rng = random.Random(2)
    for n in (0, 3, 17, 60, 500):
        sizes = {f"y{k:02d}": rng.randint(1, 40) for k in range(9)}
        base = {y: min(2, s) for y, s in sizes.items()}
        left, room = max(0, n - sum(base.values())), {y: sizes[y] - base[y] for y in sizes}
        whole, k = sum(s for y, s in sizes.items() if room[y] > 0), dict(base)
        if left and whole:
            quota = {y: left * sizes[y] / whole if room[y] else 0.0 for y in sizes}
            floors = {y: min(int(quota[y]), room[y]) for y in sizes}
            rest = left - sum(floors.values())
            for y in sorted((y for y in sizes if room[y] > floors[y]), key=lambda y: -(quota[y] - floors[y])):
                if rest:
                    floors[y] += 1
                    rest -= 1
            k = {y: base[y] + floors[y] for y in sizes}
        got = windows.allocation(spark.createDataFrame(list(sizes.items()), "y string, size long"), "y", n)
        assert {r.y: r.k for r in got.collect()} == k


def test_anchor_collisions(spark):
    df = spark.createDataFrame([("d", "doi:a/b", 1), ("d", "doi:a.b", 2), ("d", "doi:a/b", 3), ("e", "doi:a/b", 1)], "day string, key string, pos int")
    got = [r.anchor for r in windows.anchors(df, "day", "key", "pos").orderBy("day", "pos").collect()]
    assert len(set(got[:3])) == 3 and got[3] == "doi-a-b" and got[2] == got[0] + "-2" and got[0].startswith("doi-a-b--")


def test_search_and_marks(spark):
    rows = [(f"k{i}", f"2024-01-0{i}", 2024, "d", "High", "Direct", f"Title {i}", ["A", "B", "C", "D"], None, "Dir", ["Bone", "x"], ["term"]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "key string, date string, year int, direction string, priority string, relevance string, title string, authors array<string>, venue string, direction_name string, tags array<string>, terms array<string>")
    lean = search.search_record(df)
    assert lean.first().authors == "A, B, C et al."
    found, total = search.search(lean, "BONE", size=2, direction="d", year="2024")
    assert [r.key for r in found.collect()] == ["k4", "k3"] and total.first()[0] == 4
    deep = spark.createDataFrame([("k2", 2024, "hidden words")], "key string, year int, deep string")
    assert [r.key for r in search.search(lean, "hidden", deep=deep)[0].collect()] == ["k2"]
    marks = spark.createDataFrame([("k1", "read", ["t"], "2024", "Title One", "my note", "d"), ("k2", "", ["u"], "2023", "Two", "", "d")], "key string, state string, tags array<string>, at string, title string, note string, direction string")
    assert sorted(r.key for r in search.with_marks(lean, marks, ["none"], []).collect()) == ["k2", "k3", "k4"]
    assert [r.key for r in search.reading_list(marks, "read", "t", "note one").collect()] == ["k1"]


# --- sources and sinks ------------------------------------------------------------------------------


def test_buckets_tolerate_any_file(spark, tmp_path):
    papers = [{"id": "1", "title": "A", "llm": {"priority": "High", "tags": ["x"]}}, {"id": "2"}]
    (tmp_path / "2024-01-01.json").write_text(json.dumps({"schema_version": "v2", "papers": papers}))
    (tmp_path / "2024-01-02.json").write_text(json.dumps(papers[:1]))
    (tmp_path / "2024-01-03.json").write_text("{bad")
    (tmp_path / "2024-01-04.SKIPPED.json").write_text("{}")
    got = readers.buckets(spark, str(tmp_path)).select("bucket_date", "position", "id", "llm.priority").collect()
    assert sorted(map(tuple, got), key=str) == [("2024-01-01", 0, "1", "High"), ("2024-01-01", 1, "2", None), ("2024-01-02", 0, "1", "High")]
    assert readers.buckets(spark, str(tmp_path), start="2024-01-02").count() == 1
    assert [f.rsplit("/")[-1] for f in readers.buckets(spark, str(tmp_path), start="2024-01-02", end="2024-01-02").inputFiles()] == ["2024-01-02.json"]
    assert readers.buckets(spark, str(tmp_path), start="2030-01-01").count() == 0 and "llm" in readers.buckets(spark, str(tmp_path), start="2030-01-01").columns
    assert [r.bucket_date for r in readers.corrupt_buckets(spark, str(tmp_path)).collect()] == ["2024-01-03"]
    (tmp_path / "list.tsv").write_text("# c\n\n10.1/a\tmust_read\thip\n10.1/b\n")
    assert [tuple(r) for r in readers.listed_ids(spark, str(tmp_path / "list.tsv")).collect()] == [("10.1/a", "must_read", "hip"), ("10.1/b", "", "")]


def test_web_rows(spark):
    index = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, readers.inverted_index_text(index)) == "a b a b" and one(spark, readers.inverted_index_text(F.lit(None).cast("map<string,array<int>>"))) == ""
    xml = (
        "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract>"
        "<Journal><Title>J</Title><JournalIssue><PubDate><Year>2024</Year><Month>Mar</Month></PubDate></JournalIssue></Journal>"
        "<AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author><Author><LastName>M</LastName><ForeName>G</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    )
    got = readers.pubmed_rows(spark.createDataFrame([(xml,), ("<x/>",)], "xml string")).collect()
    assert len(got) == 1 and (got[0].pmid, got[0].abstract, got[0].date, got[0].year) == ("7", "one two", "2024-03-01", 2024)
    assert [(a.name, a.inferred) for a in got[0].corresponding_authors] == [("G M", True)]


def test_fetching(spark):
    answers = iter([(500, {}, {}), (429, {"Retry-After": "1"}, {}), (200, {}, {"ok": 1})])
    assert readers.fetch_json(lambda p: next(answers), {}, sleep=lambda s: None) == {"ok": 1}
    with pytest.raises(readers.RateLimited):
        readers.fetch_json(lambda p: (429, {"Retry-After": "900"}, {}), {})
    pages = {"*": {"results": [1], "meta": {"next_cursor": "b"}}, "b": {"results": [2], "meta": {"next_cursor": "c"}}}
    assert readers.cursor_pages(lambda p: pages[p["cursor"]], {}, most=2) == ([1, 2], True)
    readers.register_fetcher(spark, "fixture", lambda q: [{"q": q, "n": n} for n in range(2)])
    df = spark.read.format("fixture").option("queries", json.dumps(["x", "y"])).load()
    assert sorted((r.query, r.position) for r in df.collect()) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    keys = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "k string")
    assert [tuple(r) for r in readers.resolve_batches(keys, "k", lambda ks: {k: k.upper() for k in ks if k == "a"}).collect()] == [("a", "A")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", f"k{i}") for i in range(25)] + [("2024-01-02", "z")], "day string, key string")
    manifest = sinks.write_pages(spark, df, str(tmp_path / "site"), "day", [F.col("key")]).collect()
    assert {r.day: (r.pages, r.rows) for r in manifest} == {"2024-01-01": (2, 25), "2024-01-02": (1, 1)}
    again = sinks.write_pages(spark, df.repartition(3), str(tmp_path / "site"), "day", [F.col("key")])
    assert sorted(r.revision for r in again.collect()) == sorted(r.revision for r in manifest)
    assert not sinks.write_unless_empty(spark, df.limit(0), str(tmp_path / "day"), "2024-01-03") and not os.path.exists(tmp_path / "day")
    sinks.write_jsonl(df.limit(1), str(tmp_path / "out"))
    assert [list(json.loads(r.value)) for r in spark.read.text(str(tmp_path / "out")).collect()] == [["day", "key"]]

    def push(part):
        if any(r["key"] == "z" for r in part):
            raise OSError
        return ["created"] * len(part)

    got = {r.key: r.outcome for r in sinks.sync_batches(df.filter("key in ('z', 'k1')").coalesce(1), push, 1).collect()}
    assert got == {"z": "unknown", "k1": "created"}


# --- state, scoring, media, source rules ------------------------------------------------------------


def test_resume_refuses_other_parameters(spark):
    plan = state.backfill_plan(spark, "2024-01-15", "2024-03-02")
    progress = spark.createDataFrame([("2024-01", "complete"), ("2024-02", "in_progress")], "month string, status string")
    assert sorted(r.month for r in state.resume(plan, progress, {"a": 1}, {"a": 1}).collect()) == ["2024-02", "2024-03"]
    with pytest.raises(ValueError):
        state.resume(plan, progress, {"a": 1}, {"a": 2})


def test_scoring_contract(spark):
    def call(row, strict):
        if row["key"] == "bad":
            raise ValueError("no json")
        if row["key"] == "late" and not strict:
            raise ValueError("first try")
        return {"priority": "High"}

    got = {r.key: (r.priority, r.scorer_failed, r.scorer_failed_attempts) for r in state.score(spark.createDataFrame([("ok",), ("bad",), ("late",)], "key string"), call).collect()}
    assert got == {"ok": ("High", False, 1), "bad": (None, True, 3), "late": ("High", False, 2)}

    def spent(row, strict):
        raise state.BudgetExhausted

    seen = []
    df = spark.createDataFrame([(f"k{i}",) for i in range(40)], "key string")
    out = state.score_in_rounds(df, spent, lambda d, k: (seen.append(k), d.cache())[1], 4)
    assert seen == [0] and 0 < out.count() < 40


def test_aliases_stop_at_the_first_network_failure():
    def ask(doi):
        if doi == "c":
            raise OSError
        return (404, None, []) if doi == "b" else (200, "root", ["a2"])

    assert state.resolve_aliases(["a", "a2", "b", "c", "d"], {}, ask) == {"a": "root", "a2": "root", "b": "b"}


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 10, 20) + b"\0" * 12
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [media.dimensions(x) for x in (png, b"GIF89a" + struct.pack("<HH", 3, 4), jpeg, webp, b'<svg width="5px" height="6">', b'<svg viewBox="0 0 7 8">', b"", b"junk")] == [(640, 480), (3, 4), (20, 10), (100, 50), (5, 6), (7, 8), None, None]


def test_figures(spark):
    html = '<figure><img src="a.png" alt="x"></figure><figure><img src="b.png"><figcaption>Two\n words</figcaption></figure>'
    got = media.html_figures(spark.createDataFrame([(html,), (None,)], "h string"), "h").collect()
    assert [f.src for f in got[0].figures] == ["b.png", "a.png"] and got[0].figures[0].caption == "Two words" and got[1].figures == []
    xml = '<fig id="f1"><label>1</label><caption><p>Cap <i>x</i></p></caption><graphic xlink:href="g1.jpg"/></fig>'
    assert [tuple(f) for f in one(spark, media.xml_figures(F.lit(xml)))] == [("1", "Cap x", "g1.jpg")]


def test_source_rules(spark):
    source = "import networkx\nimport faiss  # scope: allow\nimport difflib  # scope: allow graph-library\ndef pageRank():\n    return eval('1')\n"
    got = source_audit.audit(spark.createDataFrame([("m.py", source), ("n.py", "def")], "path string, text string"))
    assert sorted((r.path, r.rule) for r in got.collect()) == [("m.py", "citation-name"), ("m.py", "dynamic-code"), ("m.py", "fuzzy-match"), ("m.py", "graph-library"), ("n.py", "syntax")]
    assert source_audit.catalogue(spark).count() == len(source_audit.RULES) and source_audit.rollup(got).count() == 2


# --- rights of figures: F42 to F46 --------------------------------------------------------------------


def test_F42_labels_by_code_parts(spark):
    raw = ["CC BY-ND-SA 4.0", "creative commons by nc nd", "CC NC", "https://creativecommons.org/licenses/by-sa/4.0/", "cc-by", "CC SA", "GPL", "cc 0", "x" * 200, "", None]
    want = ["CC BY-ND", "CC BY-NC-ND", "CC BY-NC", "CC BY-SA", "CC BY", "CC SA", "GPL", "CC0", "x" * 120, "", ""]
    assert col(spark, rights.license_label, raw) == want


def test_F43_starts_agree_and_have_come(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    cases = {
        None: True, "{}": False, "[]": False, "junk": False, '{"other": 1}': False, '{"date-parts": [[2024, 5]]}': True, '{"date-parts": [[2024, 7]]}': False, '{"date-parts": [[2024, 13]]}': False,
        '{"date-parts": [[2024], [2025]]}': False, '{"date-parts": [["2024"]]}': False, '{"date-parts": [[true]]}': False, '{"date-time": "2024-05-01T00:00:00Z"}': True, '{"date-time": 5}': False, '{"date-time": "soon"}': False,
        '{"timestamp": 1714521600000}': True, '{"timestamp": "1714521600000"}': False, '{"timestamp": true}': False, '{"timestamp": 1e300}': False, '{"date-parts": [[2024, 5, 1]], "date-time": "2024-05-01T23:00:00Z"}': True,
        '{"date-parts": [[2024, 5, 1]], "date-time": "2024-05-02T00:00:00Z"}': False, '{"date-parts": [[2024]], "timestamp": 1714521600000}': True, '{"date-time": "2024-05-01T00:00:00Z", "timestamp": 1714521600500}': True,
        '{"date-time": "2024-05-01T00:00:00Z", "timestamp": 1714521605000}': False, '{"date-time": "2024-06-01T01:00:00+02:00"}': True, '{"date-time": "2024-06-01T01:00:00"}': False,
    }
    assert col(spark, lambda c: rights.license_started(c, now), list(cases)) == list(cases.values())
    by, sa = "https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by-sa/4.0/"
    rows = [([("vor", by, None)], "CC BY"), ([("VOR", by, None), ("vor", sa, None)], ""), ([("am", by, None), ("vor", by, None)], ""), ([("vor", by, '{"date-parts": [[2030]]}')], ""), ([], ""), (None, ""), ([("vor", "http" + by[5:], None)], "")]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "k int, v array<struct<content_version:string,url:string,start:string>>")
    got = [r[1] for r in sorted(df.select("k", rights.single_vor_license(F.col("v"), now)).collect())]
    assert [g or "" for g in got] == [w for _, w in rows]


def test_F44_bylines_and_credits(spark):
    credited = ["Image by Jane Doe", "photo by: 'nasa'", "Figure: created by 王明", "Taken from the Smith archive", "Fig. 2: From Smith et al.", "Stock photo from Getty Images", "Illustration from Shutterstock", "Courtesy of X", "Diagram made by BioRender"]
    free = ["Figure by FFT", "Image by means of a filter", "Taken from the dataset", "Results from the model", "Mesh of the stem", "From smith et al", "Figure generated. by the model", "", None]
    assert col(spark, rights.third_party_rights, credited + free) == [True] * len(credited) + [False] * len(free)
    assert col(spark, rights.reviewable_caption, ["Figure 3.", "see caption", "Graphical abstract", "Stress in the stem", " ", None]) == [False, False, False, True, False, False]


RECORD = "status string, provider string, image_url string, source_url string, license string, caption string, alt string, source_label string, media_type string, width int, height int"


def test_F45_records_are_closed_unless_all_fits(spark):
    base = dict(status="available", provider="pmc", image_url="https://pmc-oa-opendata.s3.amazonaws.com/a/f1.jpg", source_url="https://example.org/a", license="CC BY 4.0", caption="Mesh of the stem", alt="", source_label="", media_type="image/jpeg", width=100, height=100)
    svg = base | dict(provider="arxiv", image_url="https://arxiv.org/html/2401.00001v2/x1.svg", source_url="https://arxiv.org/abs/2401.00001v1", media_type="image/svg+xml")
    mdpi = base | dict(provider="mdpi", image_url="https://mdpi-res.com/d_attachment/metals/metals-14-00012/article_deploy/html/images/metals-14-00012-g001.png", source_url="https://www.mdpi.com/2075-4701/14/1/12", media_type="")
    cases = [
        (base, {}, True), (base, {"status": "blocked"}, False), (base, {"license": "CC BY-NC"}, False), (base, {"license": "cc0 1.0"}, True), (base, {"caption": "Figure 1"}, False), (base, {"alt": "Photo by NASA"}, False),
        (base, {"source_label": "© X"}, False), (base, {"image_url": "http://pmc-oa-opendata.s3.amazonaws.com/a/f1.jpg"}, False), (base, {"image_url": "https://evil.org/f1.jpg"}, False), (base, {"source_url": "https://u:p@example.org/a"}, False),
        (base, {"media_type": "image/png"}, False), (base, {"media_type": ""}, True), (base, {"width": None}, True), (base, {"provider": "arxiv", "caption": "Table 2: values"}, False), (base, {"caption": "Table 2: values"}, True),
        (svg, {}, True), (svg, {"source_url": "https://arxiv.org/abs/2401.00002"}, False), (svg, {"media_type": ""}, False), (svg, {"width": 10, "height": 10}, False), (svg, {"image_url": "https://export.arxiv.org/html/2401.00001v2/x1.svg"}, False),
        (svg, {"image_url": "https://arxiv.org/html/2401.00001v2/../x1.svg"}, False), (svg, {"caption": "Adopted from a source"}, False), (svg, {"image_url": "https://arxiv.org/html/2401.00001v2/x1.svg?a=1"}, False),
        (mdpi, {}, True), (mdpi, {"provider": "pmc"}, False), (mdpi, {"source_url": "https://www.mdpi.com/2075-4701/13/1/12"}, False), (mdpi, {"source_url": "https://www.mdpi.com/2076-3417/14/1/12"}, False), (mdpi, {"height": None}, False),
    ]
    df = spark.createDataFrame([(k, base | change) for k, (base, change, _) in enumerate(cases)], f"k int, r struct<{RECORD.replace(' string', ':string').replace(' int', ':int')}>")
    got = [r[1] for r in sorted(df.select("k", rights.safe_visual(F.col("r"))).collect())]
    assert [(cases[k][1], g) for k, g in enumerate(got)] == [(c[1], c[2]) for c in cases]


def test_F14_flatten_any_depth(spark):
    raw = ['{"a": {"b": ["x", {"c": "y \\"z\\" w:"}]}, "d": null}', '"plain"', "[1, 2.5, true, [[[[\"deep\"]]]]]", "{}", None]
    assert col(spark, lambda c: texts.flatten(F.parse_json(c)), raw) == ['x y "z" w:', "plain", "1 2.5 True deep", "", ""]


def test_D02_keys_fall_back(spark):
    rows = [("arxiv:1", "10.1/x", "s", "1", "arxiv:1"), ("", " https://doi.org/doi:10.1/X ", "s", "1", "doi:10.1/x"), (None, None, "pubmed", "7", "pubmed:7"), ("", "", None, None, ":")]
    df = spark.createDataFrame(rows, "c string, d string, s string, i string, want string")
    assert all(r.got == r.want for r in df.select("want", identity.dedup_key(F.col("c"), F.col("d"), F.col("s"), F.col("i")).alias("got")).collect())


def test_F24_record_has_the_thirty_columns(spark):
    df = spark.createDataFrame([("10.1/x", 2024, ["a"], None), (None, None, None, ("High", ["t"]))], "doi string, year int, authors array<string>, llm struct<priority:string,tags:array<string>>")
    out = search.export_record(df, F.lit("d"), F.lit("e"), "1")
    rows = sorted(out.collect(), key=lambda r: r.doi)
    assert out.columns == search.EXPORT and len(set(out.columns)) == 30
    assert rows[0].doi == "" and rows[0].priority == "High" and rows[0].tags == ["t"] and rows[0].authors == [] and rows[0].year is None
    assert rows[1].priority == "" and rows[1].tags == [] and rows[1].flags == {}


def test_S16_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.replace_atomically(spark, spark.range(n), path)
        assert spark.read.json(sinks.current(spark, path)).count() == n
    os.mkdir(tmp_path / "t" / "version-left-by-a-crash")
    assert spark.read.json(sinks.current(spark, path)).count() == 5
    sinks.replace_atomically(spark, spark.range(1), path)
    assert len([f for f in os.listdir(path) if f.startswith("version-")]) == 1


def test_T03_empty_streams_and_compaction(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    stream = lambda: spark.readStream.schema("k string, n int").json(str(tmp_path / "in"))
    run = lambda: {r.k: r.n for r in state.first_seen_stream(stream(), ["k"], ["n"], str(tmp_path / "state"), str(tmp_path / "check")).collect()}
    assert run() == {}
    want = {}
    for n in range(4):
        spark.createDataFrame([("a", 9 - n), (f"b{n}", n)], "k string, n int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        want |= {"a": 9 - n, f"b{n}": n}
        assert run() == want
    state.compact(spark, ["k"], str(tmp_path / "state"), 2)
    assert len([f for f in os.listdir(tmp_path / "state") if f.startswith("batch=")]) == 1 and run() == want


# --- catalogue --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df, sql = catalog.QUERIES[name](spark, SF), duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [(str(type(x)), str(x)) for x in r]
    assert sorted(map(tuple, df.select(*[f"`{n}`" for n in names]).collect()), key=key) == sorted(sql.fetchall(), key=key)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["year", "direction", "priority", "scorer_version", "n"]
