"""Keyed state, the archive sources, bucket merges, library sync, scoring at once, pages, trigram search,
positions and walks (T02, T03, T06, S12, S13, S22, J03, X01, O08, S21, Q01, Q02, S10, O09)."""

import datetime as dt
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators import paging, windows
from corpuscle.sources import archive, buckets
from corpuscle.streaming import keyed, state

# --- keyed state ------------------------------------------------------------------------------------


def feed(spark, tmp_path, name, schema):
    """A folder as a stream, and a way to add a file of rows to it."""
    folder = tmp_path / name
    folder.mkdir()

    def add(*rows):
        path = folder / f"{len(os.listdir(folder)):04d}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + len(os.listdir(folder)),) * 2)

    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), add


def test_first_row_of_each_key_survives_restarts(spark, tmp_path):
    stream, add = feed(spark, tmp_path, "in", "key string, day string, title string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: keyed.run_available(keyed.first_seen(stream, ["key"], ["day", "title"]), out, checkpoint)
    got = lambda: sorted((r.key, r.day, r.title) for r in keyed.held(spark, out, stream.schema).collect())
    add({"key": "a", "day": "2024-01-02", "title": "x"}, {"key": "a", "day": "2024-01-01", "title": "w"}, {"key": "b", "day": "2024-01-05", "title": "y"})
    run()
    assert got() == [("a", "2024-01-01", "w"), ("b", "2024-01-05", "y")]
    add({"key": "a", "day": "2020-01-01", "title": "late"}, {"key": "c", "day": "2019-01-01", "title": "late too"})
    add({"key": "c", "day": "2018-01-01", "title": "later"})
    run()  # a new query on the same checkpoint
    run()  # nothing new
    assert got() == [("a", "2024-01-01", "w"), ("b", "2024-01-05", "y"), ("c", "2019-01-01", "late too")]


def test_cached_record_is_kept_on_errors_and_refreshed_after_its_days(spark, tmp_path):
    stream, add = feed(spark, tmp_path, "in", "key string, status string, body string, checked_at timestamp, error string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def run(*rows):
        add(*rows)
        keyed.run_available(keyed.cached_records(stream), out, checkpoint)
        return sorted((r.key, r.event, r.status or "", r.body or "", r.error or "") for r in keyed.held(spark, out, T.StructType.fromDDL(keyed.CACHE)).collect())

    row = lambda key, status, body, day, error=None: {"key": key, "status": status, "body": body, "checked_at": f"{day}T00:00:00.000Z", "error": error}
    first = [("a", "updated", "available", "v1", ""), ("n", "updated", "not_found", "", "")]
    assert run(row("a", "available", "v1", "2024-01-01"), row("n", "not_found", None, "2024-01-01")) == first
    second = sorted([*first, ("a", "kept", "available", "v1", "timeout"), ("f", "failed", "", "", "timeout")])
    assert run(row("a", "error", None, "2024-01-03", "timeout"), row("f", "error", None, "2024-01-03", "timeout")) == second
    assert run(row("a", "available", "old", "2023-12-01")) == second  # older than what is held
    third = run(row("z", "available", "z", "2024-02-20"))  # time goes on past the days of a miss and a failure
    third = run(row("z", "available", "z2", "2024-02-21"))
    assert [r for r in third if r[1] == "refresh"] == [("a", "refresh", "available", "v1", ""), ("f", "refresh", "", "", ""), ("n", "refresh", "not_found", "", "")]


# --- archive ----------------------------------------------------------------------------------------


def write_days(folder, days):
    for day, body in days.items():
        (folder / f"{day}.json").write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))


DAYS = {"2024-01-31": {"papers": [{"id": "a"}, {"id": "é"}]}, "2024-02-01": [{"id": "c"}, 7, {"id": "d"}], "2024-02-02": "{broken", "2024-02-03": '{"papers": 3}', "2024-03-01": {"papers": []}, "2024-03-02": "﻿" + json.dumps([{"id": "z"}])}


def test_range_prunes_files_before_they_are_read(spark, tmp_path):
    write_days(tmp_path, DAYS)
    (tmp_path / "notes.json").write_text("{}")
    all_ = archive.read_archive(spark, str(tmp_path))
    month = all_.filter("bucket_date >= '2024-02-01' and bucket_date <= '2024-02-29'")
    assert (all_.rdd.getNumPartitions(), month.rdd.getNumPartitions(), all_.filter("bucket_date = '2024-03-02'").rdd.getNumPartitions()) == (6, 3, 1)
    assert sorted((r.bucket_date, r.position if r.position is not None else -1, r.corrupt) for r in month.collect()) == [("2024-02-01", 0, False), ("2024-02-01", 2, False), ("2024-02-02", -1, True), ("2024-02-03", -1, True)]
    assert sorted((r.bucket_date, r.position, r.id) for r in archive.papers(all_, "id string").collect()) == [("2024-01-31", 0, "a"), ("2024-01-31", 1, "é"), ("2024-02-01", 0, "c"), ("2024-02-01", 2, "d"), ("2024-03-02", 0, "z")]
    assert all_.filter("bucket_date > '2025'").count() == 0


def test_archive_stream_stops_and_goes_on_in_mid_archive(spark, tmp_path):
    folder, out = tmp_path / "days", str(tmp_path / "out")
    folder.mkdir()
    write_days(folder, {k: DAYS[k] for k in list(DAYS)[:3]})
    sizes = []

    def note(batch, number):
        batch.write.mode("overwrite").json(f"{out}/batch={number}")  # a batch that runs again overwrites itself
        sizes.append(sorted({r.bucket_date for r in batch.collect()}))

    def run(n):
        query = archive.stream_archive(spark, f"file://{folder}").writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "ck")).start()
        until = time.time() + 60
        while len({s[0] for s in sizes if s}) < n and time.time() < until:
            time.sleep(0.2)
        query.stop()

    run(2)
    seen = [s[0] for s in sizes if s]
    assert seen[:2] == ["2024-01-31", "2024-02-01"] and all(len(s) <= 1 for s in sizes)
    sizes[:] = [[d] for d in dict.fromkeys(seen)]
    write_days(folder, {k: DAYS[k] for k in list(DAYS)[3:]})
    run(5)  # an empty bucket gives no row
    rows = spark.read.json(out).collect()
    assert sorted({r.bucket_date for r in rows if r.corrupt}) == ["2024-02-02", "2024-02-03"]
    assert sorted(r.body for r in rows if not r.corrupt) == sorted(['{"id": "a"}', '{"id": "é"}', '{"id": "c"}', '{"id": "d"}', '{"id": "z"}'])


# --- buckets ----------------------------------------------------------------------------------------

PAPERS = "bucket_date string, key string, title string, priority string"


def test_late_rows_land_in_their_bucket_and_no_other_changes(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    of = lambda *rows: spark.createDataFrame(rows, PAPERS)
    put = lambda df: buckets.merge(spark, root, df, "bucket_date", ["key"], ["title"], "priority")
    first = {r.bucket: r for r in put(of(("2024-01-01", "a", "t", "High"), ("2024-01-01", "b", "t", None), ("2024-01-02", "a", "t", "Low"), ("2024-01-03", "", "free", "Low"))).collect()}
    assert {k: (r.n_rows, r.counts) for k, r in first.items()} == {"2024-01-01": (2, {"High": 1, "": 1}), "2024-01-02": (1, {"Low": 1}), "2024-01-03": (1, {"Low": 1})}
    late = of(("2024-01-01", "a", "other", "Low"), ("2024-01-01", "c", "z", "High"), ("2024-01-01", "c", "y", "Low"), (None, "x", "x", "x"), ("no day", "x", "x", "x"))
    then = {r.bucket: r for r in put(late).collect()}
    assert {k for k in first if first[k].folder != then[k].folder} == {"2024-01-01"}
    assert then["2024-01-01"].counts == {"High": 1, "": 1, "Low": 1} and then["2024-01-01"].n_rows == 3
    held = lambda: sorted(map(tuple, buckets.read(spark, root, late.schema).select("bucket_date", "key", "title").collect()))
    was = held()
    assert was == [("2024-01-01", "a", "t"), ("2024-01-01", "b", "t"), ("2024-01-01", "c", "y"), ("2024-01-02", "a", "t"), ("2024-01-03", "", "free")]
    put(late)
    assert held() == was
    assert {r.bucket for r in put(of()).collect()} == set(first)
    only = buckets.read(spark, root, late.schema, F.col("bucket") == "2024-01-02")
    assert [r.key for r in only.collect()] == ["a"] and all("2024-01-02" in f for f in only.inputFiles())


def test_a_merge_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    good = spark.createDataFrame([("2024-01-01", "a", "t", "High")], PAPERS)
    buckets.merge(spark, root, good, "bucket_date", ["key"], ["title"], "priority")
    bad = spark.createDataFrame([("2024-01-01", "b", "t", "x")], PAPERS).withColumn("title", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        buckets.merge(spark, root, bad.withColumn("title", F.col("title").cast("string")), "bucket_date", ["key"], ["title"], "priority")
    assert [r.key for r in buckets.read(spark, root, good.schema).collect()] == ["a"]


def test_a_repair_touches_wrong_counts_only(spark, tmp_path):
    from corpuscle.sources.sinks import replace_atomically

    root = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([("2024-01-01", "a", "t", "High"), ("2024-01-01", "b", "t", None), ("2024-01-02", "a", "t", "Low"), ("2024-01-03", "a", "t", "Low")], PAPERS)
    buckets.merge(spark, root, rows, "bucket_date", ["key"], ["title"], "priority")
    check = lambda **kw: buckets.recount(spark, root, rows.schema, "bucket_date", "priority", **kw).collect()
    assert check() == []
    was = buckets.manifest(spark, root)
    wrong = was.withColumn("counts", F.when(F.col("bucket") == "2024-01-01", F.create_map(F.lit("High"), F.lit(2).cast("long"))).otherwise(F.col("counts"))).withColumn("n_rows", F.when(F.col("bucket") == "2024-01-02", 9).otherwise(F.col("n_rows")))
    replace_atomically(spark, wrong, f"{root}/manifest")
    found = {r.bucket: (r.n_rows, r.counts, r.expected_rows, r.expected) for r in check()}
    assert found == {"2024-01-01": (2, {"High": 2}, 2, {"High": 1, "": 1}), "2024-01-02": (9, {"Low": 1}, 1, {"Low": 1})}
    assert len(check(apply=True)) == 2 and check() == []
    assert {r.bucket: r.n_rows for r in buckets.manifest(spark, root).collect()} == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1}


# --- library sync -----------------------------------------------------------------------------------


def test_every_item_is_accounted_for_and_none_created_twice(spark, tmp_path):
    shelf, log = str(tmp_path / "shelf"), str(tmp_path / "log")
    os.makedirs(shelf)

    def existing(keys):
        return {k for k in keys if os.path.exists(f"{shelf}/{k}")}

    def create(items):
        for k in (i["key"] for i in items):
            if k.startswith("bad") and not os.path.exists(f"{shelf}/mended"):
                raise OSError("down")
            with open(f"{shelf}/{k}", "x"):  # fails if it is there
                pass
        return ["created"] * len(items)

    items = spark.createDataFrame([(f"k{i:03d}", i) for i in range(120)] + [("bad1", 1), ("k999", 2)], "key string, n int").coalesce(1)
    with pytest.raises(Exception, match="down"):
        archive.sync_library(items, log, existing, create, 20)
    first = {r.key: r.outcome for r in archive.outcomes(spark, log).collect()}
    assert len(first) == 122 and first["k000"] == "created" and first["bad1"] == "unknown" == first["k999"]
    open(f"{shelf}/mended", "w").close()
    archive.sync_library(items, log, existing, create, 20)
    then = {r.key: r.outcome for r in archive.outcomes(spark, log).collect()}
    assert set(then.values()) == {"created"} and len(then) == 122
    marks = [f for _, _, names in os.walk(log) for f in names if f.isupper()]
    assert sorted(marks) == ["ABORTED", "COMMITTED"]


# --- scoring ----------------------------------------------------------------------------------------


def test_eight_calls_in_flight_and_order_kept(spark, tmp_path):
    seen = str(tmp_path)

    def call(row, strict):
        with open(f"{seen}/{row['key']}-{time.time():.4f}-in", "w"):
            pass
        time.sleep(0.15 + (int(row["key"]) % 5) * 0.02)
        with open(f"{seen}/{row['key']}-{time.time():.4f}-out", "w"):
            pass
        if row["key"] == "13":
            raise ValueError("no JSON")
        return {"priority": f"p{row['key']}"}

    df = spark.createDataFrame([(f"{i}",) for i in range(32)], "key string").coalesce(1)
    began = time.time()
    got = state.score_at_once(df, call, tries=2).collect()
    assert [r.key for r in got] == [str(i) for i in range(32)] and time.time() - began < 12
    assert [r.priority for r in got if r.key != "13"] == [f"p{i}" for i in range(32) if i != 13]
    assert (got[13].scorer_failed_reason, got[13].scorer_failed_attempts) == ("ValueError: no JSON", 2)
    moves = sorted((float(f.split("-")[1]), f.endswith("-in")) for f in os.listdir(seen))
    at, most = 0, 0
    for _, begins in moves:
        at += 1 if begins else -1
        most = max(most, at)
    assert most == 8


def test_no_call_begins_after_a_refusal(spark, tmp_path):
    seen = str(tmp_path)

    def call(row, strict):
        open(f"{seen}/{row['key']}", "w").close()
        if int(row["key"]) == 5:
            raise state.BudgetExhausted
        time.sleep(0.3)
        return {"priority": "High"}

    got = state.score_at_once(spark.createDataFrame([(f"{i}",) for i in range(1200)], "key string").coalesce(1), call).collect()
    made = {int(f) for f in os.listdir(seen)}
    assert made <= set(range(8)) and len(got) == 1200
    assert all(r.scorer_failed_reason == "budget_exhausted" for r in got if int(r.key) >= 8 or int(r.key) == 5)
    assert {r.priority for r in got if int(r.key) in made - {5}} == {"High"}
    assert threading.active_count() < 50


# --- pages and search -------------------------------------------------------------------------------


def test_page_is_one_shard_and_keys_lead_on(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "queue")
    rows = [(f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"t{rng.randint(0, 30)}", f"k{i:04d}", rng.choice(["High", "Low", None]), rng.choice(["d1", "d2"])) for i in range(1003)]
    df = spark.createDataFrame(rows, "date string, title string, key string, priority string, direction string")
    paging.write_queue(df, path, ["priority", "direction"], 5, 7)
    want = sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: (r[0], r[1]), reverse=True)
    want = [r[2] for r in sorted(want, key=lambda r: (r[0], r[1], [-ord(c) for c in r[2]]), reverse=True)]
    for number in (1, 2, 36, 200, 201, 202):
        got = paging.page(spark, path, number, 7)
        assert [r.key for r in got.collect()] == want[5 * (number - 1) : 5 * number]
    plan = paging.page(spark, path, 200, 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert [tuple(r) for r in paging.page_after(spark, path, want[9]).collect()] == [(3, 5)] and [r.n for r in paging.page_after(spark, path, want[999]).collect()] == [3]
    assert paging.totals(spark, path, priority="High").first()[0] == sum(r[3] == "High" for r in rows) and paging.totals(spark, path).first()[0] == 1003
    assert paging.totals(spark, path, priority="Never").first()[0] == 0


def test_trigram_search_finds_what_a_scan_finds(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "index")
    words = ["finite", "element", "mesh", "net", "émesh", "o.net", "finit", "100%", "a_b"]
    rows = [(f"k{i}", 2020 + i % 3, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(["High", "Low"])) for i in range(400)] + [("n", 2021, None, "Low"), (None, 2021, "mesh", "Low")]
    df = spark.createDataFrame(rows, "key string, year int, blob string, priority string")
    paging.write_index(df, path, shards=4)
    for query, years, facets in [("mesh", None, {}), ("Finite Element", None, {}), ("inite e", [2021], {}), ("é", None, {}), ("", [2020], {}), ("net mesh", [2020, 2022], {"priority": "High"}), ("100%", None, {}), ("a_b", None, {}), ("absent", None, {}), ("t e", None, {})]:
        want = sorted(r[0] for r in rows if r[0] and query.lower() in (r[2] or "") and (r[2] is not None or not query) and (not years or r[1] in years) and (not facets or r[3] == "High"))
        got = paging.search_index(spark, path, query, years, shards=4, **facets)
        assert sorted(r.key for r in got.collect()) == want, query
    plan = paging.search_index(spark, path, "mesh", [2021], shards=4)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "").replace("[In(gram", "[In(gram") or "In(gram" in plan


# --- positions and walks ----------------------------------------------------------------------------


def test_positions_by_a_two_level_index(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{rng.choice([0, 0, 0, 1, 2])}", f"2024-01-{rng.randint(1, 28):02d}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "journal string, date string, id int")
    cut, _ = windows.position_index(df, "journal", ["date", "id"], 6)
    cut.write.parquet(str(tmp_path / "rows"))
    cut = spark.read.parquet(str(tmp_path / "rows"))
    index = cut.groupBy("journal", "_part").agg(F.count("*").alias("n"))
    want = {}
    for j in ("j0", "j1", "j2"):
        for k, r in enumerate(sorted(r for r in rows if r[0] == j), 1):
            want[j, k] = r[2]
    assert {(r.journal, r.position): r.id for r in windows.with_positions(cut, index, "journal", ["date", "id"]).collect()} == want
    asked = [("j0", 1), ("j0", 333), ("j1", 2), ("j2", 10_000), ("j0", 0), ("none", 1)]
    got = windows.works_at(cut, index, "journal", ["date", "id"], spark.createDataFrame(asked, "journal string, position long")).collect()
    assert {(r.journal, r.position): r.id for r in got} == {k: want[k] for k in asked[:3]}


def journal(spark, **sizes):
    return spark.createDataFrame([(j, p, f"{j}-{p}") for j, n in sizes.items() for p in range(1, n + 1)], "journal string, position long, key string")


def test_top_up_walks_on_in_the_same_order(spark):
    df = journal(spark, S1=60, S2=300, S3=3)
    draw = lambda known=(), have=(), **kw: windows.walk(df, "journal", "key", "2026-09-25", spark.createDataFrame([(k,) for k in known], "key string"), spark.createDataFrame(list(have), "journal string, k int"), **kw)
    keys = lambda picks, j: [r.key for r in sorted(picks.collect(), key=lambda r: r.nth) if r.journal == j]
    picks, report = draw()
    first = keys(picks, "S1")
    assert [len(keys(picks, j)) for j in ("S1", "S2", "S3")] == [5, 2, 3]
    by = {r.journal: r for r in report.collect()}
    assert (by["S2"].month_works, by["S2"].target_picks, by["S2"].skipped_known, by["S2"].truncated_pool) == (300, 2, 0, False) and [f"S1-{p}" for p in by["S1"].positions] == first
    full, _ = draw(first, [("S1", 5)])
    assert keys(full, "S1") == []
    more, report = draw(first, [("S1", 2)])
    assert len(keys(more, "S1")) == 3 and not set(keys(more, "S1")) & set(first)
    assert {r.journal: r.skipped_known for r in report.collect()}["S1"] == 5
    whole, _ = draw(have=[], many=8)
    assert keys(whole, "S1")[:5] == first and keys(whole, "S1")[5:] == keys(draw(first, [], many=8)[0], "S1")[:3]
    lost, report = draw([f"S1-{p}" for p in range(1, 61)])
    assert keys(lost, "S1") == [] and {r.journal: r.skipped_known for r in report.collect()}["S1"] == 15  # target and headroom
    _, report = draw(cap=50)
    assert {r.journal: (r.truncated_pool, max(r.positions) <= 50) for r in report.collect()} == {"S1": (True, True), "S2": (True, True), "S3": (False, True)}
    assert dt.date(2026, 9, 25).isoformat() == "2026-09-25"
