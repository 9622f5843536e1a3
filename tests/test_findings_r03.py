"""Queries of the round's findings on odd and shifted keys, each against its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import figures, rights
from corpuscle.llm import line_dedup
from corpuscle.operators import paging
from corpuscle.plans import catalog, features  # noqa: F401
from corpuscle.runtime import Scratch
from corpuscle.streaming import keyed
from tests.conftest import rows


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name, **tables):
        c = duckdb.connect()
        for table, sql in tables.items():
            c.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        return rows(catalog.QUERIES[name](spark, str(tmp_path))), sorted(c.execute(catalog.ORACLE_SQL[name]).fetchall(), key=str)

    return run


EVENTS = "SELECT (k * 37 + 99990)::BIGINT AS event_id, (k % 7)::BIGINT AS user_id, CASE WHEN k % 2 = 0 THEN 'view' ELSE 'click' END AS event_type, TIMESTAMP '2024-01-01' + INTERVAL (k) HOUR AS ts FROM range(300) r(k)"


def test_feed_rows_keep_event_ids_of_more_than_five_digits(against_sql):
    got, want = against_sql("feed_rows", events=EVENTS)
    assert got == want and max(r[0] for r in got) > 100_000


def test_trigram_postings_are_packed_and_whole(spark, tmp_path, monkeypatch):
    """Far fewer rows than postings, every one of them once; texts of many characters, other planes, none."""
    texts = [f"the mesh {k} of the net" for k in range(400)] + ["", "ab", "x\n😀é中", None, "".join(map(chr, range(0x4E00, 0x9000)))]
    df = spark.createDataFrame([(f"k{k}", 2020 + k % 2, t) for k, t in enumerate(texts)], "key string, year int, blob string")
    paging.write_index(df, str(tmp_path), shards=2)
    posts = spark.read.parquet(f"{tmp_path}/postings")
    got = rows(posts.select("year", "gram", F.explode("keys").alias("key")))
    assert got == sorted({(2020 + k % 2, t[j : j + 3], f"k{k}") for k, t in enumerate(texts) if t for j in range(len(t) - 2)}, key=str)
    assert posts.filter("gram = 'the'").count() < 40
    assert rows(paging.search_index(spark, str(tmp_path), "\n😀É").select("key")) == [("k402",)]


def test_trigram_search_finds_rows_that_share_a_key(spark, tmp_path):
    df = spark.createDataFrame([("k", 2020, "mesh of one"), ("k", 2020, "mesh of two"), ("l", 2020, "net")], "key string, year int, blob string")
    paging.write_index(df, str(tmp_path), shards=2)
    assert paging.search_index(spark, str(tmp_path), "mesh of").count() == 2


def test_packing_together_or_one_by_one_gives_the_same_postings():
    texts = ["".join(chr(0x100 + (7 * k + j) % 3000) for j in range(2000)) for k in range(3)]
    held = lambda packs: {(g, int(t)) for grams, ends, text in packs for g, own in zip(grams, np.split(text, ends[:-1]), strict=True) for t in own}
    want = {(t[j : j + 3], k) for k, t in enumerate(texts) for j in range(len(t) - 2)}
    assert held(paging._packed(texts)) == want == held([p for k, t in enumerate(texts) for p in paging._packed([t], k)])


def test_a_task_passes_one_row_of_each_key_to_the_state(spark, monkeypatch):
    """Whatever the size of Arrow's batches; null keys are one key."""
    df = spark.range(6000).coalesce(1).selectExpr("nullif(id % 7, 3) AS k", "6000 - id AS n", "'x' AS other")
    assert rows(keyed.slim(df, ["k"], ["n"])) == rows(df.groupBy("k").agg(F.min("n").alias("n"), F.first("other")))
    run = keyed._local_first(["k"], ["n"])
    monkeypatch.setattr(keyed, "CHUNK", 50)
    monkeypatch.setattr(keyed, "HELD", 500)
    batches = [pa.record_batch({"k": list(range(j // 2 % 3, 900, 3)), "n": [j] * 300}) for j in range(27)]
    got = [(r["k"], r["n"]) for b in run(iter(batches)) for r in b.to_pylist()]
    assert {k: min(n for x, n in got if x == k) for k, _ in got} == {k: k % 3 * 2 for k in range(900)} and 900 < len(got) < 8100


def test_figures_are_judged_by_expressions_written_once(spark):
    """Within lambdas nothing is shared, so what is written twice is worked out twice."""
    df = spark.createDataFrame([("a", "b")], "html string, url string")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert plan(df.select(rights.third_party_rights(F.col("html")))).count("regexp_replace(") <= 2  # the second in the column's name
    assert plan(figures.select_html(df, "html", "url")).count("try_url_decode(") <= 20


def test_lines_to_verify_are_read_without_shuffling_whole_texts(spark, tmp_path):
    """Whatever their number: only the marked lines, and few others, leave the tasks that read texts."""
    texts = ["\n".join(f"Doc  {k}, LINE\t{j} é" for j in range(50)) for k in range(40)] + [None, "", "\n\n-"]
    df = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    places = line_dedup.lines(df).filter("line_no >= 0").select("doc_id", "rid", "line_no", "lid", "lid2", "fp")
    nodes = places.filter("line_no % 10 = 3").select("lid").distinct()
    got = line_dedup._texts(df, places, nodes, Scratch(spark, "t"))
    assert sorted(r.norm for r in got.collect()) == sorted(f"doc {k} line {j} é" for k in range(40) for j in range(3, 50, 10))
    need = nodes.join(places, "lid").select("rid", "line_no")
    for bits in (12, 24):  # one segment, sixteen
        marks = line_dedup._marked(need, bits)
        assert len(marks) == 1 << bits - 3 and 150 < int(np.bitwise_count(marks).sum()) <= 200
        read = line_dedup._read_again(df, bits, spark.sparkContext.broadcast(marks))
        assert 200 <= read.count() < 500 and read.join(need, ["rid", "line_no"]).count() == 200
    exchanged = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert exchanged and not any("text" in x for x in exchanged)
