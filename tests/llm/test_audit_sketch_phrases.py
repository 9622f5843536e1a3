"""Operators 11 to 13 against brute force, and their defined results for odd input."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bpe, collocations, filter_audit, setsketch_dedup
from tests.llm.test_llm import DOCS, clashing, docs_of, empty, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


# --- filter audit -----------------------------------------------------------------------------------


def audited(rows, labels):
    """Plain version: rows (doc_id, text, part), labels {doc_id: (quality, toxic)}."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    flags = []
    for d, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        flags.append((p or "", f, *labels.get(d, (0, 0))))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                before = [f for f in own if all(f is not x for x in left)]
                left = [f for f in left if not f[1][name]]
                total[name] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(f[1][name] for f in before), sum(f[1][name] and sum(f[1].values()) == 1 for f in own), sum(f[2] == 1 for f in gone), sum(f[3] == 1 for f in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_plain_replay(spark):
    rng = random.Random(3)
    plain = " ".join(f"word{i % 150}" for i in range(220))
    texts = [plain, plain + " #", plain.upper(), "a b c", "", None, "A B & c", "same " * 300, "Same " * 300 + "|"]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(None, plain, "en"), (None, plain, "en"), (3, rows[3][1], rows[3][2])]
    labels = {k: (rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)}
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = filter_audit.audit(docs, spark.createDataFrame([(k, *v) for k, v in labels.items()], LABELS))
    want = audited(rows, labels)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 600 * 3


def test_audit_of_odd_rows_and_none(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1)], LABELS)
    got = filter_audit.audit(clashing(odd_docs(spark)), labels).collect()
    by = collections.defaultdict(int)
    for r in got:
        if r.step == 1 and r.filter_order.startswith("E"):
            by[r.part] = r.removed
        assert r.kept >= 0 and r.shapley >= r.removed
    assert by["en"] == 0 and by[""] == 1  # doc 3 is empty as doc 2 is; rows without an id are no copies
    assert filter_audit.audit(empty(spark), labels).count() == 0
    assert filter_audit.audit(odd_docs(spark), spark.createDataFrame([], LABELS)).filter("good_lost > 0 or toxic_lost > 0").count() == 0


# --- SetSketch --------------------------------------------------------------------------------------


def shingled(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def grouped(rows):
    """Plain version: {(doc_id, n, component)} of rows (doc_id, text) with distinct ids."""
    own = [(d, shingled(t)) for d, t in rows]
    root = {d: d for d, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(own, 2):
        both = len(s & t)
        if both and 100 * both >= 85 * (len(s) + len(t) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in own}


def edited(rng, words, share):
    return [rng.choice(["left", "right", "up"]) if rng.random() < share else w for w in words]


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(8)
    rows, words = [], [f"w{k}" for k in range(3000)]
    for group in range(40):
        base = rng.choices(words, k=rng.choice([5, 8, 20, 60, 200, 600]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.1]))))
    rows += ["", None, "one", "ONE", "one two", "One  two", "one two three", "\t \n"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = clashing(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS))
    got = setsketch_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == grouped(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "SPLIT", 8)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = list(enumerate(" ".join(edited(rng, base, 0.02)) for _ in range(150)))
    got = setsketch_dedup.near_duplicates(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == grouped(rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 62, 4000).astype(np.uint64), rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    one, two = setsketch_dedup.registers(a), setsketch_dedup.registers(b)
    assert (setsketch_dedup.merge(one, two) == setsketch_dedup.registers(np.concatenate([a, b]))).all()
    assert (setsketch_dedup.registers(b[:0]) == 0).all()
    off = []
    for share in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        for _ in range(15):
            x = rng.integers(0, 1 << 62, 700).astype(np.uint64)
            k = int(700 * share)
            y = np.concatenate([x[:k], rng.integers(0, 1 << 62, 500 - min(k, 500)).astype(np.uint64)])
            true = k / (700 + len(y) - k)
            p, q = setsketch_dedup.registers(x), setsketch_dedup.registers(y)
            got = setsketch_dedup.estimate(np.array([(p > q).sum()]), np.array([(p < q).sum()]), np.array([700]), np.array([len(y)]))[0]
            off.append(got - true)
            assert abs(got - true) < 0.13
    assert abs(float(np.mean(off))) < 0.01


def test_bucket_skips_what_is_connected():
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    own = [setsketch_dedup.shingles(" ".join(edited(rng, base, 0.003))) for _ in range(60)]
    own = [s for k, s in enumerate(own) if all(len(s) != len(t) or (s != t).any() for t in own[:k])]
    sketch = np.stack([setsketch_dedup.registers(s) for s in own])
    n, sets, counts = np.array(list(map(len, own))), [s.tobytes() for s in own], {}
    every = np.full(len(own), -1)
    found = setsketch_dedup.bucket_links(0, np.arange(len(own)), n, sketch, every, sets, counts=counts)
    first = (sketch[:, None, :6] == sketch[None, :, :6]).all(axis=2)
    assert len(found) < len(own) and counts["verified"] < first.sum() / 4
    assert setsketch_dedup.bucket_links(0, np.zeros(len(own), np.int64), n, sketch, every, sets) == []
    assert setsketch_dedup.bucket_links(0, np.arange(len(own)), n, sketch, every * 0, sets) == []
    partners = setsketch_dedup.bucket_partners(0, np.arange(len(own)), n, sketch, every)
    assert all(partners[i] and partners[j] for i, j in found)


def test_sets_of_long_texts_run_on_between_parts(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choices("abcdefgh", k=3000)) + "\n\tend"
    whole = setsketch_dedup.shingles(text)
    monkeypatch.setattr(bpe, "SLICE", 37)
    assert (setsketch_dedup.shingles(text) == whole).all() and len(whole) == len(shingled(text))


def test_near_duplicates_of_odd_rows_and_none(spark):
    got = setsketch_dedup.near_duplicates(clashing(odd_docs(spark))).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].component_id == 2 and by[5].n_shingles == 3
    assert by[8].n_shingles == 1 and by[1].kept and sum(r.doc_id == 1 for r in got) == 2
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert setsketch_dedup.near_duplicates(empty(spark)).count() == 0


def test_row_without_id_is_no_component(spark):
    t = "a b c d e f g h i j"
    got = setsketch_dedup.near_duplicates(spark.createDataFrame([(None, t), (7, t), (None, "x y z"), (9, t + " k")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 7, False), (7, 7, True), (9, 7, False)]


# --- collocations -----------------------------------------------------------------------------------


def mined(rows, least, top):
    """Plain version: rows (text, part)."""
    counts, total = collections.Counter(), collections.Counter()
    for t, p in rows:
        p = "und" if p is None else p
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[p] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        counts[p, tuple(w[i : i + k])] += 1
    out = []
    for part in total:
        cand = {w: n for (p, w), n in counts.items() if p == part and len(w) > 1 and n >= least}
        found = []
        for w, a in cand.items():
            if any(len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x))) and 100 * f >= 80 * a for x, f in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[part, w[:k]] + counts[part, w[k:]]), k, counts[part, w[:k]], counts[part, w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(part, k, ph.decode(), -a, left, right, total[part], -s) for k, (s, a, ph, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(seed=2, n=250):
    rng = random.Random(seed)
    words = ["The", "of", "é", "中", "x\x01", "x", "\x00", "big", "cat", "sat", "on", "mat", "zz", "New", "york", "city"]
    text = lambda: "".join(rng.choice(["new york City", "the cat sat on", *words]) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "!", "  ", " the "]) for _ in range(rng.randint(0, 60)))
    return [(text(), rng.choice(["en", "de", None])) for _ in range(n)] + [(None, "en"), ("", None), ("...", "fr")]


@pytest.mark.parametrize("hot", [512, 4])
def test_collocations_equal_plain_counts(spark, monkeypatch, hot):
    """With few hot beginnings, and with so many that most first words are dealt out further."""
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "SPREAD", 1)
    monkeypatch.setattr(collocations, "SHARE", 2)
    rows = phrase_rows()
    docs = clashing(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string"))
    for least, top in ((30, 2000), (5, 12)):
        got = collocations.collocations(docs, least=least, top=top)
        want = mined(rows, least, top)
        assert sorted(map(tuple, got.select("part", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want and len(want) > 10


def test_beginnings_and_partial_counts():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 6, (4000, 4))
    for k in (1, 2, 3):
        rows[rng.random(4000) < 0.2, k:] = 0
    found, n = collocations.unique(rows)
    want = collections.Counter(tuple(r[:k]) for r in rows.tolist() for k in range(1, 5) if r[k - 1])
    assert int(n.sum()) == 4000 and found.tolist() == sorted(found.tolist(), reverse=True)
    for depth in (1, 3):
        assert {tuple(s): t for s, _, t in collocations.beginnings(found, n, depth, 20)} == {s: t for s, t in want.items() if t >= 20 or len(s) < depth}


@pytest.mark.parametrize("held", [1_000_000, 7])
def test_words_run_on_between_parts(spark, monkeypatch, held):
    """Texts cut into parts of a few bytes, and runs let go in mid-text."""
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "bb", "ccc"]) + rng.choice([" ", "  ", " ", "\t", ". ", "\n"]) for _ in range(2000))
    whole = [w for some in collocations.numbered(text) for w in some]
    monkeypatch.setattr(bpe, "SLICE", 11)
    monkeypatch.setattr(collocations, "HELD", held)
    assert [w for some in collocations.numbered(text) for w in some] == whole and sum(w != b"\n" for w in whole) == len(re.findall("[a-c]+", text))

    class Here:  # the function of each task, run here
        def mapInArrow(self, run, schema):
            return run

    docs = type("Docs", (), {"sparkSession": spark, "select": lambda self, *c: Here()})()
    run, text2 = collocations.summed(docs, frozenset(), 5), "bb a. " * 30
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([text, text2, None])], names=["part", "text"])
    found, want = collections.Counter(), collections.Counter()
    for b in run(iter([batch])):
        names = [b"", *b.column(3)[0].as_py().split(b"\n")]
        rows, n = np.frombuffer(b.column(4)[0].as_py(), np.uint32).reshape(-1, 4), np.frombuffer(b.column(5)[0].as_py(), np.int64)
        for r, c in zip(rows.tolist(), n.tolist()):
            found[b.column(1)[0].as_py(), tuple(names[i] for i in r if i)] += c
    for part, t in (("en", text), ("de", text2)):
        for piece in re.split(r"[.\n]", t):
            w = piece.encode().split()
            want.update((part, tuple(w[i : i + 4])) for i in range(len(w)))
    assert found == want


def test_collocations_of_odd_rows_and_none(spark):
    got = collocations.collocations(clashing(odd_docs(spark))).collect()
    assert {(r.phrase, r.a) for r in got if r.part == "en"} == {("lorem ipsum dolor lorem", 39999), ("ipsum dolor lorem ipsum", 39999), ("dolor lorem ipsum dolor", 39999)}
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs_of(spark, ["a b c"])).count() == 0
    assert sorted((r.phrase, r.part) for r in collocations.collocations(spark.createDataFrame([(k, "a b", None if k % 2 else "und") for k in range(30)], "doc_id long, text string, lang string")).collect()) == [("a b", "und")]
