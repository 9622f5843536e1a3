"""Operators of llm against brute force, and their defined results for odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bpe, components, cotrain, edit, exact_topk, hamming, license_scan, line_dedup, mixing, queries, robust_outliers, simhash_dedup, token_counts, toxicity
from corpuscle.runtime import Scratch

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ["fp", "rid", "_rid", "size", "score", "n_words", "bucket", "component_id", "_copy", "_gone", "__own0", "taken", "predicted", "ids", "lid", "_w", "kept", "made", "y", "url", "content", "metadata", "free", "_doc", "first", "u", "m0", "_lang"]


def odd_docs(spark):
    long = "Lorem ipsum dolor " * 40_000
    data = [
        (1, "alpha beta gamma delta epsilon\nzeta eta theta iota kappa", "en", "a", 55), (1, "alpha beta gamma delta epsilon\nzeta eta theta iota kappa", "en", "a", 55),
        (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t \n", "fr", "b", 7), (None, "no id here", "en", None, 10), (None, None, None, None, None),
        (5, long, "en", "c", len(long)), (6, "Alpha, beta gamma delta epsilon!\nother line", "de", "b", 40), (7, "é中文 MIT License 😀", "es", "a", 20), (8, "x", "en", "a", 1),
    ]
    return spark.createDataFrame(data, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- byte-level BPE ---------------------------------------------------------------------------------


def test_bpe_equals_library_and_round_trips():
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.codec(BYTES, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\t", "'s", "'", "é", "中", "12", "!", "\x1c", "\x85", "\xa0", "😀", "́", "<|endoftext|>", "thntblere"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = own.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(s)
        assert own.decode(ids).decode() == s


def test_bpe_classes_letters_of_newer_unicode_as_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.codec(BYTES, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    every = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    newer = [c for c in every if bpe.NEWER.match(chr(c))]
    for c in [0x11DC7, 0x12476, 0x18D8A, *rng.sample(newer, 3000), *rng.sample(every, 20_000)]:
        s = f"{chr(c)}'s a{chr(c)}1 {chr(c)}b"
        assert np.frombuffer(own.encode(s), "<u4").tolist() == enc.encode_ordinary(s), hex(c)


def test_another_pattern_is_matched_on_whole_texts():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"[a-z ]+|[^a-z ]+"
    own = bpe.codec(BYTES, pattern)
    enc = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    text = "many words in a row, then 12 \n\n others  here"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = [f"k{i}".encode() for i in range(2000)]
    table = bpe.PerfectHash(keys, list(range(2000)))
    assert len(table.keys) == 2000 and None not in table.keys
    assert [table.get(k) for k in keys] == list(range(2000))
    assert all(table.get(f"x{i}".encode()) == -1 for i in range(2000))


def test_bpe_on_odd_rows(spark):
    out = bpe.encode(clashing(odd_docs(spark)), BYTES, P.PATTERN)
    got = out.select("text", "n_tokens", "ids", "decoded_sha256").collect()
    assert len(got) == 11 and "fp" in out.columns
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.n_tokens * 4 == len(r.ids)
    assert [r.decoded for r in bpe.decode(out, BYTES, P.PATTERN).select("decoded", "text").collect() if r.decoded != (r.text or "")] == []
    assert bpe.encode(empty(spark), BYTES, P.PATTERN).count() == 0


# --- token counts -----------------------------------------------------------------------------------


def test_counts_equal_library():
    own = token_counts.counter(WORDS)
    rng = random.Random(2)
    parts = ["a", "The", " ", "\n", "'S", "'", "é", "É", "é", "中", "12", "!", "\x1c", "\x85", "\xa0", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "İ", "ẞ", "\x00", "՘", "\U00010d50"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert own.count(s.encode()) == len(own.library.encode(s, add_special_tokens=False).ids), repr(s)
    for w in rng.sample(sorted(own.whole), 300):
        assert len(own.library.encode(w, add_special_tokens=False).ids) == 1, w


def test_counts_on_odd_rows(spark):
    own = token_counts.counter(WORDS).library
    got = token_counts.count_tokens(clashing(odd_docs(spark)), WORDS).select("text", "n_bytes", "n_tokens", "over_limit").collect()
    for r in got:
        n = len(own.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 2048)
    assert token_counts.count_tokens(empty(spark), WORDS).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups_of(x, linked):
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(x)):
        for j in range(i):
            if linked(i, j) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(x))]


def near_copies(rng, n):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(rng.randint(60, 120))) for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.randint(0, 4)):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


def test_simhash_equals_brute_force(spark):
    texts = [*near_copies(random.Random(3), 40), "", None, "one", "ONE", "two words"]
    out = {r.doc_id: r for r in simhash_dedup.near_duplicates(clashing(docs_of(spark, texts))).collect()}
    x = [slow_fingerprint(t) for t in texts]
    assert [out[i].fp & (2**64 - 1) for i in range(len(x))] == x
    assert [out[i].component_id for i in range(len(x))] == groups_of(x, lambda i, j: (x[i] ^ x[j]).bit_count() <= 4)


def test_simhash_odd_rows_and_stage(spark):
    out = simhash_dedup.near_duplicates(odd_docs(spark)).collect()
    zero = [r for r in out if r.fp == 0]
    assert len(out) == 11 and len(zero) == 4 and {r.component_id for r in zero} == {2}
    kept = simhash_dedup.keep_one(clashing(odd_docs(spark)))
    assert kept.columns == clashing(odd_docs(spark)).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7, 8] and ids.count(None) == 1  # the row without id or text is a copy of 2
    assert simhash_dedup.keep_one(empty(spark)).count() == 0


def test_pivots_discard_pairs_and_lose_none():
    rng = random.Random(17)
    x = [rng.getrandbits(64) for _ in range(600)]
    x += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in x[:200]] + x[:50]
    fp = np.array(x, np.uint64).view(np.int64)
    bucket = np.array([k % 200 % 7 for k in range(len(x))])
    a, b, counts = simhash_dedup.pivot_links(bucket, fp)
    near = {(min(x[i], x[j]), max(x[i], x[j])) for i in range(len(x)) for j in range(i) if bucket[i] == bucket[j] and x[i] != x[j] and (x[i] ^ x[j]).bit_count() <= 4}
    got = {(min(u, v), max(u, v)) for u, v in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist())}
    assert got <= near and counts["linked"] == len(near) and near
    nodes = sorted({n for p in near for n in p})
    whole, found = (groups_of(nodes, lambda i, j: (nodes[j], nodes[i]) in e) for e in (near, got))  # noqa: B023
    assert whole == found
    assert counts["linked"] <= counts["kept"] < counts["met"] / 20 and counts["met"] < counts["pairs"]
    assert simhash_dedup.pivot_links(bucket[:0], fp[:0])[2]["pairs"] == 0


def test_keep_one_leaves_exactly_one_row_of_each_component(spark):
    rng = random.Random(18)
    text = lambda: " ".join(str(rng.random()) for _ in range(30))
    a, b = text(), text()
    rows = [(5, a), (1, a), (5, b), (9, b), (None, a), (None, b), (None, "x y"), (None, "x y"), (7, text()), (7, text()), (3, a), (3, a)]
    df = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(rows)], DOCS)
    kept = sorted((r.doc_id or 0, r.text) for r in simhash_dedup.keep_one(df).collect())
    assert kept == sorted([(1, a), (5, b), (0, "x y"), (7, rows[8][1]), (7, rows[9][1])])


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_every_plan_meets_all_close_pairs(n):
    rng = random.Random(n)
    masks = hamming.plan(n)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(hamming, "SPLIT", 8)
    monkeypatch.setattr(hamming, "SHARE", 1)
    rng = random.Random(5)
    x = sorted({0b1011 ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long")
    edges = hamming.by_bucket(hamming.buckets(df, len(x), Scratch(spark, "t")), ["fp"], simhash_dedup.pivot_forest, "a long, b long", at_once=True)
    found = {r.node: r.component for r in components.components(edges, Scratch(spark, "t")).collect()}
    want = groups_of(x, lambda i, j: (x[i] ^ x[j]).bit_count() <= 4)
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    by = collections.defaultdict(set)
    for v, g in zip(x, want):
        by[g].add(found.get(sign(v), sign(v)))
    assert all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == len(by)


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    nodes = sorted({n for p in pairs for n in p if p[0] != p[1]})
    at = {n: k for k, n in enumerate(nodes)}
    links = {(at[a], at[b]) for a, b in pairs if a != b}
    want = groups_of(nodes, lambda i, j: (i, j) in links or (j, i) in links)
    assert got == {n: nodes[g] for n, g in zip(nodes, want)}


# --- lines ------------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def norm(line):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip(" ")


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    pool = near_copies(rng, 25)
    texts = ["\n".join(rng.choice(pool) + rng.choice(["", "!", " ."]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = {r.doc_id: r.removed for r in line_dedup.duplicates(clashing(docs_of(spark, texts)), Scratch(spark, "t")).collect()}
    first = {}
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            first.setdefault(norm(line), (d, k))
    names = list(first)
    fp = [int(line_dedup.line_hashes(line_dedup.lowered(n.encode()))[1][0]) for n in names]
    link = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4 and distance(names[i], names[j]) <= 0.2 * max(len(names[i]), len(names[j])) + 1e-9
    group, seen, want = dict(zip(names, groups_of(names, link))), set(), collections.defaultdict(list)
    assert len(set(group.values())) < len(names)
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            g = group[norm(line)]
            if g in seen:
                want[d].append(k)
            seen.add(g)
    assert {d: r for d, r in out.items() if r} == dict(want)


def test_failed_links_are_made_up_for(spark, monkeypatch):
    """Where the forest's own link fails verification, other links between the groups still count."""
    texts = ["aa bb cc dd ee ff", "aa bb cc dd ee ffx", "zz yy xx ww vv uu"]
    monkeypatch.setattr(hamming, "RADIUS", 64)  # every pair is proposed, so the forest is a star
    monkeypatch.setattr(line_dedup, "_forest", lambda lid, fp: [(np.array([lid.max()] * 2), np.sort(lid)[:2])] if len(lid) == 3 else [])
    monkeypatch.setattr(hamming, "plan", lambda n, radius=4: [0])
    out = {r.doc_id: r.removed for r in line_dedup.duplicates(docs_of(spark, texts), Scratch(spark, "t")).collect()}
    assert out == {0: [], 1: [0], 2: []}


def test_wide_lines_are_found_by_edit_similarity_alone(spark):
    """Against all pairs of edit similarity >= 0.8, whatever their bits: changed words, lost letters."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    texts = []
    for n in [2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60] * 5:
        w = [rng.choice(vocabulary) for _ in range(n)]
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            k = rng.randrange(n)
            v[k] = rng.choice(["changed", v[k][:-1] or "x", v[k] + "s"])
            texts.append(" ".join(v))
    names = sorted(set(texts))
    fp = {t: int(line_dedup.line_hashes(line_dedup.lowered(t.encode()))[1][0]) for t in names}
    pairs = [(a, b) for a in names for b in names if a < b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    linked = set(pairs)
    whole = dict(zip(names, groups_of(names, lambda i, j: (names[j], names[i]) in linked)))
    df, share = docs_of(spark, names), {}
    for wide in (False, True):
        found = line_dedup.lines(df, wide)
        places, own = found.filter("line_no >= 0"), found.filter("line_no = -2") if wide else None
        lid = {r.rid: r.lid for r in places.collect()}
        rid = {r.text: r.rid for r in df.select("text", F.xxhash64("doc_id", "text").alias("rid")).collect()}
        group = {r.lid: r.grp for r in line_dedup.groups(df, places, Scratch(spark, "t"), sketches=own).collect()}
        at = {t: group.get(lid[rid[t]], t) for t in names}
        share[wide] = sum(at[a] == at[b] for a, b in pairs) / len(pairs)
        assert all(whole[a] == whole[b] for a in names for b in names if at[a] == at[b])  # by edit similarity only
    far = sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in pairs)
    print("pairs", len(pairs), "beyond 4 bits", far, "recall", share)
    assert far > len(pairs) / 2 and share[True] >= 0.95 > share[False]


def test_lines_that_only_a_weak_hash_confuses_are_told_apart():
    """Thue-Morse lines collide under any polynomial hash modulo a power of two."""
    for n in (1024, 2048, 4096):
        one = "".join("ab"[k.bit_count() & 1] for k in range(n)).encode()
        ids = line_dedup.identities(line_dedup.sketch.compact(line_dedup.lowered(one + b"\n" + one.translate(bytes.maketrans(b"ab", b"ba")) + b"\n" + one.upper())))
        assert (ids[0] != ids[1]).all() and (ids[0] == ids[2]).all()


def test_lines_that_share_half_an_identity_are_not_equal(spark, monkeypatch):
    """Forced clashes of lid: lines that differ in lid2 stay, exact copies of each still go."""
    whole = line_dedup.identities

    def clashing_ids(compacted):
        ids = whole(compacted).copy()
        ids[:, 0] = 7
        return ids

    monkeypatch.setattr(line_dedup, "identities", clashing_ids)
    texts = ["alpha beta gamma", "quite another line", "alpha beta gamma", "quite another line", "a third one here"]
    df = docs_of(spark, texts)
    rows = [(i, r.rid, 0, 7, int(whole(line_dedup.sketch.compact(line_dedup.lowered(t.encode())))[0, 1].astype(np.int64)), 0) for i, t in enumerate(texts) for r in df.filter(F.col("doc_id") == i).select(line_dedup._rid()).collect()]
    ends = [(i, r[1], -1, 1, None, None) for i, r in enumerate(rows)]
    fake = spark.createDataFrame(rows + ends, "doc_id long, rid long, line_no int, lid long, lid2 long, fp long")
    monkeypatch.setattr(line_dedup, "lines", lambda df, wide=False: fake)
    out = {r.doc_id: r.removed for r in line_dedup.duplicates(df, Scratch(spark, "t")).collect()}
    assert out == {0: [], 1: [], 2: [0], 3: [0], 4: []}


def test_edit_similarity_equals_brute_force(monkeypatch):
    rng = random.Random(31)
    xs, ys = [""], ["a"]
    for _ in range(300):
        x = [rng.choice("abcdé中 ") for _ in range(rng.randint(0, 150))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 3))):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        xs.append("".join(x))
        ys.append("".join(y))
    want = [distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9 for x, y in zip(xs, ys)]
    assert edit.similar(xs, ys, 0.8).tolist() == want and 50 < sum(want) < 290
    monkeypatch.setattr(edit, "LONG", 20)  # long pairs, one by one
    monkeypatch.setattr(edit, "MASKS", 1 << 12)
    assert edit.similar(xs, ys, 0.8).tolist() == want


def test_long_lines_are_compared_whole(spark):
    rng = random.Random(32)
    words = [rng.choice(["lorem", "ipsum", "dolor", "amet"]) + str(rng.randrange(99)) for _ in range(4000)]
    near = [*words[:2000], "changed", *words[2001:]]
    far = [w if k % 3 else "other" + str(k) for k, w in enumerate(words)]
    out = {r.doc_id: r.removed for r in line_dedup.duplicates(docs_of(spark, [" ".join(x) for x in (words, near, far)]), Scratch(spark, "t"), wide=True).collect()}
    assert out == {0: [], 1: [0], 2: []}


def test_lines_odd_rows_and_stage(spark):
    df = clashing(odd_docs(spark))
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    assert got[1] == ["alpha beta gamma delta epsilon\nzeta eta theta iota kappa"] * 2  # equal rows fare alike
    assert got[6] == ["other line"] and got[2] == [None] and got[3] == [""] and got[4] == ["   \n\t \n"]
    assert line_dedup.drop_lines(empty(spark)).count() == 0


# --- top k ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [16, 4096])
def test_topk_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(exact_topk, "CHUNK", chunk)
    monkeypatch.setattr(exact_topk, "BLOCK", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 12)) * rng.lognormal(size=(150, 1))
    x[20:30] = x[5]  # ties
    data = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    data += [(200, None, "c"), (220, [1.0, None] * 6, "c"), (240, [float("nan")] * 12, "c"), (260, [], "c"), (280, [float("inf")] * 12, "c"), data[3], data[40], (300, [0.5], "c"), (None, [1.0], "c")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, norm string")
    out = exact_topk.top_k(exact_topk.quantised(df), F.col("vec_id") % 20 == 0, Scratch(spark, "t"), 5)
    got = sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect()))
    rows = [(i, np.floor(64 * r).astype(int)) for i, r in enumerate(x)] + [(i, np.floor(64 * x[i]).astype(int)) for i in (3, 40)]
    rows += [(260, np.zeros(12, int)), (300, np.array([32] + [0] * 11))]
    want = []
    for k, (a, v) in enumerate(rows):
        if a % 20 == 0:
            best = sorted((-int(v @ w), b) for j, (b, w) in enumerate(rows) if j != k)[:5]
            want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    assert got == sorted(want)


def test_topk_keeps_repeated_rows_as_its_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    data = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0]), (20, []), (20, []), (40, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = exact_topk.top_k(exact_topk.quantised(df), F.col("vec_id") % 20 == 0, Scratch(spark, "t"))
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", data)
    want = sorted(c.execute(f"SELECT query_id, rank, vec_id, score FROM ({exact_topk.ORACLE})").fetchall())
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == want
    assert [r[2] for r in want if r[0] == 0] == [1, 1, 2, 20, 20]


def test_topk_of_nothing(spark):
    every = F.col("vec_id") % 20 == 0
    v = exact_topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert exact_topk.top_k(v, every, Scratch(spark, "t")).count() == 0
    one = exact_topk.quantised(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert exact_topk.top_k(one, every, Scratch(spark, "t")).count() == 0


# --- licences ---------------------------------------------------------------------------------------


def test_license_scan_finds_every_base_place(spark):
    texts = ["MIT License, the mit-license; MIT\nLICENSE", "gnu general public license general public license", "Apache License apache licenses", "mitlicense", "", None, "license mit", "KMIT License"]
    out = {r.doc_id: r for r in license_scan.scan(clashing(docs_of(spark, texts)).drop("fp")).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, name) for name, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score == 1.0) == bool(at) and 0 <= r.score <= 1
    assert license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(odd_docs(spark)).count() == 11


def test_license_texts_with_other_words_and_without_a_key_phrase(spark):
    bsd = next(w for label, w, _ in license_scan.TEMPLATES if label == "bsd-2")
    w = bsd.split()
    filler = [" ".join(random.Random(k).choices(["some", "other", "plain", "prose", "words", "met", "following", "the", "this"], k=80)) for k in range(20)]
    texts = [bsd.upper(), " ".join([*w[:11], "changed", *w[12:]]), " ".join(["x" if k > 20 else v for k, v in enumerate(w)]), bsd.replace("source and binary", "any"), f"{filler[0]} {bsd}. {bsd}", *filler]
    got = [r.labels for r in license_scan.scan(docs_of(spark, texts)).orderBy("doc_id").select("labels").collect()]
    assert got == ["bsd,bsd-2", "bsd,bsd-2", "bsd", "", "bsd,bsd-2", *[""] * 20]


# --- toxicity ---------------------------------------------------------------------------------------


def toxic_corpus(spark, n=600):
    rng = random.Random(9)
    bad = ["vile", "rotten", "foul"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)]
        toxic = rng.random() < 0.15
        for w in rng.sample(bad, 2) if toxic else []:
            words[rng.randrange(40)] = w
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_learns_only_from_learnable_rows_and_scores_the_rest(spark):
    docs, labels = toxic_corpus(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (3, None), (None, 1), labels[5]], "doc_id long, toxic int")
    words, index, ids = toxicity.learn(df, lab, Scratch(spark, "t"))
    assert not any(map(held, ids)) and {b"vile", b"rotten", b"foul"} < set(words.number)
    got = {r.doc_id: r for r in toxicity.scored(clashing(df), words, index, ids).select("doc_id", "score", "predicted", "evidence").collect()}
    truth = dict(labels)
    assert all(got[i].predicted == truth[i] for i in truth if held(i))
    assert all(0 <= r.score <= 1 and not any(map(held, r.evidence)) for r in got.values())
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, toxic int")
    again = toxicity.learn(df, flipped, Scratch(spark, "t"))
    assert {r.doc_id: r.score for r in toxicity.scored(df, *again).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.drop_toxic(clashing(df), lab)
    assert kept.columns == clashing(df).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def slow_toxicity(docs, labels, kept):
    """Scores by the definition alone: dictionaries, all examples, no index."""
    import math

    def terms(text):
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower().encode())
        out = collections.Counter(words)
        for w in words:
            out.update(w[:k] + b"*" for k in (4, 5, 6) if len(w) > k)
        return out

    y, texts = dict(labels), {d[0]: terms(d[1]) for d in docs}
    n, pos, big = len(kept), sum(y[i] for i in kept), math.log(1 + len(docs))
    weight = {}
    for t in set().union(*(texts[i] for i in kept)):
        have = [i for i in kept if t in texts[i]]
        c, p = len(have), sum(y[i] for i in have)
        if c < 2:
            continue
        cells = [(p, c * pos / n), (c - p, c * (n - pos) / n), (pos - p, (n - c) * pos / n), (n - pos - c + p, (n - c) * (n - pos) / n)]
        g = max(0, 2 * sum(o * math.log(o / e) for o, e in cells if o))
        w = g / (g + 20) * math.log((1 + len(docs)) / (1 + sum(t in x for x in texts.values()))) / big
        if w >= toxicity.FLOOR:
            weight[t] = w

    def unit(x):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in x.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1
        return {t: w / norm for t, w in v.items()}

    units, rate = {i: unit(x) for i, x in texts.items()}, pos / n

    def vote(i):
        cos = [(round(sum(w * units[e].get(t, 0) for t, w in units[i].items()), 12), -k) for k, e in enumerate(kept) if e != i]
        best = sorted((c for c in cos if c[0] > 0), reverse=True)[: toxicity.K]
        w = [(1 / (1.02 - s), y[kept[-k]]) for s, k in best]
        return (sum(a * b for a, b in w) + rate) / (sum(a for a, _ in w) + 1) if w else None

    loo = sorted((vote(i), y[i]) for i in kept if units[i])
    value, fit = [v for v, _ in loo], [float(t) for _, t in loo]
    steps = []  # monotone regression: of all averages, the largest of those from below of the smallest from above
    for k in range(len(fit)):
        lo = max(range(k + 1), key=lambda a: (min(sum(fit[a:b]) / (b - a) for b in range(k + 1, len(fit) + 1)), -a))
        steps.append(min(sum(fit[lo:b]) / (b - lo) for b in range(k + 1, len(fit) + 1)))
    return {i: vote(i) for i in texts}, value, steps


def test_toxicity_votes_and_evidence_equal_brute_force(spark):
    docs, labels = toxic_corpus(spark, 160)
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    words, index, ids = toxicity.learn(df, lab, Scratch(spark, "t"))
    votes, value, steps = slow_toxicity(docs, labels, ids)
    scores = []
    for i, text, *_ in docs:
        x = words.counts(text.encode())
        if len(x[0]) and i not in ids:
            assert index.vote(*index.nearest(*x)) == pytest.approx(votes[i], abs=1e-9)
            scores.append((votes[i], index.score(*x)[0]))
    assert [s for _, s in sorted(scores)] == sorted(s for _, s in scores)  # calibration keeps the order
    # the calibrated steps are the monotone regression of the leave-one-out votes, smoothed by count
    for v, want in zip(value, steps):
        own = index.steps[np.searchsorted(index.steps[:, 0], v + 1e-12, side="right") - 1, 1]
        assert abs(own - want) < 0.15


def test_index_search_is_exact_with_ties_and_skips(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = random.Random(10)
    weight = np.array([rng.random() for _ in range(30)])
    vector = lambda n: (lambda t: (np.array(t, int), np.array([rng.randint(1, 3) for _ in t], float)))(sorted(rng.sample(range(30), n)))
    examples = [vector(rng.randint(0, 4)) for _ in range(700)]
    examples += examples[:200]  # ties
    index = toxicity.Index(weight, examples, [rng.randint(0, 1) for _ in examples])
    dense = np.zeros((len(examples), 30))
    for k, x in enumerate(examples):
        dense[k, x[0]] = index.unit(*x)
    for _ in range(100):
        x, skip = vector(rng.randint(1, 4)), rng.randrange(len(examples))
        q = np.zeros(30)
        q[x[0]] = index.unit(*x)
        cos = np.round(dense @ q, 12)
        cos[skip] = 0
        want = sorted(((-c, k) for k, c in enumerate(cos.tolist()) if c > 0))[: toxicity.K]
        e, s = index.nearest(*x, skip=skip)
        assert np.allclose(s, [-c for c, _ in want], atol=1e-11) and [k for _, k in want] == e.tolist()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    learnt = toxicity.learn(odd_docs(spark), none, Scratch(spark, "t"))
    assert [r.score for r in toxicity.scored(odd_docs(spark), *learnt).collect()] == [0.0] * 11
    assert toxicity.drop_toxic(empty(spark), none).count() == 0


def test_toxicity_of_odd_rows_and_text_ids(spark):
    docs, labels = toxic_corpus(spark, 200)
    df = spark.createDataFrame(docs, DOCS).union(odd_docs(spark))
    learnt = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), Scratch(spark, "t"))
    out = toxicity.scored(clashing(df), *learnt)
    assert out.count() == 211 and all(0 <= r.score <= 1 for r in out.select("score").collect())
    named = spark.createDataFrame([(f"d{i}", *rest) for i, *rest in docs], DOCS.replace("doc_id long", "doc_id string"))
    learnt = toxicity.learn(named, spark.createDataFrame([(f"d{i}", t) for i, t in labels], "doc_id string, toxic int"), Scratch(spark, "t"))
    assert any(r.evidence for r in toxicity.scored(named, *learnt).collect())


# --- quality ----------------------------------------------------------------------------------------


def test_cotraining_separates_and_keeps_clean(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)]
        docs.append((i, " ".join(words) if good else "###".join(words).upper(), "en", "a" if good else "b", 100))
        labels.append((i, int(good)))
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame([*labels[:300], (7, None), (None, 0)], "doc_id long, quality int")
    pages = spark.createDataFrame([(f"http://x.org/en/{i}?p=1",) for i in range(0, 500, 3)] + [(None,), ("junk",)], "url string")
    got = {r.doc_id: r for r in cotrain.score(df, lab, pages, Scratch(spark, "t")).collect()}
    assert all(got[i].predicted == y for i, y in labels) and len(got) == 500
    odd = cotrain.score(clashing(odd_docs(spark)), lab, pages, Scratch(spark, "t"))
    assert odd.count() == 11 and all(0 <= r.score <= 1 for r in odd.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotrain.score(odd_docs(spark), none, pages, Scratch(spark, "t")).collect()} == {0.5}


def test_each_round_offers_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "EXCHANGE", 7)
    rng = random.Random(19)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(30)]
        docs.append((i, " ".join(words) if good else "###".join(words).upper(), "en", rng.choice("abc" if good else "cde"), 100))
        labels.append((i, int(good)))
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:200], "doc_id long, quality int")
    pages = spark.createDataFrame([(f"http://{'x' if dict(labels)[i] else 'casino'}.org/en/{i}",) for i in range(0, 400, 2)], "url string")
    rows = Scratch(spark, "t").write(cotrain.features(df, lab, pages, "quality"), "f").repartition(5)
    every = rows.withColumn("spread", F.xxhash64(F.lit(6), "doc_id")).collect()
    known = [r for r in every if r.y is not None]
    assert len(known) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200)) and sum(r.free for r in every) == 200
    views = [cotrain.content_view([r.made for r in known]), cotrain.metadata_view(*([r[c] for r in known] for c in cotrain.META))]
    assert views[0].shape[1] + views[1].shape[1] == len(set(range(views[0].shape[1]))) + 1 + cotrain.NAMES + cotrain.URL  # no feature in both
    pair = cotrain.Pair(views, np.array([r.y for r in known]))
    pair.fit()
    taken = [{every[0].doc_id, every[1].doc_id}, set()]
    got = collections.defaultdict(list)
    for r in sorted(cotrain.offers(rows, pair.models, taken).collect(), key=lambda r: r["rank"]):
        got[r.view, r.label].append(r.doc_id)
    free = sorted((r for r in every if r.free), key=lambda r: r.spread)
    odds = [pair.models[0].log_odds(cotrain.content_view([r.made for r in free])), pair.models[1].log_odds(cotrain.metadata_view(*([r[c] for r in free] for c in cotrain.META)))]
    for view in (0, 1):
        for label in (0, 1):
            want = [r.doc_id for r, o in zip(free, odds[1 - view]) if r.doc_id not in taken[view] and (o if label else -o) >= np.log(0.95 / 0.05)]
            assert got[view, label] == want[:7]
    assert sum(map(len, got.values())) > 14


# --- robust outliers --------------------------------------------------------------------------------


def slow_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_outliers_counts_and_verdicts(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["ab", "cde", "fghi", "é中"]) + str(rng.randrange(50)) for _ in range(rng.randint(30, 200))) for _ in range(300)]
    texts += ["# " * 300 + "x" * 3000, "a b c d e f g h " * 10, "l\nl\n\n l \nl", None, "", " \n "]
    out = {r.doc_id: r for r in robust_outliers.judged(clashing(docs_of(spark, texts)), Scratch(spark, "t")).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(out[i].kept for i in range(300)) and not any(out[i].kept for i in range(300, 306))
    assert robust_outliers.judged(empty(spark), Scratch(spark, "t")).count() == 0
    assert robust_outliers.judged(odd_docs(spark), Scratch(spark, "t")).count() == 11


def slow_mcd(x):
    """Location and scatter by the definition, in numpy."""
    floor = np.array(robust_outliers.FLOOR)
    low = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]

    def distance(m, c):
        g = np.zeros((4, 4))
        for j in range(4):
            g[j, j] = np.sqrt(max(c[j, j] - (g[j, :j] ** 2).sum(), (floor[j] / 3) ** 2))
            for i in range(j + 1, 4):
                g[i, j] = (c[i, j] - g[i, :j] @ g[j, :j]) / g[j, j]
        return (np.linalg.solve(g, (x - m).T) ** 2).sum(axis=0)

    def moments(rows):
        c = np.cov(rows.T, bias=True)
        c[np.diag_indices(4)] = np.maximum(np.diag(c), floor**2)
        return rows.mean(axis=0), c

    m = low(x, 0.5)
    c = np.diag(np.maximum(1.4826 * low(np.abs(x - m), 0.5), floor) ** 2)
    for _ in range(3):
        d = distance(m, c)
        m, c = moments(x[d <= low(d, 0.75)])
    d = distance(m, c)
    return (*moments(x[d <= 11.143 * max(1, low(d, 0.5) / 3.357)]), distance)


def test_mcd_ignores_a_minority_and_equals_an_independent_one(spark):
    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(size=(800, 4)), rng.normal(size=(150, 4)) + 12]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double, x2 double, x3 double")
    est = robust_outliers.mcd(df, [], Scratch(spark, "t"), "m").first()
    m, c = np.array([est[f"m{k}"] for k in range(4)]), np.array([[est[f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
    want = slow_mcd(x)
    assert np.allclose(m, want[0], atol=0.02) and np.allclose(c, want[1], atol=0.05)  # percentiles are approximate
    d = want[2](m, c)
    assert abs(m).max() < 0.2 and np.median(d[:800]) < 6 and d[800:].min() > robust_outliers.CUT


def test_verdicts_equal_an_independent_estimate(spark):
    rng = random.Random(14)
    word = lambda: rng.choice(["ab", "cde", "fghi", "jklmno"]) + str(rng.randrange(50))
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(25, 150)))
        text = "%%% ".join(text.split()) if i % 40 == 7 else "q" * 900 + " " + text if i % 40 == 9 else text
        rows.append((i, text, "en" if i % 3 else "de", f"s{i % 5 if i % 11 else 9}", None))
    out = {r.doc_id: r for r in robust_outliers.judged(spark.createDataFrame(rows, DOCS), Scratch(spark, "t")).collect()}
    x = {}
    for i, text, *_ in rows:
        n, chars, symbols, dup, repeat = slow_counts(text)
        if n >= 20 and 100 * repeat <= 30 * n:
            x[i] = [np.log1p(n), np.log1p(chars / n), np.log1p(10 * symbols / n), np.sqrt(min(1, repeat / n)) + 0.1 * np.log1p(dup)]
    of = {i: (lang, source) for i, _, lang, source, _ in rows}
    pick = lambda f: np.array([x[i] for i in sorted(x) if f(of[i])])
    blend = lambda a, b, n: [n / (n + 30) * u + 30 / (n + 30) * v for u, v in zip(a, b)]
    for lang, source in set(of.values()):
        every, wide, own = pick(lambda g: True), pick(lambda g: g[0] == lang), pick(lambda g: g == (lang, source))  # noqa: B023
        wider = blend(slow_mcd(wide)[:2], slow_mcd(every)[:2], len(wide))
        m, c = blend(slow_mcd(own)[:2], wider, len(own))
        mine = [i for i in sorted(x) if of[i] == (lang, source)]
        for i, v in zip(mine, own):
            d = float((v - m) @ np.linalg.solve(c, v - m))
            assert out[i].distance == pytest.approx(d, rel=1e-6) and out[i].kept == (d <= robust_outliers.CUT)
    assert 0 < sum(not r.kept for r in out.values()) < 30


# --- mixing -----------------------------------------------------------------------------------------


def test_targets_stop_at_the_cap_and_reshare(spark):
    df = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 30)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    cap, weight = {"a": 20, "b": 200, "c": 200, None: 60}, {"a": 3, "b": 1, "c": 2, None: 3}
    want, left, open_ = {}, 360.0, set(cap)
    while True:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > cap[s]}
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
        open_ -= over
    want |= {s: each * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_takes_near_targets_and_reruns_agree(spark):
    rng = random.Random(14)
    data = [(i, "w " * rng.randint(0, 60), "en", rng.choice("abc"), None) for i in range(800)]
    df = spark.createDataFrame(data, DOCS)
    out = mixing.mix(clashing(df), Scratch(spark, "t")).collect()
    again = mixing.mix(df.repartition(7), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert len(out) == 800 and all(0 <= r.taken <= 2 * r.size for r in out)
    for s in "abc":
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01) and own[0].source_size == sum(r.size for r in own)


@pytest.mark.parametrize("tiny", ["a", "m", "z"])
def test_tiny_source_beside_large_ones_comes_near_its_target(spark, tiny):
    large = spark.range(400).select("id", F.expr("repeat('w ', 20000)").alias("text"), F.expr("concat('l', id % 4)").alias("source"))
    small = spark.range(1000, 1003).select("id", F.expr("repeat('w ', 3)").alias("text"), F.lit(tiny).alias("source"))
    more = spark.range(2000, 2010).select("id", F.expr("repeat('w ', 70)").alias("text"), F.lit(f"{tiny}2").alias("source"))
    df = large.union(small).union(more).select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), "source", F.lit(None).cast("long").alias("n_chars"))
    got = mixing.mix(df, Scratch(spark, "t")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 6 and all(abs(r.taken - r.target) <= max(1, 0.01 * r.target) for r in got)
    kept = mixing.mixed(df).groupBy("source").count().collect()
    assert {r.source for r in kept} == {r.source for r in got}


def test_mixing_odd_rows_and_stage(spark):
    out = mixing.mix(odd_docs(spark), Scratch(spark, "t")).collect()
    assert len(out) == 11 and all(r.taken <= 2 * r.size for r in out)
    df = clashing(odd_docs(spark))
    stage = mixing.mixed(df)
    assert stage.columns == df.columns and stage.filter("text is null or btrim(text) = ''").count() == 0
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.mix(empty(spark), Scratch(spark, "t")).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------------


def duck(name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.execute(queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df, sql = queries.QUERIES[name](spark, SF), duck(name)
    names = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).union(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    docs, own = clashing(docs), Scratch(spark, "t")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = own.write(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() > 0
        docs = out
    assert docs.filter("n_tokens is null").count() == 0
    nothing = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def pipeline_fixture(spark):
    """A small corpus with toxic rows, alike lines, near copies, odd rows, and its labels."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, docs = [line(14) for _ in range(4)], []
    for i in range(72):
        lines = [line(rng.randint(8, 20)) for _ in range(rng.randint(1, 3))]
        if i % 6 == 0:
            common = shared[i % 4]
            lines.insert(rng.randrange(len(lines) + 1), common if i % 12 else common + "s")
        if i % 8 == 3:
            lines[0] += " vile rotten foul"
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
    docs += [(200 + i, docs[i][1], "en", "s1", 1) for i in (1, 2, 5)]  # exact copies
    docs += [(300, None, "en", None, None), (301, "", None, "s0", 0), (302, "same words here", "en", "s2", 15), (302, "same words here", "en", "s2", 15)]
    return docs, [(i, int(i % 8 == 3)) for i in range(72)]


def slow_pipeline(docs, labels, kept_by_toxicity):
    """The stages after the first by definition alone: dictionaries, all pairs, whole streams."""
    import math

    tiktoken = pytest.importorskip("tiktoken")
    docs = [d for d in docs if d[0] in kept_by_toxicity]
    # lines: all pairs of different lines by edit similarity, the first of each group stays
    lines = [(d, k, norm(x)) for d, (_, text, *_) in enumerate(docs) if text is not None for k, x in enumerate(text.split("\n")) if norm(x)]
    names = sorted({x for *_, x in lines})
    alike = lambda i, j: abs(len(names[i]) - len(names[j])) <= 0.2 * max(len(names[i]), len(names[j])) and distance(names[i], names[j]) <= 0.2 * max(len(names[i]), len(names[j])) + 1e-9
    group = dict(zip(names, groups_of(names, alike)))
    first, gone = {}, collections.defaultdict(set)
    for d, k, x in sorted(lines, key=lambda r: (docs[r[0]][0], r[1])):
        if first.setdefault(group[x], (docs[d][:2], k)) != (docs[d][:2], k):
            gone[d].add(k)
    docs = [(i, t if t is None or d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]), *rest) for d, (i, t, *rest) in enumerate(docs)]
    # near copies: one row of each component
    fp = [slow_fingerprint(t) for _, t, *_ in docs]
    comp, best = groups_of(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4), {}
    for d, c in sorted(enumerate(comp), key=lambda r: docs[r[0]][0]):
        best.setdefault(c, d)
    docs = [docs[d] for d in sorted(best.values())]
    # the mix: golden-ratio slots, blocks of each source's stream in hash order
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, *_ in docs]
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, d in zip(size, docs) if d[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(sources)
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > 2 * own[s]}
        target |= {s: 2 * own[s] for s in over} if over else {s: each * weight[s] for s in open_}
        left -= sum(2 * own[s] for s in over)
        open_ = open_ - over if over else set()
    total = sum(target.values())
    block = max(1, math.ceil(total / (mixing.SLOTS * len(sources))))
    high = np.cumsum([target[s] for s in sources]) / total
    points = (0.5 + np.arange(max(1, round(total / block))) * mixing.GOLDEN) % 1.0
    blocks = np.bincount(np.minimum(np.searchsorted(high, points, side="right"), len(sources) - 1), minlength=len(sources))
    out = []
    for k, s in enumerate(sources):
        limit = blocks[k] * block if target[s] >= mixing.FINE * block else math.ceil(target[s] - 1e-9)
        stream = sorted((hashlib.md5(str(d[0]).encode()).hexdigest(), d[0], n, j) for j, (d, n) in enumerate(zip(docs, size)) if d[3] == s)
        at = 0
        for lap in range(2):
            for *_, n, j in stream:
                out += [docs[j]] if n and at < limit and lap * own[s] <= at else []
                at += n
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTES), special_tokens={})
    ids = [(d[0], enc.encode_ordinary(d[1] or "")) for d in out]
    return sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = pipeline_fixture(spark)
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect()
    toxic = {i for i, y in labels if y}  # the first stage finds just these, which its own tests hold against brute force
    kept = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(docs, DOCS), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - toxic - {200 + i for i in toxic}
    assert sorted(map(tuple, out)) == slow_pipeline(docs, labels, {d[0] for d in docs} - toxic)


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    rng = random.Random(15)
    text = "".join(rng.choice(["Word", "é中", " ", "  ", "\n", "!", "x" * 30, " a b c d"]) for _ in range(4000))
    whole = bpe.codec(BYTES, P.PATTERN).encode(text), token_counts.counter(WORDS).count(text.encode()), simhash_dedup.fingerprint(text), list(toxicity.tokens(text.encode()))

    def hashed(body):
        buf = line_dedup.lowered(body)
        return (*line_dedup.line_hashes(buf), *line_dedup.identities(line_dedup.sketch.compact(buf)).T)

    lines = [x.tolist() for x in hashed(text.encode())]
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert (bpe.codec(BYTES, P.PATTERN).encode(text), token_counts.counter(WORDS).count(text.encode()), simhash_dedup.fingerprint(text), list(toxicity.tokens(text.encode()))) == whole
    monkeypatch.setattr(line_dedup, "PART", 64)
    got = [[], [], [], []]
    for docs, offsets, body in line_dedup._parts([None, text.encode(), b""]):
        line, *rest = hashed(body)
        part = np.searchsorted(offsets, line, side="right") - 1
        assert (docs[part, 0] == 1).all()
        for out, x in zip(got, (line - offsets[part] + docs[part, 1], *rest)):
            out += x.tolist()
    assert got == lines
