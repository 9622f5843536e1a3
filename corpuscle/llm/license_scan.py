"""License scan by a positional index of rare words, in DataFrame operations only.

Templates are word sequences of licences with a label, some of whose words form mandatory key
phrases. Every template word gets an IDF over all documents. The index holds the rarest words of
each template (RARE of them, or as many as key phrases have): each posting is (template, position).
A document looks up its own words in that index; a hit at word i with template position p proposes
the place i - p, and the postings are intersected by relative position: a place stands only if
every one of the template's indexed words proposes it. Indexed words belong to key phrases, so none
of them can be lacking at an accepted place. What stands is verified: every word of the key phrases
must be at its position, and the IDF share of the template's words that are must be MATCH or more.
The base phrases are templates of key words only, so each of their places is found and none guessed.

Defined results: a null text counts as empty; a document without an accepted place has null first
and last words, empty labels and score 0; equal rows get equal rows; an empty table gives no row;
texts of any length are read whole, the words of one document in one task; columns of the input
pass through, but for the text, unless an output has the same name, which then replaces it.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.runtime import shielded

MATCH = 0.8
#: Words of a template that its postings hold.
RARE = 3
#: Fixed values: (label, words, key phrases); the first three are the base phrases.
TEMPLATES = [
    ("mit", "mit license", ["mit license"]),
    ("apache", "apache license", ["apache license"]),
    ("gpl", "general public license", ["general public license"]),
    ("mit-notice", "released under the mit license", ["mit license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted", "free of charge", "sublicense"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee", "permission notice appear in all copies"],
    ),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    (
        "apache-2-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license version 2 0", "except in compliance"],
    ),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    (
        "gpl-header",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        ["redistribute it", "general public license", "free software foundation"],
    ),
    (
        "lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["lesser general public license", "free software foundation"],
    ),
    ("lgpl-name", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl-name", "gnu affero general public license", ["affero general public license"]),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use", "source and binary forms", "list of conditions"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["source code form", "mozilla public license"],
    ),
    ("mpl-name", "mozilla public license", ["mozilla public license"]),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ["person or organization", "covered by this license"],
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["commercial applications", "redistribute it freely"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by", "licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("epl", "eclipse public license v 2 0", ["eclipse public license"]),
]
BASE = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows() -> list[tuple[int, int, str, bool]]:
    """(template, position, word, whether it is part of a key phrase)."""
    out = []
    for t, (_, words, keys) in enumerate(TEMPLATES):
        words, must = words.split(), set()
        for key in map(str.split, keys):
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            must |= set(range(at, at + len(key)))
        out += [(t, i, w, i in must) for i, w in enumerate(words)]
    return out


def words(text: Column) -> Column:
    """The text's words in order; A-Z in lower case."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATOR, -1)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.lit(0), F.size(parts) - lead - trail))


def idf(df: DataFrame, text: str = "text") -> dict[str, int]:
    """Weight of each template word over all documents, in thousandths of ln((n + 1) / (df + 1)),
    plus one: a row for each word of the templates is all that reaches the driver, in one pass."""
    vocabulary = sorted({w for _, _, w, _ in template_rows()})
    own = F.array_distinct(F.filter(words(F.col(text)), lambda w: w.isin(vocabulary)))
    held = df.select(F.explode(F.array_append(own, F.lit(""))).alias("w"))  # the empty word counts documents
    found = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = found.get("", 0)
    return {w: math.floor(math.log(float(n + 1) / (found.get(w, 0) + 1)) * 1000 + 0.5) + 1 for w in vocabulary}


def rare_index(weight: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, position) of each template's rarest key words, and how many of them a
    place of each template needs: all. A word that stands twice has two postings."""
    out: dict[str, list[tuple[int, int]]] = {}
    need = []
    for t in range(len(TEMPLATES)):
        must = sorted((r for r in template_rows() if r[0] == t and r[3]), key=lambda r: (-weight[r[2]], r[1]))[:RARE]
        for _, p, w, _ in must:
            out.setdefault(w, []).append((t, p))
        need.append(len(must))
    return out, need


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weight = idf(df, text)
    index, need = rare_index(weight)
    made = (text, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows, back = shielded(df, text)
    back = [b for b, c in zip(back, df.columns, strict=True) if c not in made]
    pair = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
    postings = F.create_map(*chain.from_iterable((F.lit(w), F.array(*[pair(*x) for x in ps])) for w, ps in index.items()))
    each = {t: [(p, w, k) for u, p, w, k in template_rows() if u == t] for t in range(len(TEMPLATES))}
    cell = lambda p, w, k: F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(weight[w]).alias("v"), F.lit(k).alias("k"))
    bodies = F.array(*[F.array(*[cell(*x) for x in each[t]]) for t in each])
    total = F.array(*[F.lit(sum(weight[w] for _, w, _ in each[t])) for t in each])
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])

    out = rows.withColumn("_w", words(F.col(text)))
    rare = F.array(*map(F.lit, index))
    hits = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*index), i)), lambda i: i.isNotNull())
    out = out.withColumn("_hits", F.when(F.arrays_overlap("_w", rare), hits).otherwise(F.array().cast("array<int>")))
    at = lambda i: F.get("_w", i)
    proposed = F.flatten(F.transform("_hits", lambda i: F.transform(postings[at(i)], lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("o")))))
    # a place that every indexed word of its template proposes stands as often in the sorted list
    out = out.withColumn("_all", F.array_sort(proposed))
    needs = F.array(*map(F.lit, need))
    whole = lambda c, k: (F.get("_all", k + F.get(needs, c["t"]) - 1) == c) & F.coalesce(F.get("_all", k - 1) != c, F.lit(True))
    out = out.withColumn("_places", F.filter("_all", lambda c, k: F.coalesce(whole(c, k), F.lit(False))))

    def scored(c: Column) -> Column:
        body = F.get(bodies, c["t"])
        got = F.aggregate(body, F.lit(0), lambda s, x: s + F.when(F.coalesce(at(c["o"] + x["p"]) == x["w"], F.lit(False)), x["v"]).otherwise(0))
        whole = F.forall(body, lambda x: ~x["k"] | F.coalesce(at(c["o"] + x["p"]) == x["w"], F.lit(False)))
        return F.struct(c["t"].alias("t"), c["o"].alias("o"), F.when(whole, got / F.get(total, c["t"])).otherwise(0.0).alias("s"))

    out = out.withColumn("_found", F.filter(F.transform("_places", scored), lambda c: c["s"] >= MATCH))
    out = out.withColumn("_base", F.filter("_found", lambda c: c["t"] < BASE))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(labels, x["t"])))), ",")
    starts = F.transform("_base", lambda x: x["o"])
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: x["s"])), F.lit(0.0))
    return out.select(
        *back,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named("_base").alias("base_labels"),
        named("_found").alias("labels"),
        F.round(best, 6).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join(f"({t}, '{TEMPLATES[t][0]}', {p}, '{w}', {k})" for t, p, w, k in template_rows())
#: Every place of every template by its words, without an index.
ORACLE = f"""
WITH tpl(t, label, p, w, k) AS (VALUES {_VALUES}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
occ AS (
  SELECT rid, w, i FROM (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs) WHERE w IN (SELECT w FROM tpl)),
held AS (SELECT w, count(DISTINCT rid) AS d FROM occ GROUP BY w),
weight AS (
  SELECT w, floor(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(d, 0) + 1)) * 1000 + 0.5)::BIGINT + 1 AS v
  FROM (SELECT DISTINCT w FROM tpl) LEFT JOIN held USING (w)),
body AS (SELECT t, label, p, w, k, v FROM tpl JOIN weight USING (w)),
whole AS (SELECT t, sum(v) AS total, count(*) FILTER (WHERE k) AS keys FROM body GROUP BY t),
places AS (
  SELECT o.rid, b.t, any_value(b.label) AS label, o.i - b.p AS start, sum(b.v) AS got, count(*) FILTER (WHERE b.k) AS keys
  FROM occ o JOIN body b USING (w) GROUP BY o.rid, b.t, o.i - b.p),
found AS (
  SELECT rid, p.t, label, start, got::DOUBLE / total AS s FROM places p JOIN whole h ON p.t = h.t AND p.keys = h.keys
  WHERE got::DOUBLE / total >= {MATCH}),
per AS (
  SELECT rid, count(*) FILTER (WHERE t < {BASE}) AS n_base, min(start) FILTER (WHERE t < {BASE}) AS first_word, max(start) FILTER (WHERE t < {BASE}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE t < {BASE}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score
  FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM docs LEFT JOIN per USING (rid)
"""
