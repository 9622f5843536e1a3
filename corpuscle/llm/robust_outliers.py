"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each document gives a vector of transformed statistics. For each (language, source) the location
and scatter are minimum-covariance-determinant estimates: starting from medians and MADs,
concentration steps take the share HALF of the group's documents that lie nearest (Mahalanobis)
and estimate anew. The scatter is scaled to be consistent at the normal distribution by its
median distance, reweighted once, and a document is rejected if its squared distance is above CUT.

Every group has estimates of its own, whatever its size. A group of a few documents has a scatter
that is singular or nearly so; therefore each group's estimates are drawn towards those of its
language as if these were PULL more documents of it, and a language's likewise towards those of all
documents: n / (n + PULL) of the group's own, without a threshold of size.

Order statistics are approximate percentiles with relative error 1 / ACCURACY, merged from partial
summaries; everything else is grouped sums. Estimates are a row for each group and are broadcast
only by Spark's own size check, but for the one row of all documents.

Defined results: a null text has no words and fails the base rules; null language and source are
groups of their own; equal rows get equal rows; a statistic without spread in a group counts with
the floor of its scale; where no document passes the base rules no distance is known and none is
kept; an empty table gives no row; texts of any length are counted whole, the words of one document
in one task; columns of the input pass through, but for the text, unless an output has the same
name, which then replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.runtime import Scratch, shielded

#: Share of a group that a concentration step keeps, steps, and documents that a wider group's
#: estimates stand for.
HALF, STEPS, PULL = 0.75, 3, 30
#: Chi-squared of 4 degrees of freedom: median, 0.975 quantile, and the cut: far beyond any
#: quantile of clean text, whose statistics have heavier tails than the normal distribution.
MEDIAN, REWEIGHT, CUT = 3.357, 11.143, 60.0
#: Smallest standard deviation of each statistic, so that constant ones do not reject.
FLOOR = [0.25, 0.25, 0.15, 0.1]
ACCURACY = 1000
WINDOW = 8
STATS = ["x0", "x1", "x2", "x3"]
SPLIT, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"


def _words(text: Column) -> Column:
    parts = F.split(text, SPLIT, -1)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.lit(0), F.size(parts) - lead - trail))


def counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    keep = keep or [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.select(*keep, body.alias("_t"), _words(body).alias("_w"))
    # a window's hash stands for its words; windows at i and i + 1 share all but one word
    hashes = F.expr(f"transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(slice(_w, i + 1, {WINDOW})))")
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_h", F.when(F.size("_w") > WINDOW, hashes).otherwise(none))
    out = out.withColumn("_same", F.size("_h") - F.size(F.array_distinct("_h")))
    ranked = F.expr("array_sort(transform(_h, (h, i) -> struct(h, i)))")
    out = out.withColumn("_r", F.when(F.col("_same") > 0, ranked))
    found = "filter(transform(sequence(0, size(_r) - 1), k -> if(get(_r, k - 1).h = _r[k].h or get(_r, k + 1).h = _r[k].h, _r[k].i, null)), i -> i is not null)"
    out = out.withColumn("_at", F.when(F.col("_same") > 0, F.array_sort(F.expr(found))))
    covered = f"aggregate(_at, struct(0 as n, 0 as stop), (s, i) -> struct(s.n + i + {WINDOW} - greatest(s.stop, i) as n, i + {WINDOW} as stop)).n"
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", F.when(F.contains("_t", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    long = lambda c: c.cast("long")
    n_chars = F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))
    return out.select(
        *keep,
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(n_chars).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.when(F.col("_same") > 0, F.expr(covered)).otherwise(0)).alias("n_repeat_words"),
    )


def _vector(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics: length, word length, symbols and repeats, each about even."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "x0": F.log1p("n_words"),
            "x1": F.log1p(F.col("word_chars") / n),
            "x2": F.log1p(10 * F.col("n_symbols") / n),
            "x3": F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n)) + 0.1 * F.log1p("n_dup_lines"),
        }
    )


def _factor(est: DataFrame) -> DataFrame:
    """Adds l00..l33, the inverse of the Cholesky factor of c00..c33: the whitening of the scatter."""
    p = len(STATS)
    for j in range(p):  # Cholesky, column by column
        rest = sum((F.col(f"g{j}{k}") * F.col(f"g{j}{k}") for k in range(j)), F.lit(0.0))
        # a scatter that is all but singular keeps a tenth of the floor in this direction
        est = est.withColumn(f"g{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - rest, F.lit((FLOOR[j] / 3) ** 2))))
        for i in range(j + 1, p):
            done = sum((F.col(f"g{i}{k}") * F.col(f"g{j}{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"g{i}{j}", (F.col(f"c{j}{i}") - done) / F.col(f"g{j}{j}"))
    for j in range(p):  # its inverse
        est = est.withColumn(f"l{j}{j}", 1 / F.col(f"g{j}{j}"))
        for i in range(j + 1, p):
            dot = sum((F.col(f"g{i}{k}") * F.col(f"l{k}{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", -dot / F.col(f"g{i}{i}"))
    return est.drop(*[f"g{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    p = len(STATS)
    parts = [sum((F.col(f"l{i}{j}") * (F.col(STATS[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return sum((x * x for x in parts), F.lit(0.0))


def _moments(df: DataFrame, key: list[str]) -> DataFrame:
    p = len(STATS)
    mean = [F.avg(x).alias(f"m{k}") for k, x in enumerate(STATS)]
    cov = [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
    out = df.groupBy(*key).agg(*mean, *cov)
    return out.withColumns({f"c{k}{k}": F.greatest(F.col(f"c{k}{k}"), F.lit(FLOOR[k] ** 2)) for k in range(p)})


def _with(df: DataFrame, est: DataFrame, key: list[str]) -> DataFrame:
    return df.join(est, key) if key else df.crossJoin(F.broadcast(est))  # est has one row without a key


def mcd(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Location m0.. and scatter c00.. of each key, from rows with the statistics."""
    p = len(STATS)
    middle = rows.groupBy(*key).agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m{k}") for k, x in enumerate(STATS)])
    middle = scratch.write(middle, f"{name}-middle")
    off = _with(rows, middle, key)
    mad = off.groupBy(*key, *[f"m{k}" for k in range(p)]).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{k}")), 0.5, ACCURACY).alias(f"a{k}") for k, x in enumerate(STATS)])
    start = mad.withColumns({f"c{i}{j}": F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOOR[i])) ** 2 if i == j else F.lit(0.0) for i in range(p) for j in range(i, p)})
    keep = [*key, *[f"m{k}" for k in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)]]
    est = scratch.write(_factor(start).select(keep), f"{name}-0")
    for step in range(1, STEPS + 2):
        near = _with(rows, est, key).withColumn("d", _distance())
        if step <= STEPS:
            limit, level = F.percentile_approx("d", HALF, ACCURACY), F.col("limit")
        else:  # consistent scale, then everything within the quantile counts
            limit, level = F.percentile_approx("d", 0.5, ACCURACY) / MEDIAN, REWEIGHT * F.greatest(F.col("limit"), F.lit(1.0))
        # written: of a known size, a row a group, so rows need not be dealt out by group to meet it
        limit = scratch.write(near.groupBy(*key).agg(limit.alias("limit")), f"{name}-{step}-limit")
        inside = _with(near.select(*key, *STATS, "d"), limit, key).filter(F.col("d") <= level)
        moments = _moments(inside, key)
        est = scratch.write(_factor(moments).select(keep) if step <= STEPS else moments, f"{name}-{step}")
    return est


def _blended(own: DataFrame, wide: DataFrame, sizes: DataFrame, key: list[str], wide_key: list[str]) -> DataFrame:
    """own's estimates drawn towards wide's by their sizes (key, n)."""
    numbers = [c for c in own.columns if c not in key]
    side = wide.select(*wide_key, F.struct(*numbers).alias("_wide"))
    both = _with(own.join(sizes, key), side, wide_key)
    part = F.col("n") / (F.col("n") + PULL)
    return both.select(*key, *[(part * F.col(c) + (1 - part) * F.col(f"_wide.{c}")).alias(c) for c in numbers])


def judged(df: DataFrame, scratch: Scratch, text: str = "text", cut: float = CUT) -> DataFrame:
    """df's other columns with the counts, base_failed, distance (squared) and kept."""
    made = (text, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
    own, back = shielded(df, "lang", "source", text)
    back = [b for b, c in zip(back, df.columns, strict=True) if c not in made]
    rows = counts(own.drop(*[f"__own{k}" for k, c in enumerate(df.columns) if c in made]), text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")]
    rows = rows.withColumns({"base_failed": failed, "_lang": named[0], "_source": named[1]})
    rows = scratch.write(_vector(rows), "rows")
    fit = rows.filter("not base_failed")
    sizes = scratch.write(fit.groupBy("_lang", "_source").agg(F.count("*").alias("n")), "sizes")
    langs = sizes.groupBy("_lang").agg(F.sum("n").alias("n"))
    group = ["_lang", "_source"]
    every = mcd(fit, [], scratch, "all")
    wide = scratch.write(_blended(mcd(fit, ["_lang"], scratch, "lang"), every, langs, ["_lang"], []), "wide")
    own = _blended(mcd(fit, group, scratch, "own"), wide, sizes, group, ["_lang"])
    # groups without a document that passes the base rules need no estimates
    est = scratch.write(_factor(own).select(*group, *[f"m{k}" for k in range(len(STATS))], *[f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]), "estimates")
    out = rows.join(est, group, "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(False))
    return out.select(*back, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return judged(docs, Scratch(spark, "op7")).drop("lang", "source")
