"""Collocations of two to four words by sorted suffixes.

Every word occurrence gives one suffix: the words from it to the end of its piece, WIDTH at most.
Equal suffixes of a task are summed before they are shuffled, and those for one bucket travel
together as one sorted run. Suffixes of one part (a language) that begin with the same word share a
bucket. There the runs are merged in descending order, so that all suffixes with one beginning stand
together, shorter ones after longer ones: one pass with a stack of open beginnings, of one word to
WIDTH, counts them all. The pass works on whole arrays: where neighbours part is where a beginning
is closed. Afterwards each candidate is joined to the counts of the parts of its cuts.

There are SPREAD buckets for each shuffle partition, and a bucket is all that a task holds. A first
word that more suffixes share than a bucket should hold is dealt out by the words that follow as
well, as far as needed. Such hot beginnings are told from a sample; there are at most as many of
each length as buckets (HOT at least). Counts of a beginning shorter than its key are partial and
are summed over the buckets; all others are final where they are counted, and what is below LEAST
goes no further. The sample decides how rows are dealt out, never what counts.

A run holds numbers of its own list of words. Where runs meet, words get numbers in order of their
bytes, so the order of numbers is the order of words, and everything is sorted and compared as arrays.

Defined results: a null text is empty and gives nothing; a null part is UNKNOWN, as is that value
itself; repeated rows count again; ties rank by the phrase's bytes; an empty table, or one without
a phrase of LEAST occurrences, gives no row; other columns are ignored; texts are read whole, in
parts of a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm.bpe import slices
from corpuscle.runtime import Scratch, prepare, table

#: Longest phrase, least occurrences, phrases reported of each part.
WIDTH, LEAST, TOP = 4, 30, 2000
#: A longer phrase that has this share (per cent) of a phrase's occurrences makes it redundant.
COVERED = 80
#: A beginning with more than 1 / HOT of the sampled suffixes is dealt out further; one row in SHARE is sampled.
HOT, SHARE = 512, 128
#: Buckets for each shuffle partition.
SPREAD = 2
UNKNOWN = "und"
#: Words whose suffixes a task sums before it lets them go.
HELD = 1_000_000
#: Odd factors of a key's words, the last one for mixing.
_PLACES = np.random.default_rng(13).integers(0, 1 << 63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


class Words(dict):
    """Numbers of words in order of their first sight, from 1; 0 is the end of a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in parts that run on into each other, a line end after each piece."""
    for part in slices((text or "").encode().lower()):
        yield [w for w in part.translate(_PIECES).replace(b"\n", b" \n ").split(b" ") if w]
    yield [b"\n"]


def suffixes(run: np.ndarray, width: int, waiting: int = 0) -> np.ndarray:
    """(words, width) numbers: the suffix of every word of a run, with zeros after the piece's end; the
    last words wait for what follows."""
    out = np.zeros((len(run), width), np.int64)
    out[:, 0] = run
    for k in range(1, width):
        out[:-k, k] = np.where(out[:-k, k - 1] > 0, run[k:], 0)
    return out[: max(0, len(run) - waiting)][run[: max(0, len(run) - waiting)] > 0]


def unique(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different rows in descending order, their summed counts)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.lexsort(rows.T[::-1])[::-1]
    rows = rows[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[new], np.diff(np.r_[new, len(rows)]) if counts is None else np.add.reduceat(counts[order], new)


def dealt(part: str, rows: np.ndarray, words: list[bytes], hot: frozenset, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, depth: words of the key) of suffixes whose numbers are places in words. A key is the
    shortest beginning that is not hot; the depth is one more than the suffix has words if all are."""
    hashes = np.array([0, *map(xxhash.xxh64_intdigest, words[1:])], np.uint64)
    place = {w: k for k, w in enumerate(words)}
    width = rows.shape[1]
    depth = np.ones(len(rows), np.int64)
    known: list[list[list[int]]] = [[] for _ in range(width)]
    for name, beginning in hot:
        found = [place.get(w, -1) for w in beginning.split(b" ")[:-1]]
        if name == part and min(found) > 0:
            known[len(found) - 1].append(found)
    code = np.zeros(len(rows), np.int64)
    for k in range(width - 1):
        code = code * len(words) + rows[:, k]  # at most three words of a flush, far below 2 ** 63
        if not known[k]:
            break
        codes = [sum(n * len(words) ** (k - i) for i, n in enumerate(f)) for f in known[k]]
        depth[(depth == k + 1) & np.isin(code, codes)] += 1
    key = np.full(len(rows), xxhash.xxh64_intdigest(part.encode()), np.uint64)
    for k in range(width):
        key += np.where(k < depth, hashes[rows[:, k]] * _PLACES[k], np.uint64(0))
    key ^= key >> np.uint64(32)
    key *= _PLACES[-1]
    return ((key >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), depth


def packed(rows: np.ndarray, counts: np.ndarray, words: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Suffixes as numbers of their own words: (words, numbers, counts)."""
    used, own = np.unique(rows, return_inverse=True)
    if used[0]:  # every word has a number above 0
        used, own = np.r_[0, used], own + 1
    return b"\n".join([words[k] for k in used[1:].tolist()]), own.reshape(-1).astype(np.uint32).tobytes(), counts.astype(np.int64).tobytes()


def summed(docs: DataFrame, hot: frozenset, buckets: int, part: str = "lang", width: int = WIDTH) -> DataFrame:
    """(bucket, part, depth, words, numbers, counts): a task's suffixes, equal ones summed, in sorted runs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Words, list[np.ndarray]]] = {}

        def out(open_: str | None = None) -> Iterator[pa.RecordBatch]:
            """What is held; of the part whose text goes on the last words stay."""
            left = {}
            for name, (numbers, runs) in held.items():
                words = sorted(numbers)
                words.remove(b"\n")
                words.insert(0, b"\n")
                rank = np.empty(len(words), np.int64)
                rank[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
                all_ = rank[np.concatenate(runs)]
                waiting = width - 1 if name == open_ else 0
                if waiting:
                    fresh = Words()
                    left[name] = (fresh, [np.array([fresh[words[k]] for k in all_[-waiting:].tolist()], np.int64)])
                rows, counts = unique(suffixes(all_, width, waiting))
                if not len(rows):
                    continue
                bucket, depth = dealt(name, rows, words, hot, buckets)
                order = np.lexsort((depth, bucket))
                at = np.flatnonzero(np.r_[True, (np.diff(bucket[order]) != 0) | (np.diff(depth[order]) != 0)])
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
                    own = order[a:b]
                    blobs = packed(rows[own], counts[own], words)
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int64()), pa.array([name]), pa.array([int(depth[own[0]])], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["bucket", "part", "depth", "words", "numbers", "counts"])
            held.clear()
            held.update(left)

        size = 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                for some in numbered(text.as_py()):
                    words, runs = held.setdefault(name, (Words(), []))
                    runs.append(np.fromiter(map(words.__getitem__, some), np.int64, len(some)))
                    size += len(some)
                    if size > HELD:
                        yield from out(name)
                        size = 0
        yield from out()

    read = docs.select(F.coalesce(F.col(part), F.lit(UNKNOWN)).alias("part"), "text")
    return read.mapInArrow(run, "bucket long, part string, depth int, words binary, numbers binary, counts binary")


def hot_beginnings(docs: DataFrame, buckets: int, scratch: Scratch, part: str = "lang", width: int = WIDTH) -> frozenset:
    """(part, beginning) of too many suffixes for one task, told from a sample of the rows."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            held: dict[str, tuple[Words, list[np.ndarray]]] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                numbers, runs = held.setdefault(name, (Words(), []))
                runs += [np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)) for some in numbered(text.as_py())]
            for name, (numbers, runs) in held.items():
                words, rows = list(numbers), suffixes(np.concatenate(runs), width)
                for k in range(1, width):
                    some, n = unique(rows[rows[:, k - 1] > 0, :k])
                    found += [(name, b"".join(words[i] + b" " for i in one), k, c) for one, c in zip(some.tolist(), n.tolist())]
            names, heads, ks, ns = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(heads, pa.binary()), pa.array(ks, pa.int32()), pa.array(ns, pa.int64())], names=["part", "head", "k", "n"])

    some = docs.filter(F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(SHARE)) == 0)
    read = some.select(F.coalesce(F.col(part), F.lit(UNKNOWN)).alias("part"), "text")
    counts = scratch.write(read.mapInArrow(run, "part string, head binary, k int, n long").groupBy("part", "head", "k").agg(F.sum("n").alias("n")), "sample")
    all_ = counts.filter("k = 1").agg(F.sum("n")).first()[0] or 0
    most = max(HOT, buckets)  # so many beginnings of each length at most have more than 1 / most of all: what is collected is bounded
    out = frozenset((r.part, bytes(r.head)) for r in counts.filter(F.col("n") > all_ / most).select("part", "head").collect())
    scratch.drop("sample")
    return out


def beginnings(rows: np.ndarray, counts: np.ndarray, depth: int, least: int) -> Iterator[tuple[list[int], int, int]]:
    """(numbers of a beginning, its words, n) of different suffixes in descending order: those with least
    occurrences, and all that are shorter than the key's words, whose counts are partial."""
    for k in range(1, rows.shape[1] + 1):
        some = np.flatnonzero(rows[:, k - 1] > 0)
        if not len(some):
            break
        own = rows[some, :k]
        opens = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])  # neighbours part here
        total = np.add.reduceat(counts[some], opens)
        kept = np.arange(len(opens)) if k < depth else np.flatnonzero(total >= least)
        yield from zip(own[opens[kept]].tolist(), [k] * len(kept), total[kept].tolist())


def merged(runs: Iterator[tuple[bytes, bytes, bytes]], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, suffixes, counts) of a bucket's runs, words in order of bytes, suffixes descending."""
    numbers, rows, counts = Words(), [], []
    for words, own, n in runs:
        place = np.array([0, *map(numbers.__getitem__, words.split(b"\n"))], np.int64)
        rows.append(place[np.frombuffer(own, np.uint32)].reshape(-1, width))
        counts.append(np.frombuffer(n, np.int64))
    order = sorted(w for w in numbers if w != b"\n")
    rank = np.zeros(len(numbers), np.int64)
    rank[np.fromiter(map(numbers.__getitem__, order), np.int64, len(order))] = np.arange(1, len(order) + 1)
    return [b"\n", *order], *unique(rank[np.concatenate(rows)], np.concatenate(counts))


def counted(rows: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(part, phrase, k: its words, n) of beginnings with least occurrences at least, those whose
    counts are partial included; and (part, null, 0, n) with numbers of suffixes."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns[:3]], *b.columns[3:]))
        for (_, part, depth), own in groupby(all_, key=lambda row: row[:3]):
            words, found, n = merged((tuple(x.as_py() for x in row[3:]) for row in own), width)
            got = [(b" ".join(words[i] for i in one), k, c) for one, k, c in beginnings(found, n, depth, least)]
            phrase, k, c = zip(*got, (None, 0, int(n.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(k)), pa.array(phrase, pa.binary()), pa.array(k, pa.int32()), pa.array(c, pa.int64())], names=["part", "phrase", "k", "n"])

    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket", "part", "depth")
    return sorted_.mapInArrow(run, "part string, phrase binary, k int, n long")


def phrase_counts(docs: DataFrame, scratch: Scratch, part: str = "lang", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(part, phrase, k, n) of all phrases of up to width words with least occurrences at least, and
    the number of words of each part under a null phrase."""
    buckets = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_beginnings(docs, buckets, scratch, part, width)
    counts = scratch.write(counted(summed(docs, hot, buckets, part, width), width, least), "counts")
    return counts.groupBy("part", "phrase", "k").agg(F.sum("n").alias("n")).filter((F.col("k") == 0) | (F.col("n") >= least))


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, part: str = "lang", width: int = WIDTH, least: int = LEAST, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): of each part the first phrases by score."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    all_ = scratch.write(phrase_counts(docs, scratch, part, width, least).withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    scratch.drop("counts")
    counts, words = all_.filter("k > 0"), all_.filter("k = 0").select("part", F.col("n").alias("total"))
    candidates = counts.filter("k > 1").withColumnRenamed("n", "a")
    many = candidates.withColumn("w", F.split("phrase", " "))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # longer phrases speak against what stands inside them
    inside = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: joined(a, n)))), lambda s: s.isNotNull())
    covered = many.filter("k > 2").select("part", F.explode(inside).alias("phrase"), "a").groupBy("part", "phrase").agg(F.max("a").alias("longer"))
    left = many.join(scratch.write(covered, "covered"), ["part", "phrase"], "left").filter(F.coalesce(_big(F.col("longer")) * 100 < _big(F.col("a")) * COVERED, F.lit(True)))
    cuts = left.select("part", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = scratch.write(cuts.select("part", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail")), "cuts")
    of = lambda name, n: counts.select("part", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(of("head", "l"), ["part", "head"]).join(of("tail", "r"), ["part", "tail"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least_ = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    scored = both.groupBy("part", "phrase", "a").agg(least_).select("part", "phrase", "a", "least.l", "least.r", "least.score")
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return first.join(words, "part").select("part", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).withColumnRenamed("part", "lang")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
suffixes AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM suffixes, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 30),
covered AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS sub
    FROM candidates, range(2, 4) p(m), range(1, 4) q(s) WHERE m < k AND s + m - 1 <= k) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, t.cut FROM candidates c LEFT JOIN covered v ON c.lang = v.lang AND c.phrase = v.sub, range(1, 4) t(cut)
  WHERE t.cut < c.k AND (longer IS NULL OR 100 * longer < 80 * c.a)),
scored AS (
  SELECT c.lang, c.phrase, c.a, min({'score': (2000000::HUGEINT * c.a) // (x.f + y.f), 'cut': cut, 'l': x.f, 'r': y.f}) AS least
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
    JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 : c.k], ' ') GROUP BY ALL),
ranked AS (
  SELECT lang, phrase, a, least.l AS l, least.r AS r, least.score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY least.score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
