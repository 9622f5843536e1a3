"""Near-duplicates by SetSketch registers of word shingles.

A document's set of shingles is summed up in REGISTERS registers. Register i holds the least of
exponential variates, one of each shingle, on an exponential scale: floor(1 - log_B(least)),
truncated to 16 bits. Registers of a union are the larger registers (merge), and two sets have
equal registers about as often as their Jaccard similarity says.

Documents of one set are one class, and classes are what is compared. Each class has BANDS keys of
ROWS registers; classes that share a key meet. Within a bucket, pairs whose sizes differ too far
are left out, the similarity of the others is estimated from the numbers of larger, smaller and
equal registers together, by maximum likelihood given both sizes, and pairs estimated within
reach are verified on their full sets. A pair at the threshold shares a key with a probability of
1 - 2e-9, and the estimate's margin is 4.5 standard deviations.

A pair is verified once, in the first band that it shares, and not at all where links of the same
bucket connect it already, or links of the FIRST bands, whose components are found beforehand:
what they leave are buckets with several components, so large groups of copies are over by then.
Sketches alone tell which classes of a bucket have a partner to verify; only these classes' sets,
made again from their texts, are sent there. Buckets above SPLIT classes are cut into parts, the
largest component and the rest by themselves, and only parts with pairs of two components meet.

Defined results: words are lower-cased from A-Z only; a text with fewer words than a shingle is one
shingle; null texts and texts without words have no shingle and are linked with nothing; equal rows
get equal results; rows without a doc_id take part but are never a component's id unless all its
rows lack one; kept tells whether doc_id is the component's (two nulls are equal); an empty table
gives no row; other columns are ignored; texts are read whole, in parts of a megabyte, and one
text's shingle hashes are held in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import hamming
from corpuscle.llm.bpe import _Memo as Memo
from corpuscle.llm.bpe import slices
from corpuscle.llm.components import components
from corpuscle.runtime import Scratch, prepare, table

#: Words of a shingle; similarity in per cent from which documents are linked.
SHINGLE, SIMILAR = 3, 85
#: Registers, and how many make a band's key: BANDS keys use all but the last few registers.
REGISTERS, ROWS = 256, 6
BANDS = REGISTERS // ROWS
#: Base and rate of the exponential scale, and its largest value.
B, RATE, LARGEST = 1.001, 20.0, 65535
#: Standard deviations below the threshold that an estimate may have.
MARGIN = 4.5
#: Bands whose components are found before the rest; classes of a bucket above which it is cut.
FIRST, SPLIT = 3, 256
#: Classes joined by broadcast, at most; classes up to which the list of wanted sets is broadcast, so that
#: the texts need no shuffle.
LARGE, WANTED = 10_000, 250_000
_RNG = np.random.default_rng(1203)
_TIMES, _PLUS = _RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
#: Odd factors of a shingle's places, the last one for mixing; hashes of words met so far.
_PLACES = _RNG.integers(0, 1 << 63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = Memo(xxhash.xxh64_intdigest)
#: Shingles worked on at once.
_CHUNK = 256


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: sums of the words' hashes times a factor for each
    place, mixed. Words are hashed once and remembered."""
    parts, kept = [], []
    for part in slices((text or "").encode().lower()):
        words = kept + part.split()  # shingles run on from one part into the next
        n = len(words) - width + 1
        kept = words[-(width - 1) :] if width > 1 else []
        if n < 1:
            continue
        word = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        own = word[:n] * _PLACES[0]
        for k in range(1, width):
            own += word[k : n + k] * _PLACES[k % 8] + np.uint64(k)
        own ^= own >> np.uint64(32)
        own *= _PLACES[-1]
        own ^= own >> np.uint64(29)
        parts.append(np.unique(own))
    if parts:
        return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return np.array([xxhash.xxh64_intdigest(b" ".join(kept))] if kept else [], np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; all zero for the empty set. A register's variate comes from 32 bits,
    which for sets of many millions can only make registers more often equal."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least, high = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(high), _CHUNK):
        x = np.multiply.outer(high[a : a + _CHUNK], _TIMES)
        x += _PLUS
        np.minimum(least, x.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(more: np.ndarray, fewer: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of n and m elements of whose registers so many are
    larger and so many smaller than the other's."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    u, v, same = n / (n + m), m / (n + m), REGISTERS - more - fewer
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)
    slope = lambda x: (B - 1) / B / np.log(B) / (1 - x * (B - 1) / B)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave: its slope tells on which side the best value is
        j = (low + high) / 2
        a, b = u - v * j, v - u * j
        pa_, pb = p(a), p(b)
        up = -more * v * slope(a) / pa_ - fewer * u * slope(b) / pb + same * (v * slope(a) + u * slope(b)) / np.maximum(1 - pa_ - pb, 1e-12)
        low, high = np.where(up > 0, j, low), np.where(up > 0, high, j)
    return (low + high) / 2


def sketched(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(row, rid: which text, doc_id, n, key: digest of the set, sketch) of every row; key and sketch
    are null where there is no shingle."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sketch = [], [], []
            for t in b.column(3):
                own = shingles(t.as_py(), width)
                n.append(len(own))
                key.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                sketch.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], names=["row", "rid", "doc_id", "n", "key", "sketch"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text").mapInArrow(run, f"row long, rid long, doc_id {kind}, n long, key binary, sketch binary")


def sets(docs: DataFrame, keys: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, set) of keys (rid, node, key): the sets of these classes, from a text of each."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.as_py(), width).tobytes() for t in b.column(2)]
            right = [k.as_py() == xxhash.xxh128_digest(s) for k, s in zip(b.column(1), own)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(right)), pa.array([s for s, r in zip(own, right) if r], pa.binary())], names=["node", "set"])

    keys = F.broadcast(keys) if keys.count() <= WANTED else keys
    same = keys.join(docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text"), "rid")
    return same.select("node", "key", "text").mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def reach(n: np.ndarray, m: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= similar * np.maximum(n, m)


def _screened(i: int, rest: np.ndarray, band: int, n: np.ndarray, sketch: np.ndarray, similar: int) -> np.ndarray:
    """Those of rest whose first band in common with i is this one and whose estimate is in reach."""
    at_least = similar / 100 - MARGIN * (similar * (100 - similar) / 1e4 / REGISTERS) ** 0.5
    a, b = sketch[i], sketch[rest]
    equal = (a == b)[:, : BANDS * ROWS].reshape(len(rest), BANDS, ROWS).all(axis=2)
    new = equal.argmax(axis=1) == band
    rest, b = rest[new], b[new]
    if not len(rest):
        return rest
    return rest[estimate((a > b).sum(axis=1), (a < b).sum(axis=1), n[i], n[rest]) >= at_least]


def _partners(comp: np.ndarray, n: np.ndarray, side: np.ndarray, similar: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a bucket, by size, the larger ones that it may be linked to: of another component,
    of the other side (unless there are none) and not too large."""
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    for at, i in enumerate(order.tolist()):
        rest = order[at + 1 : np.searchsorted(sizes, n[i] * 100 // similar, side="right")]
        rest = rest[(comp[rest] != comp[i]) & ((side[rest] < 0) | (side[rest] != side[i]))]
        if len(rest):
            yield i, rest


def bucket_partners(band: int, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, side: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Which rows of a bucket have a partner to verify."""
    found = np.zeros(len(n), bool)
    for i, rest in _partners(comp, n, side, similar):
        near = _screened(i, rest, band, n, sketch, similar)
        found[near] = True
        found[i] |= len(near) > 0
    return found


def bucket_links(band: int, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, side: np.ndarray, own: list[bytes], similar: int = SIMILAR, counts: dict | None = None) -> list[tuple[int, int]]:
    """Links (by position) of one bucket that connect what is not connected: a spanning forest of
    those whose first shared band is this one."""
    names, group = np.unique(comp, return_inverse=True)
    whole: dict[int, np.ndarray] = {}
    members = {g: [g] for g in range(len(names))}
    root = np.arange(len(names))
    links = []
    of = lambda i: whole.setdefault(i, np.frombuffer(own[i], np.uint64))
    for i, rest in _partners(comp, n, side, similar):
        rest = rest[root[group[rest]] != root[group[i]]]
        for j in _screened(i, rest, band, n, sketch, similar).tolist() if len(rest) else ():
            x, y = int(root[group[i]]), int(root[group[j]])
            if x == y:
                continue
            if counts is not None:
                counts["verified"] = counts.get("verified", 0) + 1
            both = len(np.intersect1d(of(i), of(j), assume_unique=True))
            if 100 * both >= similar * (n[i] + n[j] - both):
                links.append((i, j))
                if len(members[x]) < len(members[y]):
                    x, y = y, x
                root[members[y]] = x
                members[x] += members.pop(y)
    return links


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of rows that come in order of bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        bucket = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != int(bucket[a]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spread(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (bucket, band, node, comp) with buckets above SPLIT rows cut into parts, and a side: pairs of
    two sides count, and within a bucket without sides (-1) all do. The largest component's rows do
    not meet each other. Which buckets are large is told from one row in hamming.SHARE."""
    some = rows.filter(F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(hamming.SHARE)) == 0).groupBy("bucket", "comp").agg((F.count("*") * hamming.SHARE).alias("k"))
    sizes = some.groupBy("bucket").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("main")).filter(F.col("all") > SPLIT)
    parts = lambda k: F.greatest(F.ceil(k / SPLIT), F.lit(1)).cast("int")
    hot = scratch.write(sizes.select("bucket", F.col("main.comp").alias("main"), parts(F.col("main.k")).alias("p"), parts(F.col("all") - F.col("main.k")).alias("q")), name)
    large = hot.count()
    if not large:
        return rows.withColumn("side", F.lit(-1))
    cut = rows.join(F.broadcast(hot) if large <= hamming.BROADCAST_ROWS else hot, "bucket", "left")
    at = lambda of: F.pmod(F.xxhash64(F.lit(6), "node"), of).cast("int")
    meet = lambda kind, i, j, side: F.struct(F.xxhash64("bucket", F.lit(kind), i, j).alias("bucket"), side.cast("int").alias("side"))
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    mine = at(F.col("q"))
    with_main = F.transform(upto(F.col("p")), lambda i: meet(0, i, mine, F.lit(1)))
    with_rest = F.transform(upto(F.col("q")), lambda j: meet(1, F.least(mine, j), F.greatest(mine, j), F.when(mine == j, -1).otherwise((mine > j).cast("int"))))
    places = (
        F.when(F.col("main").isNull(), F.array(F.struct("bucket", F.lit(-1).alias("side"))))
        .when(F.col("comp") == F.col("main"), F.transform(upto(F.col("q")), lambda j: meet(0, at(F.col("p")), j, F.lit(0)))).otherwise(F.concat(with_main, with_rest))
    )
    return cut.select("band", "node", "comp", F.explode(places).alias("at")).select("at.bucket", "band", "node", "comp", "at.side")


def links(rows: DataFrame, nodes: DataFrame, full: DataFrame, scratch: Scratch, name: str, similar: int = SIMILAR) -> DataFrame:
    """(a, b) of rows (bucket, band, node, comp) by nodes (node, n, sketch) and full (node, set)."""

    def columns(b: pa.RecordBatch) -> list:
        return [int(b.column(1)[0].as_py()), *(b.column(k).to_numpy() for k in (3, 4)), np.stack([np.frombuffer(s.as_py(), np.uint16) for s in b.column(6)]), b.column(5).to_numpy()]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _buckets(batches):
            if len(b) > 1 and (found := bucket_partners(*columns(b), similar)).any():
                yield b.filter(pa.array(found))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _buckets(batches):
            if found := bucket_links(*columns(b), b.column(7).to_pylist(), similar) if len(b) > 1 else []:
                i, j = map(list, zip(*found))
                node = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    shape = ["bucket", "band", "node", "comp", "n", "side", "sketch"]
    kinds = "bucket long, band int, node long, comp long, n long, side int, sketch binary"
    near = spread(rows, scratch, f"{name}-hot").join(nodes, "node").select(*shape).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(screen, kinds)
    near = scratch.write(near, f"{name}-screened")
    both = near.join(full, "node").select(*shape, "set").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "a long, b long")
    out = scratch.write(both, name)
    scratch.drop(f"{name}-screened")
    return out


def _several(rows: DataFrame, column: str, scratch: Scratch, name: str) -> DataFrame:
    """rows of those buckets that hold several values of the column. The list of these buckets is
    written, so that the join can split a bucket with very many rows."""
    found = rows.groupBy("bucket").agg(F.min(column).alias("x"), F.max(column).alias("y")).filter("x < y").select("bucket")
    return rows.join(scratch.write(found, name), "bucket", "left_semi")


def classes(docs: DataFrame, own: DataFrame, scratch: Scratch, width: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(key, n_rows, first) of every class: the first row that links reach from it, itself included."""
    prepare(docs.sparkSession)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "rid")
    known = scratch.write(own.filter("key is not null").groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("n_rows")), "classes")
    nodes = scratch.write(own.join(known.select(F.col("first.row").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch"), "sketches")
    key = lambda k: F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS))
    keyed = nodes.select("node", F.posexplode(F.array(*map(key, range(BANDS)))).alias("band", "bucket"))
    live = scratch.write(_several(scratch.write(keyed, "keys"), "node", scratch, "met"), "live")
    scratch.drop("keys")
    wanted = scratch.write(known.select(F.col("first.row").alias("node"), F.col("first.rid").alias("rid"), "key").join(live.select("node").distinct(), "node", "left_semi"), "wanted")
    full = scratch.write(sets(docs, wanted, width), "sets")
    near = links(live.filter(F.col("band") < FIRST).withColumn("comp", F.col("node")), nodes, full, scratch, "near", similar)
    comp = scratch.write(components(near, scratch, "near-components"), "near-groups")
    rest = live.filter(F.col("band") >= FIRST).join(comp, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("comp"))
    more = links(_several(scratch.write(rest, "rest"), "comp", scratch, "still"), nodes, full, scratch, "more", similar)
    for name in ("sets", "live", "rest"):
        scratch.drop(name)
    # of the later links only those between components of the first matter
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    joined = components(between, scratch).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    by_node = known.select(F.col("first.row").alias("node"), "key", "first", "n_rows").join(comp, "node", "left").withColumn("part", F.coalesce("component", "node")).join(joined, "part", "left")
    by_node = scratch.write(by_node.select("key", "first", "n_rows", F.coalesce("whole", "part").alias("component")), "grouped")
    least = by_node.groupBy("component").agg(F.min("first").alias("least"))
    return by_node.join(scratch.write(least, "least"), "component").select("key", F.col("least").alias("first"), "n_rows")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, width: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "setsketch")
    docs = docs.select("doc_id", "text")
    own = scratch.write(sketched(docs, width), "rows")
    known = scratch.write(classes(docs, own, scratch, width, similar).select("key", "n_rows", F.col("first.doc_id").alias("component_id")), "known")
    large = known.filter(F.col("n_rows") > max(1, own.count() // LARGE)).select("key", F.col("component_id").alias("_large"))  # at most LARGE
    out = own.select("doc_id", "n", "key").join(F.broadcast(large.withColumn("_found", F.lit(True))), "key", "left")
    rest = out.filter("_found is null").select("doc_id", "n", "key").join(known.select("key", "component_id"), "key", "left")
    alone = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    every = out.filter("_found").select("doc_id", "n", "key", F.col("_large").alias("component_id")).unionByName(rest)
    return every.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), alone.eqNullSafe(F.col("doc_id")).alias("kept"))


def op12_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
elements AS (SELECT id, n, unnest(s) AS e FROM classes),
pairs AS (
  SELECT a.id AS x, b.id AS y FROM elements a JOIN elements b ON a.e = b.e AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT id, id FROM classes UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.y, d.doc_id) AS component_id, d.doc_id = coalesce(r.y, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = c.id
"""
