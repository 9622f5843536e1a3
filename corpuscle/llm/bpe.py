"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the whole vocabulary: a pre-token that is itself a
vocabulary entry resolves to its id with one hash and one comparison. Tier two is for the rest:
a heap of candidate merges over a doubly linked list of bytes, so that a piece of n bytes costs
n log n however long it is.

The tables are built once, on the driver, and broadcast. Letters and digits of a Unicode version
newer than the pattern's own stand for symbols there, so they are shown to the pattern as such.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty
string; special-token strings are ordinary text; repeated rows get equal rows; columns of the
input other than the text pass through, unless an output has the same name, which then replaces
it; an empty table gives no row. Texts above a megabyte are cut before a single space between two
other characters, which no match of FAMILY crosses; under any other pattern they are matched whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.runtime import prepare

_M64 = (1 << 64) - 1
#: Above any rank: the pair does not merge.
_NONE = 1 << 31
#: The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern of this family of tokenizers; no match of it crosses the cuts below.
FAMILY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits newer than Unicode 16, which are symbols to the library.
NEWER = re.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Text under FAMILY is cut here first.
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A space between two other characters: text can be cut before it.
CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Characters (or bytes) of a text that are worked on at once, which bounds a long text's memory.
SLICE = 1 << 20
#: Entries that a worker remembers for units and for pieces, each; forgotten all at once.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by displaced buckets: n keys, n slots, each key checked on lookup."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        parts: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key, 0)
            parts[h % self.buckets].append((h, k))
        slots = [-1] * n
        self.shift = [0] * self.buckets
        order = sorted((b for b in range(self.buckets) if parts[b]), key=lambda b: -len(parts[b]))
        free = 0
        for b in order:
            if len(parts[b]) == 1:  # a lone key takes any free slot; the shift names it directly
                while slots[free] >= 0:
                    free += 1
                slots[free], self.shift[b] = parts[b][0][1], -free - 1
                continue
            d = 1
            while True:
                at = [self._slot(h, d) for h, _ in parts[b]]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            for s, (_, k) in zip(at, parts[b], strict=True):
                slots[s] = k
            self.shift[b] = d
        self.keys = [keys[k] if k >= 0 else None for k in slots]
        self.values = [values[k] if k >= 0 else -1 for k in slots]

    def _slot(self, h: int, d: int) -> int:
        h = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _M64
        return (h ^ (h >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1 if it is not in the table."""
        h = xxhash.xxh64_intdigest(key, 0)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by lowest-rank merges, leftmost first: a heap over linked bytes."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get, none = ranks.get, _NONE
    after, before = list(range(1, n + 1)), list(range(-1, n))  # a part at i is piece[i : after[i]]
    pair = [get(piece[i : i + 2], none) for i in range(n - 1)] + [none]  # rank with the next part
    heap = [r << 32 | i for i, r in enumerate(pair) if r != none]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:  # one of the two parts has changed since
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = none
        if k < n:
            before[k] = i
            r = pair[i] = get(piece[i : after[k]], none)
            if r != none:
                push(heap, r << 32 | i)
        else:
            pair[i] = none
        h = before[i]
        if h >= 0:
            r = pair[h] = get(piece[h:k], none)
            if r != none:
                push(heap, r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """One vocabulary and pattern, ready to encode texts and decode ids."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        self.ranks, self.whole, self.pattern = ranks, whole, regex.compile(pattern)
        self.find, self.cuts = self.pattern.findall, pattern == FAMILY
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.table[v] = k
        self.units: dict[str, bytes] = _Memo(self._unit)
        self.pieces: dict[str, bytes] = _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        one = self.whole.get(raw)
        return array("I", [one] if one >= 0 else merge_bytes(raw, self.ranks)).tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii() and NEWER.search(unit):
            shown = NEWER.sub("\u00a7", unit)  # a symbol in every version
            return b"".join([self.pieces[unit[m.start() : m.end()]] for m in self.pattern.finditer(shown)])
        return b"".join([self.pieces[p] for p in self.find(unit)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.cuts:
            return self._unit(text)
        if len(text) <= SLICE:
            return b"".join(map(self.units.__getitem__, UNIT.findall(text)))
        out, start = [], 0
        while start < len(text):
            cut = CUT.search(text, start + SLICE)
            stop = cut.start() if cut else len(text)
            out.append(b"".join(map(self.units.__getitem__, UNIT.findall(text[start:stop]))))
            start = stop
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, array("I", ids)))


def slices(raw: bytes) -> Iterator[bytes]:
    """A UTF-8 text in parts that end before a space."""
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + SLICE)
        stop = stop if stop >= 0 else len(raw)
        yield raw[start:stop] if start or stop < len(raw) else raw
        start = stop


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        out = self.make(key)
        if len(key) <= 64:
            self[key] = out
        return out


_CODECS: dict[tuple[str, str], Codec] = {}
_BUILT: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec for a vocabulary file; built once in a process."""
    if (path, pattern) not in _BUILT:
        ranks = load_ranks(path)
        _BUILT[path, pattern] = Codec(ranks, PerfectHash(list(ranks), list(ranks.values())), pattern)
    return _BUILT[path, pattern]


def shared(spark: SparkSession, path: str, pattern: str):
    """A function that gives workers the codec: its tables are built here and broadcast, some 50,000
    entries of a vocabulary."""
    own = codec(path, pattern)
    tables = spark.sparkContext.broadcast((own.ranks, own.whole, pattern))

    def get() -> Codec:
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = Codec(*tables.value)
        return _CODECS[path, pattern]

    return get


def _mapped(df: DataFrame, added: list[T.StructField], make) -> DataFrame:
    """df with columns made batch by batch; make(batch) gives the added arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + added)
    arrow, names = to_arrow_schema(schema), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + make(batch)
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (binary, little-endian unsigned 32-bit; only if keep_ids), ids_sha256 and
    decoded_sha256, the digest of the bytes that decoding the ids gives."""
    get = shared(prepare(df.sparkSession), path, pattern)
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids", T.BinaryType())] * keep_ids
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = get()
        n, ids, a, b = [], [], [], []
        for value in batch.column(batch.schema.get_field_index(text)):
            raw = own.encode(value.as_py())
            n.append(len(raw) // 4)
            ids += [raw] * keep_ids
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(own.decode(raw)).hexdigest())
        return [pa.array(n, pa.int64()), *([pa.array(ids, pa.binary())] * keep_ids), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _mapped(df, added, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that binary ids stand for; ids that end within a character give U+FFFD there,
    null ids give null."""
    get = shared(prepare(df.sparkSession), path, pattern)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = get()
        raw = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return [pa.array([None if x is None else own.decode(x).decode("utf-8", "replace") for x in raw], pa.string())]

    return _mapped(df, [T.StructField(text, T.StringType())], make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
