"""Token counts with a whole-token shortcut.

Offline (once, on the driver, whose result is broadcast), every vocabulary string that ends a word
is encoded alone; those that come out as one token form the proven set. A pre-token in that set counts one without a merge; only the rest is
merged. Text is cut at ASCII white space first, which no pre-token of this tokenizer family
crosses, and each chunk's count is remembered.

Defined results: a null text counts as empty and has no tokens; the strings of added special
tokens count one each wherever they stand, as the library handles them by default; no
truncation or padding; repeated rows get equal rows; an empty table gives no row; texts above a
megabyte are counted in parts that end before a space; columns of the input pass through unless an
output has the same name, which then replaces it.

Characters that Unicode 3.2 does not assign can differ in class or case between the versions of
Unicode that the library and Python carry, so a chunk that holds one is counted by the library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpuscle.llm.bpe import _NONE, _mapped, _Memo, slices
from corpuscle.runtime import prepare


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _unstable() -> re.Pattern:
    """Matches characters that Unicode 3.2 does not assign; surrogates cannot occur."""
    old, spans, start = unicodedata.ucd_3_2_0.category, [], None
    for c in range(0x80, 0x110001):
        new = c < 0x110000 and old(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols remain after all merges, lowest rank first and leftmost first."""
    n = left = len(symbols)
    part, get, none = list(symbols), ranks.get, _NONE
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [get(p, none) for p in zip(part, part[1:])] + [none]  # rank with the next part
    heap = [r << 32 | i for i, r in enumerate(pair) if r != none]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:  # one of the two parts has changed since
            continue
        left -= 1
        j = after[i]
        part[i] += part[j]
        k = after[i] = after[j]
        pair[j] = none
        if k < n:
            before[k] = i
            r = pair[i] = get((part[i], part[k]), none)
            if r != none:
                push(heap, r << 32 | i)
        else:
            pair[i] = none
        h = before[i]
        if h >= 0:
            r = pair[h] = get((part[h], part[i]), none)
            if r != none:
                push(heap, r << 32 | h)
    return left


class Counter:
    """Counts the tokens of texts for a tokenizers file of the word-end BPE kind."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(pairs)}
        self.letter = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.unstable = _unstable()
        self.whole = self.prove(model["vocab"]) if whole is None else whole
        self.chunks: dict[bytes, int] = _Memo(self._chunk)
        self.words: dict[str, int] = _Memo(self._word)

    def symbols(self, piece: str) -> list[str]:
        out = [self.letter[b] for b in piece.encode()]
        out[-1] += self.end
        return out

    def prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """The pre-tokens that encode alone as one token, as text."""
        byte_of = {c: b for b, c in enumerate(self.letter)}
        proven = []
        for entry in vocab:
            if not entry.endswith(self.end) or entry == self.end:
                continue
            try:
                word = bytes(byte_of[c] for c in entry[: -len(self.end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not the whole of any text
            if merge_count(self.symbols(word), self.ranks) == 1:
                proven.append(word)
        return frozenset(proven)

    def _word(self, word: str) -> int:
        return 1 if word in self.whole else merge_count(self.symbols(word), self.ranks)

    def _plain(self, text: str) -> int:
        if self.unstable.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        # the library lowers each character alone, without the rule for a final sigma
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.words.__getitem__, self.find(low)))

    def _chunk(self, raw: bytes) -> int:
        text = raw.decode()
        if self.special is None or not (found := self.special.findall(text)):
            return self._plain(text)
        return len(found) + sum(map(self._plain, filter(None, self.special.split(text))))

    def count(self, raw: bytes) -> int:
        """Tokens of a whole UTF-8 text."""
        return sum(sum(map(self.chunks.__getitem__, part.split())) for part in slices(raw))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    """This process's counter for a file; proven here unless the proven set is given."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes (of the text in UTF-8), n_tokens and over_limit (n_tokens above limit)."""
    proven = prepare(df.sparkSession).sparkContext.broadcast(counter(path).whole)  # words of a vocabulary
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = counter(path, proven.value)
        raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        n = [own.count(x or b"") for x in raw]
        return [pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]

    return _mapped(df, added, make)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
