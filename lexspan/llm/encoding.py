"""Problem 8: encoding of texts with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every prefix of a piece's bytes there is exactly one token that can end its encoding: the token that ends there, whose
own bytes encode to itself and that is compatible with the token that ends the remaining prefix. Storing that last token
for every prefix gives the encoding in linear time, makes appends exact without starting over, and lets an edit near the
end keep the table up to the edit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexspan.sources.tables import table

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that divides a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's caches; they are emptied beyond it. Longer pieces than CACHED_CHARS are not kept.
CACHE_ENTRIES, CACHED_CHARS = 150_000, 40


class Vocabulary:
    """Tokens by their bytes, and the pairs of tokens that may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        # Ends of tokens' left parts and starts of their right parts, at each place where a character may begin inside a token.
        self._seams: set[tuple[bytes, bytes]] = set()
        for b in ranks:
            for k in range(1, len(b)):
                if b[k] & 0xC0 != 0x80:
                    self._seams.add((self._last_char(b[:k]), self._first_char(b[k:])))
        self._joined: dict[str, bool] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """From lines of `base64 rank`."""
        return cls({base64.b64decode(a): int(n) for a, n in map(bytes.split, data.splitlines())})

    @staticmethod
    def _last_char(b: bytes) -> bytes:
        k = len(b) - 1
        while k > 0 and b[k] & 0xC0 == 0x80:
            k -= 1
        return b[k:]

    @staticmethod
    def _first_char(b: bytes) -> bytes:
        k = 1
        while k < len(b) and b[k] & 0xC0 == 0x80:
            k += 1
        return b[:k]

    def joined(self, two: str) -> bool:
        """Whether some token may reach across the boundary of two characters; if none does, the encoding divides there."""
        known = self._joined.get(two)
        if known is None:
            a, b = two[0].encode("utf-8", "replace"), two[1].encode("utf-8", "replace")
            lefts = [a[k:] for k in range(len(a))]
            known = self._joined[two] = any((x, b[:k]) in self._seams for x in lefts for k in range(1, len(b) + 1))
            if len(self._joined) > 4 * CACHE_ENTRIES:
                self._joined.clear()
        return known

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: the pair of lowest rank is merged first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether a token's bytes encode to the token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to a, b."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self._pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self._pairs) > 4 * CACHE_ENTRIES:
                self._pairs.clear()
        return known


class PrefixTable:
    """The last token of every prefix of some bytes; grows by appends and can be cut back for an edit."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Lengthen the bytes; earlier entries stay as they are."""
        v, start = self.vocabulary, len(self.data)
        self.data += more
        data, last, ranks = self.data, self.last, v.ranks
        for i in range(start + 1, len(data) + 1):
            for k in range(max(0, i - v.longest), i):
                t = ranks.get(data[k:i])
                if t is not None and (v.whole(t) if k == 0 else last[k] >= 0 and v.compatible(last[k], t) and v.whole(t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put `new` in the place of data[start:end]; the table up to start is kept."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        return self.append(new + rest)

    def ids(self) -> list[int]:
        """The tokens, found backwards from the last prefix."""
        out, i = [], len(self.data)
        while i:
            t = self.last[i]
            out.append(t)
            i -= len(self.vocabulary.tokens[t])
        return out[::-1]


class _Pieces(dict):
    """Ids by piece of the pattern, found when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        v = self.vocabulary
        t = v.ranks.get(piece.encode("utf-8", "replace"))
        if t is not None and v.whole(t):
            ids: tuple[int, ...] = (t,)
        elif piece.isascii():
            ids = tuple(PrefixTable(v, piece.encode()).ids())
        else:
            cuts = [0, *(i for i in range(1, len(piece)) if not v.joined(piece[i - 1 : i + 1])), len(piece)]
            if len(cuts) > 2:
                ids = tuple(chain.from_iterable(self[piece[a:b]] for a, b in zip(cuts, cuts[1:])))
            else:
                ids = tuple(PrefixTable(v, piece.encode("utf-8", "replace")).ids())
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class _Chunks(dict):
    """Ids by chunk of text between single spaces; `lead` stands before each chunk."""

    def __init__(self, pieces: _Pieces, lead: str):
        super().__init__()
        self.pieces, self.lead, self.find = pieces, lead, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pieces
        ids = tuple(chain.from_iterable([pieces[p] for p in self.find(self.lead + chunk)]))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts; strings that look like special tokens are ordinary text."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = _Pieces(vocabulary)
        self.first, self.later = _Chunks(self.pieces, ""), _Chunks(self.pieces, " ")
        self.uneven = regex.compile(r" \s|\s ").search
        self.divide = regex.compile(r"(?<=\S) (?=\S)").split

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids by chunk. The pattern always divides before a single space between other characters."""
        if text[:1].isspace() or text[-1:].isspace() or self.uneven(text):
            chunks = self.divide(text)
        else:
            chunks = text.split(" ")
        yield self.first[chunks[0]]
        yield from map(self.later.__getitem__, chunks[1:])

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.parts(text)), dtype=np.int32) if text else np.empty(0, np.int32)

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text))) if text else 0


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """This process's encoder of a vocabulary; it outlives the task."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary.parse(data))
    return _ENCODERS[key]


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """(id, ids) of every row: an empty text gives an empty list, a null text null; white space is kept.

    One narrow pass without a shuffle; the vocabulary (a file of under 1 MB) goes to the workers once. Texts of any length
    take time in proportion. Repeated rows and null ids come out as they went in. A lone surrogate is read as `?`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(sent.value).encode
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 512):
                part = texts.slice(lo, 512)
                arrays = [None if t is None else encode(t) for t in part.to_pylist()]
                sizes = np.array([0, *(0 if a is None else len(a) for a in arrays)])
                offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.array([*(a is None for a in arrays), False]))
                values = np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), lists], names=[id_column, "ids"])

    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, ids array<int>"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, keep: list[str], text_column: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """The columns `keep` and `tokens`, the number of ids of the text (0 for null)."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder_of(sent.value).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = [count(t) if t else 0 for lo in range(0, len(texts), 512) for t in texts.slice(lo, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"
    return docs.select(*keep, text_column).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids of every document's text."""
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
SQL: dict[str, str] = {}
