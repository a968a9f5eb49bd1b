"""Texts measured in tokens of a public tokenizer, in Arrow batches.

The tokenizer cuts a text into words and encodes each by itself, so a text's tokens are the sum over its words. Words are found by numpy passes over the code points
of all texts of a batch, and equal words are encoded once; the counts are those of encoding every text whole.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsearch.runtime import ship_package

#: Vocabulary file (ranks), the same path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points measured at once.
SLICE = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins and the last ends)."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate([np.zeros(0, np.uint32), *raw]), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def hashed(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of code points: a polynomial in an odd number, and the length."""
    room = 1 << max(10, int(len(points)).bit_length())
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * _powers(_ODD, room)[: len(points)], out=sums[1:])
    return (sums[end] - sums[begin]) * _powers(_ODD_INVERSE, room)[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    space = regex.compile(r"\s")
    for c in range(0x110000):
        what = unicodedata.category(chr(c))
        if what[0] == "L":
            out[c] = _LETTER
        elif what[0] == "N":
            out[c] = _NUMBER
        elif what[0] in "ZC" and space.match(chr(c)):
            out[c] = _SPACE
    return out


def words(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words that :data:`PATTERN` cuts begin."""
    n = len(points)
    cls = _classes()[points]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[starts] = True
    first = edge[:n].copy()
    first[1:] |= cls[1:] != cls[:-1]
    space = cls == _SPACE
    ends = np.ones(n, bool)  # the next character is of another run or text
    ends[:-1] = first[1:]
    # of white space before something, the last character is left over; a blank goes with what follows
    before_more = ends & space & ~edge[1:]
    first |= before_more
    blank = before_more & (points == 32)
    after = np.flatnonzero(blank) + 1
    first[after] = False
    # contractions, where an apostrophe begins a run of signs by itself
    quote = np.flatnonzero(first & (points == 39))
    quote = quote[quote + 1 < n]
    if len(quote):
        one = points[quote + 1]
        inside = ~edge[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        has_two = (quote + 2 < n) & inside & ~edge[np.minimum(quote + 2, n)]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long_ = has_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        first[quote[short | long_] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long_ & ~short] + 3])
        rest = rest[rest < n]
        first[rest[~edge[rest]]] = True
    return np.flatnonzero(first)


class Counter:
    """Counts tokens; keeps the counts of words it has met."""

    #: Distinct words kept before starting over.
    KEPT = 500_000

    def __init__(self, vocabulary: str = VOCABULARY):
        self.encode = encoding(vocabulary).encode_ordinary
        self.known: dict[int, int] = {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        part: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if t:
                part.append(i)
                size += len(t)
            if part and (size >= SLICE or i == len(texts) - 1):
                out[part] = self._count([texts[j] for j in part])
                part, size = [], 0
        if part:
            out[part] = self._count([texts[j] for j in part])
        return out

    def _count(self, texts: list[str]) -> np.ndarray:
        points, starts = laid_out(texts)
        begin = words(points, starts)
        end = np.append(begin[1:], len(points))
        if len(self.known) > self.KEPT:
            self.known = {}
        coded = pa.array(hashed(points, begin, end)).dictionary_encode()
        of, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        where = np.zeros(len(of), np.int64)
        where[at[::-1]] = np.arange(len(at))[::-1]
        sizes = np.zeros(len(of), np.int64)
        for i, h in enumerate(of):
            n = self.known.get(h)
            if n is None:
                j = where[i]
                n = self.known[h] = len(self.encode(points[begin[j] : end[j]].tobytes().decode("utf-32-le", "surrogatepass")))
            sizes[i] = n
        sums = np.concatenate([[0], np.cumsum(sizes[at])])
        edges = np.searchsorted(begin, starts)
        return sums[edges[1:]] - sums[edges[:-1]]


def token_counts(df: DataFrame, ids: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(ids, n_tokens bigint) of every row. Null and empty texts have 0 tokens; strings of special tokens are ordinary text."""
    rows = df.select(*ids, F.col(text).alias("__fs_text"))
    ship_package(df.sparkSession)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            counts = counter.count(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema)
