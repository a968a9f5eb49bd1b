"""Personal information in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

Every token of every text is scored by the field. Viterbi decoding is done only around positions where, by an exact bound from the field's own scores, the
best path may have an entity; the labels are the same as of decoding each text whole. No rule or word list decides where to look. What is
labelled is then trimmed of brackets and closing punctuation, and spans that can't be what they are labelled are dropped (an email without a domain, a
number with too few digits). Not found, among others: digits other than decimal ones of Unicode, names of one word.

Tokens are made by numpy passes over the code points of all texts of a batch; equal tokens are recognised by a 64-bit hash of their code points, so that the
features of a token are made once. They are its shape, beginnings and endings, whether it is a word of the training sentences, and how common it is, by
the ranks of a public tokenizer's vocabulary, with and without a capital. The field is trained from a small labelled table
(:mod:`pii_labelled`) on the driver, in about half a minute whatever the data; the model is a few megabytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsearch.llm import crf, pii_labelled, tokens
from foldsearch.llm.pii_labelled import TYPES
from foldsearch.runtime import ensure_checkpoint_dir, ship_package

LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

#: Labelled passages to train from.
PASSAGES = 22000
#: Added to the score of beginning an entity: a missed one is worse than a few words too many.
LEAN = 1.0
#: Characters of text labelled at once. A longer text is labelled in pieces that overlap by OVERLAP characters.
SLICE, OVERLAP = 1 << 20, 2000

_SIGNS = "@＠.,-/()+:;'’\"<>[]{}&ºª°_–‑＋§#=%*"
#: Coarse classes: outside, kinds of words, lengths of numbers, line ends, signs; each also glued to the token before.
_KINDS = ["out", "upper1", "upper", "cap", "lower1", "lower", "mixed", *(f"d{i}" for i in range(1, 11)), "line", "lines", "other", *_SIGNS]
_KIND_AT = {k: i for i, k in enumerate(_KINDS)}
CLASSES = 2 * len(_KINDS)

BLANK, LETTER, DIGIT, LINE, SIGN = range(5)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """What each code point is part of: nothing, a word (letters and marks), a number, an end of line, a sign by itself."""
    out = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        what = unicodedata.category(chr(c))
        if what[0] in "LM":
            out[c] = LETTER
        elif what == "Nd":
            out[c] = DIGIT
        elif what[0] == "Z" or what == "Cc":
            out[c] = BLANK
    out[ord("\n")] = LINE
    return out


@dataclass
class Tokens:
    """Tokens of texts laid end to end: where they begin and end, their text, whether they touch the one before, a hash."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    glued: np.ndarray
    hashed: np.ndarray


def tokenize(points: np.ndarray, starts: np.ndarray) -> Tokens:
    """Tokens of the code points of all texts; ``starts`` are where each begins, and the end of the last."""
    n = len(points)
    cls = char_classes()[points]
    full = cls != BLANK
    first = full & (cls == SIGN)
    first[1:] |= full[1:] & (cls[1:] != cls[:-1])
    edges = starts[:-1][starts[:-1] < n]
    first[edges] = full[edges]
    if n:
        first[0] = full[0]
    last = full.copy()
    last[:-1] &= first[1:] | ~full[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(starts, begin, side="right") - 1
    glued = np.zeros(len(begin), bool)
    glued[1:] = (begin[1:] == end[:-1]) & (text[1:] == text[:-1])
    return Tokens(begin, end, text, glued, tokens.hashed(points, begin, end))


def kind(token: str) -> str:
    c = token[0]
    if c == "\n":
        return "line" if len(token) == 1 else "lines"
    if c.isdecimal():
        return f"d{min(10, len(token))}"
    if char_classes()[ord(c)] == LETTER:
        if token.islower() or not token.isalpha():
            return "lower1" if len(token) == 1 else "lower"
        if token.isupper():
            return "upper1" if len(token) == 1 else "upper"
        return "cap" if token[0].isupper() and token[1:].islower() else "mixed"
    return c if c in _KIND_AT else "other"


@lru_cache(2)
def common_words(vocabulary: str) -> dict[str, int]:
    """Words of letters with a blank before them in a public tokenizer's vocabulary: 0 for the most common, then 1 and 2."""
    out = {}
    for word, rank in tokens.encoding(vocabulary)._mergeable_ranks.items():
        text = word.decode("utf-8", "ignore")
        if text[:1] == " " and text[1:].isalpha():
            out[text[1:]] = 0 if rank < 3000 else 1 if rank < 15000 else 2
    return out


def features(token: str, words: set[str], given: set[str], common: dict[str, int]) -> tuple[str, ...]:
    """What the field sees of a token."""
    k = kind(token)
    out = [f"k={k}"]
    low = token.lower()
    if token[0].isdecimal():
        out.append(f"d0={token[0] == '0'}{min(8, len(token))}")
        if len(token) == 4:
            out.append(f"y={token[:2]}")
    elif k in ("lower", "upper", "cap", "mixed", "lower1", "upper1"):
        own, small = common.get(low.capitalize(), 3), common.get(low, 3)
        out.append(f"c={k}{own}{small}")
        if low in words:
            out.append(f"w={low}")
            out.append(f"in={k}")
        else:
            out += [f"s2={low[-2:]}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"s5={low[-5:]}", f"p3={low[:3]}", f"l={min(len(low), 12)}", f"new={k}"]
    if low in given:
        out.append("given")
    return tuple(out)


#: Values of the columns of :func:`places`.
_CHUNKS, _RUNS = 2 * 6 * 4 * 5 + 1, 11 * 4 * 4 + 1
VOCABULARY = {w: i for i, w in enumerate(sorted(pii_labelled.frame_words()), 1)}
COLUMN_SIZES = [2 * _CHUNKS, _CHUNKS, _CHUNKS, _RUNS, _RUNS * len(_KINDS), 16, *[len(VOCABULARY) + 1] * 3]
_NUMBER_SIGNS = np.array([_KIND_AT[c] for c in "+＋-./()–‑"])
_AT_SIGNS = np.array([_KIND_AT[c] for c in "@＠"])
_CAPITALS = np.array([_KIND_AT[c] for c in ("upper1", "upper")])


def places(t: Tokens, kinds: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """What a token is part of, as columns of small numbers (see COLUMN_SIZES).

    A chunk is what stands between blanks: an at-sign in it, digits, letters, signs; for the token's own chunk (and whether it begins it) and the ones before and
    after. A run is numbers, the signs in them and capitals glued to them, also across blanks: digits in all, how it begins, whether it has letters. Then whether one of the
    two tokens before or after is the same. Last, for tokens of a run with digits, the three words before the run (``known`` are numbers of words in VOCABULARY).
    """
    n = len(kinds)
    length = t.end - t.begin
    is_digit = (kinds >= _KIND_AT["d1"]) & (kinds <= _KIND_AT["d10"])
    digits = np.where(is_digit, length, 0)
    new_text = np.ones(n, bool)
    new_text[1:] = t.text[1:] != t.text[:-1]
    begins = np.flatnonzero(~t.glued | new_text)
    chunk = np.cumsum(~t.glued | new_text) - 1
    over = lambda x: np.add.reduceat(x.astype(np.int64), begins)
    has_at = over(np.isin(kinds, _AT_SIGNS)) > 0
    n_digits = np.searchsorted([1, 3, 5, 7, 10], over(digits), side="right")
    lower = over((kinds == _KIND_AT["lower"]) | (kinds == _KIND_AT["lower1"])) > 0
    capital = over((kinds >= _KIND_AT["upper1"]) & (kinds <= _KIND_AT["mixed"])) > 0
    letters = lower + 2 * capital
    sign = np.select([over(kinds == _KIND_AT["-"]) > 0, over(kinds == _KIND_AT["."]) > 0, over(kinds == _KIND_AT["/"]) > 0, over(kinds > _KIND_AT["lines"]) > 0], [1, 2, 3, 4], 0)
    of_chunk = 1 + ((has_at * 6 + n_digits) * 4 + letters) * 5 + sign
    text_of = t.text[begins]
    after, before = np.zeros_like(of_chunk), np.zeros_like(of_chunk)
    same = text_of[1:] == text_of[:-1]
    after[:-1][same], before[1:][same] = of_chunk[1:][same], of_chunk[:-1][same]
    first = np.zeros(n, np.int64)
    first[begins] = 1
    # numbers
    short_capital = np.isin(kinds, _CAPITALS) & (length <= 2)
    near_digit = np.zeros(n, bool)
    near_digit[1:] |= is_digit[:-1] & t.glued[1:]
    near_digit[:-1] |= is_digit[1:] & t.glued[1:]
    near_digit[:-2] |= is_digit[2:] & t.glued[1:-1] & np.isin(kinds[1:-1], _NUMBER_SIGNS)
    member = is_digit | np.isin(kinds, _NUMBER_SIGNS) | (short_capital & near_digit)
    part = np.cumsum(np.concatenate([[True], (member[1:] != member[:-1]) | new_text[1:]])) - 1
    sums = np.bincount(part, weights=digits).astype(np.int64)
    with_letters = np.bincount(part, weights=short_capital & member) > 0
    head = np.full(len(sums), n - 1)
    np.minimum.at(head, part[is_digit | (kinds == _KIND_AT["+"]) | (kinds == _KIND_AT["＋"])], np.flatnonzero(is_digit | (kinds == _KIND_AT["+"]) | (kinds == _KIND_AT["＋"])))
    how = np.select([np.isin(kinds[head], [_KIND_AT["+"], _KIND_AT["＋"]]), kinds[head] == _KIND_AT["d3"], length[head] > 4], [1, 2, 3], 0)
    groups = np.bincount(part, weights=is_digit).astype(np.int64)
    bucket = np.searchsorted([1, 3, 5, 6, 7, 8, 9, 10, 11, 13], sums, side="right")
    of_run = 1 + (bucket * 4 + how) * 4 + np.where(with_letters, 0, np.minimum(groups, 6) // 2)
    run = np.where(member, of_run[part], 0)
    again = np.zeros(n, np.int64)
    for bit, by in ((1, 1), (4, 2)):
        same = (t.hashed[by:] == t.hashed[:-by]) & (t.text[by:] == t.text[:-by])
        again[by:] += bit * same
        again[:-by] += 2 * bit * same
    starts = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | new_text[1:]]))
    is_word = (kinds >= _KIND_AT["upper1"]) & (kinds <= _KIND_AT["mixed"])
    last_word = np.maximum.accumulate(np.where(is_word, np.arange(n), -1))
    counts = member & (sums > 0)[part]
    words = []
    at = starts - 1
    for _ in range(3):
        at = np.where(at >= 0, last_word[at], -1)
        ok = (at >= 0) & (t.text[at] == t.text[starts]) & (starts - at <= 12)
        words.append(np.where(counts, np.where(ok, known[at], 0)[part], 0))
        at = at - 1
    return [2 * of_chunk[chunk] + first, after[chunk], before[chunk], run, run * len(_KINDS) + kinds, again, *words]


def _gold(passages: list[list[tuple[str, str]]], starts: np.ndarray, t: Tokens) -> np.ndarray:
    out = np.zeros(len(t.begin), np.int64)
    for i, pieces in enumerate(passages):
        at = starts[i]
        for p, kind_ in pieces:
            if kind_:
                a, b = np.searchsorted(t.begin, [at, at + len(p)])
                out[a:b] = LABELS.index("I-" + kind_)
                out[a] = LABELS.index("B-" + kind_)
            at += len(p)
    return out


@lru_cache(2)
def trained(passages: int = PASSAGES, seed: int = 5, rounds: int = 24, vocabulary: str = tokens.VOCABULARY) -> crf.Model:
    """The model, trained from the labelled table. The same vocabulary and numbers give the same model."""
    words, common, known_ = pii_labelled.frame_words(), common_words(vocabulary), pii_labelled.known_names(seed)
    names = {g.lower() for g in known_}
    table = pii_labelled.labelled(passages, seed, known_)
    texts = ["".join(p for p, _ in pieces) for pieces in table]
    points, starts = tokens.laid_out(texts)
    t = tokenize(points, starts)
    whole = "".join(texts)
    feats: dict[tuple[str, ...], int] = {("outside",): 0}
    known: dict[str, int] = {}
    ids, kinds, in_words = (np.zeros(len(t.begin), np.int64) for _ in range(3))
    for i, (a, b) in enumerate(zip(t.begin.tolist(), t.end.tolist())):
        token = whole[a:b]
        if token not in known:
            known[token] = feats.setdefault(features(token, words, names, common), len(feats))
        ids[i], kinds[i], in_words[i] = known[token], _KIND_AT[kind(token)], VOCABULARY.get(token.lower(), 0)
    place = np.arange(len(ids)) + crf.GAP * (t.text + 1)
    size = len(ids) + crf.GAP * (len(texts) + 1)
    spread = lambda x: _spread(x, place, size)
    columns = [spread(x) for x in places(t, kinds, in_words)]
    lengths = np.bincount(t.text, minlength=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + crf.GAP * (np.arange(len(texts)) + 1)
    model = crf.train(
        list(feats), CLASSES, spread(ids), spread(2 * kinds + t.glued), columns, COLUMN_SIZES, spread(_gold(table, starts, t)), begins[lengths > 0], lengths[lengths > 0], LABELS, rounds=rounds
    )
    begins_entity = [i for i, name in enumerate(LABELS) if name[0] == "B"]
    model.moves[:, begins_entity] += LEAN
    model.starts[begins_entity] += LEAN
    model.extra = {"words": words, "common": common}
    return model


def _spread(values: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[place] = values
    return out


class Labeller:
    """Labels texts with a model; keeps the scores of tokens it has met."""

    #: Distinct tokens kept before starting over.
    KEPT = 200_000

    def __init__(self, model: crf.Model, given: set[str] | frozenset[str] = frozenset()):
        self.model, self.given = model, given
        self._reset()

    def _reset(self) -> None:
        self.index: dict[int, int] = {}
        self.table = self.model.rows([("outside",)])
        self.kinds, self.known = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.used = 1

    def _ids(self, t: Tokens, points: np.ndarray) -> np.ndarray:
        if self.used > self.KEPT:
            self._reset()
        coded = pa.array(t.hashed).dictionary_encode()
        of, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [i for i, h in enumerate(of) if h not in self.index]
        if new:
            where = np.zeros(len(of), np.int64)
            where[at[::-1]] = np.arange(len(at))[::-1]
            strings = [points[t.begin[j] : t.end[j]].tobytes().decode("utf-32-le", "surrogatepass") for j in where[new]]
            m = self.model
            got = m.rows([features(s, m.extra["words"], self.given, m.extra["common"]) for s in strings])
            if self.used + len(new) > self.table.shape[1]:
                room = max(2 * self.table.shape[1], self.used + len(new), 4096)
                wider = np.zeros((self.table.shape[0], room, self.table.shape[2]), np.float32)
                wider[:, : self.used] = self.table[:, : self.used]
                self.table = wider
                self.kinds, self.known = (np.concatenate([x, np.zeros(room - len(x), np.int64)]) for x in (self.kinds, self.known))
            self.table[:, self.used : self.used + len(new)] = got
            self.kinds[self.used : self.used + len(new)] = [_KIND_AT[kind(s)] for s in strings]
            self.known[self.used : self.used + len(new)] = [VOCABULARY.get(s.lower(), 0) for s in strings]
            for i in new:
                self.index[of[i]] = self.used
                self.used += 1
        return np.array([self.index[h] for h in of], np.int64)[at]

    def label(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of the entities of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        points, starts = tokens.laid_out(texts)
        t = tokenize(points, starts)
        if len(t.begin) == 0:
            return out
        ids = self._ids(t, points)
        place = np.arange(len(ids)) + crf.GAP * (t.text + 1)
        size = len(ids) + crf.GAP * (len(texts) + 1)
        kinds = self.kinds[ids]
        wide, classes, *columns = (_spread(x, place, size) for x in (ids, 2 * kinds + t.glued, *places(t, kinds, self.known[ids])))
        outside = np.ones(size, bool)
        outside[place] = False
        labels = self.model.label(self.model.emissions(self.table, wide, classes, columns), outside)[place]
        begun = None
        for j in np.flatnonzero(labels).tolist():
            name, i = LABELS[labels[j]], int(t.text[j])
            a, b = int(t.begin[j] - starts[i]), int(t.end[j] - starts[i])
            if name[0] == "I" and begun == (i, j - 1):
                out[i][-1] = (out[i][-1][0], out[i][-1][1], b)
            else:
                out[i].append((name[2:], a, b))
            begun = (i, j)
        return out


_DOMAIN = re.compile(r"[\w.+-]+\s?(?:@|＠|\(at\)|\[at\]|\{at\}|\sat\s)\s?[\w-]+(?:(?:\.|\sdot\s|\s?[\[({]dot[\])}]\s?)[\w-]+)+", re.I)


#: The longest stretch without an empty line: nothing goes on beyond one.
_STRETCH = re.compile(r"(?:(?!\n\n).)+", re.S)


def checked(kind_: str, text: str) -> tuple[int, int] | None:
    """The part of a labelled text that stays: without outer brackets and closing punctuation; None if it can't be of its type."""
    a, b = 0, len(text)
    while a < b and (text[a].isspace() or text[a] in "<[{\"'“«:;,."):
        a += 1
    closing = ">]}\"'”»:;," + ("" if kind_ == "person" else ".")
    while a < b and (text[b - 1].isspace() or text[b - 1] in closing):
        b -= 1
    while b > a and text[b - 1] == ")" and text.count("(", a, b) < text.count(")", a, b):
        b -= 1
    while a < b and text[a] == "(" and text.count("(", a, b) > text.count(")", a, b):
        a += 1
    if b - a > 1 and text[a] == "(" and text[b - 1] == ")" and text.find(")", a) == b - 1:
        a, b = a + 1, b - 1
    if kind_ == "person" and text[a:b].endswith(".") and not re.search(r"\b\w\.$", text[a:b]):
        b -= 1
    got = text[a:b]
    digits = sum(c.isdecimal() for c in got)
    if kind_ == "email":
        ok = bool(_DOMAIN.fullmatch(got))
    elif kind_ == "phone":
        ok = digits >= 7
    elif kind_ == "id_number":
        ok = digits >= 5
    elif kind_ == "address":
        ok = digits >= 1 and any(c.isalpha() for c in got)
    else:
        parts = re.findall(r"[^\W\d_]+", got)
        ok = digits == 0 and len(parts) >= 2 and any(len(p) > 1 for p in parts)
    return (a, b) if ok else None


def find(labeller: Labeller, texts: pa.Array) -> list[list[tuple[str, int, int, str]]]:
    """(type, first character, last + 1, text) of the entities of each text. Null and empty texts have none."""
    whole = texts.to_pylist()
    out: list[list[tuple[str, int, int, str]]] = [[] for _ in whole]
    pieces: list[tuple[int, int, str]] = []  # text, characters before, piece
    size = 0
    for i, text in enumerate(whole):
        step = SLICE - OVERLAP
        for at in range(0, len(text or ""), step):
            if at and len(text) - at <= OVERLAP:
                break  # the piece before reached the end
            pieces.append((i, at, text[at : at + SLICE]))
            size += len(pieces[-1][2])
            if size >= SLICE:
                _label_pieces(labeller, pieces, out)
                pieces, size = [], 0
    _label_pieces(labeller, pieces, out)
    return out


def _label_pieces(labeller: Labeller, pieces: list[tuple[int, int, str]], out: list[list[tuple[str, int, int, str]]]) -> None:
    for (i, offset, piece), got in zip(pieces, labeller.label([p for _, _, p in pieces])):
        for t, a, b in got:
            if (offset and a < OVERLAP // 2) or (len(piece) == SLICE and a >= SLICE - OVERLAP // 2):
                continue  # begins in the half of an overlap that is the other piece's
            for part in _STRETCH.finditer(piece[a:b]):
                kept = checked(t, part.group())
                if kept:
                    s, e = a + part.start() + kept[0], a + part.start() + kept[1]
                    out[i].append((t, offset + s, offset + e, piece[s:e]))


def _run_over(df: DataFrame, ids: list[str], text: str, given: DataFrame | None, model: crf.Model | None, schema: T.StructType, make) -> DataFrame:
    """``given``: given names known beforehand, a small table held by the driver; without it the field does without."""
    spark = df.sparkSession
    ship_package(spark)
    names = frozenset(r[0].lower() for r in given.where(F.col(given.columns[0]).isNotNull()).collect()) if given is not None else frozenset()
    shared = spark.sparkContext.broadcast((model or shared_model(spark), names))  # a few megabytes, whatever the data
    rows = df.select(*ids, F.col(text).alias("__fs_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(*shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            yield from make(b, texts, find(labeller, texts), schema)

    return rows.mapInArrow(run, schema)


def save_model(spark: SparkSession, model: crf.Model, path: str) -> None:
    """Keep a model as one row of a Parquet folder; one that is there already stays."""
    out = io.BytesIO()
    columns = {f"column{i}": c for i, c in enumerate(model.columns)}
    np.savez_compressed(out, weights=model.weights, pairs=model.pairs, moves=model.moves, starts=model.starts, **columns)
    names = {"labels": model.labels, "classes": model.classes, "features": list(model.features), "words": sorted(model.extra["words"]), "common": model.extra["common"]}
    spark.createDataFrame(pa.table({"numbers": pa.array([out.getvalue()], pa.binary()), "names": pa.array([json.dumps(names)])})).coalesce(1).write.mode("ignore").parquet(path)


def load_model(spark: SparkSession, path: str) -> crf.Model | None:
    """A kept model; None if there is none."""
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    if row is None:
        return None
    x, names = np.load(io.BytesIO(bytes(row["numbers"]))), json.loads(row["names"])
    columns = [x[f"column{i}"] for i in range(len(COLUMN_SIZES))]
    features_ = {f: i for i, f in enumerate(names["features"])}
    return crf.Model(names["labels"], names["classes"], features_, x["weights"], x["pairs"], x["moves"], x["starts"], columns, {"words": set(names["words"]), "common": names["common"]})


_kept: dict[str, crf.Model] = {}


def shared_model(spark: SparkSession) -> crf.Model:
    """The model of :func:`trained`, trained once and kept in the shared folder under a name made of the training's code and parameters."""
    code = b"".join(Path(m.__file__).read_bytes() for m in (crf, pii_labelled, sys.modules[__name__])) + Path(tokens.VOCABULARY).read_bytes()
    key = hashlib.sha256(code).hexdigest()[:16]
    if key not in _kept:
        path = f"{os.path.dirname(ensure_checkpoint_dir(spark).rstrip('/'))}/foldsearch-recogniser-{key}"
        model = load_model(spark, path)
        if model is None:
            model = trained()
            save_model(spark, model, path)
        _kept[key] = model
    return _kept[key]


def find_pii(df: DataFrame, ids: list[str], text: str, given: DataFrame | None = None, model: crf.Model | None = None) -> DataFrame:
    """(ids, pii_type, pii_start, pii_end, pii_text): every occurrence, positions in characters from 0.

    Null and empty texts have none; very long ones are looked through whole.
    """
    schema = T.StructType([*df.select(*ids).schema.fields, T.StructField("pii_type", T.StringType()), T.StructField("pii_start", T.IntegerType()), T.StructField("pii_end", T.IntegerType()), T.StructField("pii_text", T.StringType())])

    def make(b, texts, found, schema):
        rows = [i for i, f in enumerate(found) for _ in f]
        flat = [x for f in found for x in f]
        take = pa.array(rows, pa.int64())
        cols = [c.take(take) for c in b.columns[:-1]]
        cols += [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()), pa.array([x[3] for x in flat], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return _run_over(df, ids, text, given, model, schema, make)


def redact(df: DataFrame, ids: list[str], text: str, given: DataFrame | None = None, model: crf.Model | None = None) -> DataFrame:
    """(ids, text with placeholders, n_found). A null text stays null."""
    schema = T.StructType([*df.select(*ids).schema.fields, T.StructField("redacted", T.StringType()), T.StructField("n_found", T.IntegerType())])

    def make(b, texts, found, schema):
        out = [None if t is None else replaced(t, f) for t, f in zip(texts.to_pylist(), found)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=schema.names)

    return _run_over(df, ids, text, given, model, schema, make)


def replaced(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """``text`` with each entity replaced by its placeholder and everything else unchanged."""
    out, at = [], 0
    for t, a, b, _ in sorted(found, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[t]]
            at = b
    return "".join([*out, text[at:]])
