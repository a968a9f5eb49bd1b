"""Folding of case, diacritics and width, character by character, from one table for queries and columns.

A character's fold: the usual form of a full- or half-width character, case folded, decomposed, without nonspacing marks, composed again.
A mark or format character that folds to itself folds to nothing. So ``ẞ``, ``ß`` and ``ss`` are equal, ``É`` is ``e``, ``ﬃ`` is ``ffi``,
and ``ガ`` is ``カ``. Letters that aren't a base with a mark (``ø``, ``ł``, ``đ``, ``ı``) stay.

The table is made from the Unicode data of the running Python; query and column use the same one. One-to-one folds and deletions are one ``translate``,
which Spark keeps in generated code; the few folds to several characters come first, and only where a text has one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsearch.runtime import small_table

#: White space and line ends, as trimmed from queries.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Joins the characters of one expansion in strict folding, where a match may not begin inside.
JOINER = ""


def fold_char(ch: str) -> str:
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    plain = "".join(chr(int(x, 16)) for x in rest.split()) if tag in ("<wide>", "<narrow>") else ch
    parts = unicodedata.normalize("NFD", plain.casefold())
    out = unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))
    return "" if out == ch and unicodedata.category(ch) in ("Mn", "Mc", "Me", "Cf") else out


@lru_cache(1)
def table() -> dict[str, str]:
    """All characters that don't fold to themselves."""
    out = {}
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (f := fold_char(chr(c))) != chr(c):
            out[chr(c)] = f
    return out


@lru_cache(1)
def expansions() -> dict[str, str]:
    return {c: f for c, f in table().items() if len(f) > 1}


@lru_cache(1)
def _one_to_one() -> tuple[str, str]:
    kept = {c: f for c, f in table().items() if len(f) == 1}
    gone = [c for c, f in table().items() if not f]
    return "".join([*kept, *gone]), "".join(kept.values())


def fold(text: str, joiner: str = "") -> str:
    """The folded text. With ``joiner`` the characters of an expansion are joined by it."""
    t = table()
    return "".join(joiner.join(t[c]) if c in t else c for c in text)


def trim(text: str) -> str:
    return text.strip(BLANKS)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def fold_col(c: Column, present: set[str] | None = None, joiner: str = "") -> Column:
    """The folded column; null stays null. ``present`` (characters of the corpus) only makes the plan smaller."""
    spread = c
    many = {k: v for k, v in expansions().items() if present is None or k in present}
    if many:
        chain = c
        for k, v in many.items():
            chain = F.replace(chain, F.lit(k), F.lit(joiner.join(v)))
        spread = F.when(c.rlike(_class("".join(many))), chain).otherwise(c)
    src, dst = _one_to_one()
    if present is not None:
        t = {k: table()[k] for k in sorted(present & table().keys()) if len(table()[k]) < 2} | dict(zip(UPPER, LOWER))
        kept = {k: v for k, v in t.items() if v}
        src, dst = "".join([*kept, *(k for k, v in t.items() if not v)]), "".join(kept.values())
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, lower_ascii(c)).otherwise(F.translate(spread, src, dst))


def needs_fold(c: Column) -> Column:
    """Whether a text has a non-ASCII character that doesn't fold to itself."""
    return ~(F.octet_length(c) == F.char_length(c)) & (fold_col(c) != lower_ascii(c))


def strict_pattern(folded_joined: str) -> str:
    """Pattern for a needle in text folded with :data:`JOINER`: a match may end inside an expansion but not begin there."""
    import re

    chars = [re.escape(c) for c in folded_joined.replace(JOINER, "")]
    return f"(?<!{JOINER})" + f"{JOINER}?".join(chars)


def fold_table(spark, present: set[str] | None = None) -> DataFrame:
    """(scalar, folded) of the characters that change; of the corpus only, if ``present`` is given."""
    import pyarrow as pa

    t = {c: f for c, f in table().items() if present is None or c in present}
    return small_table(spark, {"scalar": pa.array([ord(c) for c in t], pa.int32()), "folded": pa.array(list(t.values()), pa.string())})
