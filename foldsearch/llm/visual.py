"""One form for texts that look the same, made by DuckDB inside Arrow partitions.

A text's form: compatibility characters (full width, half width, presentation forms, ligatures, radicals, odd spaces) become the usual ones;
invisible characters go; the rest is composed (NFC); letters that look the same in Latin, Greek and Cyrillic become the Latin
one, also under accents; outer spaces go. Letters, accents, case and visible signs are kept, so texts that differ visibly keep different forms.

Superscripts, circled or squared signs, fractions, mathematical styles, the long s and single Korean letters are seen to differ and stay
as they are. The joiner and non-joiner stay after an Indic virama, where they change what is seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldsearch.runtime import ship_package

#: Decomposition tags of characters that look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Ranges of <compat> characters that do: micro sign, Latin digraphs, spaces, leaders, roman numerals, radicals, ligatures.
SAME_LOOK_COMPAT = ((0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2000, 0x200A), (0x2024, 0x2026), (0x205F, 0x205F), (0x2160, 0x217F), (0x2E9F, 0x2FD5), (0xFB00, 0xFB4F))
#: Look-alike letters and, beside them, the Latin letter whose upright form they share. Unicode's names and decompositions don't tell looks, so these are
#: listed: Cyrillic, Greek, Cherokee, Armenian and Latin letters of other names. Letters that differ slightly (к and k, ı and i) are left apart.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХҮӀԚԜаесһіјорѕухԁԛԝӏ", "ABESIJKMHOPCTYXYIQWaechijopsyxdqwl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνρ", "ABEZHIKMNOPTYXCocjvp"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩ", "ABCDEGHJKLMPRSTVWZY"
ARMENIAN, ARMENIAN_AS = "օոսցհՕՍՏԼզյ", "onughOUSLqj"
#: Signs and letters elsewhere that look the same.
OTHER, OTHER_AS = "‐﹣ʼɡɑÐƉ", "--’gaĐĐ"
#: Combining classes of viramas are 9; a joiner after one is seen.
JOINERS = r"[\x{200C}\x{200D}]"
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0100}-\x{E01EF}]"


def _plain(ch: str) -> str:
    """What ``ch`` decomposes to as far as that looks the same."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return ch
    if tag not in SAME_LOOK and not (tag == "<compat>" and any(a <= ord(ch) <= b for a, b in SAME_LOOK_COMPAT)):
        return ch
    out = "".join(_plain(chr(int(x, 16))) for x in rest.split())
    return ch if len(out) > 1 and out[0] == " " else out  # spacing accents are seen as such


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(one to one, one to many, look-alikes), made from the Unicode data by rule."""
    one, many = {}, {}
    for c in range(0x80, 0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch) == "Zs":
            one[ch] = " "
        elif (out := _plain(ch)) != ch:
            (one if len(out) == 1 else many)[ch] = out
    alike = dict(zip(CYRILLIC + GREEK + CHEROKEE + ARMENIAN + OTHER, CYRILLIC_AS + GREEK_AS + CHEROKEE_AS + ARMENIAN_AS + OTHER_AS))
    for c in range(0xC0, 0x2000):  # accented ones, by their base letter
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0] in alike:
            out = unicodedata.normalize("NFC", alike[parts[0]] + parts[1:])
            if len(out) == 1:
                alike[chr(c)] = out
    return one, many, alike


@lru_cache(1)
def _viramas() -> str:
    return "".join(rf"\x{{{c:X}}}" for c in range(0x900, 0x12000) if unicodedata.combining(chr(c)) == 9)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translated(column: str, table: dict[str, str], present: set[str]) -> str:
    used = sorted(table.keys() & present)
    return f"translate({column}, {_quoted(''.join(used))}, {_quoted(''.join(table[c] for c in used))})" if used else column


def form_sql(present: set[str], source: str = "batch") -> str:
    """SQL for the forms of ``source`` (i, t). ``present`` are its characters, so that the SQL lists no others."""
    one, many, alike = tables()
    spread = "t"
    for ch in sorted(many.keys() & present):
        spread = f"replace({spread}, {_quoted(ch)}, {_quoted(many[ch])})"
    spread = _translated(spread, one, present)
    # a joiner after a virama is put back with it, anything else invisible goes
    hidden = f"nfc_normalize(regexp_replace(t, '([{_viramas()}])({JOINERS})|{INVISIBLE}', '\\1\\2', 'g'))"
    # accents may only now have met their letters, so the look-alikes aren't limited to what was present
    latin = f"translate(t, {_quoted(''.join(alike))}, {_quoted(''.join(alike.values()))})" if present & _alike_bases() else "t"
    return f"""
        with spread as (select i, {spread} as t from {source}),
             seen as (select i, {hidden} as t from spread),
             latin as (select i, nfc_normalize({latin}) as t from seen)
        select regexp_replace(t, '^\\s+|\\s+$', '', 'g') as t
        from latin order by i
    """


@lru_cache(1)
def _alike_bases() -> frozenset[str]:
    """Characters that may lead to a look-alike: they or what they become."""
    one, many, alike = tables()
    return frozenset(alike) | {c for c, o in (one | many).items() if set(o) & alike.keys()} | {c for c in map(chr, range(0x1F00, 0x2000)) if unicodedata.normalize("NFC", c) in alike} | {"‑"}


def connect():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("set threads = 1")
    con.execute("set memory_limit = '512MB'")
    return con


def forms(con, texts: pa.Array) -> pa.Array:
    """The form of each text; null stays null. Texts of visible ASCII and blanks have one form but for outer blanks; equal ones of the others are formed once."""
    texts = texts.cast(pa.string())
    other = pc.fill_null(pc.match_substring_regex(texts, "[^ -~]"), False)
    plain = pc.ascii_trim(texts, " ")
    if not pc.any(other).as_py():
        return plain
    coded = texts.filter(other).dictionary_encode()
    distinct = coded.dictionary
    seen = np.zeros(0x110000, bool)
    seen[np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    present = {chr(c) for c in np.flatnonzero(seen)}
    con.register("batch", pa.table({"i": pa.array(np.arange(len(distinct))), "t": distinct}))
    got = con.sql(form_sql(present)).to_arrow_table().column("t").combine_chunks()
    got = got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks)
    return pc.replace_with_mask(plain, other, got.cast(pa.string()).take(coded.indices))


def with_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the form of ``column`` as ``out`` (a column of that name is replaced). Null stays null, empty texts stay empty."""
    if out == column:
        return with_form(df, column, "__fs_form").drop(column).withColumnRenamed("__fs_form", column)
    ship_package(df.sparkSession)
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])
    at = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, forms(con, b.column(at))], names=[*b.schema.names, out])

    return rest.mapInArrow(run, schema)
