"""What is made once so that searches are fast: folded search texts, the index of characters, their frequencies.

Search texts: one row for each place position with all primary and all alternate texts folded and joined by a separator that no text holds. A search
is then ``contains`` on two columns, inside generated code. The index lists the positions of each folded character; a place that holds a needle
holds all its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsearch.functions.fold import fold_col
from foldsearch.schema import SearchSpec

#: Between the texts of a row; a needle that holds it is looked for text by text.
SEPARATOR = "\x1f"


def texts(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """All texts of the columns as one array, without nulls."""
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) if isinstance(df.schema[c].dataType, T.ArrayType) else F.array(F.col(c)) for c in columns]
    joined = F.concat(*parts) if parts else F.array().cast("array<string>")
    return F.filter(joined, lambda x: x.isNotNull())


def raw_fields(df: DataFrame, spec: SearchSpec, pos: str = "pos") -> DataFrame:
    """(pos, primary_texts, alternate_texts) as they are."""
    return df.select(F.col(pos).alias("pos"), texts(df, spec.primary).alias("primary_texts"), texts(df, spec.alternate).alias("alternate_texts"))


def folded_text(array: Column, present: set[str] | None = None) -> Column:
    return fold_col(F.array_join(array, SEPARATOR), present)


def search_fields(df: DataFrame, spec: SearchSpec, pos: str = "pos", present: set[str] | None = None) -> DataFrame:
    """(pos, primary_text, alternate_text), folded."""
    raw = raw_fields(df, spec, pos)
    return raw.select("pos", folded_text(F.col("primary_texts"), present).alias("primary_text"), folded_text(F.col("alternate_texts"), present).alias("alternate_text"))


def postings(fields: DataFrame) -> DataFrame:
    """(scalar, pos): each folded character once for each position. Sorted by scalar when stored, so that files are skipped by their ranges."""
    chars = F.array_distinct(F.split(F.concat_ws(SEPARATOR, "primary_text", "alternate_text"), ""))
    return fields.select(F.explode(chars).alias("c"), "pos").where((F.col("c") != "") & (F.col("c") != SEPARATOR)).select(scalar(F.col("c")).alias("scalar"), "pos")


def scalar(c: Column) -> Column:
    """Code point of a single character."""
    return F.ascii(c)


def scalar_freq(posts: DataFrame) -> DataFrame:
    """(scalar, n): at how many positions a character occurs."""
    return posts.groupBy("scalar").agg(F.count(F.lit(1)).alias("n"))


def posting_bitmaps(posts: DataFrame) -> DataFrame:
    """(scalar, bucket, bits): positions as bitmaps of 32768 positions each, so a frequent character has many short rows."""
    at = F.col("pos") + 1
    return posts.select("scalar", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("scalar", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def corpus_chars(df: DataFrame, spec: SearchSpec) -> set[str]:
    """The distinct characters of the searched texts; their number is bounded by Unicode, not by the data."""
    all_texts = F.concat(texts(df, spec.primary), texts(df, spec.alternate))
    got = df.select(F.explode(F.array_distinct(F.split(F.array_join(all_texts, ""), ""))).alias("c")).distinct()
    return {r["c"] for r in got.collect() if r["c"]}


def memory_summary(fields: DataFrame) -> DataFrame:
    """Bytes of texts of ASCII only and of others, and the number of rows."""
    size = F.octet_length("primary_text") + F.octet_length("alternate_text")
    plain = F.octet_length("primary_text") + F.octet_length("alternate_text") == F.char_length("primary_text") + F.char_length("alternate_text")
    return fields.agg(F.sum(F.when(plain, size).otherwise(0)).alias("ascii_bytes"), F.sum(F.when(~plain, size).otherwise(0)).alias("other_bytes"), F.count(F.lit(1)).alias("n_rows"))
