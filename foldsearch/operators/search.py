"""Ranked search for a folded substring: primary texts before alternate ones, each in position order.

Four ways give the same rows: folding while scanning, scanning stored folded texts, and either of them over the candidates of the
character index only. Wide rows are fetched by position after the ranking, so only two text columns are read for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from foldsearch.functions import fold as U
from foldsearch.operators.artifacts import SEPARATOR, folded_text, raw_fields, search_fields
from foldsearch.operators.ordinals import positions, running
from foldsearch.schema import SearchSpec

DEFAULT_LIMIT = 20
#: The index is left aside when even its rarest character occurs in more than this share of the rows.
INDEX_SHARE = 0.05
#: Fewer rows than this are scanned sooner than candidates are looked up; the index is left aside.
INDEX_LEAST_ROWS = 5_000_000
#: Needles of a batch looked for in one pass over the texts.
BATCH_NEEDLES = 100
#: Rows of one query's matches numbered in one task, where all are asked for.
BATCH_RANGE = 100_000
#: A limited result up to this many rows is broadcast to fetch the wide rows.
FETCH_ROWS = 100_000


class Mode(Enum):
    SCAN = "scan"
    STORED = "stored"
    INDEX = "index"
    INDEX_STORED = "index_stored"


@dataclass(frozen=True)
class Query:
    """A query as typed: blanks trimmed at both ends, then folded."""

    trimmed: str
    folded: str

    @classmethod
    def of(cls, text: str) -> Query:
        trimmed = U.trim(text)
        return cls(trimmed, U.fold(trimmed))

    @property
    def scalars(self) -> list[str]:
        return list(dict.fromkeys(self.folded))


def rank_of(primary: Column, alternate: Column, needle: str | Column) -> Column:
    """0 for a match in a primary text, 1 in an alternate one only, null for none."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(F.contains(primary, n), 0).when(F.contains(alternate, n), 1)


def _rank_each(raw_primary: Column, raw_alternate: Column, needle: str) -> Column:
    """The same text by text, for needles that hold the separator."""
    hit = lambda a: F.exists(a, lambda x: F.contains(U.fold_col(x), F.lit(needle)))
    return F.when(hit(raw_primary), 0).when(hit(raw_alternate), 1)


def _rank_strict(raw_primary: Column, raw_alternate: Column, folded: str) -> Column:
    pattern = U.strict_pattern(folded)
    hit = lambda a: F.exists(a, lambda x: U.fold_col(x, joiner=U.JOINER).rlike(pattern))
    return F.when(hit(raw_primary), 0).when(hit(raw_alternate), 1)


def frequencies(freq: DataFrame, codes: list[int]) -> dict[int, int]:
    """How often the characters occur, a row each brought to the driver."""
    return {r["scalar"]: r["n"] for r in freq.where(F.col("scalar").isin(codes)).collect()}


def candidates(posts: DataFrame, n: dict[int, int], query: Query, n_rows: int, share: float = INDEX_SHARE) -> DataFrame | None:
    """Positions that hold every character of the query; None if even the rarest is too frequent to help.

    ``n`` are the frequencies of the query's characters; the rarest are intersected first.
    """
    codes = [ord(c) for c in query.scalars]
    if any(k not in n for k in codes):
        return posts.select("pos").where("false")
    useful = sorted((k for k in codes if n[k] <= share * n_rows), key=lambda k: n[k])
    if not useful:
        return None
    got = posts.where(F.col("scalar") == useful[0]).select("pos")
    for k in useful[1:]:
        got = got.join(posts.where(F.col("scalar") == k).select("pos"), "pos", "left_semi")
    return got


def intersect_postings(posts: DataFrame, scalars: list[int]) -> DataFrame:
    """Positions at which all of ``scalars`` occur, in one pass over their postings."""
    wanted = list(dict.fromkeys(scalars))
    return posts.where(F.col("scalar").isin(wanted)).groupBy("pos").agg(F.count_distinct("scalar").alias("n")).where(F.col("n") == len(wanted)).select("pos")


def intersect_bitmaps(maps: DataFrame, scalars: list[int]) -> DataFrame:
    """(bucket, bits): positions at which all of ``scalars`` occur, as bitmaps, from those of :func:`artifacts.posting_bitmaps`; empty ones are left out."""
    wanted = list(dict.fromkeys(scalars))
    both = maps.where(F.col("scalar").isin(wanted)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count_distinct("scalar").alias("n"))
    return both.where((F.col("n") == len(wanted)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


@dataclass
class SearchTables:
    """What a search reads: wide ``rows`` with ``pos``, and the stored artifacts as far as there are any.

    ``present`` are the characters of the corpus, if known (a store says so): folding while scanning then needs only their folds.
    """

    rows: DataFrame
    spec: SearchSpec
    fields: DataFrame | None = None
    postings: DataFrame | None = None
    freq: DataFrame | None = None
    n_rows: int | None = None
    present: frozenset[str] | None = None
    index_least_rows: int = INDEX_LEAST_ROWS
    _n: dict[int, int] = field(default_factory=dict, repr=False)

    def found(self, query: Query) -> DataFrame | None:
        """The index's candidates, or None where it doesn't help. Frequencies once asked for are kept: at most one for each character there is."""
        if self.postings is None or self.freq is None:
            return None
        if self.n_rows is None:
            self.n_rows = self.rows.count()
        if self.n_rows < self.index_least_rows:
            return None
        new = [k for k in map(ord, query.scalars) if k not in self._n]
        if new:
            self._n |= dict.fromkeys(new, 0) | frequencies(self.freq, new)
        return candidates(self.postings, {k: v for k, v in self._n.items() if v}, query, self.n_rows)


def matches(tables: SearchTables, query: Query, mode: Mode = Mode.STORED, strict: bool = False, within: DataFrame | None = None) -> DataFrame:
    """(pos, rank) of all matches of a non-empty query; ``within`` limits them to given positions.

    Stored texts and the index are used as the mode says and as far as they exist. A query that folds to nothing (a lone mark) matches nothing.
    """
    spec = tables.spec
    if not query.folded:
        return tables.rows.select("pos", F.lit(0).alias("rank")).where("false")
    stored = mode in (Mode.STORED, Mode.INDEX_STORED) and tables.fields is not None and not strict and SEPARATOR not in query.folded
    base = tables.fields if stored else raw_fields(tables.rows, spec)
    if mode in (Mode.INDEX, Mode.INDEX_STORED):
        found = tables.found(query)
        if found is not None:
            base = base.join(found, "pos", "left_semi")
    if within is not None:
        base = base.join(within.select("pos"), "pos", "left_semi")
    if strict:
        rank = _rank_strict(F.col("primary_texts"), F.col("alternate_texts"), query.folded)
    elif SEPARATOR in query.folded:
        rank = _rank_each(F.col("primary_texts"), F.col("alternate_texts"), query.folded)
    elif stored:
        rank = rank_of(F.col("primary_text"), F.col("alternate_text"), query.folded)
    else:
        rank = rank_of(folded_text(F.col("primary_texts"), tables.present), folded_text(F.col("alternate_texts"), tables.present), query.folded)
    return base.select("pos", rank.alias("rank")).where("rank is not null")


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """(pos, rank, rank_no): primary before alternate, each by position, the first ``limit`` of them; any negative limit means all."""
    if limit == 0:
        return found.withColumn("rank_no", F.lit(0).cast("long")).where("false")
    if limit > 0:
        first = found.orderBy("rank", "pos").limit(limit)  # at most `limit` rows from here on
        return first.withColumn("rank_no", F.row_number().over(Window.orderBy("rank", "pos")).cast("long"))
    numbered = positions(found.withColumn("__fs_r", -F.col("rank")), "__fs_r", "pos", "rank_no")
    return numbered.drop("__fs_r").withColumn("rank_no", F.col("rank_no") + 1)


def fetch(tables: SearchTables, top: DataFrame, limit: int) -> DataFrame:
    """The wide rows of ranked positions, with ``rank`` and ``rank_no``."""
    small = 0 <= limit <= FETCH_ROWS
    return tables.rows.join(F.broadcast(top) if small else top, "pos")


def search(tables: SearchTables, text: str, limit: int = DEFAULT_LIMIT, mode: Mode = Mode.STORED, strict: bool = False) -> DataFrame:
    """Rows matching ``text`` with rank (0 primary, 1 alternate) and rank_no from 1.

    An empty query gives the first ``limit`` rows by position. Negative limits mean all, 0 none. ``strict`` lets no match begin inside an expansion
    (``se`` isn't found in ``ße``).
    """
    query = Query.of(text)
    if not query.trimmed:
        return fetch(tables, ranked(tables.rows.select("pos", F.lit(0).alias("rank")), limit), limit)
    return fetch(tables, ranked(matches(tables, query, mode, strict), limit), limit)


def batch_search(fields: DataFrame, texts: list[str], limit: int = DEFAULT_LIMIT, among: DataFrame | None = None) -> DataFrame:
    """(query_no, pos, rank, rank_no) of many queries in one pass over the stored texts for each block of queries.

    A row is tested against all needles of the block inside generated code, and only hits leave the scan. ``among`` (query_no, pos) limits each query to its
    candidates. Empty queries match nothing here; negative limits mean all, and then a query's matches are numbered in ranges of
    positions, so that one that matches most rows needs no single task.
    """
    needles = [(i, Query.of(t).folded) for i, t in enumerate(texts)]
    needles = [(i, n) for i, n in needles if n]
    if not needles or limit == 0:
        return fields.select("pos", F.lit(0).alias("query_no"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("rank_no")).where("false")
    if among is None:
        out = None
        for at in range(0, len(needles), BATCH_NEEDLES):
            block = needles[at : at + BATCH_NEEDLES]
            tested = F.array(*[F.struct(F.lit(i).alias("query_no"), rank_of(F.col("primary_text"), F.col("alternate_text"), n).alias("rank")) for i, n in block])
            hits = fields.select("pos", F.inline(tested)).where("rank is not null")
            out = hits if out is None else out.unionAll(hits)
    else:
        named = F.element_at(F.create_map(*[F.lit(x) for i, n in needles for x in (i, n)]), F.col("query_no"))
        out = among.join(fields, "pos").select("pos", "query_no", rank_of(F.col("primary_text"), F.col("alternate_text"), named).alias("rank")).where("rank is not null")
    if limit < 0:
        chunked = out.withColumn("__fs_chunk", F.floor(F.col("pos") / BATCH_RANGE))
        numbered = running(chunked, ["query_no"], ["rank", "__fs_chunk"], [F.col("pos")], F.lit(1).cast("long"), "rank_no")
        return numbered.select("query_no", "pos", "rank", (F.col("rank_no") + 1).alias("rank_no"))
    order = Window.partitionBy("query_no").orderBy("rank", "pos")
    numbered = out.select("query_no", "pos", "rank").withColumn("rank_no", F.row_number().over(order))
    # compared before the cast, so that Spark limits each query's rows before the shuffle
    return numbered.where(F.col("rank_no") <= limit).withColumn("rank_no", F.col("rank_no").cast("long"))


def batch_candidates(posts: DataFrame, texts: list[str]) -> DataFrame:
    """(query_no, pos): positions that hold all characters of each query, in one pass over the postings of all their characters."""
    asked = [(i, list(dict.fromkeys(Query.of(t).folded))) for i, t in enumerate(texts)]
    spark = posts.sparkSession
    pairs = [(i, ord(c), len(cs)) for i, cs in asked for c in cs]
    if not pairs:
        return posts.select(F.lit(0).alias("query_no"), "pos").where("false")
    # one row for each query and character of it: the caller's own list
    wanted = spark.createDataFrame(pairs, "query_no int, scalar int, of int")
    met = posts.join(F.broadcast(wanted), "scalar").groupBy("query_no", "pos", "of").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = of").select("query_no", "pos")


def batch(tables: SearchTables, texts: list[str], limit: int = DEFAULT_LIMIT, mode: Mode = Mode.STORED) -> DataFrame:
    """:func:`batch_search` in any of the four ways."""
    stored = mode in (Mode.STORED, Mode.INDEX_STORED) and tables.fields is not None
    fields = tables.fields if stored else search_fields(tables.rows, tables.spec, present=tables.present)
    among = batch_candidates(tables.postings, texts) if mode in (Mode.INDEX, Mode.INDEX_STORED) and tables.postings is not None else None
    return batch_search(fields, texts, limit, among)


def visit(tables: SearchTables, text: str, each: Callable[[Row], bool], mode: Mode = Mode.STORED) -> int:
    """Give ``each`` the matching rows in order of rank until it returns False; how many it was given.

    Rows come to the driver a partition at a time, so stopping early leaves the rest of them where they are.
    """
    found = search(tables, text, -1, mode).orderBy("rank_no")
    given = 0
    for row in found.toLocalIterator():
        given += 1
        if not each(row):
            break
    return given


class SearchSession:
    """Type-ahead: a query that goes on from the last one is looked for only among its matches.

    An empty query clears the state; the same folded query changes nothing; anything else is a new search. Matches are kept cached between steps.
    """

    def __init__(self, tables: SearchTables, mode: Mode = Mode.STORED):
        self.tables, self.mode = tables, mode
        self.folded = ""
        self._found: DataFrame | None = None
        self.narrowed = 0

    def update(self, text: str) -> SearchSession:
        query = Query.of(text)
        if not query.trimmed:
            self._keep(None)
            self.folded = ""
        elif self._found is not None and query.folded == self.folded:
            return self
        else:
            goes_on = self._found is not None and self.folded != "" and query.folded.startswith(self.folded)
            self.narrowed += goes_on
            self._keep(matches(self.tables, query, self.mode, within=self._found if goes_on else None))
            self.folded = query.folded
        return self

    def _keep(self, found: DataFrame | None) -> None:
        old, self._found = self._found, found.cache() if found is not None else None
        if found is not None and old is not None:
            self._found.count()  # before what it was made from is let go
        if old is not None:
            old.unpersist()

    def results(self, limit: int = DEFAULT_LIMIT) -> DataFrame:
        if self._found is None:
            return search(self.tables, "", limit)
        return fetch(self.tables, ranked(self._found, limit), limit)

    def close(self) -> None:
        self._keep(None)
