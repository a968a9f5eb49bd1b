"""Queries of the engine's own operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsearch import workload
from foldsearch.functions import fields as X
from foldsearch.functions import fold as U
from foldsearch.operators import artifacts as A
from foldsearch.operators import catalog, lookup
from foldsearch.operators.ordinals import TIE_BLOCK, positions, running
from foldsearch.operators.search import Mode, Query, SearchSession, SearchTables, batch_search, intersect_postings, matches, ranked, search
from foldsearch.runtime import table
from foldsearch.schema import PLACES, SearchSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PARTS = SearchSpec("p_partkey", ("p_name",), ("p_brand", "p_type"), "cents", "p_partkey")
DOCUMENTS = SearchSpec("doc_id", ("text",), ("title", "applicant"), "n_chars", "doc_id")

#: The queries of the published workload.
WORKLOAD = workload.QUERIES
BATCH = ["a", "an", "new", "san", "burg", "to", "mün", "são", "rio", "ß", "ffi", "о", "ова", "北", "가", "  Upper "]


# What the other engine's own functions leave to do. It has lower() and strip_accents(); the rest of the fold is written down here, apart from the library.
_ORACLE_WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９！＂＃＄％＆＇（）＊＋，－．／：；＜＝＞？＠［＼］＾＿｀｛｜｝～\u3000µς"
_ORACLE_USUAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ μσ"
_ORACLE_NARROW_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
_ORACLE_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_ORACLE_SPREAD = {"ß": "ss", "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Texts and their folds, as agreed for this kind of search.
PINNED_FOLDS = (
    ("É", "e"), ("e\u0301", "e"), ("ß", "ss"), ("ẞ", "ss"), ("STRASSE", "strasse"), ("Straße", "strasse"), ("ﬃ", "ffi"), ("Ｎｏｖａ", "nova"), ("ΆΝΩ", "ανω"), ("ς", "σ"), ("Ёлка", "елка"), ("İ", "i"), ("ガ", "カ"), ("ｶﾞ", "カ"),
    ("Ångström", "angstrom"), ("São", "sao"), ("ñ", "n"), ("Łódź", "łodz"), ("ø", "ø"), ("đ", "đ"), ("ı", "ı"), ("가", "가"), ("北京", "北京"), ("No\u200bva", "nova"), ("\u0301", ""), ("Việt", "viet"), ("A b", "a b"), ("", ""),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_fold(expr: str, joiner: str = "") -> str:
    """The fold in the other engine's own functions."""
    for k, v in _ORACLE_SPREAD.items():
        expr = f"replace({expr}, {_quoted(k)}, {_quoted(joiner.join(v))})"
    usual = f"translate(regexp_replace({expr}, '\\p{{Cf}}', '', 'g'), {_quoted(_ORACLE_WIDE + _ORACLE_NARROW_KANA)}, {_quoted(_ORACLE_USUAL + _ORACLE_KANA)})"
    # character by character, as composing over several (Korean letters) is no folding
    return f"array_to_string(list_transform(string_split(lower({usual}), ''), lambda c: strip_accents(c)), '')"


def _oracle_needle(text: str) -> str:
    return oracle_fold(_quoted(text.strip()))


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- Scans, projections, filters -------------------------------------------------------------------------------------


@query("select geoname_id, name, country_code from cities")
def scan_project(spark, d):
    return table(spark, d, "cities").select("geoname_id", "name", "country_code")


@query("select * from cities")
def scan_all_fields(spark, d):
    return table(spark, d, "cities")


@query(
    """select geoname_id as id, source_line, coalesce(timezone, '') as timezone, coalesce(array_to_string(list_filter(alternate_names, lambda x: x is not null), chr(9)), '') as alternates,
      cast((case when population >= 100000 then 1 else 0 end) | (case when country_code = 'XG' then 2 else 0 end) | (case when elevation is not null then 4 else 0 end)
        | (case when len(alternate_names) > 0 then 8 else 0 end) as integer) as flags from cities"""
)
def project_computed(spark, d):
    flags = catalog.flag_bits([F.col("population") >= 100_000, F.col("country_code") == "XG", F.col("elevation").isNotNull(), F.size("alternate_names") > 0])
    return table(spark, d, "cities").select(
        F.col("geoname_id").alias("id"), "source_line", F.coalesce("timezone", F.lit("")).alias("timezone"), catalog.joined("alternate_names").alias("alternates"), flags.alias("flags")
    )


@query("select geoname_id, source_line from cities where country_code = 'XG'")
def filter_eq(spark, d):
    return table(spark, d, "cities").where(F.col("country_code") == "XG").select("geoname_id", "source_line")


@query("select geoname_id, population from cities where population >= 1000000")
def filter_cmp(spark, d):
    return table(spark, d, "cities").where(F.col("population") >= 1_000_000).select("geoname_id", "population")


@query("select geoname_id, source_line from cities where latitude between 35 and 60 and longitude between -10 and 40")
def filter_bbox(spark, d):
    return table(spark, d, "cities").where(catalog.in_box("latitude", "longitude", 35, 60, -10, 40)).select("geoname_id", "source_line")


@query("select geoname_id, source_line from cities where country_code = 'XG' and admin1_code = '01' and feature_class = 'P'")
def filter_conj(spark, d):
    return table(spark, d, "cities").where((F.col("country_code") == "XG") & (F.col("admin1_code") == "01") & (F.col("feature_class") == "P")).select("geoname_id", "source_line")


@query("select geoname_id, population from cities where population <> 0")
def filter_nonzero(spark, d):
    return table(spark, d, "cities").where(F.col("population") != 0).select("geoname_id", "population")


@query("select doc_id, lang, n_chars from documents where doc_id = 1307 limit 1")
def point_lookup(spark, d):
    return catalog.by_id(table(spark, d, "documents"), "doc_id", 1307).select("doc_id", "lang", "n_chars")


@query("select bool_or(population > 20000000) as found from cities")
def exists_flag(spark, d):
    return catalog.any_row(table(spark, d, "cities"), F.col("population") > 20_000_000)


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def top_n_prefix(spark, d):
    return catalog.top(table(spark, d, "customer"), 10, [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_acctbal")


@query("select geoname_id, population, source_line from cities where country_code = 'XG' order by population desc, source_line limit 10")
def filtered_top_n(spark, d):
    return catalog.top(table(spark, d, "cities").where("country_code = 'XG'"), 10, [F.desc("population"), F.asc("source_line")]).select("geoname_id", "population", "source_line")


@query("select source_line, population, row_number() over (order by population desc nulls last, source_line) as rank_no from cities")
def full_sort(spark, d):
    """All rows in order, with their place in it: sorted in ranges, numbered within them."""
    ordered = positions(table(spark, d, "cities"), "population", "source_line", "rank_no")
    return ordered.select("source_line", "population", (F.col("rank_no") + 1).alias("rank_no"))


# --- Places in ranking order -----------------------------------------------------------------------------------------


def placed(spark: SparkSession, d: str) -> DataFrame:
    """The places a search sees: those with a population, in order of it."""
    return positions(table(spark, d, "cities").where("population <> 0"), "population", "source_line")


_PLACED = "placed as (select *, row_number() over (order by population desc, source_line) - 1 as pos from cities where population <> 0)"
_TEXTS = """texts as (select pos, geoname_id, array_to_string(list_filter([name, ascii_name], lambda x: x is not null), chr(31)) as p,
      coalesce(array_to_string(list_concat(coalesce(alternate_names, []), coalesce(alternate_ascii_names, [])), chr(31)), '') as a from placed)"""
_FIELDS = f"{_PLACED}, {_TEXTS}, fields as (select pos, geoname_id, {oracle_fold('p')} as primary_text, {oracle_fold('a')} as alternate_text from texts)"


def _search_sql(text: str, limit: int) -> str:
    """The same search in SQL over all places."""
    cut = "" if limit < 0 else f"qualify rank_no <= {limit}"
    if not text.strip():
        return f"with {_PLACED} select geoname_id, pos, 0 as rank, pos + 1 as rank_no from placed {'' if limit < 0 else f'where pos < {limit}'}"
    q = f"(select {_oracle_needle(text)})"
    # a query of marks only folds to nothing and finds nothing
    return f"""with {_FIELDS}, found as (select geoname_id, pos, case when {q} = '' then null when contains(primary_text, {q}) then 0 when contains(alternate_text, {q}) then 1 end as rank from fields)
      select geoname_id, pos, rank, row_number() over (order by rank, pos) as rank_no from found where rank is not null {cut}"""


def tables(spark: SparkSession, d: str, index: bool = False) -> SearchTables:
    rows = placed(spark, d)
    fields = A.search_fields(rows, PLACES)
    if not index:
        return SearchTables(rows, PLACES, fields)
    posts = A.postings(fields)
    return SearchTables(rows, PLACES, fields, posts, A.scalar_freq(posts), index_least_rows=0)


def _searched(name: str, text: str, limit: int, mode: Mode = Mode.STORED, index: bool = False) -> None:
    def run(spark, d):
        return search(tables(spark, d, index), text, limit, mode).select("geoname_id", "pos", "rank", "rank_no")

    run.__name__ = name
    query(_search_sql(text, limit))(run)


@query(f"with {_PLACED} select source_line, pos from placed")
def ordinal_pos(spark, d):
    return placed(spark, d).select("source_line", "pos")


_searched("search_ascii", "sal", 20)
_searched("search_accented", "é", 20)
_searched("search_sharp_s", "ß", 50)
_searched("search_greek", "ΆΝΩ", 20)
_searched("search_ligature", "ﬃ", 20)
_searched("search_fullwidth", "Ｎｏｖａ", 20)
_searched("search_unlimited", "mora", -1)
_searched("search_limit_zero", "mora", 0)
_searched("search_empty_query", "", 25)
_searched("search_blank_unlimited", " 　\n", -7)
_searched("search_whitespace_trim", "　 new \n", 20)
_searched("search_inner_blank", "de cima", 20)
_searched("search_primary_first", "старое", 100)
_searched("search_cjk", "石", 50)
_searched("search_no_match", "京x", -1)
_searched("search_mark_only", "́", 20)
_searched("mode_scan", "bruck", 50, Mode.SCAN)
_searched("mode_stored", "bruck", 50, Mode.STORED)
_searched("mode_index", "石ナ", 50, Mode.INDEX, True)
_searched("mode_index_stored", "石ナ", 50, Mode.INDEX_STORED, True)


def _fields_of(name: str, spec: SearchSpec, rows: str, prim: str, alt: str, text: str, limit: int, rows_of) -> None:
    q = f"(select {_oracle_needle(text)})"

    def run(spark, d):
        got = rows_of(spark, d)
        return search(SearchTables(got, spec, A.search_fields(got, spec)), text, limit).select(spec.id, "pos", "rank", "rank_no")

    run.__name__ = name
    query(
        f"""with placed as ({rows}), found as (select {spec.id}, pos, case when contains({oracle_fold(prim)}, {q}) then 0 when contains({oracle_fold(alt)}, {q}) then 1 end as rank from placed)
        select {spec.id}, pos, rank, row_number() over (order by rank, pos) as rank_no from found where rank is not null qualify rank_no <= {limit}"""
    )(run)


_fields_of(
    "search_parts",
    PARTS,
    "select *, row_number() over (order by cast(round(p_retailprice * 100) as bigint) desc, p_partkey) - 1 as pos from part",
    "p_name",
    "concat_ws(chr(31), p_brand, p_type)",
    "ring",
    60,
    lambda s, d: positions(table(s, d, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long")), "cents", "p_partkey"),
)
_fields_of(
    "search_documents",
    DOCUMENTS,
    "select *, row_number() over (order by n_chars desc nulls last, doc_id) - 1 as pos from documents",
    "text",
    "concat_ws(chr(31), title, applicant)",
    "été",
    40,
    lambda s, d: positions(table(s, d, "documents").select("doc_id", "text", "title", "applicant", "n_chars"), "n_chars", "doc_id"),
)


@query(f"""with {_FIELDS} select geoname_id, pos from fields where contains(alternate_text, 'heights') and not contains(primary_text, 'heights')""")
def search_alternate_only(spark, d):
    t = tables(spark, d)
    return t.rows.join(matches(t, Query.of("heights")).where("rank = 1"), "pos").select("geoname_id", "pos")


@query(_search_sql("nova", -1))
def narrow_chain(spark, d):
    session = SearchSession(tables(spark, d))
    for text in ("n", "no", "nov", "nova"):
        session.update(text)
    return session.results(-1).select("geoname_id", "pos", "rank", "rank_no")


@query(_search_sql("ov", 200))
def narrow_reclassify(spark, d):
    session = SearchSession(tables(spark, d)).update("o").update("ov").update("OV ")
    return session.results(200).select("geoname_id", "pos", "rank", "rank_no")


@query(
    "with "
    + _FIELDS
    + ", needles as (select * from (values "
    + ", ".join(f"({i}, {_oracle_needle(t)})" for i, t in enumerate(BATCH))
    + """) n(query_no, needle)), found as (select query_no, pos, case when contains(primary_text, needle) then 0 else 1 end as rank from fields join needles
      on contains(primary_text, needle) or contains(alternate_text, needle))
      select query_no, pos, rank, row_number() over (partition by query_no order by rank, pos) as rank_no from found qualify rank_no <= 50"""
)
def batch_search_top(spark, d):
    return batch_search(tables(spark, d).fields, BATCH, 50)


# --- Folding ---------------------------------------------------------------------------------------------------------


@query(f"select source_line, {oracle_fold('name')} as folded from cities")
def fold_scalar(spark, d):
    return table(spark, d, "cities").select("source_line", U.fold_col(F.col("name")).alias("folded"))


@query("select * from (values " + ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(PINNED_FOLDS)) + ") t(case_no, text, folded)")
def fold_pinned(spark, d):
    """Agreed texts and folds; the SQL is the agreed list itself."""
    given = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PINNED_FOLDS)], "case_no int, text string")
    return given.select("case_no", "text", U.fold_col(F.col("text")).alias("folded"))


@query(f"select count(*) as n from cities where strlen(name) <> length(name) and {oracle_fold('name')} <> translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
def fold_needs(spark, d):
    return table(spark, d, "cities").where(U.needs_fold(F.col("name"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"select p_partkey from part where contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ring')")
def ascii_lower_contains(spark, d):
    return table(spark, d, "part").where(F.contains(U.lower_ascii(F.col("p_name")), F.lit("ring"))).select("p_partkey")


@query(f"with {_FIELDS} select pos, primary_text, alternate_text from fields")
def search_texts(spark, d):
    return tables(spark, d).fields


@query(
    f"""with placed as (select *, 0 as pos from cities), {_TEXTS}, chars as (select distinct unnest(string_split(p || a, '')) as c from texts where p || a <> ''),
      folded as (select c, {oracle_fold('c')} as f from chars where c <> '' and c <> chr(31))
      select cast(unicode(c) as integer) as scalar, f as folded from folded where f <> c"""
)
def fold_table(spark, d):
    """Fold of every character of the places that changes."""
    rows = table(spark, d, "cities")
    return U.fold_table(spark, A.corpus_chars(rows, PLACES))


# a single character begins inside an expansion exactly where the joiner precedes it
@query(
    f"""with {_PLACED}, {_TEXTS}, joined as (select pos, geoname_id, replace({oracle_fold('p', U.JOINER)}, '{U.JOINER}s', '') as p, replace({oracle_fold('a', U.JOINER)}, '{U.JOINER}s', '') as a from texts),
      found as (select geoname_id, pos, case when contains(p, 's') then 0 when contains(a, 's') then 1 end as rank from joined)
      select geoname_id, pos, rank, row_number() over (order by rank, pos) as rank_no from found where rank is not null"""
)
def strict_expansion(spark, d):
    """Matches that don't begin inside an expansion."""
    return search(tables(spark, d), "s", -1, Mode.SCAN, strict=True).select("geoname_id", "pos", "rank", "rank_no")


# --- Index -----------------------------------------------------------------------------------------------------------

_POSTS = f"{_FIELDS}, posts as (select distinct unnest(string_split(primary_text || chr(31) || alternate_text, '')) as c, pos from fields), index_ as (select cast(unicode(c) as integer) as scalar, pos from posts where c <> chr(31) and c <> '')"


def _postings(spark, d) -> DataFrame:
    return A.postings(tables(spark, d).fields)


@query(f"with {_POSTS} select scalar, pos from index_")
def postings_build(spark, d):
    return _postings(spark, d)


@query(f"with {_POSTS} select scalar, count(*) as n from index_ group by scalar order by n desc, scalar limit 10")
def scalar_freq_top(spark, d):
    return A.scalar_freq(_postings(spark, d)).orderBy(F.desc("n"), "scalar").limit(10)


@query(f"with {_PLACED}, {_TEXTS}, chars as (select unnest(string_split(p || a, '')) as c from texts) select distinct c from chars where c <> chr(31) and c <> ''")
def distinct_scalars(spark, d):
    rows = placed(spark, d)
    every = F.concat(A.texts(rows, PLACES.primary), A.texts(rows, PLACES.alternate))
    return rows.select(F.explode(F.split(F.array_join(every, ""), "")).alias("c")).where("c <> ''").distinct()


@query(f"with {_POSTS} select pos from index_ where scalar in (ascii('k'), ascii('r'), ascii('u')) group by pos having count(distinct scalar) = 3")
def posting_intersect(spark, d):
    return intersect_postings(_postings(spark, d), [ord(c) for c in "kru"])


@query(f"with {_POSTS} select pos from index_ where scalar in (ascii('k'), ascii('r'), ascii('u')) group by pos having count(distinct scalar) = 3")
def semi_candidates(spark, d):
    posts = _postings(spark, d)
    rows = placed(spark, d).select("pos")
    for c in "kru":
        rows = lookup.at_positions(rows, posts.where(F.col("scalar") == ord(c)))
    return rows


@query(f"with {_POSTS} select scalar, count(*) as n from index_ group by scalar")
def bitmap_counts(spark, d):
    maps = A.posting_bitmaps(_postings(spark, d))
    return maps.groupBy("scalar").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query(f"with {_FIELDS} select geoname_id, 'missing' as side from fields where contains(primary_text, 'nov') and not contains(primary_text, 'nova') and geoname_id not in (select geoname_id from fields where contains(primary_text, 'nova'))")
def anti_diff(spark, d):
    t = tables(spark, d)
    ids = lambda text: t.rows.join(matches(t, Query.of(text)).where("rank = 0"), "pos").select("geoname_id")
    return lookup.differences(ids("nov"), ids("nova"), "geoname_id")


@query(f"with {_FIELDS} select pos from fields where contains(primary_text, 'ova') union all select pos from fields where contains(alternate_text, 'ova') and not contains(primary_text, 'ova')")
def merge_union(spark, d):
    t = tables(spark, d)
    found = matches(t, Query.of("ova"))
    return found.where("rank = 0").unionAll(found.where("rank = 1")).select("pos")


@query(
    f"""with {_FIELDS}, sizes as (select strlen(primary_text) + strlen(alternate_text) as b, length(primary_text) + length(alternate_text) as c from fields)
      select cast(sum(case when b = c then b else 0 end) as bigint) as ascii_bytes, cast(sum(case when b <> c then b else 0 end) as bigint) as other_bytes, count(*) as n_rows from sizes"""
)
def artifact_sizes(spark, d):
    return A.memory_summary(tables(spark, d).fields)


# --- Lookups ---------------------------------------------------------------------------------------------------------

_ADMIN = "(select code, arg_max(ascii_name, source_line) as {name} from {table} where code is not null group by code)"


@query(f"select source_line, c.country_code, c.admin1_code, a.a1 from cities c left join {_ADMIN.format(name='a1', table='admin1_codes')} a on a.code = c.country_code || '.' || c.admin1_code")
def lookup_join_1(spark, d):
    names = X.last_wins(table(spark, d, "admin1_codes"), "code", "ascii_name", "source_line").toDF("k", "a1")
    rows = table(spark, d, "cities").withColumn("k", X.dotted_key(F.col("country_code"), F.col("admin1_code")))
    return lookup.lookup(rows, names, "k", 500_000).select("source_line", "country_code", "admin1_code", "a1")


@query(f"select source_line, a.a2 from cities c left join {_ADMIN.format(name='a2', table='admin2_codes')} a on a.code = c.country_code || '.' || c.admin1_code || '.' || c.admin2_code")
def lookup_join_2(spark, d):
    names = X.last_wins(table(spark, d, "admin2_codes"), "code", "ascii_name", "source_line").toDF("k", "a2")
    rows = table(spark, d, "cities").withColumn("k", X.dotted_key(F.col("country_code"), F.col("admin1_code"), F.col("admin2_code")))
    return lookup.lookup(rows, names, "k", 500_000).select("source_line", "a2")


@query("select c_custkey, n_name from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def lookup_join_unmatched(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup.lookup(table(spark, d, "customer"), nations, "c_nationkey", 500_000).select("c_custkey", "n_name")


@query("select code, arg_max(ascii_name, source_line) as name from admin2_codes where code is not null group by code")
def last_wins_dedupe(spark, d):
    return X.last_wins(table(spark, d, "admin2_codes"), "code", "ascii_name", "source_line").toDF("code", "name")


@query("select source_line, country_code || '.' || admin1_code || '.' || admin2_code as k from cities")
def key_concat(spark, d):
    return table(spark, d, "cities").select("source_line", X.dotted_key(F.col("country_code"), F.col("admin1_code"), F.col("admin2_code")).alias("k"))


# --- Field functions -------------------------------------------------------------------------------------------------


@query("select doc_id, list_filter(list_transform(string_split(coalesce(replace(title, ' / ', ' , ,'), ''), ','), lambda x: trim(x)), lambda x: x <> '') as items from documents")
def csv_list_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", X.list_of(F.replace("title", F.lit(" / "), F.lit(" , ,"))).alias("items"))


@query("select source_line, list_filter(coalesce(alternate_names, []), lambda x: strlen(x) = length(x)) as plain, list_filter(coalesce(alternate_names, []), lambda x: strlen(x) <> length(x)) as other from cities")
def ascii_partition(spark, d):
    names = F.coalesce("alternate_names", F.array().cast("array<string>"))
    return table(spark, d, "cities").select("source_line", X.ascii_items(names).alias("plain"), X.other_items(names).alias("other"))


_ORACLE_INT = "case when regexp_full_match({0}, '[+-]?[0-9]{{1,18}}') then cast({0} as bigint) end"


@query(f"select source_line, {_ORACLE_INT.format('admin1_code')} as n, coalesce({_ORACLE_INT.format('admin1_code')}, 0) as n0 from cities")
def tolerant_int(spark, d):
    c = F.col("admin1_code")
    return table(spark, d, "cities").select("source_line", X.int_or_null(c).alias("n"), X.int_or_zero(c).alias("n0"))


#: Texts, whole numbers, numbers and days as a tolerant reader takes them; nothing is None or 0.
PINNED_FIELDS = (
    ("12", 12, 12.0, None), ("+7", 7, 7.0, None), ("-3", -3, -3.0, None), (" 5", None, 0.0, None), ("5 ", None, 0.0, None), ("", None, 0.0, None), ("1.5", None, 1.5, None), ("1d", None, 0.0, None), ("2f", None, 0.0, None),
    ("1e3", None, 1000.0, None), ("x", None, 0.0, None), ("0x1F", None, 31.0, None), ("1_000", None, 0.0, None), ("9223372036854775807", 9223372036854775807, 9223372036854775807.0, None), ("9223372036854775808", None, 9223372036854775808.0, None), ("٣", None, 0.0, None),
    ("2020-02-29", None, 0.0, "2020-02-29"), ("2021-02-29", None, 0.0, None), ("2020-1-2", None, 0.0, None), ("2020/01/02", None, 0.0, None), ("2020-01-02 ", None, 0.0, None), ("0001-01-01", None, 0.0, "0001-01-01"), ("2020-13-01", None, 0.0, None),
)


@query(
    "select case_no, text, cast(n as bigint) as n, cast(d as double) as d, cast(day as date) as day from (values "
    + ", ".join(f"({i}, {_quoted(t)}, {'null' if n is None else n}, {d!r}, {'null' if day is None else _quoted(day)})" for i, (t, n, d, day) in enumerate(PINNED_FIELDS))
    + ") t(case_no, text, n, d, day)"
)
def tolerant_fields(spark, d):
    """Texts read as whole numbers, numbers and days; the SQL is the agreed list itself."""
    given = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PINNED_FIELDS)], "case_no int, text string")
    c = F.col("text")
    return given.select("case_no", "text", X.int_or_null(c).alias("n"), X.double_or_zero(c).alias("d"), X.date_or_null(c).alias("day"))


@query("select source_line, try_cast(t as date) as day from (select source_line, case when regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then x end as t from (select source_line, case source_line % 4 when 0 then x when 1 then replace(x, '-0', '-9') when 2 then replace(x, '-0', '-') else x || ' ' end as x from (select source_line, strftime(modification_date, '%Y-%m-%d') as x from cities)))")
def tolerant_date(spark, d):
    """Dates as they are, with impossible parts, with parts of one digit, with a blank behind."""
    text = F.date_format("modification_date", "yyyy-MM-dd")
    kind = F.pmod(F.col("source_line"), F.lit(4))
    spoiled = F.when(kind == 0, text).when(kind == 1, F.replace(text, F.lit("-0"), F.lit("-9"))).when(kind == 2, F.replace(text, F.lit("-0"), F.lit("-"))).otherwise(F.concat(text, F.lit(" ")))
    return table(spark, d, "cities").select("source_line", X.date_or_null(spoiled).alias("day"))


@query("select source_line, nullif(country_code, '') as country_code from cities")
def null_if_empty(spark, d):
    return table(spark, d, "cities").select("source_line", X.empty_to_null(F.col("country_code")).alias("country_code"))


_CRC_STEP = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"


def _crc_byte(value: str) -> str:
    """Eight steps of the reflected polynomial 0xEDB88320 over the low byte."""
    expr = value
    for _ in range(8):
        expr = f"(select {_CRC_STEP} from (select {expr} as c))"
    return expr


@query(
    f"""with names as (select distinct name from cities), steps as (select i, {_crc_byte("i")} as t from (select unnest(range(256)) as i)), tab as materialized (select list(t order by i) as t from steps),
      bytes as (select name, t, [('0x' || hex(encode(name))[2 * k - 1 : 2 * k])::integer for k in range(1, strlen(name) + 1)] as b from names, tab),
      sums as (select name, list_reduce(list_prepend(4294967295::bigint, b::bigint[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) as c from bytes)
      select source_line, lower(lpad(to_hex(xor(c, 4294967295)), 8, '0')) as crc from cities left join sums using (name)"""
)
def crc_fingerprint(spark, d):
    """CRC-32 of each name; the SQL makes it byte by byte from the polynomial."""
    return table(spark, d, "cities").select("source_line", X.crc_hex(F.col("name")).alias("crc"))


@query("select source_line, cast(modification_date - date '1970-01-01' as integer) as days, modification_date as day from cities")
def epoch_days(spark, d):
    days = F.unix_date("modification_date")
    return table(spark, d, "cities").select("source_line", days.alias("days"), F.date_from_unix_date(days).alias("day"))


# --- Aggregates ------------------------------------------------------------------------------------------------------


@query("select count(*) as n from cities")
def count_all(spark, d):
    return table(spark, d, "cities").agg(F.count(F.lit(1)).alias("n"))


@query("select country_code, min(population) as least, max(population) as most, cast(sum(population) // count(*) as bigint) as mean from cities where population > 0 group by country_code")
def min_max_avg(spark, d):
    return (
        table(spark, d, "cities")
        .where("population > 0")
        .groupBy("country_code")
        .agg(F.min("population").alias("least"), F.max("population").alias("most"), F.expr("sum(population) div count(1)").alias("mean"))
    )


@query("select country_code, " + ", ".join(f"sum(case when feature_class = '{c}' then 1 else 0 end)::bigint as {c}" for c in "PAS") + " from cities group by country_code")
def pivot_counts(spark, d):
    got = table(spark, d, "cities").groupBy("country_code").pivot("feature_class", list("PAS")).agg(F.count(F.lit(1)))
    return got.select("country_code", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "PAS"])


@query("select cast(sum(hash_ % 1000003) as bigint) as checksum from (select geoname_id * 31 + source_line as hash_ from cities)")
def checksum_reduce(spark, d):
    return table(spark, d, "cities").agg(F.sum((F.col("geoname_id") * 31 + F.col("source_line")) % 1_000_003).alias("checksum"))


@query("select country_code, list_sort(list(distinct geoname_id)) as ids from cities where population > 1000000 group by country_code")
def sorted_ids(spark, d):
    return table(spark, d, "cities").where("population > 1000000").groupBy("country_code").agg(F.array_sort(F.collect_set("geoname_id")).alias("ids"))


@query("select country_code, geoname_id, row_number() over (partition by country_code order by geoname_id) - 1 as id_no from (select distinct country_code, geoname_id from cities where geoname_id is not null)")
def sorted_ids_all(spark, d):
    """The sorted id list of each country over all rows, one row for each id: numbered in id blocks, so no country needs one task or one array."""
    ids = table(spark, d, "cities").where("geoname_id is not null").select("country_code", "geoname_id").distinct()
    code = ids.withColumns({"none": F.col("country_code").isNull(), "code": F.coalesce("country_code", F.lit("")), "block": F.floor(F.col("geoname_id") / TIE_BLOCK)})
    return running(code, ["none", "code"], ["block"], [F.col("geoname_id")], F.lit(1).cast("long"), "id_no").select("country_code", "geoname_id", "id_no")


@query(f"with {_PLACED} select country_code, count(*) as n, min(pos) as best from placed group by country_code")
def best_position(spark, d):
    return placed(spark, d).groupBy("country_code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("best"))


@query("select r_name, n_name, cast(count(*) as bigint) as n, grouping(r_name, n_name)::integer as g from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def rollup_counts(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("g"))


@query("select country_code, source_line, cast(row_number() over (partition by country_code order by population desc, source_line) as integer) as place_no from cities qualify place_no <= 3")
def window_top(spark, d):
    w = Window.partitionBy("country_code").orderBy(F.desc("population"), "source_line")
    return table(spark, d, "cities").select("country_code", "source_line", F.row_number().over(w).alias("place_no")).where("place_no <= 3")


@query(_search_sql("ber", 30))
def two_list_quota(spark, d):
    """Primary and alternate matches as two lists, the second filling what the first leaves of the limit."""
    t = tables(spark, d)
    return t.rows.join(F.broadcast(ranked(matches(t, Query.of("ber")), 30)), "pos").select("geoname_id", "pos", "rank", "rank_no")
