"""Queries of the training-text problems over the test tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsearch.llm import mixing, packing, pii, tokens, topn, visual
from foldsearch.operators.orphans import current_rows
from foldsearch.operators.skew import skew_join
from foldsearch.runtime import bounded_broadcast, ensure_checkpoint_dir, table

TOP_PLACES = 10
#: A register of agreed names up to this many rows is broadcast.
BROADCAST_NAMES = 200_000


def p2_top_places(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(table(spark, d, "cities"), ["country_code", "population"]).where("country_code <> '' and population > 0")
    return topn.top_n(rows, ["country_code"], "population", ["geoname_id"], TOP_PLACES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top_places(spark, d).select("country_code", "geoname_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(geoname_id, field_name, text) of all names."""
    one = lambda f, c: F.transform(c, lambda t: F.struct(F.lit(f).alias("field_name"), t.alias("text")))
    fields = F.concat(
        one("name", F.array("name")), one("ascii_name", F.array("ascii_name")), one("alternate_names", F.coalesce("alternate_names", F.array().cast("array<string>")))
    )
    return table(spark, d, "cities").select("geoname_id", F.inline(fields)).where("text <> ''")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every name of the places with its consistent form."""
    return visual.with_form(_texts(spark, d).distinct(), "text", "form")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    register = visual.with_form(table(spark, d, "name_register").select("ref_id", "name"), "name", "form")
    small, _ = bounded_broadcast(table(spark, d, "name_register"), BROADCAST_NAMES)
    # repeated names are rare and only results are made distinct, so the names themselves aren't shuffled
    names = visual.with_form(_texts(spark, d), "text", "form")
    met = names.join(F.broadcast(register), "form") if small else skew_join(names, register, ["form"], ["geoname_id", "field_name", "text"])
    return met.where("text <> name").select("geoname_id", "field_name", "ref_id").distinct()


def _counts(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Tokens of every document, counted once and kept in the shared folder: a few numbers for each text."""
    ensure_checkpoint_dir(spark)
    return tokens.token_counts(table(spark, d, "documents"), columns, "text").checkpoint()


def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    return {r["pack_id"]: r["capacity_tokens"] for r in table(spark, d, "pack_sizes").where("pack_id is not null and capacity_tokens > 0").collect()}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_counts(spark, d, ["doc_id"]), _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused room for each capacity."""
    return packing.fill_report(p7_containers(spark, d), _capacities(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers over the capacity and documents with missing parts, for each capacity."""
    return packing.check_report(p7_containers(spark, d), _capacities(spark, d))


def _targets(spark: SparkSession, d: str) -> dict[str, mixing.Target]:
    """Of several lines of a source the one with the largest share counts."""
    lines = table(spark, d, "mix_targets").where("source is not null")
    rows = lines.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("r")).select("source", "r.*").collect()
    return {r["source"]: mixing.Target(float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows}


def p8_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents in order of the schedule's slots."""
    return mixing.mix(_counts(spark, d, ["doc_id", "source"]), _targets(spark, d))[0]


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.uses(p8_schedule(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_schedule(spark, d), table(spark, d, "mix_targets"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents used more often than their source allows."""
    return mixing.check_report(p8_schedule(spark, d), table(spark, d, "mix_targets").where("source is not null"))


def p9_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal information in the documents."""
    return pii.find_pii(table(spark, d, "documents"), ["doc_id"], "text", table(spark, d, "given_names").select("given_name"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_entities(spark, d).select("doc_id", "pii_type", "pii_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with placeholders for what was found."""
    return pii.redact(table(spark, d, "documents"), ["doc_id"], "text", table(spark, d, "given_names").select("given_name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_top_places, p4_found, p4_forms, p7_containers, p7_fill, p7_check, p8_documents, p8_shares, p8_schedule, p8_check, p9_found, p9_entities, p9_redacted)
}

_CURRENT = "(select * from cities where geoname_id <> 0 qualify row_number() over (partition by geoname_id order by source_line desc) = 1)"
_TOP = f"""select country_code, population, geoname_id, cast(row_number() over (partition by country_code order by population desc, geoname_id) as integer) as rank_no
    from {_CURRENT} where country_code <> '' and population > 0 qualify rank_no <= 10"""

# The same looks written down for the other engine, apart from the operator's tables: of what occurs in names, which signs look the same.
_WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９！＃＆＇（）－．／ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝµ⽊⽯⼭⽥⽔⼤⼩"
_USUAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!#&'()-./ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワンμ木石山田水大小"
_MARKS, _MARKS_AS = "ﾞﾟ‐‑﹣ʼ", "\u3099\u309a---’"
_LETTERS = "АВЕЅІЈКМНОРСТУХҮӀԚԜаесһіјорѕухԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνρɡɑÐƉ"
_LETTERS_AS = "ABESIJKMHOPCTYXYIQWaechijopsyxdqwlABEZHIKMNOPTYXCocjvpgaĐĐ"
_ACCENTED, _ACCENTED_AS = "ЀЁЇѐёїӐӒӖӦӰӑӓӗӧӱΆΈΊΌΎόΪΫЌќ", "ÈËÏèëïĂÄĔÖŸăäĕöÿÁÉÍÓÝóÏŸḰќ"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǆ": "dž", "Ǉ": "LJ", "ǉ": "lj", "Ǌ": "NJ", "ǌ": "nj"}
#: Presentation forms of Arabic letters: first and last form of each letter, in the order of the alphabet's block.
_ARABIC = "آأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
_ARABIC_FORMS = (2, 2, 2, 2, 4, 2, 4, 2, 4, 4, 4, 4, 4, 2, 2, 2, 2, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 2, 2, 4)


def _oracle_form(text: str) -> str:
    """The form of a text in the other engine's own functions and the lists above."""
    at, shaped = 0xFE81, ""
    for n in _ARABIC_FORMS:
        shaped += "".join(chr(at + i) for i in range(n))
        at += n
    letters = "".join(c * n for c, n in zip(_ARABIC, _ARABIC_FORMS))
    q = lambda x: "'" + x.replace("'", "''") + "'"
    for k, v in _LIGATURES.items():
        text = f"replace({text}, {q(k)}, {q(v)})"
    for i, v in enumerate(("لآ", "لأ", "لإ", "لا")):
        for k in (0xFEF5 + 2 * i, 0xFEF6 + 2 * i):
            text = f"replace({text}, {q(chr(k))}, {q(v)})"
    text = f"translate({text}, {q(_WIDE + _MARKS + shaped)}, {q(_USUAL + _MARKS_AS + letters)})"
    text = f"regexp_replace(regexp_replace({text}, '\\p{{Zs}}', ' ', 'g'), '([\\x{{94D}}\\x{{9CD}}\\x{{A4D}}\\x{{ACD}}\\x{{B4D}}\\x{{BCD}}\\x{{C4D}}\\x{{CCD}}\\x{{D4D}}\\x{{DCA}}])([\\x{{200C}}\\x{{200D}}])|\\p{{Cf}}|[\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}\\x{{FE00}}-\\x{{FE0F}}]', '\\1\\2', 'g')"
    return f"trim(nfc_normalize(translate(nfc_normalize({text}), {q(_LETTERS + _ACCENTED)}, {q(_LETTERS_AS + _ACCENTED_AS)})))"


_FOUND_FORMS = f"""with every as (
    select geoname_id, 'name' as field_name, name as text from cities union all select geoname_id, 'ascii_name', ascii_name from cities
    union all select geoname_id, 'alternate_names', unnest(alternate_names) from cities
  ), named as (select distinct * from every where text <> ''),
  forms as (select text, {_oracle_form('text')} as form from (select distinct text from named)),
  agreed as (select ref_id, name, {_oracle_form('name')} as form from name_register)
"""
#: Texts and their forms.
PINNED_FORMS = (
    ("Ｎｏｖａ　Ｌｉｎａ", "Nova Lina"), ("e\u0301te\u0301", "été"), ("No\u200bva\ufeff", "Nova"), ("Nova\u00a0Lina", "Nova Lina"), ("Νοvа", "Nova"), ("Москва", "Mocквa"), ("ё", "ë"), ("ﬁeld", "field"), ("ｶﾞ", "ガ"), ("\u1100\u1161", "가"),
    ("\u2f4a", "木"), ("\u212a", "K"), ("a‑b", "a-b"), ("ﻻ", "لا"), (" Nova\u200b ", "Nova"), ("µ", "μ"), ("nova", "nova"), ("m²", "m²"), ("①", "①"), ("ł", "ł"), ("ſ", "ſ"), ("ß", "ß"), ("क्\u200dष", "क्\u200dष"), ("Ꭰ\u200d", "D"), ("", ""),
)


def p4_pinned(spark: SparkSession, d: str) -> DataFrame:
    """Agreed texts and forms; the SQL is the agreed list itself."""
    given = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PINNED_FORMS)], "case_no int, text string")
    return visual.with_form(given, "text", "form")


QUERIES["p4_pinned"] = p4_pinned

SQL: dict[str, str] = {
    "p4_found": _FOUND_FORMS + "select distinct geoname_id, field_name, ref_id from named n join forms f using (text) join agreed a on a.form = f.form where n.text <> a.name",
    "p4_forms": _FOUND_FORMS + "select geoname_id, field_name, text, form from named join forms using (text)",
    "p4_pinned": "select * from (values " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PINNED_FORMS)) + ") t(case_no, text, form)",
    "p7_check": "select pack_id, (select count(*) from documents) as n_docs, 0::bigint as n_over, 0::bigint as n_gaps from pack_sizes where capacity_tokens > 0",
    "p8_check": "select distinct source, 0::bigint as n_over from mix_targets where source is not null",
    "p2_found": f"select country_code, geoname_id from ({_TOP})",
    "p2_top_places": _TOP,
}
