"""Top N of groups and visually identical texts."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldsearch.llm import topn, visual


def brute_top(data, n):
    out = []
    for g in {x[0] for x in data} - {None}:
        own = sorted((x for x in data if x[0] == g and x[1] is not None), key=lambda x: (-x[1], x[2]))
        out += [(g, s, t, i + 1) for i, (s, t) in enumerate((x[1], x[2]) for x in own[:n])]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize("broadcast", [True, False])
def test_top_n(spark, n, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(topn, "BROADCAST_GROUPS", 1)
    r = random.Random(n)
    data = [(r.choice(["hot", "hot", "hot", "a", "b", "", None]), r.choice([None, 0, -5, 7, 7, 7, 10**15, r.randrange(-1000, 1000)]), i, "x") for i in range(800)]
    df = spark.createDataFrame(data, "g string, s long, t long, rank_no string")
    got = sorted(tuple(x) for x in topn.top_n(df, ["g"], "s", ["t"], n).select("g", "s", "t", "rank_no").collect())
    assert got == brute_top(data, n)


def test_top_n_of_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", 5.0, 1)] * 50 + [("a", float("inf"), 2), ("b", float("-inf"), 3), ("c", None, 1)], "g string, s double, t int")
    got = sorted(tuple(x) for x in topn.top_n(df, ["g"], "s", ["t"], 3).collect())
    assert got == [("a", 5.0, 1, 2), ("a", 5.0, 1, 3), ("a", float("inf"), 2, 1), ("b", float("-inf"), 3, 1)]
    assert topn.top_n(df, ["g"], "s", ["t"], 0).count() == 0 and topn.top_n(df.limit(0), ["g"], "s", ["t"], 3).count() == 0


def test_top_n_of_equal_rows_without_ties(spark, monkeypatch):
    """A hot group of equal rows and no tie columns, on the way that splits groups."""
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 1)
    df = spark.createDataFrame([("hot", 7)] * 900 + [("hot", 9), ("a", 1), ("a", 1)], "g string, s int")
    got = sorted(tuple(x) for x in topn.top_n(df, ["g"], "s", [], 4).collect())
    assert got == [("a", 1, 1), ("a", 1, 2), ("hot", 7, 2), ("hot", 7, 3), ("hot", 7, 4), ("hot", 9, 1)]


def test_bins_keep_the_order(spark):
    r = random.Random(0)
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, *(r.uniform(-1e6, 1e6) for _ in range(500)), *(float(i) for i in range(-50, 50)), 2.0**62])
    got = [x["b"] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", topn.score_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def forms(*texts):
    return visual.forms(visual.connect(), pa.array(texts, pa.string())).to_pylist()


SAME = [
    ("Ｎｏｖａ　Ｌｉｎａ", "Nova Lina"),
    ("e\u0301te", "éte"),
    ("No\u200bva\ufeff", "Nova"),
    ("No\u00adva\u2060\u200e", "Nova"),
    ("Nova\u00a0Lina", "Nova Lina"),
    ("Nova\u202fLina", "Nova\u2007Lina"),
    ("Νοvа", "Nova"),
    ("ё", "\u0435\u0308"),
    ("ё", "ë"),
    ("ﬁeld", "field"),
    ("ｶﾞ", "ガ"),
    ("가", "\u1100\u1161"),
    ("\u2f4a", "木"),
    ("\uf9f4", "林"),
    ("\u212a", "K"),
    ("a‑b", "a-b"),
    ("ﻻ", "لا"),
    (" Nova\u200b ", "Nova"),
    ("µ", "μ"),
]
OTHER = [("Nova", "nova"), ("Nova", "Nóva"), ("ä", "a"), ("ß", "ss"), ("m²", "m2"), ("①", "1"), ("ł", "l"), ("к", "k"), ("क्\u200dष", "क्ष"), ("ſ", "s"), ("ガ", "カ"), ("a b", "ab"), ("Ω", "O")]


def test_same_and_other_looks():
    for a, b in SAME:
        assert len(set(forms(a, b))) == 1, (a, b)
    for a, b in OTHER:
        assert len(set(forms(a, b))) == 2, (a, b)


def test_forms_of_odd_texts():
    assert forms(None, "", "\u200b", "it's; drop 'x' \\1") == [None, "", "", "it's; drop 'x' \\1"]
    long = "Ｎо\u200bва " * 50_000
    assert forms(long)[0] == ("Noвa " * 50_000).strip()
    assert forms() == []


def test_forms_are_stable_and_as_in_python():
    r = random.Random(6)
    pool = "abcÀéñ аеоѕΟΡﬁﬃＡｂ\u200b\u00ad\u0301\u0308\u3000‐가가ｶﾞ木⽊İ٣"
    texts = ["".join(r.choices(pool, k=r.randint(0, 14))) for _ in range(500)]
    got = forms(*texts)
    one, many, alike = visual.tables()
    import re

    hidden = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), visual.INVISIBLE))

    def brute(t):
        t = "".join(many.get(c, one.get(c, c)) for c in t)
        t = unicodedata.normalize("NFC", hidden.sub("", t))
        return unicodedata.normalize("NFC", "".join(alike.get(c, c) for c in t)).strip(" ")

    assert got == [brute(t) for t in texts]
    assert forms(*got) == got


def test_with_form_keeps_other_columns(spark):
    df = spark.createDataFrame([("Ｎ", 1, "x"), (None, 2, "y"), ("", None, None)], "t string, i int, form string")
    got = sorted((tuple(r) for r in visual.with_form(df, "t", "form").select("t", "i", "form").collect()), key=repr)
    assert got == sorted([("Ｎ", 1, "N"), (None, 2, None), ("", None, "")], key=repr)
    assert visual.with_form(df.limit(0), "t", "form").count() == 0
    assert {r["t"] for r in visual.with_form(df, "t", "t").collect()} == {"N", "", None}
