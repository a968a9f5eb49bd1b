"""Ranking, folding, modes and type-ahead on small made-up places."""

import random

import pytest
from pyspark.sql import functions as F

from foldsearch.functions import fold as U
from foldsearch.operators import artifacts as A
from foldsearch.operators.ordinals import positions
from foldsearch.operators.search import Mode, Query, SearchSession, SearchTables, batch_search, search
from foldsearch.schema import SearchSpec

SPEC = SearchSpec("id", ("name", "ascii_name"), ("alternate_names", "alternate_ascii_names"), "weight", "line")
SCHEMA = "id string, name string, ascii_name string, alternate_names array<string>, alternate_ascii_names array<string>, pos bigint"


def place(key, name, ascii_name=None, alt=(), alt_ascii=()):
    return (key, name, name if ascii_name is None else ascii_name, list(alt), list(alt_ascii))


def tables(spark, places, index=True):
    rows = spark.createDataFrame([(*p, i) for i, p in enumerate(places)], SCHEMA)
    fields = A.search_fields(rows, SPEC)
    posts = A.postings(fields)
    return SearchTables(rows, SPEC, fields, posts, A.scalar_freq(posts), len(places), index_least_rows=0) if index else SearchTables(rows, SPEC, fields)


def ids(df):
    return [r["id"] for r in df.orderBy("rank_no").collect()]


def find(t, text, limit=-1, mode=Mode.STORED, **k):
    return ids(search(t, text, limit, mode, **k))


KANJI = [place("tokyo", "東京", "Tokyo"), place("beijing", "北京", "Beijing"), place("kyoto", "京都", "Kyoto")]
MIXED = [
    place("tokyo", "東京", "Tokyo", ["東京都"], ["Tokyo Metropolis"]),
    place("munchen", "München", "Munchen"),
    place("beijing", "北京", "Beijing"),
    place("eszett", "ẞeta", "Beta"),
    place("ligature", "ﬃtown", "LigatureTown"),
]
CASES = [
    ([place("alt-high", "Alpha", alt_ascii=["jil"]), place("primary-low", "Jilburg")], "jil", -1, ["primary-low", "alt-high"]),
    ([place("alt-high", "Alpha", alt_ascii=["jil"]), place("primary-low", "Jilburg")], "jil", 1, ["primary-low"]),
    ([place("tokyo", "Tokyo")], "tok", 0, []),
    ([place(f"tok-{i}", f"Tokyo {i}") for i in range(40)], "tok", 5, [f"tok-{i}" for i in range(5)]),
    ([place("eszett", "ẞeta", "Beta")], "ße", -1, ["eszett"]),
    ([place("athens-upper", "ΑΘΉΝΑ", "Athina")], "θή", -1, ["athens-upper"]),
    ([place("ligature", "ﬃtown", "ffitown")], "ffi", -1, ["ligature"]),
    (KANJI, "京", -1, ["tokyo", "beijing", "kyoto"]),
    (KANJI, "東京", -1, ["tokyo"]),
    ([place("munchen", "München", "Munchen"), place("zurich", "Zürich", "Zurich"), place("berlin", "Berlin")], "münch", -1, ["munchen"]),
    ([place("ascii-only", "Plain", "Munchen"), place("other", "Other")], "mün", -1, ["ascii-only"]),
    ([place("ascii-only", "Kyoto", alt_ascii=["Tokyo Metropolis"]), place("utf8-match", "京都", "Kyoto")], "京", -1, ["utf8-match"]),
    ([place("berlin", "Berlin")], "京", -1, []),
    ([place("a", "New York"), place("b", "Newyork")], "  new york\n", -7, ["a"]),
    ([place("a", "Ｔｏｋｙｏ")], "tok", -1, ["a"]),
    ([place("a", "éte"), place("b", "été")], "été", -1, ["a", "b"]),
    ([place("a", "Alpha"), place("b", "Beta")], "　 ", 1, ["a"]),
    ([place("a", "Alpha")], "́", -1, []),
    ([place("a", "x"), place("b", None, "")], "longer than any", -1, []),
    ([place("a", "one", alt=["two"]), place("b", "onetwo")], "onetwo", -1, ["b"]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases_in_all_modes(spark, n):
    places, text, limit, expected = CASES[n]
    t = tables(spark, places)
    for mode in Mode:
        assert find(t, text, limit, mode) == expected, mode


def test_modes_agree(spark):
    t = tables(spark, MIXED)
    for text in ("tok", "東京", "mün", "ße", "ffi", "京", "beta"):
        assert len({tuple(find(t, text, -1, m)) for m in Mode}) == 1


def test_strict_expansion(spark):
    t = tables(spark, [place("a", "ße")])
    assert [bool(find(t, x, strict=True)) for x in ("se", "sse", "ss", "s", "e")] == [False, True, True, True, True]
    assert find(t, "se") == ["a"]


def test_needle_with_separator(spark):
    t = tables(spark, [place("a", "one", "two"), place("b", "one\x1ftwo")])
    assert find(t, "one\x1ftwo") == ["b"]


def test_session(spark):
    t = tables(spark, [place("jakarta", "Jakarta"), place("jilin", "Jilin"), place("jihlava", "Jihlava")])
    s = SearchSession(t)
    assert ids(s.results(2)) == ["jakarta", "jilin"]
    assert ids(s.update("j").results(1)) == ["jakarta"]
    assert ids(s.update("ji").results(-1)) == ["jilin", "jihlava"]
    assert ids(s.update("jil").results(-1)) == ["jilin"]
    assert s.narrowed == 2
    assert ids(s.update("").results(-1)) == ["jakarta", "jilin", "jihlava"]
    s.close()


def test_session_reclassifies(spark):
    t = tables(spark, [place("switch", "Aaa", alt_ascii=["ab"]), place("primary", "Abbot")])
    s = SearchSession(t)
    assert ids(s.update("a").results(-1)) == ["switch", "primary"]
    assert ids(s.update("ab").results(-1)) == ["primary", "switch"]
    assert ids(s.update("b").results(-1)) == ["primary", "switch"]
    s.close()


def test_random_chains_narrow_as_fresh(spark):
    r = random.Random(4)
    letters = "abßéÉeΘ東ｔT "
    t = tables(spark, [place(str(i), "".join(r.choices(letters, k=r.randint(0, 6))), alt=["".join(r.choices(letters, k=4))]) for i in range(60)])
    t = SearchTables(t.rows.cache(), SPEC, t.fields.cache())
    s = SearchSession(t)
    for _ in range(4):
        text = ""
        for _ in range(3):
            text += r.choice(letters)
            assert ids(s.update(text).results(-1)) == find(t, text)


def test_batch(spark):
    t = tables(spark, MIXED, index=False)
    texts = ["tok", "", "京", "x"]
    got = batch_search(t.fields, texts, -1).collect()
    for i, text in enumerate(texts):
        one = [p["pos"] for p in search(t, text, -1).orderBy("rank_no").collect()] if text else []
        assert [p["pos"] for p in sorted((g for g in got if g["query_no"] == i), key=lambda g: g["rank_no"])] == one


def test_fold_column_and_text_agree(spark):
    r = random.Random(1)
    samples = ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x300, 0x600), r.randrange(0x1E00, 0x2000), r.randrange(0xFB00, 0xFB10), r.randrange(0xFF00, 0xFFA0)])) for _ in range(12)) for _ in range(200)]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select("t", U.fold_col(F.col("t")).alias("f")).collect()
    assert all(g["f"] == U.fold(g["t"]) for g in got)
    assert U.fold("ẞ") == "ss" and U.fold("ﬃ") == "ffi" and U.fold("É") == "e" and U.fold("Ａ") == "a" and U.fold("́") == ""
    assert Query.of(" 　É ").folded == "e"


def test_positions(spark):
    r = random.Random(2)
    rows = [(r.choice([0, 0, 0, 5, 5, 9, None, -3, 10**12]), i) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "v bigint, l bigint")
    got = [(x["v"], x["l"]) for x in positions(df, "v", "l").orderBy("pos").collect()]
    assert got == sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else -(2**62)), x[1]))
    assert [x["pos"] for x in positions(df, "v", "l").orderBy("pos").collect()] == list(range(300))
    assert positions(df.limit(0), "v", "l").count() == 0


def test_visit_stops_early(spark):
    from foldsearch.operators.search import visit

    t = tables(spark, MIXED)
    seen = []
    assert visit(t, "o", lambda r: seen.append(r["rank_no"]) or len(seen) < 2) == 2 and seen == [1, 2]
    assert visit(t, "qqqq", lambda r: True) == 0


def test_batches_in_all_ways(spark):
    from foldsearch.operators.search import batch

    t = tables(spark, MIXED)
    t.fields = A.search_fields(t.rows, SPEC)
    asked = ["o", "tok", "", "京", "qq"]
    for mode in Mode:
        for limit in (-1, 2):
            got = sorted(tuple(r) for r in batch(t, asked, limit, mode).select("query_no", "pos", "rank", "rank_no").collect())
            plain = sorted((i, r["pos"], r["rank"], r["rank_no"]) for i, q in enumerate(asked) if q for r in search(t, q, limit).collect())
            assert got == plain, (mode, limit)
