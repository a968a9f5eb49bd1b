from foldsearch import workload
from foldsearch.operators import artifacts as A
from foldsearch.operators.search import SearchTables


def test_workload(spark, tmp_path):
    from test_search import MIXED, SPEC, tables

    t = tables(spark, MIXED)
    t = SearchTables(t.rows.cache(), SPEC, A.search_fields(t.rows, SPEC).cache(), t.postings.cache(), t.freq.cache(), len(MIXED))
    got = workload.run(t, ["tok", "京"], (-1, 1)).cache()
    assert got.count() == 16 and workload.mismatches(got).count() == 0
    assert {r["query"]: r["results"] for r in got.where("limit = -1").collect()} == {"tok": 1, "京": 2}
    assert workload.by_mode(got).count() == 4 and workload.summary(got).count() == 8
    workload.report(got, str(tmp_path / "r.md"))
    assert "| limit | mode |" in (tmp_path / "r.md").read_text()
