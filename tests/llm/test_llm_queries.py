"""The queries of the subpackage: DuckDB's rows where SQL can say the same, invariants elsewhere."""

import pytest
from helpers import connect, rows_of, sql_rows

from foldsearch.llm import queries


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_rows(spark, con, small_dir, name):
    df = queries.QUERIES[name](spark, small_dir)
    if name in queries.SQL:
        names, expected = sql_rows(con, queries.SQL[name])
        assert sorted(df.columns) == names and rows_of(df) == expected
    else:
        assert df.count() > 0


def test_every_document_is_packed_once(spark, con, small_dir):
    got = queries.p7_containers(spark, small_dir).toPandas()
    n = con.execute("select count(*) from documents").fetchone()[0]
    assert set(got.groupby("pack_id").doc_id.nunique()) == {n}
    assert len(got) == len(got.drop_duplicates(["pack_id", "doc_id", "part_no"]))


def test_redacted_text_keeps_the_rest(spark, small_dir):
    from foldsearch.llm.pii import replaced

    entities = {}
    for r in queries.p9_entities(spark, small_dir).collect():
        entities.setdefault(r["doc_id"], []).append((r["pii_type"], r["pii_start"], r["pii_end"], r["pii_text"]))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in queries.p9_redacted(spark, small_dir).collect():
        t = texts[r["doc_id"]]
        assert r["redacted"] == (None if t is None else replaced(t, entities.get(r["doc_id"], [])))
