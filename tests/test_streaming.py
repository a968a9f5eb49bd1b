"""Type-ahead over a stream of keystrokes."""

import json

from foldsearch.operators.search import SearchTables, search
from foldsearch.streaming.typeahead import answer_into, step_kind, typeahead_steps


def test_step_kinds():
    assert [step_kind(*x) for x in (("", "a", "a"), ("a", "ab", "ab"), ("ab", "ab", "AB"), ("ab", "b", "b"), ("b", "", ""))] == ["fresh", "narrow", "same", "fresh", "clear"]


def test_stream(spark, tmp_path):
    from test_search import MIXED, SPEC, tables

    t = tables(spark, MIXED, index=False)
    keys = [("s", 1, "T"), ("s", 2, "to"), ("s", 3, "tok"), ("u", 1, "mün"), ("u", 2, None), (None, 1, "x")]
    (tmp_path / "in").mkdir()
    for i, k in enumerate(keys):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(("session_id", "step_no", "text"), k))) + "\n")
    got, steps = [], []

    def sink(df, epoch):
        got.extend(df.collect())

    def each(batch, epoch):
        batch.persist()
        steps.extend(batch.collect())
        answer_into(t.fields, sink)(batch, epoch)
        batch.unpersist()

    stream = spark.readStream.schema("session_id string, step_no long, text string").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    run = typeahead_steps(stream).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["session_id"], r["step_no"]): r["kind"] for r in steps} == {("s", 1): "fresh", ("s", 2): "narrow", ("s", 3): "narrow", ("u", 1): "fresh", ("u", 2): "clear"}
    plain = SearchTables(t.rows, SPEC, t.fields)
    for text in ("t", "to", "tok", "mun"):
        expected = [r["pos"] for r in search(plain, text).orderBy("rank_no").collect()]
        assert [r["pos"] for r in sorted((g for g in got if g["folded"] == text), key=lambda g: g["rank_no"])] == expected
