"""The plans are those meant: filters and columns reach the files, nothing is shuffled without need."""

import pytest
from pyspark.sql import functions as F

from foldsearch.operators.search import Mode, Query, candidates, matches, ranked
from foldsearch.plans import general, reference
from foldsearch.sources import store as S


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def tables(spark, small_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "store")
    S.write_store(spark.read.parquet(f"{small_dir}/cities.parquet").where("population <> 0"), path)
    return S.read_store(spark, path, verify=False)


def test_filters_reach_the_files(spark, small_dir):
    assert "PushedFilters: [IsNotNull(country_code), EqualTo(country_code,XG)]" in plan_of(reference.filter_eq(spark, small_dir))
    assert "GreaterThanOrEqual(latitude" in plan_of(reference.filter_bbox(spark, small_dir))
    p = plan_of(reference.scan_project(spark, small_dir))
    assert "ReadSchema: struct<geoname_id:bigint,name:string,country_code:string>" in p


def test_search_reads_two_texts_and_sorts_only_the_top(tables):
    p = plan_of(ranked(matches(tables, Query.of("sal"), Mode.STORED), 20))
    assert "ReadSchema: struct<pos:bigint,primary_text:string,alternate_text:string>" in p
    assert "TakeOrderedAndProject" in p and "population" not in p


def test_index_reads_only_its_characters(tables):
    got = candidates(tables.postings, {ord("石"): 5}, Query.of("石"), 10**6)
    assert "EqualTo(scalar," in plan_of(got)


def test_stored_search_stays_in_generated_code(tables):
    p = plan_of(matches(tables, Query.of("sal"), Mode.STORED))
    assert "Exchange" not in p and "Python" not in p
    filters = [x for x in p.split("\n") if "Filter (" in x]
    assert filters and all(x.strip().lstrip(":+- ").startswith("* Filter") for x in filters)  # the star marks generated code


def test_batches_stay_in_generated_code(spark, tables):
    from foldsearch.operators.search import batch_search

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows what is generated only after it ran
    try:
        p = plan_of(batch_search(tables.fields, ["a", "mün", "ß"], 5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [x for x in p.split("\n") if "Generate (" in x or "Filter (" in x or "Scan parquet" in x]
    assert any("* Generate" in x for x in lines) and "Python" not in p


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "p6_found"])
def test_general_problems_stay_in_the_jvm(spark, small_dir, name):
    p = plan_of(general.QUERIES[name](spark, small_dir))
    assert "Python" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_snapshots_read_what_they_compare(spark, small_dir):
    p = plan_of(general.p5_found(spark, small_dir))
    assert "name:string" not in p and "latitude" not in p


def test_placed_rows_are_not_moved_again(spark):
    from foldsearch.operators import skew

    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = skew.plan_placement(df, ["k"], 4)
    p = plan_of(skew.place(df, ["k"], plan, ["id"]).groupBy(skew.TASK, "k").agg(F.count("*")))
    assert p.lower().count("exchange (") <= 2  # one exchange, perhaps one small broadcast


def test_batches_are_limited_before_the_shuffle(tables):
    from foldsearch.operators.search import batch_search

    assert "WindowGroupLimit" in plan_of(batch_search(tables.fields, ["a", "b"], 5))
