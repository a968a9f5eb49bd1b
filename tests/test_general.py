"""Skewed keys, orphan references, snapshot changes and points against brute force, with odd inputs."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from foldsearch.operators import orphans, skew, snapshots, spatial

D = datetime.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- Skew ------------------------------------------------------------------------------------------------------------


def test_pack_balances():
    where, total = skew.pack({i: 1.0 for i in range(10)} | {"big": 5.0}, 3)
    assert set(where) == {*range(10), "big"} and max(total) <= 5.0 and sum(total) == 15.0


def test_plan_splits_large_keys(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    plan = skew.plan_placement(df, ["k"], 8)
    assert len(plan.shards) == 1 and plan.imbalance < 1.3
    assert 5 <= len(next(iter(plan.shards.values()))) <= 8
    counts = [r["count"] for r in skew.place(df, ["k"], plan, ["id"]).groupBy(skew.TASK).count().collect()]
    assert max(counts) < 2 * 9000 / 8


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_per_key_results(spark, share):
    r = random.Random(1)
    data = [("hot" if r.random() < share else r.choice(["a", "b", "", None]), r.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, item int, n_rows int")
    got = {x["k"]: (x["n_rows"], x["n_items"]) for x in skew.per_key_results(df, ["k"], "item", tasks=5).collect()}
    expected = {k: (sum(x[0] == k for x in data), len({x[1] for x in data if x[0] == k} - {None})) for k in {x[0] for x in data}}
    assert got == expected


def test_per_key_results_of_copies_and_matching(spark):
    df = spark.createDataFrame([("c", 7)] * 500 + [("d", 1), (None, 2)], "k string, item int")
    matching = spark.createDataFrame([("c", 10), (None, 11)], "k string, extra int")
    got = rows(skew.per_key_results(df, ["k"], "item", matching, 4).select("k", "extra", "n_rows", "n_items"))
    assert got == sorted([("c", 10, 500, 1), ("d", None, 1, 1), (None, 11, 1, 1)], key=repr)
    assert skew.per_key_results(df.limit(0), ["k"], "item").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    r = random.Random(3)
    left = spark.createDataFrame([("hot" if r.random() < 0.5 else r.choice(["a", "b", None, "z"]), i) for i in range(300)], "k string, id int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("q", 5)], "k string, v int")
    assert rows(skew.skew_join(left, right, ["k"], ["id"], how, 4)) == rows(left.join(right, "k", how))
    assert rows(skew.skew_join(left.limit(0), right, ["k"], ["id"], how, 4)) == []
    assert rows(skew.skew_join(left, right.limit(0), ["k"], ["id"], how, 4)) == rows(left.join(right.limit(0), "k", how))


def test_skew_join_refuses_right_joins(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        skew.skew_join(df, df, ["id"], ["id"], "right")


# --- Orphans ---------------------------------------------------------------------------------------------------------


def parents_of(spark, lines):
    df = spark.createDataFrame(lines, "code string, a date, b date, n_refs int")
    return orphans.parent_events(df, "t", F.col("code"), F.col("a"), F.col("b"))


def test_orphans_against_brute_force(spark):
    r = random.Random(5)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(r.randrange(60))
    lines = [(r.choice("abcd"), r.choice([None, day(), day()]), r.choice([None, day(), day()]), 1) for _ in range(12)]
    children = [(r.choice(["a", "b", "c", "d", "e", None]), r.choice([None, day(), day(), day()])) for _ in range(400)]
    refs = spark.createDataFrame([(i, "t", k, d) for i, (k, d) in enumerate(children)], "id int, ref_table string, ref_key string, d date").select("id", "ref_table", "ref_key", F.unix_date("d").alias("ref_day"))

    def orphan(k, d):
        own = [x for x in lines if x[0] == k]
        if d is None:
            return not own
        return not any((x[1] is None or x[1] <= d) and (x[2] is None or d < x[2]) for x in own)

    missing = orphans.orphan_keys(parents_of(spark, lines), refs)
    got = {r["id"] for r in orphans.orphan_rows(refs, missing, ["id"]).collect()}
    assert got == {i for i, (k, d) in enumerate(children) if k is not None and orphan(k, d)}
    report = orphans.orphan_report(missing)
    assert sum(r["n_orphans"] for r in report.collect()) == len(got)


def test_orphans_empty_sides(spark):
    refs = spark.createDataFrame([(1, "t", "x", None)], "id int, ref_table string, ref_key string, ref_day int")
    none = parents_of(spark, [])
    assert orphans.orphan_rows(refs, orphans.orphan_keys(none, refs), ["id"]).count() == 1
    assert orphans.orphan_keys(parents_of(spark, [("x", None, None, 0)]), refs).count() == 0
    assert orphans.orphan_keys(none, refs.limit(0)).count() == 0


def test_orphan_rows_of_a_hot_key_are_spread(spark):
    """One key and null day holds nine tenths of the references: the largest task stays under twice the mean."""
    n, tasks = 20_000, 8
    key = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    refs = spark.range(n).select("id", F.lit("t").alias("ref_table"), key.alias("ref_key"), F.lit(None).cast("int").alias("ref_day"))
    missing = orphans.orphan_keys(parents_of(spark, [("k0", None, None, 0)]), refs)
    got = orphans.orphan_rows(refs, missing, ["id"], tasks)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == refs.where("ref_key <> 'k0'").count()
    plan = skew.plan_placement(refs, ["ref_table", "ref_key", "ref_day"], tasks)
    placed = skew.place(refs, ["ref_table", "ref_key", "ref_day"], plan, ["id"]).groupBy(skew.TASK).count().collect()
    assert max(r["count"] for r in placed) < 2 * n / tasks


def test_current_rows(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (0, "c", 9), (None, "d", 1), (2, None, None), (1, "z", 5)], "geoname_id long, name string, source_line long")
    assert rows(orphans.current_rows(df, ["name"])) == sorted([(1, "z"), (2, None)], key=repr)


def test_city_references_need_both_codes(spark):
    df = spark.createDataFrame(
        [(1, "X", "1", "2", None, 1), (2, None, "1", "", None, 1), (3, "X", "", "2", None, 1), (4, "X", None, None, None, 1)],
        "geoname_id long, country_code string, admin1_code string, admin2_code string, modification_date date, source_line long",
    )
    got = {(r["geoname_id"], r["ref_table"], r["ref_key"]) for r in orphans.city_references(df).collect()}
    assert got == {(1, "admin1_codes", "X.1"), (1, "admin2_codes", "X.1.2"), (2, "admin1_codes", ".1")}


# --- Snapshots -------------------------------------------------------------------------------------------------------

SNAP = "snap int, at timestamp, line long, key long, v long, w date, idx int, pairs string"


def changes(df, **k):
    return rows(snapshots.snapshot_changes(df, "snap", "key", ["at", "line"], ["v", "w"], **k).select("snap", "key", "change_kind"))


def brute_changes(data, skip=()):
    best, numbers = {}, sorted({x[0] for x in data if x[0] is not None})
    for s, at, line, key, v, w, *_ in data:
        if s is None or key is None or key in skip:
            continue
        rank = (at is not None, at or datetime.datetime.min, line is not None, line or 0, v is not None, v or 0, w is not None, w or D.min)
        if (s, key) not in best or rank > best[s, key][0]:
            best[s, key] = rank, (v, w)
    out = []
    for a, b in zip(numbers, numbers[1:]):
        for key in {k for s, k in best if s in (a, b)}:
            x, y = best.get((a, key)), best.get((b, key))
            if x is None or y is None or x[1] != y[1]:
                out.append((b, key, "added" if x is None else "removed" if y is None else "changed"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys_per_leaf", [1, 16, 10_000])
def test_changes_against_brute_force(spark, keys_per_leaf):
    r = random.Random(keys_per_leaf)
    t = lambda: r.choice([None, datetime.datetime(2024, 1, r.randint(1, 5))])
    data = [(r.choice([2, 3, 7, 9, None]), t(), r.choice([None, *range(50)]), r.choice([None, 0, *range(1, 40)]), r.choice([None, 1, 2]), r.choice([None, D(2020, 1, 1)]), 1, "x") for _ in range(500)]
    data += data[:80]
    df = spark.createDataFrame(data, SNAP)
    assert changes(df, keys_per_leaf=keys_per_leaf) == brute_changes(data)
    assert changes(df, keep=F.col("key") != 0, keys_per_leaf=keys_per_leaf) == brute_changes(data, skip=(0,))


def test_snapshots_of_skipped_rows_still_count(spark):
    data = [(1, None, 1, 5, 1, None, 0, ""), (2, None, 1, 0, 1, None, 0, ""), (3, None, 1, 5, 1, None, 0, "")]
    df = spark.createDataFrame(data, SNAP)
    assert changes(df, keep=F.col("key") != 0) == [(2, 5, "removed"), (3, 5, "added")]


def test_keys_delivered_over_and_over(spark):
    """A third of all rows are copies of one key: combined before they are brought to its leaf."""
    r = random.Random(4)
    data = [(s, datetime.datetime(2024, 1, 1), i, k, r.choice([1, 2]), None, 0, "") for s in (1, 2, 3) for i, k in enumerate([*range(1, 60), *[7] * 4000])]
    assert changes(spark.createDataFrame(data, SNAP)) == brute_changes(data)


def test_few_changes_compare_few_rows(spark):
    """With one key in a thousand changed, under a tenth of the rows are in differing leaves."""
    n = 40_000
    df = spark.range(2 * n).select((F.col("id") % 2).cast("int").alias("idx"), F.expr("id div 2").alias("key"))
    df = df.withColumn("v0", F.when((F.col("idx") == 1) & (F.col("key") % 1000 == 3), 1).otherwise(0))
    bits = snapshots.leaf_bits(n, snapshots.keys_for_rate(0.001))
    leaf = df.withColumn("leaf", snapshots.leaf_of(F.col("key"), bits))
    digests = snapshots.leaf_digests(leaf.select("leaf", "idx", snapshots.row_digest(F.col("key"), [F.col("v0")]).alias("digest")))
    found = snapshots.differing_leaves(digests, bits, 1, 8)
    assert 0 < leaf.join(found, "leaf").count() < 0.1 * 2 * n
    assert leaf.join(found, "leaf").where("v0 = 1").count() == n // 1000


def test_equal_and_single_snapshots(spark):
    data = [(s, None, k, k, k, None, 0, "") for s in (1, 2) for k in range(200)]
    df = spark.createDataFrame(data, SNAP)
    assert changes(df) == [] and changes(df.where("snap = 1")) == [] and changes(df.limit(0)) == []


# --- Points ----------------------------------------------------------------------------------------------------------


def metres(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * spatial.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def test_near_pairs_against_brute_force(spark):
    r = random.Random(8)
    pts = []
    for lat, lon in [(0, 0), (51, 179.999), (-33, -180), (89.999, 10), (90, 0), (-90, 50), (-89.99, -120), (60, 25), (0.0045, 0.0045)]:
        for _ in range(12):
            pts.append((max(-90.0, min(90.0, lat + r.uniform(-0.02, 0.02))), (lon + r.uniform(-0.02, 0.02) + 180) % 360 - 180))
    pts += [(60.0, 25.0)] * 5 + [(90.0, 10.0), (90.0, -70.0), (1.0, 180.0), (1.0, -180.0)]
    df = spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate(pts)] + [(900, None, 1.0, 1), (901, 1.0, None, 1)], "id long, lat double, lon double, cell int")
    for limit in (500.0, 3000.0, 60_000.0):
        got = rows(spatial.near_pairs(df, limit, 4))
        expected = [(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if metres(pts[i], pts[j]) <= limit]
        assert got == sorted(expected, key=repr)
    assert spatial.near_pairs(df.limit(0), 500.0).count() == 0


def contains(ys, xs, lat, lon):
    for x in (lon - 360, lon, lon + 360):
        odd, n = False, len(ys)
        for i in range(n):
            y1, x1, y2, x2 = ys[i], xs[i], ys[(i + 1) % n], xs[(i + 1) % n]
            turn = (x2 - x1) * (lat - y1) - (x - x1) * (y2 - y1)
            if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
                return True
            if (y1 > lat) != (y2 > lat) and x < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        if odd:
            return True
    return False


def test_containing_areas_against_brute_force(spark):
    r = random.Random(9)
    areas = [
        (1, [0.0, 0.0, 2.0, 2.0], [0.0, 2.0, 2.0, 0.0]),
        (2, [0.0, 2.0, 2.0, 1.0, 2.0, 0.0], [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]),
        (3, [10.0, 12.0, 11.0, 10.0], [179.0, 180.5, 182.0, 179.0]),
        (4, [-1.0, -1.0, -3.0], [5.0, 9.0, 7.0]),
        (5, [0.0, 1.0], [0.0, 1.0]),
        (6, None, None),
        (7, [0.0, None, 1.0], [0.0, 1.0, 1.0]),
    ]
    pts = [(r.uniform(-3, 12), r.choice([r.uniform(-1, 10), r.uniform(178, 180), r.uniform(-180, -177)])) for _ in range(300)]
    pts += [(0.0, 0.0), (2.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 2.0), (11.0, -178.0), (2.0, 2.0), (1.0, -1.0)]
    points = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(pts)] + [(999, None, None, "")], "id long, lat double, lon double, area string")
    rings = spark.createDataFrame([(*a, 1) for a in areas], "area long, ys array<double>, xs array<double>, id int")
    got = rows(spatial.containing_areas(points, rings, tasks=4))
    expected = [(i, k) for i, (a, b) in enumerate(pts) for k, ys, xs in areas[:4] if contains(ys, xs, a, b)]
    assert got == sorted(expected, key=repr)
    assert spatial.containing_areas(points.limit(0), rings).count() == 0
    assert spatial.containing_areas(points, rings.limit(0)).count() == 0
