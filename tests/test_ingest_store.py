"""Files in, store out and back, and stores that have been tampered with."""

import glob
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foldsearch.functions import fields as X
from foldsearch.operators.search import Mode, search
from foldsearch.schema import PLACES
from foldsearch.sources import places as P
from foldsearch.sources import store as S


def line(key="1", name="Name", ascii_name="Name", alt="", lat="1.5", lon="2.5", country="US", cc2="", a1="", a2="", pop="10", elev="", dem="", tz="", day="2020-01-02"):
    return "\t".join([key, name, ascii_name, alt, lat, lon, "P", "PPL", country, cc2, a1, a2, "", "", pop, elev, dem, tz, day])


@pytest.fixture
def files(tmp_path):
    rows = [
        line("1", 'Quote "x"', alt=" Alpha, Ünï ,, beta ", a1="NY", a2="001", pop="500", elev="12", dem="x", tz="Zone"),
        line("x", lat="bad", lon="", pop="500", day="2020-13-99", a1="NY", cc2="CA,MX"),
        "\t".join(line().split("\t")[:18]),
        line("3", pop="zero"),
        line("4", pop="-5", a1="ZZ"),
        line("5", "Old", pop="0"),
        line("6", "東京", "Tokyo", pop="9000", country="", a1="NY"),
    ]
    (tmp_path / "places.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "a1.txt").write_text("US.NY\tNew\tFirst\t1\nUS.NY\tNew\tSecond\t2\nshort\tx\n")
    (tmp_path / "a2.txt").write_text("US.NY.001\tCounty\tCounty A\t1\n")
    return tmp_path


def test_ingest(spark, files):
    got = {r["geoname_id"]: r for r in P.read_places(spark, *(str(files / f) for f in ("places.txt", "a1.txt", "a2.txt"))).collect()}
    assert set(got) == {1, 0, 4, 6}
    assert [got[k]["source_line"] for k in (1, 0, 4, 6)] == [0, 1, 2, 3]
    one = got[1]
    assert one["name"] == 'Quote "x"' and one["alternate_names"] == ["Ünï"] and one["alternate_ascii_names"] == ["Alpha", "beta"]
    assert one["admin1_name"] == "Second" and one["admin2_name"] == "County A" and one["elevation"] == 12 and one["dem"] is None and one["timezone"] == "Zone"
    assert str(one["modification_date"]) == "2020-01-02"
    bad = got[0]
    assert bad["latitude"] == 0.0 and bad["longitude"] == 0.0 and bad["modification_date"] is None and bad["admin2_name"] is None and bad["cc2"] == ["CA", "MX"] and bad["timezone"] is None
    assert got[4]["population"] == -5 and got[4]["admin1_name"] is None and got[6]["admin1_name"] is None


def test_ingest_feeds_a_store(spark, files, tmp_path):
    rows = P.read_places(spark, *(str(files / f) for f in ("places.txt", "a1.txt", "a2.txt")))
    S.write_store(rows, str(tmp_path / "s"))
    t = S.read_store(spark, str(tmp_path / "s"))
    assert [r["geoname_id"] for r in t.rows.orderBy("pos").collect()] == [6, 1, 0, 4]
    assert [r["geoname_id"] for r in search(t, "ünï").collect()] == [1]


def test_command_line(spark, files, tmp_path, capsys):
    from foldsearch.__main__ import main

    out = str(tmp_path / "s")
    assert main(["build", *(str(files / f) for f in ("places.txt", "a1.txt", "a2.txt")), out, "--source", "made up"]) == 0
    assert main(["info", out]) == 0 and '"row_count": 4' in capsys.readouterr().out
    assert main(["search", out, "ünï", "--limit", "5"]) == 0 and "  geoname_id: 1" in capsys.readouterr().out
    assert main(["info", out + "-none"]) == 1 and "no store" in capsys.readouterr().err


def test_zip(files, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(files / "a1.txt", "a1.txt")
    out = P.unzip_member(str(tmp_path / "a.zip"), "a1.txt", str(tmp_path / "out"))
    assert open(out).read().startswith("US.NY")
    with pytest.raises(FileNotFoundError):
        P.unzip_member(str(tmp_path / "a.zip"), "none.txt", str(tmp_path / "out"))


@pytest.fixture
def stored(spark, small_dir, tmp_path):
    rows = spark.read.parquet(f"{small_dir}/cities.parquet").where("population <> 0")
    path = str(tmp_path / "store")
    return path, S.write_store(rows, path, source_name="made up"), rows


def test_store_round_trip(spark, stored):
    path, manifest, rows = stored
    t = S.read_store(spark, path)
    assert manifest.row_count == t.rows.count() == rows.count()
    assert S.read_manifest(spark, path) == manifest
    assert X.fingerprint(t.rows.drop("pos")) == X.fingerprint(rows)
    for text in ("a", "é", "ß", "石", ""):
        got = {m: [r["pos"] for r in search(t, text, 30, m).orderBy("rank_no").collect()] for m in Mode}
        assert len({tuple(v) for v in got.values()}) == 1
    narrow = S.read_store(spark, path, ["geoname_id"], verify=False)
    assert narrow.rows.columns == ["pos", "geoname_id"]


def test_store_refuses_other_content(spark, stored):
    path, manifest, _ = stored
    for change in ({"data_fingerprint": "0-0-0"}, {"search_fingerprint": "1-1-1"}, {"schema_version": 99}):
        S._write_manifest(spark, path, type(manifest)(**{**json.loads(manifest.to_json()), **change}))
        with pytest.raises(S.StoreError):
            S.read_store(spark, path)
    S._write_manifest(spark, path, manifest)
    part = sorted(glob.glob(f"{path}/rows/*.parquet"))[0]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(part, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017 (a broken page or another checksum)
        S.read_store(spark, path)
    with pytest.raises(S.StoreError):
        S.read_store(spark, path + "-none")


def test_foreign_artifacts_are_rebuilt(spark, stored):
    path, _, rows = stored
    t = S.read_store(spark, path, verify=False)
    others = t.rows.withColumn("name", F.concat(F.lit("To "), "name"))
    mixed = S.with_artifacts(others, PLACES, t)
    assert mixed.postings is None and search(mixed, "to ", -1).count() == others.count()
    assert S.with_artifacts(t.rows, PLACES, t).postings is not None


def test_field_functions(spark):
    df = spark.sql("select '123456789' as t, cast(null as string) as n, ' a , ,b\tc,' as l")
    r = df.select(X.crc_hex(F.col("t")).alias("c"), X.list_of(F.col("n")).alias("e"), X.list_of(F.col("l")).alias("l"), X.dotted_key(F.lit("a"), F.col("n")).alias("k"), X.int_or_zero(F.lit("1x")).alias("i"), X.date_or_null(F.lit("2020-02-30")).alias("d")).first()
    assert r["c"] == "cbf43926" and r["e"] == [] and r["l"] == ["a", "b\tc"] and r["k"] is None and r["i"] == 0 and r["d"] is None


def test_report(tmp_path):
    P.write_report(str(tmp_path / "r.md"), "T", [{"a": "x|y", "b": 1}])
    assert "x\\|y" in (tmp_path / "r.md").read_text()
