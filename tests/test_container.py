"""The binary container: round trip, frames, damaged files."""

import datetime
import random
import struct

import pyarrow as pa
import pytest

from foldsearch.sources import container as C

MAGIC = "TEST"
META = {"generatedAt": "2024-01-01T00:00:00Z", "sourceName": "made up"}


def row(**k):
    base = {"geoname_id": 42, "name": "Testville", "ascii_name": "Testville", "alternate_names": ["Téstvillé"], "alternate_ascii_names": ["Testvile"], "latitude": 12.34, "longitude": 56.78}
    base |= {"feature_class": "P", "feature_code": "PPL", "country_code": "US", "cc2": [], "admin1_code": "NY", "admin1_name": "New York", "admin2_code": None, "admin2_name": None, "admin3_code": None, "admin4_code": ""}
    return base | {"population": 123456, "elevation": None, "dem": -3, "timezone": "America/New_York", "modification_date": datetime.date(1969, 12, 30)} | k


def test_round_trip():
    rows = [row(), row(name="", alternate_names=[], modification_date=None), row(name="東京" * 400)]
    meta, got = C.decode(C.encode(rows, META, MAGIC, b"other" * 50), MAGIC)
    assert got == rows and meta["cityCount"] == 3 and meta["sourceName"] == "made up"
    assert C.decode(C.encode([], META, MAGIC), MAGIC)[1] == []


def test_damage_is_seen():
    data = C.encode([row()], META, MAGIC, b"search data")
    for at in (0, 4, 12, 20, 32, 40, len(data) - 30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((C.ContainerError, UnicodeDecodeError)):
            C.decode(bytes(bad), MAGIC)
    for cut in (data[:-1], data + b"x", data[:20], b""):
        with pytest.raises(C.ContainerError):
            C.decode(cut, MAGIC)
    with pytest.raises(C.ContainerError):
        C.decode(data, "ELSE")


def test_blocks_as_another_implementation_packs_them():
    r = random.Random(1)
    for n in (0, 1, 20, 300, 70_000):
        data = bytes(r.choice(b"abcab") for _ in range(n)) + b"z" * n
        assert C.unpack_frames(C.pack_frames(data), len(data)) == data
        if data:
            out = bytearray()
            C.unpack_block(pa.Codec("lz4_raw").compress(data, asbytes=True), out)
            assert bytes(out) == data


def test_block_that_goes_on_from_the_last():
    first = b"0123456789abcdef"
    second = bytes([0x0C]) + struct.pack("<H", 16) + bytes([0x50]) + b"vwxyz"  # 16 bytes from 16 back, then five letters
    data = C.FRAME_PLAIN + struct.pack("<I", 16) + first + C.FRAME_PACKED + struct.pack("<II", 21, len(second)) + second + C.FRAME_END
    assert C.unpack_frames(data, 37) == first + first + b"vwxyz"


def test_read_in_spark(spark, small_dir, tmp_path):
    from foldsearch.operators.ordinals import positions

    rows = positions(spark.read.parquet(f"{small_dir}/cities.parquet").where("population <> 0"), "population", "source_line")
    (tmp_path / "a.bin").write_bytes(C.container_bytes(rows, META, MAGIC))
    got = C.read_container(spark, str(tmp_path / "a.bin"), MAGIC)
    names = [n for n, _ in C.RECORD]
    assert got.orderBy("pos").select("pos", *names).collect() == rows.orderBy("pos").select("pos", *names).collect()
    with pytest.raises(C.ContainerError):
        C.container_bytes(rows, META, MAGIC, rows=5)


@pytest.mark.parametrize("file_bytes", [C.FILE_BYTES, 2000])
def test_table_of_many_files(spark, small_dir, tmp_path, file_bytes):
    from foldsearch.operators.ordinals import positions

    rows = positions(spark.read.parquet(f"{small_dir}/cities.parquet").where("population <> 0"), "population", "source_line")
    names = [n for n, _ in C.RECORD]
    for i, df in enumerate((rows, rows.where("pos % 7 <> 3"), rows.repartition(3, "geoname_id"), rows.where("pos < 0"))):
        C.write_containers(df, f"{tmp_path}/{i}", META, MAGIC, file_bytes=file_bytes)
        got = C.read_container(spark, f"{tmp_path}/{i}", MAGIC)
        assert got.orderBy("pos").select("pos", *names).collect() == df.orderBy("pos").select("pos", *names).collect()
    files = [C.opened(p.read_bytes(), MAGIC) for p in (tmp_path / "0").glob("part-*")]
    assert all(len(payload) < file_bytes + 2000 for _, payload in files)
    assert sum(meta["cityCount"] for meta, _ in files) == rows.count()


def test_roundtrip_of_more_rows_than_the_driver_takes(spark, small_dir, monkeypatch):
    from foldsearch.plans import stores

    monkeypatch.setattr(C.container_bytes, "__defaults__", ("pos", 5))
    got = [r["pos"] for r in stores.container_roundtrip(spark, small_dir).select("pos").orderBy("pos").collect()]
    assert len(got) > 5 and got == list(range(len(got)))


def test_null_in_a_list_is_refused():
    with pytest.raises(C.ContainerError):
        C.encode([row(), row(cc2=["US", None])], META, MAGIC)
