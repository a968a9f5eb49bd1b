"""The binary container of place tables: read (any number of files) and written (a small table as one file, a table of any size as many).

Header of nine little-endian 32-bit numbers: magic, file version, bytes of metadata, raw and stored bytes and CRC-32 of the places, raw and
stored bytes and CRC-32 of search data. Then the metadata (JSON), the places and the search data. Stored blocks are LZ4 in frames. Search data is checked
but not used: this engine makes its own from the texts. A table of several files has in the metadata of each the positions of its places.
"""

from __future__ import annotations

import datetime
import itertools
import json
import struct
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsearch.runtime import ship_package
from foldsearch.schema import PLACE

# Fixed values of the format
FILE_VERSION, PLACES_VERSION, METADATA_VERSION = 3, 2, 3
NO_TEXT, NO_INT, NO_DATE = 0xFFFFFFFF, -(2**63), -(2**31)
FRAME_PACKED, FRAME_PLAIN, FRAME_END = b"bv41", b"bv4-", b"bv4$"
#: Columns of a record in stored order with their kinds.
RECORD = (
    ("geoname_id", "int"),
    ("name", "text"),
    ("ascii_name", "text"),
    ("alternate_names", "texts"),
    ("alternate_ascii_names", "texts"),
    ("latitude", "double"),
    ("longitude", "double"),
    ("feature_class", "optional_text"),
    ("feature_code", "optional_text"),
    ("country_code", "text"),
    ("cc2", "texts"),
    ("admin1_code", "optional_text"),
    ("admin2_code", "optional_text"),
    ("admin3_code", "optional_text"),
    ("admin4_code", "optional_text"),
    ("population", "int"),
    ("elevation", "optional_int"),
    ("dem", "optional_int"),
    ("timezone", "optional_text"),
    ("modification_date", "date"),
    ("admin1_name", "optional_text"),
    ("admin2_name", "optional_text"),
)

#: Rows a container may have when written as one: they pass through the driver.
WRITE_ROWS = 1_000_000
#: Bytes of places after which a table of many files goes on in the next.
FILE_BYTES = 1 << 24
#: In the metadata of a file of many: stretches of positions as (first, number). Readers that don't know it pass it over.
POSITIONS = "positions"
FRAME_BYTES = 1 << 16
_EPOCH = datetime.date(1970, 1, 1)
_COUNT, _DAYS, _INT, _DOUBLE = (struct.Struct(form) for form in ("<I", "<i", "<q", "<d"))
#: As what numbers are stored, and null.
_NUMBERS = {"int": (pa.int64(), 0, "<i8"), "optional_int": (pa.int64(), NO_INT, "<i8"), "double": (pa.float64(), 0.0, "<f8"), "date": (pa.int32(), NO_DATE, "<i4")}
ROW = T.StructType([T.StructField("pos", T.LongType()), *PLACE.fields])


class ContainerError(ValueError):
    """Bytes that aren't a container, or a damaged one."""


# --- LZ4 -------------------------------------------------------------------------------------------------------------


def unpack_block(block: bytes, out: bytearray) -> None:
    """Append what an LZ4 block stands for; it may refer to what ``out`` already holds."""
    i, n = 0, len(block)
    while i < n:
        token = block[i]
        i += 1
        size = token >> 4
        if size == 15:
            while True:
                size += block[i]
                i += 1
                if block[i - 1] != 255:
                    break
        out += block[i : i + size]
        i += size
        if i >= n:  # the last sequence is letters only
            return
        back = block[i] | block[i + 1] << 8
        i += 2
        size = (token & 15) + 4
        if size == 19:
            while True:
                size += block[i]
                i += 1
                if block[i - 1] != 255:
                    break
        if not 0 < back <= len(out):
            raise ContainerError("a block refers to before its beginning")
        at = len(out) - back
        if back >= size:
            out += out[at : at + size]
        else:  # the copy overlaps itself, so it repeats
            out += (out[at:] * (size // back + 1))[:size]


def unpack_frames(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    codec = pa.Codec("lz4_raw")
    try:
        while i < len(data):
            kind = data[i : i + 4]
            if kind == FRAME_END:
                break
            if kind == FRAME_PLAIN:
                (n,) = struct.unpack_from("<I", data, i + 4)
                out += data[i + 8 : i + 8 + n]
                i += 8 + n
            elif kind == FRAME_PACKED:
                raw, n = struct.unpack_from("<II", data, i + 4)
                block = data[i + 12 : i + 12 + n]
                try:
                    got = codec.decompress(block, decompressed_size=raw, asbytes=True)
                    out += got
                except (pa.ArrowException, OSError):  # it goes on from the block before
                    unpack_block(block, out)
                i += 12 + n
            else:
                raise ContainerError("unknown frame")
    except (IndexError, struct.error) as e:
        raise ContainerError("a frame ends early") from e
    if len(out) != size:
        raise ContainerError(f"{size} bytes expected, {len(out)} found")
    return bytes(out)


def pack_frames(data: bytes) -> bytes:
    if not data:
        return b""
    codec, out = pa.Codec("lz4_raw"), []
    for i in range(0, len(data), FRAME_BYTES):
        part = data[i : i + FRAME_BYTES]
        packed = codec.compress(part, asbytes=True)
        out.append(FRAME_PACKED + struct.pack("<II", len(part), len(packed)) + packed if len(packed) < len(part) else FRAME_PLAIN + struct.pack("<I", len(part)) + part)
    return b"".join([*out, FRAME_END])


# --- Records ---------------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> dict:
    """The fields of a record."""
    out, at = {}, 0
    try:
        for name, kind in RECORD:
            if kind == "text" or kind == "optional_text":
                (n,) = _COUNT.unpack_from(data, at)
                at += 4
                if n == NO_TEXT and kind == "optional_text":
                    out[name] = None
                else:
                    out[name] = data[at : at + n].decode()
                    at += n
            elif kind == "texts":
                (n,) = _COUNT.unpack_from(data, at)
                at += 4
                texts = out[name] = []
                for _ in range(n):
                    (n,) = _COUNT.unpack_from(data, at)
                    texts.append(data[at + 4 : at + 4 + n].decode())
                    at += 4 + n
            elif kind == "date":
                (v,) = _DAYS.unpack_from(data, at)
                out[name] = None if v == NO_DATE else _EPOCH + datetime.timedelta(v)
                at += 4
            else:
                (v,) = (_DOUBLE if kind == "double" else _INT).unpack_from(data, at)
                out[name] = None if v == NO_INT and kind == "optional_int" else v
                at += 8
    except (struct.error, UnicodeDecodeError) as e:
        raise ContainerError("a record ends early or has no text where one should be") from e
    if at != len(data):
        raise ContainerError("a text ends early" if at > len(data) else "a record is longer than its fields")
    return out


def _stored(kind: str, column: pa.Array) -> list[bytes]:
    """The values of a column as they are stored."""
    if kind == "texts":
        texts = column.flatten()
        if texts.null_count:
            raise ContainerError("a list with a null can't be stored")
        rest = iter(_stored("text", texts))
        return [_COUNT.pack(n) + b"".join(itertools.islice(rest, n)) for n in column.value_lengths().fill_null(0).to_pylist()]
    if kind == "text" or kind == "optional_text":
        none = _COUNT.pack(NO_TEXT if kind == "optional_text" else 0)
        return [none if v is None else _COUNT.pack(len(v)) + v for v in column.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
    number, empty, form = _NUMBERS[kind]
    data = column.cast(number).fill_null(empty).to_numpy(zero_copy_only=False).astype(form).tobytes()
    size = number.bit_width // 8
    return [data[i : i + size] for i in range(0, len(data), size)]


def _records(columns: Mapping[str, pa.Array]) -> Iterator[bytes]:
    return map(b"".join, zip(*(_stored(kind, columns[name]) for name, kind in RECORD)))


def opened(data: bytes, magic: str) -> tuple[dict, bytes]:
    """(metadata, bytes of the places) of a container whose first four letters are ``magic``; all checks of versions, lengths and checksums are made."""
    if len(data) < 36:
        raise ContainerError("too short for a header")
    head = struct.unpack_from("<9I", data)
    if data[:4] != magic.encode() or head[1] != FILE_VERSION:
        raise ContainerError("not a container of this version")
    _, _, n_meta, raw, stored, crc, s_raw, s_stored, s_crc = head
    if len(data) != 36 + n_meta + stored + s_stored:
        raise ContainerError("the parts don't add up to the file")
    try:
        meta = json.loads(data[36 : 36 + n_meta])
    except ValueError as e:
        raise ContainerError("the metadata can't be read") from e
    if meta.get("schemaVersion") != METADATA_VERSION:
        raise ContainerError("made for another schema")
    at = 36 + n_meta
    payload = unpack_frames(data[at : at + stored], raw)
    search = unpack_frames(data[at + stored :], s_raw)
    for what, bytes_, value, named in (("places", payload, crc, "cityDataFingerprint"), ("search data", search, s_crc, "searchDataFingerprint")):
        if zlib.crc32(bytes_) != value or meta.get(named) != f"{value:08x}":
            raise ContainerError(f"the checksum of the {what} differs")
    return meta, payload


def unpacked(meta: dict, payload: bytes) -> Iterator[dict]:
    """The places one by one; what doesn't agree with the metadata is an error, if only after the last."""
    try:
        version, n = struct.unpack_from("<II", payload)
        if version != PLACES_VERSION:
            raise ContainerError("places of another version")
        at = 8
        for _ in range(n):
            (size,) = _COUNT.unpack_from(payload, at)
            yield _fields(payload[at + 4 : at + 4 + size])
            at += 4 + size
    except struct.error as e:
        raise ContainerError("the places end early") from e
    if at != len(payload) or n != meta.get("cityCount"):
        raise ContainerError("the number of places differs")


def decode(data: bytes, magic: str) -> tuple[dict, list[dict]]:
    """(metadata, places) of a container, checked."""
    meta, payload = opened(data, magic)
    return meta, list(unpacked(meta, payload))


def packed(records: list[bytes], metadata: dict, magic: str, search: bytes = b"") -> bytes:
    """A container of stored records; counts and fingerprints of the metadata are filled in."""
    payload = struct.pack("<II", PLACES_VERSION, len(records)) + b"".join(struct.pack("<I", len(r)) + r for r in records)
    crc, s_crc = zlib.crc32(payload), zlib.crc32(search)
    meta = json.dumps(metadata | {"schemaVersion": METADATA_VERSION, "cityCount": len(records), "cityDataFingerprint": f"{crc:08x}", "searchDataFingerprint": f"{s_crc:08x}"}, sort_keys=True).encode()
    stored, s_stored = pack_frames(payload), pack_frames(search)
    head = magic.encode() + struct.pack("<8I", FILE_VERSION, len(meta), len(payload), len(stored), crc, len(search), len(s_stored), s_crc)
    return head + meta + stored + s_stored


def encode(rows: list[dict], metadata: dict, magic: str, search: bytes = b"") -> bytes:
    """A container of ``rows`` in the given order."""
    columns = {name: pa.array([r.get(name) for r in rows], _arrow(PLACE[name].dataType)) for name, _ in RECORD}
    return packed(list(_records(columns)), metadata, magic, search)


def read_container(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """``pos`` and the place table of the container files at ``path``, each read by one task; ``source_line`` is the position in its file.

    A file that doesn't tell its positions begins at 0.
    """
    ship_package(spark)
    arrow = pa.schema([pa.field("pos", pa.int64()), *(pa.field(f.name, _arrow(f.dataType)) for f in PLACE.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                meta, payload = opened(data.as_py(), magic)
                pos = itertools.chain.from_iterable(range(first, first + n) for first, n in meta.get(POSITIONS, [(0, meta.get("cityCount", 0))]))
                for part in itertools.batched(enumerate(zip(unpacked(meta, payload), pos, strict=True)), 10_000):
                    yield pa.RecordBatch.from_pylist([r | {"pos": at, "source_line": i} for i, (r, at) in part], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROW)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.string())
    return {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "date": pa.date32()}[kind.simpleString()]


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Write a container's bytes as one file on whatever storage the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def container_bytes(df: DataFrame, metadata: dict, magic: str, order: str = "pos", rows: int = WRITE_ROWS) -> bytes:
    """A container of a small table. Tables of more than ``rows`` rows are refused: a container is one block of bytes; use ``write_containers`` or a store."""
    if df.limit(rows + 1).count() > rows:
        raise ContainerError(f"more than {rows} rows; write several files or a store instead")
    return encode([r.asDict() for r in df.orderBy(order).select(*[n for n, _ in RECORD]).collect()], metadata, magic)


def write_containers(df: DataFrame, path: str, metadata: dict, magic: str, pos: str = "pos", file_bytes: int = FILE_BYTES) -> None:
    """A table of any size as container files in the folder ``path``, written by the tasks that hold the rows; what was there is replaced.

    A file holds places of one task, in order, and tells their positions. The first file holds none, so that a table without places has a file.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([_open_end(packed(records, metadata | {POSITIONS: stretches}, magic))], pa.binary())})

        records, stretches, size = [], [], 0
        for b in batches:
            for at, record in zip(b.column(0).to_pylist(), _records(dict(zip(b.schema.names, b.columns)))):
                if records and size + len(record) > file_bytes:
                    yield file()
                    records, stretches, size = [], [], 0
                if stretches and at == sum(stretches[-1]):
                    stretches[-1][1] += 1
                else:
                    stretches.append([at, 1])
                records.append(record)
                size += len(record)
        if records:
            yield file()

    files = df.sortWithinPartitions(pos).select(F.col(pos).alias("pos"), *[n for n, _ in RECORD]).mapInArrow(run, "content binary")
    none = df.sparkSession.range(0, 1, 1, 1).select(F.lit(_open_end(packed([], metadata, magic))).alias("content"))
    # a line a file, whose line end is the last frame's end
    lines = none.unionAll(files).select(F.col("content").cast("string").alias("value"))
    lines.write.mode("overwrite").options(lineSep=FRAME_END.decode(), maxRecordsPerFile=1, compression="none").text(path)


def _open_end(data: bytes) -> bytes:
    return data.removesuffix(FRAME_END)
