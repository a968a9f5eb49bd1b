"""The place table, what of it is searched, and the manifest of a store."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

SCHEMA_VERSION = 1
FOLD_VERSION = 1

_TEXTS = T.ArrayType(T.StringType(), False)
PLACE = T.StructType(
    [
        T.StructField("geoname_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ascii_name", T.StringType()),
        T.StructField("alternate_names", _TEXTS),
        T.StructField("alternate_ascii_names", _TEXTS),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("feature_class", T.StringType()),
        T.StructField("feature_code", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("cc2", _TEXTS),
        T.StructField("admin1_code", T.StringType()),
        T.StructField("admin1_name", T.StringType()),
        T.StructField("admin2_code", T.StringType()),
        T.StructField("admin2_name", T.StringType()),
        T.StructField("admin3_code", T.StringType()),
        T.StructField("admin4_code", T.StringType()),
        T.StructField("population", T.LongType()),
        T.StructField("elevation", T.LongType()),
        T.StructField("dem", T.LongType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("modification_date", T.DateType()),
        T.StructField("source_line", T.LongType()),
    ]
)


@dataclass(frozen=True)
class SearchSpec:
    """Which columns are searched. Text and text-array columns may be mixed; ``order_value`` descending, then ``order_line``, is the ranking."""

    id: str
    primary: tuple[str, ...]
    alternate: tuple[str, ...] = ()
    order_value: str = "population"
    order_line: str = "source_line"


PLACES = SearchSpec("geoname_id", ("name", "ascii_name"), ("alternate_names", "alternate_ascii_names"))


@dataclass(frozen=True)
class Manifest:
    """What a store says of itself."""

    schema_version: int
    fold_version: int
    generated_at: str
    source_name: str
    sort_order: str
    row_count: int
    data_fingerprint: str
    search_fingerprint: str
    search_spec: dict
    source_urls: list[str] = field(default_factory=list)
    includes_admin1_names: bool = True
    includes_admin2_names: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))
