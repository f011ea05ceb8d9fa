"""A vendor's paged tables as a Spark data source: filters choose the pages, each page is a partition.

The source reads what a vendor's table service gives: an index of pages, each with the range of tickers and dates that
it holds, and pages of columns and rows. Filters on the ticker, the dimension and the date are taken from the query, so pages
out of range are never asked for, and rows that don't pass are dropped before they reach the JVM. ``root`` is a folder of any file system
that Arrow knows (``file://``, ``s3://``, ``hdfs://``); a download of the service in that form serves offline.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

INDEX = "index.json"
#: Columns by which pages are ordered, so that the index has their ranges.
RANGED = ("ticker", "datekey")


def _read(root: str, name: str) -> dict:
    files, path = fs.FileSystem.from_uri(root)
    with files.open_input_stream(f"{path}/{name}") as f:
        return json.loads(f.read())


def _plain(value):
    return value.isoformat() if isinstance(value, datetime.date) else value


class Page(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class VendorReader(DataSourceReader):
    """Values of filters and pages are compared as the service's text or numbers; dates are ISO text there."""

    KINDS = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.root, self.taken = schema, options["root"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = self.KINDS.get(type(f))
            value = getattr(f, "value", None)
            if isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.taken.append((f.attribute[0], "known", None))
            elif kind is None or len(f.attribute) != 1 or (value is None if not isinstance(value, tuple) else None in value):
                yield f
            else:
                self.taken.append((f.attribute[0], kind, tuple(map(_plain, value)) if isinstance(value, tuple) else _plain(value)))

    def partitions(self) -> list[Page]:
        pages = _read(self.root, INDEX)["pages"]
        return [Page(p["file"]) for p in pages if all(self._may_hold(p, *f) for f in self.taken)] or [Page("")]

    def _may_hold(self, page: dict, column: str, kind: str, value) -> bool:
        if kind == "known" or column not in RANGED or f"{column}_min" not in page:
            return True
        lo, hi = page[f"{column}_min"], page[f"{column}_max"]
        return {"=": lambda: lo <= value <= hi, "in": lambda: any(lo <= v <= hi for v in value), ">": lambda: hi > value, ">=": lambda: hi >= value, "<": lambda: lo < value, "<=": lambda: lo <= value}[kind]()

    @staticmethod
    def _passes(x, kind: str, value) -> bool:
        if x is None or x == "" or kind == "known":
            return x is not None and x != ""
        return {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value}[kind]()

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.name:
            return
        page = _read(self.root, partition.name)
        at = {c["name"]: i for i, c in enumerate(page["columns"])}
        for row in page["data"]:
            if all(c in at and self._passes(row[at[c]], kind, v) for c, kind, v in self.taken):
                yield tuple(self._typed(row[at[f.name]] if f.name in at else None, f.dataType) for f in self.columns.fields)

    @staticmethod
    def _typed(value, kind: T.DataType):
        if value is None or value == "":
            return None
        return datetime.date.fromisoformat(value) if isinstance(kind, T.DateType) else float(value) if isinstance(kind, T.DoubleType) else value


class VendorPages(DataSource):
    """``spark.read.format("vendor_pages").schema(...).option("root", ...).load()``; a column that the vendor lacks is null."""

    @classmethod
    def name(cls) -> str:
        return "vendor_pages"

    def schema(self) -> T.StructType:
        """Text, dates and numbers as the first page names them."""
        names = {"String": T.StringType(), "Date": T.DateType()}
        page = _read(self.options["root"], _read(self.options["root"], INDEX)["pages"][0]["file"])
        return T.StructType([T.StructField(c["name"], names.get(c["type"], T.DoubleType())) for c in page["columns"]])

    def reader(self, schema: T.StructType) -> VendorReader:
        return VendorReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorPages)
