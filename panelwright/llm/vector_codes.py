"""Vectors as short codes: each part of a vector by the index of its nearest codebook entry, all in whole numbers.

Components become ``floor(scale * x)``. A codebook of a part position starts as that part of the vectors with the
smallest ids; a round assigns every part to its nearest entry and replaces entries by the floor of their parts' mean.
Codebooks (``parts * entries`` rows of a part's width, whatever the table's size) are broadcast; a task finds the
distances of a batch by ``|x|^2 - 2 x.c + |c|^2`` as integer matrix products, keeps sums per entry and emits them
once, and Spark adds the tasks' sums by (part, entry, position). Whole numbers make every result exact, so it hangs
neither on the order of rows nor on a repeated task.

Defined cases: vectors that are null or hold a null, NaN or infinite component go. The vector with the smallest id
(null last, ties by the vector) sets the length; vectors of another length keep a row with null code and error. A
length that ``parts`` doesn't divide is a ValueError. Fewer vectors than ``entries`` make smaller codebooks. Repeated
ids and vectors are rows of their own. An empty table gives an empty result. Components are exact at any size (Python
integers once 64 bits might not do); an error beyond a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, cut_lineage, map_batches, with_id

#: Up to this size of components, a squared distance over 2^10 components fits 64 bits with room for the norm expansion.
SAFE = 1 << 25
LONG_MAX = (1 << 63) - 1
SUMS = "part int, entry int, position int, total decimal(38,0), n long"
WIDE = Context(prec=38)


@dataclass(frozen=True)
class Codebooks:
    """``values[part][entry]`` lists an entry's components; ``length`` is that of the vectors they are made for."""

    values: list[list[list[int]]]
    length: int
    scale: int

    def text(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(str(x) for part in self.values for entry in part for x in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where products of 64 bits could overflow."""
    if not values.size or np.abs(values).max() < SAFE / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _arrays(books: Codebooks) -> list[np.ndarray]:
    """A matrix (entries, width) of each part; Python integers where 64 bits might not do."""
    widest = max((abs(x) for part in books.values for entry in part for x in entry), default=0)
    kind = np.int64 if widest <= SAFE else object
    return [np.array(part, dtype=kind).reshape(len(part), len(part[0])) for part in books.values]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, its squared distance) of each row, exact."""
    if book.dtype == object or rows.dtype == object:
        rows, book = rows.astype(object), book.astype(object)
    far = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(rows)), at]


def _rows(batch: pa.RecordBatch, column: int, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the batch's vectors of this length, their whole components)."""
    vectors = batch.column(column)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == length)
    chosen = vectors.take(pa.array(fits))
    return fits, _floored(chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), length), scale)


def _kept(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(others)]).where(usable(F.col("vector")))


def start(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks of the vectors with the smallest ids (at most ``entries`` rows are gathered); None for no vector."""
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*order).limit(entries).select("vector").collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if any(len(r["vector"]) != length for r in first):
        first = kept.where(F.size("vector") == length).orderBy(*order).limit(entries).select("vector").collect()
    whole = _floored(np.array([r["vector"] for r in first], dtype=np.float64).reshape(len(first), length), scale)
    width = length // parts
    return Codebooks([[[int(x) for x in row[p * width : (p + 1) * width]] for row in whole] for p in range(parts)], length, scale)


def sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, position, total, n): the components of the parts nearest to each used entry, added over all vectors."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        arrays, width = _arrays(books), books.length // len(books.values)
        total = [np.zeros(b.shape, dtype=object) for b in arrays]
        count = [np.zeros(len(b), dtype=np.int64) for b in arrays]
        for batch in batches:
            _, whole = _rows(batch, 0, books.length, books.scale)
            for p, book in enumerate(arrays):
                part = whole[:, p * width : (p + 1) * width]
                at, _ = nearest(part, book)
                here = np.zeros(book.shape, dtype=part.dtype)
                np.add.at(here, at, part)
                total[p] += here
                count[p] += np.bincount(at, minlength=len(book))
        used = [(p, e) for p, n in enumerate(count) for e in np.flatnonzero(n)]
        cells = [(p, int(e), i, WIDE.create_decimal(int(total[p][e, i])), int(count[p][e])) for p, e in used for i in range(width)]
        columns = list(zip(*cells, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.record_batch([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "position", "total", "n"])

    partial = kept.select("vector").mapInArrow(run, SUMS)
    return partial.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors; a round gathers one number a codebook component."""
    kept = _kept(df, id_col, vector_col)
    books = start(kept, parts, entries, scale)
    for _ in range(rounds if books else 0):
        values = [[list(entry) for entry in part] for part in books.values]
        for r in sums(kept, books).collect():
            values[r["part"]][r["entry"]][r["position"]] = int(r["total"]) // r["n"]
        books = Codebooks(values, books.length, scale)
    return books


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code binary, error long) of each usable vector: one byte a part, and the squared distances summed over parts."""
    kept = _kept(df, id_col, vector_col, label_col)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def make():
        books = shared.value
        arrays, width = _arrays(books), books.length // len(books.values)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            fits, whole = _rows(batch, 1, books.length, books.scale)
            codes, error = np.zeros((len(fits), len(arrays)), dtype=np.uint8), np.zeros(len(fits), dtype=object)
            for p, book in enumerate(arrays):
                codes[:, p], far = nearest(whole[:, p * width : (p + 1) * width], book)
                error += far
            code, wrong = [None] * batch.num_rows, [None] * batch.num_rows
            for i, row, e in zip(fits, codes, error, strict=True):
                code[i], wrong[i] = row.tobytes(), int(e) if e <= LONG_MAX else None
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(code, pa.binary()), pa.array(wrong, pa.int64())], ["id", "label", "code", "error"])

        return step

    schema = with_id(kept, "code binary, error long")
    schema.fields.insert(1, T.StructField("label", kept.schema["other_0"].dataType))
    return map_batches(kept, make, T.StructType(schema.fields))


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, code, error, label_error), codebooks) over all usable vectors.

    ``label_error`` adds the errors of equal labels (nulls are equal). The sums have one row a label and are joined
    back, small ones by a broadcast that the planner sizes, so no label's rows meet in one task.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part, so a codebook has 256 entries at most")
    books = fit(df, id_col, vector_col, parts, entries, rounds)
    if books is None:
        kept = _kept(df, id_col, vector_col, label_col)
        return kept.select("id", F.col("other_0").alias("label"), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).where("false"), None
    coded = cut_lineage(encode(df, books, id_col, vector_col, label_col))
    total = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")
    unfit = F.count(F.when(F.col("code").isNotNull() & F.col("error").isNull(), 1)) > 0
    by_label = coded.groupBy("label").agg(F.when(~unfit, total).alias("label_error")).select(apart(coded, "label").alias("of"), "label_error")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("id", "label", "code", "error", "label_error"), books
