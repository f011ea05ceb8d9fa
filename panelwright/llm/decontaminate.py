"""Benchmark decontamination: exact word windows of test items, found in training documents.

A-Z are lower-cased and words are runs of ASCII letters and digits and of all code points above ASCII. A
window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

The windows' rolling hashes are broadcast in blocks of at most ``block_words`` item words (a proven size),
each block scanned by every document; a hash that meets is verified word by word. With several blocks,
each scan reads the texts again and leaves only the hits of texts that have any, by a digest of the text, to be united and
joined to the documents, so texts are never copied and a benchmark of any size gives the same result.

Defined results: null has no words; an item without words has no window; repeated items are items of their
own, and items with the same window all count as hit; a null item id counts as the string ``null``; very long
texts are scanned whole; empty tables give no hits or no rows; other columns are ignored by ``find_hits``
and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, id_and_text, map_batches, with_id

#: Bytes that are no word character become blanks.
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: An odd multiplier for the rolling hash, modulo 2**64 (fixed value).
BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").lower().translate(_BLANK).split()


class WindowIndex:
    """The windows of some items: vocabulary, and per length the sorted hashes with their items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows[tuple(ids[i : i + width])].add(item)
        self.windows = {w: sorted(v) for w, v in windows.items()}
        self.hashes = {}
        for n in {len(w) for w in self.windows}:
            rows = np.array([w for w in self.windows if len(w) == n], np.uint64)
            self.hashes[n] = np.unique(self._hash(rows.T))
        self.shortest = min(self.hashes, default=0)

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            total = (total + column + np.uint64(1)) * np.uint64(BASE)
            total ^= total >> np.uint64(29)
        return total

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit spans in words (end exclusive) and the items met."""
        tokens = words(text)
        if not tokens or not self.hashes:
            return len(tokens), [], set()
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in tokens], np.int64)
        known = ids >= 0
        # Only runs of benchmark words of at least the shortest window can hold one.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        spans, met = [], set()
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start < self.shortest:
                continue
            run = ids[start:end].astype(np.uint64)
            for n, hashes in self.hashes.items():
                if n > len(run):
                    continue
                rolled = self._hash([run[k : len(run) - n + 1 + k] for k in range(n)])
                at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
                for i in np.flatnonzero(hashes[at] == rolled):
                    if items := self.windows.get(tuple(run[i : i + n].tolist())):
                        spans.append((int(start + i), int(start + i + n)))
                        met.update(items)
        return len(tokens), merge(spans), met


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint, ordered spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items in blocks of at most ``block_words`` words (or one item), read partition by partition."""
    block, size = [], 0
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")), F.col(f"`{text_col}`").cast("string"))
    for item, text in items.toLocalIterator():
        n = len(words(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """(id_col, n_words int, hits array<struct<start, end>>, items array<string>) per row of ``docs``.

    ``hits`` are disjoint word spans, ends exclusive; ``items`` are distinct and sorted as strings.
    """
    source = id_and_text(docs, id_col, text_col)
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _scanned(source, WindowIndex(block, width), with_id(source, f"n_words int, {HITS}")).withColumnRenamed("id", id_col)
    by_digest = docs.select(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = []
    while block is not None:
        found = _scanned(by_digest, WindowIndex(block, width), with_id(by_digest, f"n_words int, {HITS}")).where(F.size("hits") > 0)
        parts.append(Written(found.dropDuplicates(["id"]), "hits").df)  # a row a text that is hit, without the text
        block, following = following, next(blocks, None)
    united = reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = map_batches(united, _merged, with_id(united, HITS)).withColumnRenamed("id", "of")  # at most a row a block was gathered
    counted = map_batches(source, _counted, with_id(source, "n_words int, digest string"))
    none = lambda c: F.coalesce(c, F.array().cast(united.schema[c].dataType)).alias(c)
    return counted.join(united, F.col("digest") == F.col("of"), "left").select(F.col("id").alias(id_col), "n_words", none("hits"), none("items"))


HITS = "hits array<struct<start:int,end:int>>, items array<string>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(lists) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in lists], SPAN)


def _scanned(source: DataFrame, windows: WindowIndex, schema) -> DataFrame:
    """(id, n_words, hits, items) of each (id, text)."""
    index = source.sparkSession.sparkContext.broadcast(windows)

    def make():
        scan = index.value.scan

        def step(batch):
            n, spans, met = zip(*(scan(t) for t in batch.column(1).to_pylist()), strict=True)
            items = pa.array([sorted(m) for m in met], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), _spans(spans), items], ["id", "n_words", "hits", "items"])

        return step

    return map_batches(source, make, schema)


def _merged():
    def step(batch):
        spans = [merge((x["start"], x["end"]) for x in h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _spans(spans), batch.column(2)], ["id", "hits", "items"])

    return step


def _counted():
    def step(batch):
        found = batch.column(1).to_pylist()
        digest = [hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest() for t in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words(t)) for t in found], pa.int32()), pa.array(digest)], ["id", "n_words", "digest"])

    return step


#: A document is contaminated if it has a hit word and hit words are at least a twentieth of its words.
N_HIT = "aggregate(hits, 0L, (n, h) -> n + h.end - h.start)"


def contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns kept; null ids are judged by their own text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    judged = find_hits(row, benchmark, "row", "text", **options).select("row", "n_words", F.expr(N_HIT).alias("n_hit"))
    return judged.where(~contaminated()).select("row.*")
