"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Fingerprints: text lower-cased in A-Z, words separated by ASCII white space, shingles of three words
(repeats counted), XXH64 with seed 42 of each; a bit is set where over half of the shingles set it. Two
fingerprints link at ``distance`` or fewer differing bits, and a class is what links reach.

Search, over distinct fingerprints only:

1. Bits are grouped into partitions by their correlation over all fingerprints, so that correlated bits
   share a partition.
2. Thresholds per partition are allotted by dynamic programming on the estimated number of candidates,
   with sum(threshold + 1) = distance + 1: any two fingerprints within the distance then agree to within
   its threshold in some partition. A partition may get threshold -1 and is then not probed.
3. Every fingerprint is indexed by each partition's value and probes all values within the threshold;
   candidates are verified by their full distance.

A bucket of more than ``crowded`` fingerprints would give quadratically many candidates. All
fingerprints that are in or probe such a bucket take an exact other way: each is sent to the centres of
all radius-(distance/2 rounded up) balls that hold it, and every centre links what meets there to its
smallest member, which is at most ``distance`` away for an even distance (verified all the same). The
links kept have the same connected components as all links, so no class is lost or split.

Defined results: null or wordless text has fingerprint 0 and links like any other; a text of fewer than
three words has its whole sequence as its one shingle; ties of a bit's vote leave it 0; exact copies
share a fingerprint and so a class; repeated rows are kept; rows with a null id take no part in linking
and get the class of their fingerprint, or null; an empty table gives an empty result; other columns are
ignored by the operator and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut_lineage, id_and_text, map_batches, texts, with_id
from .components import components

BITS = 64


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    shingles = zip(starts, ends[width - 1 :], strict=False) if len(words) >= width else iter([(0, len(joined) + 1)])
    votes, n = np.zeros(BITS, np.int64), 0
    while part := [digest(joined[a : b - 1], seed) for a, b in itertools.islice(shingles, 65_536)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
        n += len(part)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long with the same bits."""

    def make():
        def step(batch):
            values = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])

        return step

    source = id_and_text(df, id_col, text_col)
    return map_batches(source, make, with_id(source, "fp long"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how often two bits are both set, over all of them."""

    def make():
        def step(batch):
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both = np.rint(bits.T @ bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BITS), pa.int32()), pa.array(both.tolist(), pa.list_(pa.int64())), pa.array([len(values)] * BITS, pa.int64())],
                ["bit", "both", "n"],
            )

        return step

    per_batch = map_batches(fps.select("fp"), make, "bit int, both array<long>, n long")
    rows = (
        per_batch.select("bit", "n", F.posexplode("both").alias("other", "k"))
        .groupBy("bit", "other").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).collect()
    )  # 64 x 64 rows at any size
    table = np.zeros((BITS, BITS))
    for r in rows:
        table[r["bit"], r["other"]] = r["k"]
    return (int(rows[0]["n"]) if rows else 0), table


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of nearly equal size, each bit next to those it correlates with."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [min(left, key=lambda b: (-spread[b], b))]
        left.discard(group[0])
        while len(group) < size:
            best = min(left, key=lambda b: (-correlation[b, group].sum(), b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], units: int) -> list[int]:
    """Thresholds by dynamic programming: costs[i][u] is the price of threshold u - 1 in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        best = {
            total: min((best[total - u][0] + row[u], [*best[total - u][1], u - 1]) for u in range(min(total, len(row) - 1) + 1) if total - u in best)
            for total in range(units + 1)
            if any(total - u in best for u in range(min(total, len(row) - 1) + 1))
        }
    return best[units][1]


def _value(fp, bits: list[int]):
    """A partition's bits of a fingerprint, in place."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask))


def _within(bits: list[int], radius: int) -> list[int]:
    """Signed masks that flip up to ``radius`` of the bits."""
    masks = [sum(1 << b for b in flips) for r in range(radius + 1) for flips in itertools.combinations(bits, r)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2, parts: int = 3, crowded: int = 64) -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``distance``; ``fps`` (node, fp) has distinct fp."""
    n, both = bit_statistics(fps)
    groups = partition_bits(n, both, parts)
    p = np.diag(both) / max(n, 1)
    same = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _value(F.col("fp"), g).alias("key")) for i, g in enumerate(groups)])).alias("x"))
    sizes = same.select("x.*").groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    squares = {r["part"]: float(r["s"]) for r in sizes.groupBy("part").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("s")).collect()}
    costs = []
    for i, bits in enumerate(groups):
        odds = [2 * p[b] * (1 - p[b]) / max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-9) for b in bits]
        price, row, pairs = 1.0, [0.0], squares.get(i, 0.0)
        for r in range(distance + 1):
            row.append(pairs * price + n * len(_within(bits, r)))
            price += sum(np.prod(c) for c in itertools.combinations(odds, r + 1))
        costs.append(row)
    thresholds = allot(costs, distance + 1)

    def keys(i: int, radius: int):
        value, masks = _value(F.col("fp"), groups[i]), F.array(*[F.lit(m) for m in _within(groups[i], radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(m).alias("key")))

    def keyed(radius_of) -> DataFrame:
        entries = [keys(i, radius_of(t)) for i, t in enumerate(thresholds) if t >= 0]
        return fps.select("node", "fp", F.explode(F.concat(*entries)).alias("x")).select("node", "fp", "x.*")

    crowd = sizes.where(F.col("size") > crowded).select("part", "key")
    sized = sizes.where((F.col("size") > 1) | F.lit(max(thresholds) > 0)).where(F.col("size") <= crowded).select("part", "key")
    index = keyed(lambda t: 0).join(sized, ["part", "key"], "left_semi")
    probes = keyed(lambda t: t).join(sized, ["part", "key"], "left_semi") if max(thresholds) > 0 else index
    x, y = index.alias("x"), probes.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    found = x.join(
        y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node") if max(thresholds) == 0 else F.col("x.node") != F.col("y.node")) & near
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    packed = keyed(lambda t: t).join(crowd, ["part", "key"], "left_semi").select("node", "fp").distinct()
    radius = (distance + 1) // 2
    balls = packed.select("node", "fp", F.explode(F.transform(F.array(*[F.lit(m) for m in _within(list(range(BITS)), radius)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    least = balls.groupBy("centre").agg(F.min(F.struct("node", "fp")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select(apart(balls, "centre").alias("c"), "least")
    met = balls.join(least.hint("merge"), (F.col("centre") == F.col("c")) & (F.col("node") != F.col("least.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= distance))
    return found.unionAll(met.select("node", "least.node")).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, parts: int = 3, crowded: int = 64) -> DataFrame:
    """(id_col, fp long, component): one row per row of ``df``; component is the smallest id of its class."""
    if distance % 2:
        raise ValueError("distance must be even: the exact way for crowded buckets meets at balls of half of it")
    docs = cut_lineage(fingerprints(df, id_col, text_col, width))
    distinct = cut_lineage(docs.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    classes = components(links(distinct, distance, parts, crowded))
    of_fp = distinct.join(classes, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component"))
    return docs.join(of_fp.hint("merge"), docs["fp"] == of_fp["of"], "left").select(F.col("id").alias(id_col), "fp", "component")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classify=near_duplicate_classes, **options) -> DataFrame:
    """One row of each class stays: that with the class's smallest id (all columns kept).

    Rows repeated under one id are one document and leave one row (the least by its columns' hash). Rows with a null id
    cannot be told apart and all stay. ``classify`` gives (id_col, component): by fingerprint distance here, by verified
    similarity with ``near_copies.similar_classes``.
    """
    classes = cut_lineage(classify(df, id_col, text_col, **options).select(F.col(id_col).alias("gone"), "component"))
    dropped = classes.where("gone <> component").select("gone").distinct()
    kept = df.join(dropped.hint("merge"), df[id_col] == dropped["gone"], "left_anti")
    if classes.where("gone is not null").groupBy("gone").count().where("count > 1").isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    once = kept.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.xxhash64(whole).alias("order"), whole.alias("row")).groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return once.unionByName(kept.where(F.col(id_col).isNull()))
