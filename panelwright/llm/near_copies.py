"""Near copies by fingerprints with verified similarity: pigeonhole probes over a wide fingerprint, exact sets at the end.

SimHash fingerprints of whole texts within two bits (``simhash.links``) find very close copies only: at a Jaccard
similarity of 0.8 two of them differ in some ten of 64 bits, and a search that far compares a quadratic number of texts.
So there is a second, wide fingerprint of ``BANDS * ROWS`` bytes: each byte is of the shingle with the least of one
of as many hashes, and two texts agree in a byte about as often as they are similar. It is probed as in the pigeonhole
method, by partitions in which two fingerprints must agree:

1. Texts equal word for word are one text, named by the smallest id that has it.
2. A text has a row for each of ``BANDS`` partitions, keyed by the partition's ``ROWS`` least hashes; two texts of
   similarity 0.8 agree in one with probability 1 - (1 - 0.8^4)^16 = 0.9998. Rows are sorted by key and then by the
   fingerprint's following bytes, a different order for each partition, and split into ranges of about equal size, so a
   key that any share of all texts has is split too.
3. Each row meets the ``NEAR`` rows before it with its key, across ranges too: those that agree in most of the following bytes.
   Versions of a text, each an edit of an earlier one, so meet the versions nearest to them, in several orders.
   Rows that agree in fewer than ``LEAST`` of all bytes (four deviations under 0.8) are no candidates.
4. Candidates are verified by their exact shingle sets, each text's best three first, then all that still are in different
   classes; so a large group is joined by few comparisons, and no candidate is left out that could join two classes.
5. A key of over ``NEAR + 1`` rows that still are in several classes gets the rest: all its pairs of different classes are compared by
   fingerprint, in tasks of two blocks of about ``BLOCK`` rows or ``BLOCK_BYTES``, and candidates among them by their sets of hashed shingles there and
   then. A pair that has the similarity joins its classes for the rest of the task, so a task hands on fewer links than it has rows; these
   are verified as before. So neighbours only spare comparisons inside classes, and all texts that agree in a partition are candidates of
   each other; time is quadratic only in keys whose texts are no copies of each other, and what is written never is.
6. Verified links and equal texts give classes.

Defined results: as in ``simhash``; wordless and null texts are equal to each other; a text of fewer than ``width``
words has its whole sequence as its one shingle; of an id with several texts, each is compared on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, apart, cut_lineage, id_and_text, map_batches, texts, with_id
from .components import pointers
from .simhash import links

#: Partitions of the wide fingerprint and the hashes of each; rows that a row meets; the least bytes in which candidates agree.
BANDS, ROWS, NEAR, LEAST = 16, 4, 8, 38
#: Rows of a block of a crowded key and bytes of their hashed shingles, about.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Candidates of a text that are verified in each round; None for all that are left.
ROUNDS = (3, None)
#: An odd multiplier for hashes, modulo 2**64 (fixed value).
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What tells the wide fingerprint's hashes apart.
SALTS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _key(text: str) -> int:
    """A hash of a text's words, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words(text)), 1)).view(np.int64))


def wide(distinct: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(key of each partition, the wide fingerprint's bytes) of hashed shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(distinct), 4096):
        least = np.minimum(least, ((distinct[k : k + 4096, None] ^ SALTS) * MIX).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = (keys ^ rows[:, j]) * MIX
        keys ^= keys >> np.uint64(29)
    return keys, least.astype(np.uint8).tobytes()


def hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles of some words, as sorted hashes."""
    hashed = np.array(list(map(xxhash.xxh64_intdigest, tokens)), np.uint64)
    n = max(1, len(hashed) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, len(hashed))):
        total = (total ^ hashed[j : j + n]) * MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def sketch(text: str, width: int) -> tuple[int, int, int, np.ndarray, bytes]:
    """(hash of the words, SimHash of the distinct shingles, their number, keys of the partitions, wide fingerprint)."""
    tokens = words(text)
    key = xxhash.xxh64_intdigest(b" ".join(tokens), 1)
    if not tokens:
        return key, 0, 1, np.zeros(0, np.uint64), b""
    distinct = hashes(tokens, width)
    votes = sum(np.unpackbits(distinct[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(distinct), 65_536))
    fp = int.from_bytes(np.packbits(2 * votes > len(distinct)).tobytes(), "big")
    return key, fp, len(distinct), *wide(distinct)


def shingles(text: str, width: int) -> set[bytes]:
    tokens = words(text)
    if len(tokens) < width:
        return {b" ".join(tokens)}
    return {b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def jaccard(a: str, b: str, width: int) -> float:
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, fp, n, bands, wide) of each row; the text is read once."""

    def make():
        def step(batch):
            key, fp, n, bands, marks = zip(*(sketch(t, width) for t in texts(batch)), strict=True)
            whole = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
            ends = np.cumsum([0, *map(len, bands)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands).view(np.int64)))
            columns = [batch.column(0), whole(key), whole(fp), pa.array(n, pa.int64()), lists, pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "n", "bands", "wide"])

        return step

    return map_batches(docs, make, with_id(docs, "key long, fp long, n long, bands array<long>, wide binary"))


MEETINGS = "a long, b long, equal int, band long, turned binary, key long"


def _meet(batches):
    """Pairs of near rows (a, b, equal) among rows (band, turned, key) in order, and the task's first and last rows as they are."""
    size, ends = BANDS * ROWS, []
    band, marks, key = np.zeros(0, np.int64), np.zeros((0, size), np.uint8), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        if len(ends) < NEAR:
            ends += batch.slice(0, NEAR - len(ends)).to_pylist()
        band = np.append(band[-NEAR:], batch.column(0).to_numpy())
        marks = np.vstack([marks[-NEAR:], np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, size)])
        key = np.append(key[-NEAR:], batch.column(2).to_numpy())
        found = []
        for d in range(1, min(NEAR, len(band) - 1) + 1):
            at = np.flatnonzero((band[d:] == band[:-d]) & (key[d:] != key[:-d]))
            equal = (marks[at] == marks[at + d]).sum(axis=1)
            at, equal = at[equal >= LEAST], equal[equal >= LEAST]
            found.append((np.minimum(key[at], key[at + d]), np.maximum(key[at], key[at + d]), equal))
        a, b, equal = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        none = lambda kind: pa.nulls(len(a), kind)
        columns = [pa.array(a), pa.array(b), pa.array(equal, pa.int32()), none(pa.int64()), none(pa.binary()), none(pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "equal", "band", "turned", "key"])
    ends += [{"band": int(x), "turned": m.tobytes(), "key": int(k)} for x, m, k in zip(band[-NEAR:], marks[-NEAR:], key[-NEAR:], strict=True)]
    columns = [pa.nulls(len(ends), pa.int64())] * 2 + [pa.nulls(len(ends), pa.int32())]
    columns += [pa.array([e[c] for e in ends], kind) for c, kind in (("band", pa.int64()), ("turned", pa.binary()), ("key", pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "equal", "band", "turned", "key"])


def _near_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b, equal): keys of texts that meet in some partition, and the bytes in which they agree; a row for each partition."""
    turned = lambda j: F.concat(F.expr(f"substring(wide, {ROWS * j + ROWS + 1})"), F.expr(f"substring(wide, 1, {ROWS * j + ROWS})"))
    rows = F.array(*[F.struct(F.col("bands")[j].alias("band"), turned(j).alias("turned")) for j in range(BANDS)])
    every = distinct.where(F.size("bands") > 0).select("key", F.explode(rows).alias("row")).select("row.band", "row.turned", "key")
    order = ["band", "turned", "key"]
    met = cut_lineage(every.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_meet, MEETINGS))
    ends = met.where("band is not null").select(*order).distinct()  # a few rows a task, so that rows meet across tasks
    across = ends.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInArrow(_meet, MEETINGS)
    return met.unionByName(across).where("a is not null").select("a", "b", "equal")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): those of ``pairs`` (a_node, b_node, ka, kb) whose texts have the similarity; one text travels to the other's place."""
    text = F.coalesce("text", F.lit("")).alias("text")
    ones = pairs.join(docs.select(F.col("id").alias("a_id"), text), F.col("a_node") == F.col("a_id")).select("a_node", "b_node", "ka", "kb", F.col("text").alias("a_text"))
    held = ones.join(docs.select(F.col("id").alias("b_id"), text), F.col("b_node") == F.col("b_id")).select("a_node", "b_node", "ka", "kb", "a_text", F.col("text").alias("b_text"))

    def make():
        def step(batch):
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            alike = [_key(a) == ka and _key(b) == kb and jaccard(a, b, width) >= similarity for ka, kb, a, b in rows]  # an id may have other texts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

        return step

    node = docs.schema["id"].dataType
    return map_batches(held, make, T.StructType([T.StructField("a", node), T.StructField("b", node)]))


def _apart_rows(distinct: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, key, node, blocks, class): the texts of partitions that over ``NEAR + 1`` texts of several ``classes`` have."""
    held = (F.col("n") if "n" in distinct.columns else F.lit(0)) * 8
    of_text = classes.select(F.col("node").alias("of"), "component")
    placed = distinct.where(F.size("bands") > 0).join(of_text.hint("merge"), F.col("node") == F.col("of"), "left")
    every = placed.select("key", "node", held.alias("held"), F.xxhash64(F.coalesce("component", "node")).alias("class"), F.explode("bands").alias("band"))
    by_band = every.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    crowded = by_band.where((F.col("n") > NEAR + 1) & (F.col("lo") != F.col("hi")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / BLOCK_BYTES)).cast("int")
    crowded = crowded.select(apart(crowded, "band").alias("b"), blocks.alias("blocks"))
    return every.join(crowded.hint("merge"), F.col("band") == F.col("b")).select("band", "key", "node", "blocks", "class")


def _sets(texts_of: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(k, hashes): the sorted hashes of the shingles of the texts (key, node)."""
    held = docs.join(texts_of.hint("merge"), F.col("id") == F.col("node")).select("key", "text")

    def make():
        def step(batch):
            rows = [(k, hashes(words(t), width).tobytes()) for k, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) if _key(t) == k]  # an id may have other texts
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["k", "hashes"])

        return step

    return map_batches(held, make, "k long, hashes binary").dropDuplicates(["k"])


def _shared(sets: list[np.ndarray]):
    """A function of a row: the shingles that its set shares with each of ``sets``."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    owners, ends = np.repeat(np.arange(len(sets)), sizes)[order], np.cumsum(np.bincount(codes))
    starts, bounds = np.append(0, ends[:-1]), np.append(0, np.cumsum(sizes))

    def of(x: int) -> np.ndarray:
        return np.bincount(np.concatenate([owners[starts[c] : ends[c]] for c in codes[bounds[x] : bounds[x + 1]]]), minlength=len(sets))

    return of, sizes


def _apart_pairs(distinct: DataFrame, classes: DataFrame, docs: DataFrame | None = None, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b, equal): keys of texts of different ``classes`` that agree in a partition that over ``NEAR + 1`` texts have.

    With ``docs``, only pairs whose hashed shingles have the similarity, and of these only what joins two classes of a task.
    """
    rows = _apart_rows(distinct, classes)
    marks = distinct.select(F.col("key").alias("k"), "wide")
    if docs is not None:
        rows = cut_lineage(rows)
        marks = marks.join(_sets(rows.select("key", "node").distinct(), docs, width).hint("merge"), "k")
    else:
        marks = marks.withColumn("hashes", F.lit(None).cast("binary"))
    rows = rows.join(marks.hint("merge"), F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    held = ["block", "key", "class", "wide", "hashes"]
    tasks = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), *held)
    tasks = tasks.groupBy("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct(*held)).alias("rows"))

    def make():
        def step(batch):
            for i, j, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = pa.RecordBatch.from_struct_array(cell.values)
                block, key, of = (rows.column(c).to_numpy() for c in range(3))
                of, whole = of.copy(), rows.column(4).null_count == 0
                marks = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                if whole:
                    shared, sizes = _shared([np.frombuffer(x, np.uint64) for x in rows.column(4).to_pylist()])
                for x in range(len(key)):
                    others = np.arange(x + 1, len(key)) if i == j else np.flatnonzero(block == j) if block[x] == i else []
                    others = others[of[others] != of[x]] if len(others) else others
                    if not len(others):
                        continue
                    equal = (marks[others] == marks[x]).sum(axis=1)
                    others, equal = others[equal >= LEAST], equal[equal >= LEAST]
                    if whole and len(others):
                        both = shared(x)[others]
                        alike = both / (sizes[x] + sizes[others] - both) >= similarity
                        joins = []
                        for y in np.flatnonzero(alike):
                            if of[others[y]] != of[x]:
                                of[of == of[others[y]]] = of[x]
                                joins.append(y)
                        others, equal = others[joins], equal[joins]
                    if len(others):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[others], key[x])), pa.array(np.maximum(key[others], key[x])), pa.array(equal, pa.int32())], ["a", "b", "equal"])

        return step

    return map_batches(tasks.select("i", "j", "rows"), make, "a long, b long, equal int").groupBy("a", "b").agg(F.max("equal").alias("equal"))


def _classes(candidates: DataFrame, docs: DataFrame, width: int, similarity: float, known: DataFrame | None = None, rounds: tuple[int | None, ...] = ROUNDS) -> DataFrame:
    """(node, component) of the texts that ``known`` classes and verified candidates (a_node, b_node, ka, kb, equal) link, smallest ones left out.

    Each round starts from the classes of the one before, which stand for all links found so far.
    """
    left, written, classes = candidates, None, known
    for place, most in enumerate(rounds):
        before = written
        if place:  # only what could still join two classes
            one, two = (classes.select(F.col("node").alias(f"{x}_of"), F.col("component").alias(f"{x}_class")) for x in "ab")
            placed = left.join(one, F.col("a_node") == F.col("a_of"), "left").join(two, F.col("b_node") == F.col("b_of"), "left")
            left = placed.where("coalesce(a_class, a_node) <> coalesce(b_class, b_node)").select("a_node", "b_node", "ka", "kb", "equal")
        if most is not None:  # a pair's place is its better one in its two texts' orders
            by_node = Window.partitionBy("node").orderBy(F.desc("equal"), F.xxhash64("ka", "kb"), "ka", "kb")
            each = left.select("*", F.explode(F.array("ka", "kb")).alias("node")).withColumn("place", F.row_number().over(by_node))  # a text has BANDS * NEAR * 2 candidates at most
            left = each.groupBy("a_node", "b_node", "ka", "kb", "equal").agg(F.min("place").alias("place"))
        written = Written(left, "candidates")
        if before:
            before.remove()
        chosen, left = (written.df.where(f"place <= {most}"), written.df.where(f"place > {most}")) if most is not None else (written.df, None)
        if chosen.isEmpty() and classes is not None:
            break
        found = Written(_verified(chosen.select("a_node", "b_node", "ka", "kb"), docs, width, similarity), "links")
        if classes is None:
            classes = pointers(found.df)
        elif not found.df.isEmpty():
            classes = pointers(found.df.unionAll(classes.select("node", "component")))
        found.remove()
    written.remove()
    return classes


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component): one row per row of ``df`` with an id; component is the smallest id of its class."""
    if similarity < 0.8:
        raise ValueError("the partitions of the wide fingerprint are made for a similarity of 0.8 or more")
    docs = id_and_text(df, id_col, text_col).where("id is not null")
    described = cut_lineage(_described(docs, width))
    distinct = cut_lineage(described.groupBy("key", "fp", "n").agg(F.min(F.struct("id", "bands", "wide")).alias("least")).select("key", "fp", "n", F.col("least.id").alias("node"), "least.bands", "least.wide"))
    by_fp = distinct.groupBy("fp").agg(F.min("key").alias("node"))
    close = links(by_fp, distance=2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first_of = by_fp.select(apart(by_fp, "fp").alias("f"), F.col("node").alias("first"))
    same_fp = distinct.join(first_of.hint("merge"), F.col("fp") == F.col("f")).where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    alike = close.unionAll(same_fp).withColumn("equal", F.lit(BANDS * ROWS))
    pairs = _near_pairs(distinct).unionAll(alike).groupBy("a", "b").agg(F.max("equal").alias("equal"))

    of_text = distinct.select("key", "n", "node")

    def candidates(pairs: DataFrame) -> DataFrame:
        one, two = of_text.toDF("ka", "na", "a_node"), of_text.toDF("kb", "nb", "b_node")
        sized = pairs.join(one.hint("merge"), F.col("a") == F.col("ka")).join(two.hint("merge"), F.col("b") == F.col("kb"))
        fits = F.least("na", "nb") + 1e-6 >= similarity * F.greatest("na", "nb")  # the lesser set holds all that both share
        return sized.where(fits & (F.col("a_node") != F.col("b_node"))).select("a_node", "b_node", "ka", "kb", "equal")

    classes = _classes(candidates(pairs), docs, width, similarity)
    rest = candidates(_apart_pairs(distinct, classes, docs, width, similarity))
    classes = _classes(rest, docs, width, similarity, classes, rounds=(None,))  # few, and nearly all of them are links
    of_key = distinct.join(classes, "node", "left").select(F.col("key").alias("k"), F.col("fp").alias("f"), F.col("n").alias("m"), F.coalesce("component", "node").alias("component"))
    found = described.join(of_key.hint("merge"), (F.col("key") == F.col("k")) & (F.col("fp") == F.col("f")) & (F.col("n") == F.col("m")))
    return found.select(F.col("id").alias(id_col), "component")
