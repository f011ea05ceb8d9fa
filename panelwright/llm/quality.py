"""Quality of documents: ridge regression on random Fourier features of document statistics, calibrated.

A text gives ``len(STATISTICS)`` numbers: lengths, shares of kinds of characters and words, repetition of words and
lines, entropy. Cosines of random projections of the standardised numbers approximate a Gaussian kernel
(exp(-|x-y|^2 / (2 width^2))), so a linear fit on them is a kernel machine whose cost does not grow with the rows. A
task adds up the products of its rows' features, a matrix of ``(features + 2)^2`` numbers for each fold; Spark adds the
tasks' matrices row by row, and the driver solves one small system a fold. Folds are by text, so copies share one; each
fold's rows are scored by the system without it, and pool-adjacent-violators on counts of those scores in ``BINS`` bins
turns raw scores into shares of label 1.

Statistics and features are whole numbers (units of 2^-16 and 2^-12), so all sums are exact and hang neither on the
order of rows nor on repeated tasks. All labelled rows are learned from; nothing is sampled.

Defined cases: a null text is an empty one, and an empty text has a score like any other. Rows without a label
(null, or no row of that id) teach nothing; an id with several labels counts once for each pair of rows. Null ids have
no label. Without any labelled row every score is 0.5; with labels of one kind every score is that kind. Repeated rows
are scored each. Very long texts are read whole, in pieces cut at white space, with memory for their distinct words
and lines. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, id_and_text, map_batches, texts, with_id

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "letters", "digits", "marks", "symbols", "space", "entropy",
    "mark_runs", "upper_words", "letterless_words", "short_words", "long_words", "distinct_words", "commonest_word", "repeated_next", "log_lines", "line_length", "distinct_lines", "commonest_line",
)
STAT_UNIT, FEATURE_UNIT = 1 << 16, 1 << 12
FOLDS, BINS = 5, 2000
#: Characters of a text looked at together.
PIECE = 1 << 20
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"[^\w\s]{2,}")


@cache
def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane: 0 other, 1 lower-case or uncased letter, 2 upper-case, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 line end."""
    by_group = {"L": 1, "M": 1, "N": 3, "P": 4, "S": 5, "Z": 6}
    kinds = np.array([by_group.get(unicodedata.category(chr(i))[0], 0) for i in range(1 << 16)], dtype=np.uint8)
    kinds[[i for i in range(1 << 16) if chr(i).isupper()]] = 2
    kinds[[i for i in range(1 << 16) if chr(i).isspace()]] = 6
    kinds[10] = 7
    return kinds


def pieces(text: str) -> Iterator[str]:
    """The text cut at white space into pieces of about ``PIECE`` characters."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def statistics(text: str) -> list[int]:
    """The text's numbers in units of 1 / STAT_UNIT."""
    table, chars, seen, lines = _kinds(), np.zeros(8, np.int64), np.zeros(1 << 16, np.int64), Counter()
    known, n_words, upper, letterless, short, long, repeated, runs, last = Counter(), 0, 0, 0, 0, 0, 0, 0, None
    for piece in pieces(text):
        codes = np.minimum(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
        found = np.bincount(codes, minlength=1 << 8)
        seen[: len(found)] += found
        words = piece.split()
        known.update(words)
        n_words += len(words)
        upper += sum(map(str.isupper, words))
        repeated += sum(map(operator.eq, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
        runs += len(_RUN.findall(piece))
    for word, n in known.items():
        letterless += n * (word.upper() == word.lower())
        short += n * (len(word) == 1)
        long += n * (len(word) > 15)
    lines.update(filter(None, map(str.strip, text.split("\n"))))
    chars += np.bincount(table, weights=seen, minlength=8).astype(np.int64)
    n, n_lines = len(text), sum(lines.values())
    solid, letters = max(n - int(chars[6] + chars[7]), 1), int(chars[1] + chars[2])
    shares = seen[seen > 0] / max(n, 1)
    words, some_lines = max(n_words, 1), max(n_lines, 1)
    numbers = (
        np.log1p(n), np.log1p(n_words), np.log1p(solid / words), chars[2] / max(letters, 1), letters / solid, chars[3] / solid, chars[4] / solid, chars[5] / solid, (chars[6] + chars[7]) / max(n, 1),
        -(shares * np.log2(shares)).sum(), runs / words, upper / words, letterless / words, short / words, long / words, len(known) / words, max(known.values(), default=0) / words, repeated / words,
        np.log1p(n_lines), np.log1p(n / some_lines), len(lines) / some_lines, max(lines.values(), default=0) * (len(lines) < n_lines) / some_lines,
    )
    return [round(float(x) * STAT_UNIT) for x in numbers]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fold, stats array<long>) of each whole text; equal texts share a fold."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            stats = pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), stats, batch.column(2)], ["id", "stats", "fold"])

        return step

    docs = id_and_text(df, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int"))
    return map_batches(docs, make, with_id(docs, "stats array<long>, fold int"))


@dataclass(frozen=True)
class Fourier:
    """cos(W (x - mean) / deviation + phase) in units of 1 / FEATURE_UNIT."""

    mean: np.ndarray
    deviation: np.ndarray
    width: float
    n: int
    seed: int

    @property
    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((len(self.mean), self.n)) / self.width, rng.uniform(0, 2 * np.pi, self.n)

    def features(self, stats: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(rows, n + 1) whole numbers; the last column is one."""
        apart = np.clip((stats - self.mean) / self.deviation, -8, 8)
        waves = np.rint(np.cos(apart @ drawn[0] + drawn[1]) * FEATURE_UNIT)
        return np.hstack([waves, np.full((len(stats), 1), float(FEATURE_UNIT))])


@dataclass(frozen=True)
class Model:
    """Weights of the features, and the calibrated score as a function of the raw one."""

    fourier: Fourier | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    raw: np.ndarray = field(default_factory=lambda: np.zeros(1))
    share: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def normal_equations(labelled: DataFrame, fourier: Fourier) -> dict[int, np.ndarray]:
    """For each fold, sums over its rows of the products of (features, 1, label); (n + 2) x (n + 2) exact numbers."""
    shared = labelled.sparkSession.sparkContext.broadcast(fourier)
    size = fourier.n + 2
    kinds = pa.schema([("fold", pa.int32()), ("at", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def rows(fold: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([fold] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fourier, total = shared.value, {}
        drawn = fourier.drawn
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = fourier.features(_matrix(part.column(0), len(STATISTICS)), drawn)
                full = np.hstack([x, part.column(2).to_numpy()[:, None].astype(float) * FEATURE_UNIT])
                folds = part.column(1).to_numpy()
                for fold in np.unique(folds):
                    mine = full[folds == fold]
                    sums = (mine.T @ mine).astype(np.int64)  # exact: products under 2^24, at most 2^10 of them
                    total[int(fold)] = total.get(int(fold), 0) + sums
        for fold, sums in total.items():
            yield rows(fold, sums)

    def add(table: pa.Table) -> pa.Table:
        """One row of one fold's matrix over all tasks."""
        sums = _matrix(table["sums"].combine_chunks(), size).sum(axis=0)
        return pa.table([table["fold"][:1], table["at"][:1], pa.array([sums.tolist()], pa.list_(pa.int64()))], schema=kinds)

    ddl = "fold int, at int, sums array<long>"
    parts = labelled.select("stats", "fold", "y").mapInArrow(run, ddl)
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "at").applyInArrow(add, ddl).collect():  # folds x (n + 2) rows
        found.setdefault(r["fold"], np.zeros((size, size)))[r["at"]] = r["sums"]
    return found


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the features and the intercept, which is not penalised, for the mean squared error plus ``ridge`` |w|^2."""
    n = len(sums) - 2
    scaled = sums / float(FEATURE_UNIT) ** 2
    rows = scaled[n, n]
    penalty = np.append(np.full(n, ridge * rows), 1e-9 * max(rows, 1.0))
    return np.linalg.solve(scaled[: n + 1, : n + 1] + np.diag(penalty), scaled[: n + 1, n + 1])


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, share of ones) of each block of ascending places; shares ascend."""
    blocks: list[list[float]] = []
    for x, n, k in zip(at, total, ones, strict=True):
        blocks.append([x * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            upper = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], upper, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _raw(df: DataFrame, fourier: Fourier, weights: np.ndarray, finish, ddl: str) -> DataFrame:
    """``finish(batch, raw scores)`` of each batch of (stats, fold, ...); a fold has its row of ``weights``, or all the only one."""
    shared = df.sparkSession.sparkContext.broadcast((fourier, weights))

    def make():
        fourier, weights = shared.value
        drawn = fourier.drawn

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = fourier.features(_matrix(batch.column(0), len(STATISTICS)), drawn) / FEATURE_UNIT
            chosen = weights[batch.column(1).to_numpy()] if len(weights) > 1 else weights
            yield finish(batch, (x * chosen).sum(axis=1))

        return step

    return map_batches(df, make, ddl)


def fit(labelled: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 11) -> Model:
    """Learn from ``labelled`` (stats, fold, y): sums for the scale, one matrix a fold, counts of raw scores for the calibration."""
    d = len(STATISTICS)
    cells = [F.col("stats")[i].cast("decimal(38,0)") for i in range(d)]
    moments = labelled.agg(F.count(F.lit(1)), *[F.sum(c) for c in cells], *[F.sum(F.expr(f"cast(stats[{i}] * stats[{i}] as decimal(38,0))")) for i in range(d)]).first()
    n = moments[0]
    if not n:
        return Model()
    mean = np.array([float(x) / n for x in moments[1 : d + 1]])
    squares = np.array([float(int(q) * n - int(s) ** 2) / n**2 for s, q in zip(moments[1 : d + 1], moments[d + 1 :], strict=True)])
    fourier = Fourier(mean, np.sqrt(np.maximum(squares, (STAT_UNIT / 1000) ** 2)), width, n_features, seed)
    sums = normal_equations(labelled, fourier)
    whole = sum(sums.values())
    weights = solve(whole, ridge)
    without = np.array([solve(whole - sums[f], ridge) if f in sums and len(sums) > 1 else weights for f in range(FOLDS)])

    def binned(batch: pa.RecordBatch, raw: np.ndarray) -> pa.RecordBatch:
        place = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1)  # raw scores are about 0 to 1
        return pa.record_batch([pa.array(place.astype(np.int32)), batch.column(2)], ["place", "y"])

    counts = _raw(labelled.select("stats", "fold", "y"), fourier, without, binned, "place int, y int").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    found = sorted(counts.collect())  # at most BINS rows
    place, total, ones = (np.array(c, dtype=float) for c in zip(*found, strict=True))
    raw, share = isotonic((place + 0.5) * 2 / BINS - 0.5, total, ones)
    return Model(fourier, weights, raw, share)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of ``document_statistics``."""
    if model.fourier is None:
        return stats.select("id", F.lit(0.5).alias("score"))

    def finish(batch: pa.RecordBatch, raw: np.ndarray) -> pa.RecordBatch:
        calibrated = np.interp(raw, model.raw, model.share).round(6)
        return pa.record_batch([batch.column(2), pa.array(calibrated)], ["id", "score"])

    return _raw(stats.select("stats", "fold", "id"), model.fourier, model.weights[None, :], finish, with_id(stats, "score double"))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that teach nothing: CRC-32 of the id as text leaves 1 by 3; a null id's does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of each document, learned from the labelled rows for which ``learn`` (of the column ``id``) holds.

    Texts are read once; their statistics (about 200 bytes a row) are written to the shared folder, as they are joined
    with the labels and scored. That table stays, as the result reads it; the labelled rows' table is removed.
    """
    stats = Written(document_statistics(docs, id_col, text_col), "quality-statistics").df
    marks = labels.select(F.col(f"`{id_col}`").alias("of"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1)")
    known = stats.where(learn).join(marks, F.col("id") == F.col("of")).select("stats", "fold", "y")
    with Written(known, "quality-labelled") as labelled:
        model = fit(labelled)
    return score(stats, model)
