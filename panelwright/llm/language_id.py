"""Language identification by words first, then progressively shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word scores by the mean log frequency
of its known character n-grams of the longest order that has any, from ``ORDERS[0]`` down to single
letters. A text's language maximises the sum over its words; its score is the mean over its words of the
probability that the word alone gives to that language.

Training takes a bounded sample of labelled rows: about ``max_rows`` of them, chosen by a hash of the id
(all of them where there are fewer). Words and n-grams that occur ``least`` times or more in a language are kept;
the bound on rows fixes how many there can be for the driver to gather and broadcast. Predictions read the whole of
every text and nothing else.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text where
training saw no labelled row; words of an unseen script leave all languages even; ties go to the language
that sorts first; very long texts are read whole; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored by the operator and kept by ``keep_identified``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, with_id

ORDERS = (5, 4, 3, 2, 1)
UND = "und"
#: Most unseen words a worker remembers the scores of.
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found]


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single letters without the marks."""
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    rows: np.ndarray  # log frequencies, one row per word or n-gram


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 10_000, least: int = 3) -> Model:
    """Count words and n-grams of the sample on Spark and bring those that recur to the driver."""
    labels = labelled.where(F.col(lang_col).isNotNull())
    total = labels.select(lang_col).count()  # reads no text
    known = labels.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    part = min(1.0, max_rows / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(np.ceil(part * 1_000_000)))

    def count_words():
        def step(batch):
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items() if word]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

        return step

    def count_grams():
        def step(batch):
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[lang, 0, word] += n
                for order in ORDERS:
                    for gram in grams(word, order):
                        counts[lang, order, gram] += n
            columns = [*zip(*counts, strict=True), counts.values()] if counts else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "kind", "gram", "n"])

        return step

    per_word = map_batches(sample.select("text", "lang"), count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = map_batches(per_word, count_grams, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    sizes = counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    counted = counted.persist()
    size_of = {(r["lang"], r["kind"]): r["total"] + r["distinct"] for r in sizes.collect()}  # six rows a language
    top = counted.where(F.col("n") >= least).toArrow().to_pandas()
    counted.unpersist()
    languages = sorted({lang for lang, _ in size_of})
    place = {lang: i for i, lang in enumerate(languages)}
    tables: list[dict[str, int]] = [{} for _ in range(1 + len(ORDERS))]
    blocks = []
    base = 0
    for kind in (0, *ORDERS):
        mine = top[top["kind"] == kind]
        names = sorted(mine["gram"].unique())
        index = {g: i for i, g in enumerate(names)}
        counts = np.zeros((len(names), len(languages)))
        counts[mine["gram"].map(index).to_numpy(int), mine["lang"].map(place).to_numpy(int)] = mine["n"]
        blocks.append(np.log((counts + 0.5) / [size_of.get((lang, kind), 1) for lang in languages]))
        tables[0 if kind == 0 else 1 + ORDERS.index(kind)] = {g: base + i for g, i in index.items()}
        base += len(names)
    rows = np.concatenate(blocks) if blocks else np.zeros((0, 0))
    return Model(languages, tables[0], tables[1:], rows)


class Scorer:
    """Scores texts in one worker; unseen words' rows are appended, and dropped before a batch that would make them over ``CACHE``."""

    def __init__(self, model: Model):
        self.model, self.known = model, len(model.rows)
        self.log, self.share = model.rows, self._softmax(model.rows)
        self.index = dict(model.words)

    @staticmethod
    def _softmax(rows: np.ndarray) -> np.ndarray:
        if not rows.size:
            return rows
        e = np.exp(rows - rows.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _learn(self, unseen: list[str]) -> None:
        """Append the back-off rows of unseen words."""
        found, sizes = [], []
        for word in unseen:
            before = len(found)
            for order, table in zip(ORDERS, self.model.grams, strict=True):
                found += [i for g in grams(word, order) if (i := table.get(g)) is not None]
                if len(found) > before:
                    break
            sizes.append(len(found) - before)
        size = np.array(sizes)
        sums = np.zeros((len(unseen) + 1, len(self.model.languages)))
        np.add.at(sums, np.repeat(np.arange(len(unseen)), size), self.model.rows[found]) if len(found) < 64 else None
        if len(found) >= 64:
            running = np.concatenate((np.zeros((1, sums.shape[1])), np.cumsum(self.model.rows[found], axis=0)))
            ends = np.cumsum(size)
            sums[:-1] = running[ends] - running[ends - size]
        rows = sums[:-1] / np.maximum(size, 1)[:, None]
        for k, word in enumerate(unseen):
            self.index[word] = len(self.log) + k
        self.log = np.concatenate((self.log, rows))
        self.share = np.concatenate((self.share, self._softmax(rows)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            counts = Counter(words(text)) if text else {}
            counts.pop("", None)
            out.append(counts)
        if not self.model.languages:
            return [(UND, 0.0)] * len(texts)
        asked = set().union(*out)
        unseen = asked - self.index.keys()
        if unseen and len(self.log) - self.known + len(unseen) > CACHE:
            self.log, self.share, self.index = self.log[: self.known], self.share[: self.known], dict(self.model.words)
            unseen = asked - self.index.keys()  # all that these texts need, however many
        if unseen:
            self._learn(sorted(unseen))
        get = self.index.__getitem__
        result = []
        for counts in out:
            if not counts:
                result.append((UND, 0.0))
                continue
            at, times = np.fromiter(map(get, counts), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
            best = int(np.argmax(times @ self.log[at]))
            result.append((self.model.languages[best], float(min(1.0, times @ self.share[at, best] / times.sum()))))
        return result


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred string, score double), one row per row of ``df``."""
    source = id_and_text(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(sent.value).predict

        def step(batch):
            found = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"]
            )

        return step

    return map_batches(source, make, with_id(source, "lang_pred string, score double")).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: a fifth, by the CRC-32 of the id's text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.25) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of at least ``least``; all columns kept."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    judged = predict(row, model, "row", "text")
    return judged.where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select("row.*")
