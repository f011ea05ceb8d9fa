"""Text to bounded scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default lexicon.
POSITIVE = "raised record accelerating strong beat expansion robust upgraded outperform momentum confident".split()
NEGATIVE = "lowered withdrawing declining weak miss contraction headwinds downgraded restructuring cautious softened".split()
SIGNAL_SCHEMA = "guidance_change double, tone double, reason string"
#: Characters of a document that an extractor is shown.
EXTRACT_CHARS = 12_000


def count_words(text: Column | str, words: list[str]) -> Column:
    """Non-overlapping substring counts, summed over the words."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return reduce(lambda a, b: a + b, (F.regexp_count(low, F.lit(r"\Q" + w + r"\E")) for w in words))


def keyword_tone(text: Column | str, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """(p - n) / (p + n), 0 without a hit."""
    p, n = count_words(text, positive or POSITIVE), count_words(text, negative or NEGATIVE)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def parse_signal(raw: Column | str) -> Column:
    """The struct in the outermost braces of a model's answer; NULL where there is none."""
    return F.from_json(F.regexp_extract(F.col(raw) if isinstance(raw, str) else raw, r"(?s)\{.*\}", 0), SIGNAL_SCHEMA)


def is_valid(signal: str = "signal") -> Column:
    s = F.col(signal)
    ok = s["guidance_change"].between(-1, 1) & s["tone"].between(-1, 1) & (F.length(F.trim(s["reason"])) > 0)
    return F.coalesce(ok, F.lit(False))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("text_sha", F.sha2(F.coalesce(text_col, F.lit("")), 256))


def answers_to_misses(docs: DataFrame, answer: Callable[[str], str], known: DataFrame | None, text_col: str = "text", shown_chars: int | None = EXTRACT_CHARS) -> DataFrame:
    """(text_sha, raw): answers about the texts that ``known`` (text_sha) lacks, one a text, asked in batches of Arrow.

    ``answer`` is shown the first ``shown_chars`` characters, or with None the whole text.
    """
    shown = F.col(text_col) if shown_chars is None else F.substring(text_col, 1, shown_chars)
    wanted = _keyed(docs, text_col).groupBy("text_sha").agg(F.min(shown).alias("shown"))
    misses = wanted.join(known.select("text_sha"), "text_sha", "left_anti") if known is not None else wanted

    @F.pandas_udf("string")
    def ask(shown: pd.Series) -> pd.Series:
        return shown.map(lambda t: answer(t or ""))

    return misses.select("text_sha", ask("shown").alias("raw"))


def extract(docs: DataFrame, answer: Callable[[str], str], cache: DataFrame | None = None, text_col: str = "text", shown_chars: int | None = EXTRACT_CHARS) -> DataFrame:
    """``docs`` with ``signal``: cached answers by the text's SHA-256, an injected ``answer`` for the others."""
    known = cache.select("text_sha", "raw") if cache is not None else None
    answers = answers_to_misses(docs, answer, known, text_col, shown_chars)
    answers = answers.unionByName(known) if known is not None else answers
    return _keyed(docs, text_col).join(answers, "text_sha", "left").withColumn("signal", parse_signal("raw"))


class AnswerCache:
    """Stored answers under ``path``, a folder for each batch that filled them; one answer a text.

    A batch's folder appears whole or not at all. A batch that is repeated after its answers were stored, as a stream repeats
    one that failed later on, finds its folder and asks nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        """(text_sha, raw)."""
        if not self._exists(""):
            return self.spark.createDataFrame([], "text_sha string, raw string")
        stored = self.spark.read.schema("text_sha string, raw string").parquet(self.path)
        return stored.groupBy("text_sha").agg(F.min("raw").alias("raw"))

    def fill(self, docs: DataFrame, answer: Callable[[str], str], batch: str, text_col: str = "text", shown_chars: int | None = EXTRACT_CHARS) -> DataFrame:
        """Ask about what is not stored yet, store it as ``batch``, and give ``docs`` with their signals from the store."""
        if not self._exists(f"batch={batch}/_SUCCESS"):
            answers_to_misses(docs, answer, self.read(), text_col, shown_chars).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return _keyed(docs, text_col).join(self.read(), "text_sha", "left").withColumn("signal", parse_signal("raw"))

    def follow(self, docs: DataFrame, answer: Callable[[str], str], then: Callable[[DataFrame, int], None], checkpoint: str, name: str = "stream", **options):
        """A query that fills the cache from a stream and hands each batch's documents with their signals to ``then``."""

        def step(batch: DataFrame, number: int) -> None:
            then(self.fill(batch, answer, f"{name}-{number}", **options), number)

        return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_misses(docs: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_sha): distinct texts that the cache (text_sha) lacks."""
    return docs.select(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_sha")).distinct().join(cache.select("text_sha"), "text_sha", "left_anti")
