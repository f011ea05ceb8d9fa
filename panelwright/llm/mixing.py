"""Mixing sources to target weights by temperature.

1. A source's share p is its part of all tokens; its weight is proportional to p ** exponent. Exponent 1
   keeps the shares, smaller ones lift small sources, larger ones large sources.
2. The exponent is bisected until the weights' entropy meets ``entropy`` (in nats), or until the source
   repeated most is repeated ``repetition`` times (the flattest mix within that limit).
3. The weights are realised exactly as token quotas of ``budget``: each source is read in epochs, every
   epoch a new hash-keyed permutation of all its documents; the last epoch is cut where the quota is
   filled (the document that crosses it stays). The streams are cut into blocks in proportion, so every
   block holds each source's weight, and a block is again a hash-keyed permutation of its documents.

Only DataFrame operations. Positions within an epoch are running token sums over a permutation of
arbitrary size: documents are put in hash ranges of about ``range_rows`` rows, sums of whole ranges are
accumulated on the small table of ranges, and only within a range is there a sort. A source that holds a
third of all rows is thus as many ranges as it needs.

Defined results: a null source is a source of its own; null token counts count as 0; documents without
tokens take no quota but are placed in each epoch they fall in; repeated ids are ordered by id only and
keep all their rows; an empty table, or one without tokens, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Bisections done in each pass over the table of sources, and passes.
LEVELS, PASSES = 4, 12
#: Sources that may be broadcast; beyond, their table is joined by shuffle.
BROADCAST_SOURCES = 100_000


def _at(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, most repetitions) of the weights at each exponent; one pass over the sources."""
    p = F.col("p")
    sums = [
        x
        for k, e in enumerate(exponents)
        for x in (
            F.sum(F.pow(p, F.lit(e))).alias(f"z{k}"),
            F.sum(F.pow(p, F.lit(e)) * F.ln(p)).alias(f"l{k}"),
            F.max(F.pow(p, F.lit(e)) / F.col("tokens")).alias(f"m{k}"),
        )
    ]
    row = sources.agg(*sums).first()
    return [(math.log(row[f"z{k}"]) - e * row[f"l{k}"] / row[f"z{k}"], row[f"m{k}"] / row[f"z{k}"] * budget) for k, e in enumerate(exponents)]


def bisect_exponent(sources: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None, low: float = 0.0, high: float = 8.0) -> float:
    """The exponent that meets the target over ``sources`` (p, tokens), bisected ``LEVELS * PASSES`` times.

    Entropy falls and so, up to exponent 1, do repetitions as the exponent grows. A target beyond reach gives the
    nearest end: ``low``, or for repetition 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    if repetition is not None:
        high = min(high, 1.0)
    enough = (lambda h, r: h <= entropy) if repetition is None else (lambda h, r: r <= repetition)
    if enough(*_at(sources, [low], budget)[0]):
        return low
    for _ in range(PASSES):
        step = (high - low) / 2**LEVELS
        inner = [low + step * k for k in range(1, 2**LEVELS)]
        first = next((k for k, x in enumerate(_at(sources, inner, budget)) if enough(*x)), len(inner))
        low, high = low + step * first, low + step * (first + 1)
    return high


def permutation_key(*parts: Column | str) -> Column:
    """The first 52 bits of an MD5 of the parts, a uniform key in [0, 2**52)."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 13), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    tokens: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    entropy: float | None = None,
    repetition: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 0,
    range_rows: int = 4_000,
) -> DataFrame:
    """(id_col, source, epoch long, block long, position long, n_tokens long): the mixed corpus, in order of block and position.

    ``budget`` defaults to all tokens there are.
    """
    sized = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n")))
    sources = cut_lineage(sized.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    found = sources.where("tokens > 0").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = found["tokens"] or 0, found["n"]
    goal = budget if budget is not None else total
    shares = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    if total:
        exponent = bisect_exponent(shares, goal, entropy, repetition)
        scale = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    else:
        exponent, scale = 1.0, 1.0
    quota = shares.select(
        F.col("source").alias("of"), "tokens",
        F.round(F.pow("p", F.lit(exponent)) / F.lit(scale) * F.lit(float(goal))).cast("long").alias("quota"),
        F.ceil(F.col("rows") / F.lit(range_rows)).cast("long").alias("ranges"),
    )
    quota = F.broadcast(quota) if n_sources <= BROADCAST_SOURCES else quota.hint("merge")
    copies = sized.join(quota, F.col("source").eqNullSafe(F.col("of"))).where("quota > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1) div tokens)")))
    keyed = copies.withColumn("key", permutation_key(F.col("id").cast("string"), F.col("epoch").cast("string"), F.lit(str(seed)))).withColumn(
        "range", F.floor(F.col("key") / F.lit(float(2**52)) * F.col("ranges"))
    )
    part = ["source", "epoch", "range"]
    within = Window.partitionBy(*part).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    sums = keyed.groupBy(*part).agg(F.sum("n").alias("n"))
    ahead = sums.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("range").alias("r"),
        F.coalesce(F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    offset = F.col("epoch") * F.col("tokens") + F.col("ahead") + F.col("before")
    streams = (
        placed.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("range") == F.col("r")))
        .withColumn("offset", offset).where("offset < quota")
        .withColumn("block", F.floor(F.col("offset") / F.col("quota") * F.lit(float(max(1, math.ceil(goal / block_tokens))))).cast("long"))
    )
    shuffled = permutation_key(F.lit("block"), F.col("block").cast("string"), F.col("epoch").cast("string"), F.col("id").cast("string"), F.lit(str(seed)))
    order = Window.partitionBy("block").orderBy("shuffled", "id", "epoch")
    return streams.withColumn("shuffled", shuffled).select(
        F.col("id").alias(id_col), "source", "epoch", "block", (F.row_number().over(order) - 1).cast("long").alias("position"), F.col("n").alias("n_tokens")
    )


def word_tokens(text_col: str = "text") -> Column:
    """Words between ASCII white space, a token count that needs no vocabulary."""
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
