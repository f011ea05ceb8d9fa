"""Checks against fooling oneself, and the ledger of trials."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, correlation
from .metrics import excess_kurtosis, jarque_bera_p, skewness


def base_rate(events: DataFrame, event: str, fires: str) -> DataFrame:
    """(base_rate, tpr, fpr, precision, lift) of an alarm ``fires`` for ``event``, both boolean columns, by Bayes' rule."""
    rates = events.agg(
        F.avg(F.col(event).cast("double")).alias("base_rate"), F.avg(F.when(F.col(event), F.col(fires).cast("double"))).alias("tpr"),
        F.avg(F.when(~F.col(event), F.col(fires).cast("double"))).alias("fpr"),
    )
    hits = F.col("tpr") * F.col("base_rate")
    precision = F.try_divide(hits, hits + F.col("fpr") * (1 - F.col("base_rate")))
    return rates.withColumn("precision", precision).withColumn("lift", F.try_divide("precision", "base_rate"))


def bayes_precision(tpr: float, fpr: float, base: float) -> dict:
    hits = tpr * base
    precision = hits / (hits + fpr * (1 - base)) if hits + fpr * (1 - base) > 0 else math.nan
    return {"precision": precision, "lift": precision / base if base else math.nan}


def simpson(rows: DataFrame, group: str, treated: str, outcome: str) -> DataFrame:
    """(pooled, n_groups, signs_agree, reversed): treatment effect pooled and within groups, from one rollup."""
    means = rows.rollup(group).agg(
        (F.avg(F.when(F.col(treated), F.col(outcome))) - F.avg(F.when(~F.col(treated), F.col(outcome)))).alias("effect"), F.grouping_id().alias("level")
    )
    pooled, within = F.max(F.when(F.col("level") == 1, F.col("effect"))), F.when(F.col("level") == 0, F.signum("effect"))
    out = means.agg(pooled.alias("pooled"), F.count(within).alias("n_groups"), F.min(within).alias("lo"), F.max(within).alias("hi"))
    agree = (F.col("lo") == F.col("hi")) & (F.col("lo") != 0)
    return out.select("pooled", "n_groups", F.coalesce(agree, F.lit(False)).alias("signs_agree"), F.coalesce(agree & (F.signum("pooled") != F.col("lo")), F.lit(False)).alias("reversed"))


def lookahead(panel: DataFrame, signal: str = "score", ret: str = "ret", margin: float = 0.05, least: float = 0.1) -> DataFrame:
    """(now, next, suspicious): a signal that knows the same bar's return better than the next one's."""
    both = panel.select(F.col(signal).alias("s"), F.col(ret).alias("r0"), F.lead(ret, 1).over(by_symbol()).alias("r1"))
    out = both.where("s is not null and r0 is not null").agg(
        correlation(F.col("s"), F.col("r0")).alias("now"),
        correlation(F.when(F.col("r1").isNotNull(), F.col("s")), F.when(F.col("r1").isNotNull(), F.col("r1"))).alias("next"),
    )
    flagged = (F.abs("now") > F.abs("next") + margin) & (F.abs("now") > least)
    return out.withColumn("suspicious", F.coalesce(flagged, F.lit(False)))


def fat_tails(returns: DataFrame, column: str = "net") -> DataFrame:
    """(n, skew, kurtosis, jarque_bera_p, verdict)."""
    r = F.col(column)
    out = returns.agg(F.count(r).alias("n"), skewness(r).alias("skew"), excess_kurtosis(r).alias("kurtosis"), jarque_bera_p(r).alias("jarque_bera_p"))
    verdict = F.when(F.col("n") < 8, "insufficient data").when((F.col("jarque_bera_p") < 0.05) & (F.col("kurtosis") > 1), "fat tails").when(F.col("jarque_bera_p") < 0.05, "not normal").otherwise("near normal")
    return out.withColumn("verdict", verdict)


# Trials.

#: What makes a request a trial of its own (fixed values); the declared number of trials does not.
TRIAL_KEYS = ("provider", "factor", "lookback", "skip", "cost_bps", "gross", "periods", "seed", "start", "symbols")
NUMERIC = ("lookback", "skip", "cost_bps", "gross", "periods", "seed")


def canonical_text(value) -> str | None:
    return None if value is None else str(value).strip()


def canonical_number(value):
    """126, 126.0 and "126" alike; NaN as "nan"; what is no number as trimmed text."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return canonical_text(value)
    if math.isnan(x):
        return "nan"
    return int(x) if math.isfinite(x) and x == int(x) else x


def canonical_symbols(symbols) -> list[str]:
    """Trimmed, upper-cased, sorted; blanks go, repeats stay. A lone value is one symbol."""
    given = symbols if isinstance(symbols, Iterable) and not isinstance(symbols, str) else [symbols]
    return sorted(s for s in (str(x).strip().upper() for x in given if x is not None) if s)


def canonical_request(request: dict) -> dict:
    out = {}
    for key in TRIAL_KEYS:
        value = request.get(key)
        out[key] = canonical_symbols(value) if key == "symbols" else canonical_number(value) if key in NUMERIC else canonical_text(value)
    return out


def fingerprint(request: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the canonical request."""
    return hashlib.sha256(json.dumps(canonical_request(request), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprint_columns(requests: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """``requests`` with ``fingerprint`` of its columns: a canonical JSON text, sorted by key, hashed by Spark."""
    def canonical(name: str):
        c = F.col(name)
        if name in NUMERIC:
            x = c.cast("double")
            whole = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
            return F.coalesce(whole, F.lit("null"))
        if name == "symbols":
            kept = F.filter(F.transform(F.split(c, ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")
            return F.concat(F.lit('["'), F.array_join(F.array_sort(kept), '","'), F.lit('"]'))
        return F.coalesce(F.concat(F.lit('"'), F.trim(c.cast("string")), F.lit('"')), F.lit("null"))

    body = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), canonical(n)) for n in sorted(columns)])
    return requests.withColumn("fingerprint", F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16))


def ledger(trials: DataFrame, declared: int = 1) -> DataFrame:
    """(workspace, n_runs, n_distinct, effective): distinct fingerprints are the floor of the declared number."""
    out = trials.groupBy("workspace").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("fingerprint").alias("n_distinct"))
    return out.withColumn("effective", F.greatest(F.col("n_distinct"), F.lit(declared).cast("long")))


class TrialLedger:
    """Trials of one session; resets are remembered."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.resets: list[dict] = []

    def record(self, request: dict) -> str:
        key = fingerprint(request)
        self.counts[key] = self.counts.get(key, 0) + 1
        return key

    @property
    def distinct(self) -> int:
        return len(self.counts)

    def effective(self, declared: int = 1) -> int:
        return max(int(declared), self.distinct)

    def reset(self, reason: str = "") -> None:
        self.resets.append({"reason": reason, "distinct": self.distinct, "runs": sum(self.counts.values())})
        self.counts = {}


def ledger_epochs(trials: DataFrame, resets: DataFrame, floor: int = 1, time: str = "ts", order: str = "id", width: str = "1 day") -> DataFrame:
    """(workspace, epoch, n_runs, n_distinct, effective): trials since each reset of their workspace, as events in time order.

    ``trials`` has workspace, fingerprint, the time and ``order``; ``resets`` workspace, the time and ``order``, by which an epoch is
    named (null before the first reset). A reset counts before trials of its time. A busy workspace's history is split by time.
    """
    from .asof import epochs

    placed = epochs(trials.select("workspace", "fingerprint", time), resets.select("workspace", time, order), ["workspace"], time, order, width)
    counted = placed.groupBy("workspace", "epoch").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("fingerprint").alias("n_distinct"))
    return counted.withColumn("effective", F.greatest("n_distinct", F.lit(floor).cast("long")))
