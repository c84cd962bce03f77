"""Ages of children: from transcript header rows to weighted histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.functions.text import age_in_months, clean, pipe_field

BINS = 6


def child_ages(headers: DataFrame, half: str = "half", ordinal: str = "ord") -> DataFrame:
    """(transcript_id, child_age_months, child_age_raw) from `@ID:` rows of Transcript, Speaker, Utterance.

    A row counts if it has eight pipe-delimited fields, names the child by participant
    or role and has an age. The last such row of a transcript wins, later halves last.
    """
    utterance, transcript = clean(F.col("Utterance")), clean(F.col("Transcript"))
    raw = pipe_field(utterance, 3)
    is_child = (pipe_field(utterance, 2) == "CHI") | (pipe_field(utterance, 7) == "Target_Child")
    rows = headers.filter((clean(F.col("Speaker")) == "@ID:") & transcript.isNotNull() & utterance.isNotNull() & is_child)
    rows = rows.select(transcript.alias("transcript_id"), raw.alias("child_age_raw"), age_in_months(raw).alias("child_age_months"), half, ordinal).filter("child_age_months IS NOT NULL")
    last = F.max_by(F.struct("child_age_months", "child_age_raw"), F.struct(half, ordinal)).alias("x")
    return rows.groupBy("transcript_id").agg(last).select("transcript_id", "x.child_age_months", "x.child_age_raw")


def bin_edges(low: float | None, high: float | None, bins: int = BINS) -> list[float]:
    """Equal-width edges between whole months around the extremes; [0, 1] without ages."""
    from math import ceil, floor

    if low is None or high is None:
        return [0.0, 1.0]
    a, b = float(floor(low)), float(ceil(high))
    return [a + i * ((b - a) / bins) for i in range(bins)] + [b]


def bin_of(value: Column, edges: list[float]) -> Column:
    """Bin number from 0; closed on the left, the last bin on both sides; null outside.

    If all edges are equal, the one value falls into the last bin.
    """
    last = len(edges) - 2
    n = reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges[:-1]]) - 1
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(n, F.lit(last)))


def age_histogram(rows: DataFrame, age: str, weight: Column | None = None, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(by..., bin, low, high, weight, share) over the bins that have rows."""
    ends = rows.agg(F.min(age), F.max(age)).first()
    edges = bin_edges(ends[0], ends[1], bins)
    at = F.array(*[F.lit(e) for e in edges])
    keys = by or []
    w = F.sum(F.lit(1) if weight is None else weight)
    found = rows.select(*keys, bin_of(F.col(age), edges).alias("bin"), *( [] if weight is None else [weight.alias("__w")])).filter("bin IS NOT NULL")
    w = F.count(F.lit(1)) if weight is None else F.sum("__w")
    counts = found.groupBy(*keys, "bin").agg(w.alias("weight"))
    totals = counts.groupBy(*keys).agg(F.sum("weight").alias("__total"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))  # totals is one row
    return joined.select(*keys, "bin", F.get(at, F.col("bin")).alias("low"), F.get(at, F.col("bin") + 1).alias("high"), "weight", F.try_divide(F.col("weight").cast("double"), F.col("__total").cast("double")).alias("share"))


def weighted_mean(value: Column, weight: Column) -> Column:
    known = value.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)).cast("double"))
