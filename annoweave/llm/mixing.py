"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is the size that its target weight asks for, over
the size it has. Each document draws its count by inverting the Poisson distribution
of that mean at a uniform number hashed from (seed, doc_id), is exploded by its count
and dealt out by a hash of (seed, doc_id, replica): the same rows on every run and
every cluster. DataFrame expressions only. A hot source needs no care: its size is a
partial sum per task, and its rows are never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, text_of

SEED = 2024
#: Without explicit weights a source gets a share in proportion to size ** ALPHA.
ALPHA = 0.5
#: More sources than this are joined by key and not broadcast.
BROADCAST_SOURCES = 10_000
#: Means above this are drawn as sums of several draws, since exp(-mean) would vanish.
DRAW = 64.0


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the colon-joined parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the tail is below double precision."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"])


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0) -> DataFrame:
    """(source, rate, draws, cdf) for each source; sizes are characters of text.

    The result has budget times the corpus's characters in expectation. A source
    without characters keeps rate 1. With explicit weights (any positive scale), a
    source that isn't named gets weight 0; None names the null source.
    """
    # a row a source, stored: everything below reads these and not the texts again
    sizes = cut(docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.length(text_of())).cast("double").alias("size")))
    if weights is None:
        want = F.pow("size", F.lit(alpha))
    else:
        named = [F.lit(x) for k, w in weights.items() if k is not None for x in (k, float(w))]
        known = F.create_map(*named)[F.col("mix_source")] if named else F.lit(None).cast("double")
        want = F.when(F.col("mix_source").isNull(), float(weights.get(None, 0.0))).otherwise(F.coalesce(known, F.lit(0.0)))
    all_of = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, want))).first()
    total, wanted = all_of[0] or 0.0, all_of[1] or 1.0
    rate = F.when(F.col("size") > 0, want / F.lit(wanted) * F.lit(budget * total) / F.col("size")).otherwise(1.0)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW)).cast("int")
    return sizes.select("mix_source", rate.alias("rate")).withColumn("draws", draws).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: int = SEED, number: str | None = None) -> DataFrame:
    """Each row as often as its draw says, globally shuffled.

    Null sources form a source of their own. Rows of one doc_id share their draw; of
    the rows with a null doc_id, those of one text do. Null text has no characters. Rows
    are dealt out by id, text and replica, so neither a hot null id nor a hot source
    meets in one task. An empty table gives no rows. All columns of docs come back
    unchanged, whatever their names; with `number`, a column of that name is added that
    numbers a row's replicas from 1.
    """
    names = docs.columns
    if number in names:
        raise ValueError(f"documents have a column {number} already")
    rates = repetition_rates(docs, weights, alpha, budget)
    rates = rates.select("mix_source", *[F.col(c).alias(f"__aw_{c}") for c in ("draws", "cdf")]).withColumnRenamed("mix_source", "__aw_source")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_of())))
    draw = lambda j: F.size(F.filter("__aw_cdf", lambda c: c < hashed_uniform(F.lit(str(seed)), F.col("__aw_key"), j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__aw_draws")), F.lit(0), lambda acc, j: acc + draw(j))
    one = F.size(F.filter("__aw_cdf", lambda c: c < F.col("__aw_u")))
    drawn = (
        docs.join(rates, docs["source"].eqNullSafe(F.col("__aw_source")))
        .withColumn("__aw_key", key)
        .withColumn("__aw_u", hashed_uniform(F.lit(str(seed)), F.col("__aw_key"), F.lit("1")))
        .withColumn("__aw_n", F.when(F.col("__aw_draws") == 1, one).otherwise(count))
        .filter("__aw_n > 0")
    )
    copies = drawn.select(*names, "__aw_key", F.explode(F.sequence(F.lit(1), F.col("__aw_n"))).alias("__aw_replica"))
    placed = copies.withColumn("__aw_place", F.xxhash64(F.lit(seed), "__aw_key", text_of(), "__aw_replica"))
    dealt = placed.repartition("__aw_place").sortWithinPartitions("__aw_place")
    return dealt.select(*names, *([F.col("__aw_replica").alias(number)] if number else []))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """The replicated, shuffled rows with the columns of docs only."""
    return replicate(docs, weights, alpha, budget, seed)


ORACLE_SQL = f"""
WITH s AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
r AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size, {ALPHA}) / (SELECT sum(pow(size, {ALPHA})) FROM s WHERE size > 0)
    * (SELECT sum(size) FROM s) / size ELSE 1.0 END AS rate FROM s),
k AS (SELECT unnest(range(0, 200)) AS k),
c AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, k),
u AS (
  SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':1'), 1, 13))::BIGINT + 0.5)
    / {float(1 << 52)} AS u FROM documents),
n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(c.k)::BIGINT AS n
  FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS replica FROM n
"""
