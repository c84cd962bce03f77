"""Agreement between two label columns, and what can be derived from pair counts.

Everything starts from pair_counts, a small mergeable table: counts of (left, right)
by group. Agreement, kappa, confusion and per-label figures are sums over it, so a hot
group costs partial counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """(by..., l, r, n) over rows with both labels."""
    both = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.groupBy(*(by or []), F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add up pair counts of finer groups."""
    return pairs.groupBy(*(by or []), "l", "r").agg(F.sum("n").alias("n"))


def kappa_of(n: Column, agree: Column, chance: Column) -> Column:
    """Cohen's kappa with one division: chance is the sum over labels of left count times right count.

    Null without pairs. If chance agreement is certain: 1 if all agree, else 0.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(n == 0, None).when(wide(n) * wide(n) == chance, F.when(agree == n, 1.0).otherwise(0.0)).otherwise(
        (wide(n) * wide(agree) - chance).cast("double") / (wide(n) * wide(n) - chance).cast("double")
    )


def agreement_stats(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_overlap, n_agree, exact_agreement, cohen_kappa) from pair counts."""
    keys = by or []
    sides = F.explode(F.array(
        F.struct(F.col("l").alias("label"), F.col("n").alias("ln"), F.lit(0).cast("long").alias("rn"), F.when(F.col("l") == F.col("r"), F.col("n")).otherwise(0).alias("an")),
        F.struct(F.col("r").alias("label"), F.lit(0).cast("long").alias("ln"), F.col("n").alias("rn"), F.lit(0).cast("long").alias("an")),
    ))
    labels = pairs.select(*keys, sides.alias("x")).groupBy(*keys, "x.label").agg(F.sum("x.ln").alias("ln"), F.sum("x.rn").alias("rn"), F.sum("x.an").alias("an"))
    product = F.sum(F.col("ln").cast("decimal(19,0)") * F.col("rn").cast("decimal(19,0)"))
    sums = labels.groupBy(*keys).agg(F.coalesce(F.sum("ln"), F.lit(0)).alias("n_overlap"), F.coalesce(F.sum("an"), F.lit(0)).alias("n_agree"), product.alias("__chance"))
    n, a = F.col("n_overlap"), F.col("n_agree")
    return sums.select(*keys, "n_overlap", "n_agree", F.try_divide(a.cast("double"), n.cast("double")).alias("exact_agreement"), kappa_of(n, a, F.col("__chance")).alias("cohen_kappa"))


def confusion_matrix(df: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    return pair_counts(df, left, right, by)


def label_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of each label, r taken as predicted and l as true."""
    keys = by or []
    sides = F.explode(F.array(
        F.struct(F.col("l").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"), F.when(F.col("l") == F.col("r"), F.col("n")).otherwise(0).alias("hit_n")),
        F.struct(F.col("r").alias("label"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("hit_n")),
    ))
    sums = pairs.select(*keys, sides.alias("x")).groupBy(*keys, "x.label").agg(F.sum("x.hit_n").alias("tp"), F.sum("x.pred_n").alias("predicted"), F.sum("x.true_n").alias("actual"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return sums.select(
        *keys, "label", "tp", "predicted", "actual",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("actual")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"),
    )


def siding(model: Column, first: Column, second: Column, aside: tuple[str, ...] = ("Uncoded", "Excluded")) -> Column:
    """With whom a model sides where two coders disagree (null elsewhere)."""
    open_ = first.isNotNull() & second.isNotNull() & (first != second) & model.isNotNull()
    return F.when(open_, F.when(model == first, "sides_with_1").when(model == second, "sides_with_2").when(model.isin(*aside), "uncoded_or_excluded").otherwise("neither"))


def error_bucket(human: Column, model: Column, buckets: dict[str, tuple[str, str]]) -> Column:
    """The named bucket of an unordered pair of different labels; `other` if it has no name."""
    out = F.lit("other")
    for name, (a, b) in buckets.items():
        out = F.when(((human == a) & (model == b)) | ((human == b) & (model == a)), name).otherwise(out)
    return F.when(human.isNotNull() & model.isNotNull() & (human != model), out)


def run_delta(first: DataFrame, second: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of two runs side by side, and their differences."""
    a = first.select(*keys, *[F.col(m).alias(f"{m}_1") for m in metrics])
    b = second.select(*keys, *[F.col(m).alias(f"{m}_2") for m in metrics])
    return a.join(b, keys, "full").select(*keys, *[c for m in metrics for c in (F.col(f"{m}_1"), F.col(f"{m}_2"), (F.col(f"{m}_2") - F.col(f"{m}_1")).alias(f"{m}_delta"))])


def unpivot_flags(df: DataFrame, keep: list[str], flags: dict[str, tuple[str, str]], values: tuple[str, ...] = ("Yes", "No")) -> DataFrame:
    """(keep..., flag, left, right) with only the values of the contract; others become null."""
    inside = lambda c: F.when(F.col(c).isin(*values), F.col(c))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), inside(a).alias("left"), inside(b).alias("right")) for k, (a, b) in flags.items()]))
    return df.select(*keep, rows.alias("x")).select(*keep, "x.flag", "x.left", "x.right")


def sorted_counts(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """(by..., name): counts of the non-null values of key as a map in order of value."""
    n = df.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def recoded(label: Column, group: tuple[str, ...], inside: str, outside: str) -> Column:
    """Labels of a group under one name, all others under another; null stays null."""
    return F.when(label.isNotNull(), F.when(label.isin(*group), inside).otherwise(outside))


def binary_agreement(df: DataFrame, left: str, right: str, group: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Agreement on whether a label is of a group."""
    yes_no = lambda c: recoded(F.col(c), group, "in", "out")
    rows = df.select(*(by or []), yes_no(left).alias("__left"), yes_no(right).alias("__right"))
    return agreement_stats(pair_counts(rows, "__left", "__right", by), by)


def agreement_where_agreed(df: DataFrame, first: str, second: str, model: str, by: list[str] | None = None) -> DataFrame:
    """A model's agreement with the label on which two coders agree."""
    return agreement_stats(pair_counts(df.filter(F.col(first) == F.col(second)), first, model, by), by)


def with_and_without(df: DataFrame, left: str, right: str, flag: Column, names: tuple[str, str], name: str = "rows_used") -> DataFrame:
    """Agreement over all rows and over those without the flag, in one pass."""
    used = F.explode(F.when(F.coalesce(flag, F.lit(False)), F.array(F.lit(names[0]))).otherwise(F.array(*[F.lit(n) for n in names]))).alias(name)
    return agreement_stats(pair_counts(df.select(used, left, right), left, right, [name]), [name])


def gap_to_humans(df: DataFrame, first: str, second: str, model: str, by: list[str]) -> DataFrame:
    """(by..., human_kappa, model_kappa, gap): how far a model's kappa with the first coder is from the second coder's."""
    human, own = (agreement_stats(pair_counts(df, first, c, by), by).select(*by, F.col("cohen_kappa").alias(n)) for c, n in ((second, "human_kappa"), (model, "model_kappa")))
    return human.join(own, by).withColumn("gap", F.col("model_kappa") - F.col("human_kappa"))


def label_set(df: DataFrame, labels: list[str], by: list[str], name: str = "label") -> DataFrame:
    """The different labels of several columns together."""
    return df.select(*by, F.explode(F.array(*labels)).alias(name)).filter(F.col(name).isNotNull()).distinct()
