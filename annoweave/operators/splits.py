"""Balanced splits by transcript: tables, objective, search, summaries and checks."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annoweave.functions.coding import codes, coding_status, overlap_pair
from annoweave.operators.ages import bin_edges, bin_of, weighted_mean
from annoweave.operators.agreement import agreement_stats, pair_counts, sorted_counts
from annoweave.schemas import NEITHER_SPLIT, SPLIT_ITERATIONS, SPLIT_SEED, SPLIT_TARGETS
from annoweave.session import cut

# Weights of the objective's terms and its penalties.
W_SHARE, W_BOTH, W_ONE, W_AGREE, W_KAPPA, W_AGE, W_HIST = 35.0, 18.0, 18.0, 16.0, 10.0, 0.035, 8.0
NO_OVERLAP, NO_AGES = 5.0, 10.0


def transcript_table(records: DataFrame, unit: str = "transcript_id", first: str = "coded_by_1", second: str = "coded_by_2", left: str = "bloom_1", right: str = "bloom_2", age: str = "child_age_months", order: Column | None = None) -> DataFrame:
    """One row a transcript: rows, age, coding status, overlap and agreement counts; with `order`, a number of each record, first_seen."""
    seen = [] if order is None else [F.min(order).alias("first_seen")]
    status = coding_status(F.col(first), F.col(second))
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    return records.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(age).alias("age_months"),  # one value a transcript
        F.count_if(status == "both_coders").alias("both_coders"),
        F.count_if(status == "one_coder").alias("one_coder"),
        F.count_if(both).alias("n_overlap_bloom"),
        F.count_if(both & (F.col(left) == F.col(right))).alias("n_bloom_agree"),
        *seen,
    )


def label_counts(records: DataFrame, unit: str = "transcript_id", left: str = "bloom_1", right: str = "bloom_2") -> DataFrame:
    """(unit, l, r, n): the pair counters of each transcript."""
    return pair_counts(records, left, right, [unit])


def objective_terms(table: DataFrame, pairs: DataFrame, assignment: DataFrame, targets: dict[str, float] | None = None, unit: str = "transcript_id") -> DataFrame:
    """One row a target split with its terms of the objective; `score` is their sum.

    A split without rows scores infinity. assignment is (unit, split).
    """
    targets = targets or SPLIT_TARGETS
    spark = table.sparkSession
    ends = table.agg(F.min("age_months"), F.max("age_months")).first()
    if ends[0] is None:
        raise ValueError("no transcript has an age")
    edges = bin_edges(*ends)
    # each row counts for its split and for the whole
    owner = F.explode(F.array("split", F.lit("*"))).alias("g")
    rows = table.join(assignment, unit).select("*", owner)
    age, n = F.col("age_months"), F.col("n_rows")
    bins = [F.sum(F.when(bin_of(age, edges) == i, n).otherwise(0)).alias(f"h{i}") for i in range(len(edges) - 1)]
    sums = rows.groupBy("g").agg(F.sum(n).alias("n"), F.sum("both_coders").alias("both"), F.sum("one_coder").alias("one"), weighted_mean(age, n).alias("mean_age"), *bins)
    irr = agreement_stats(pairs.join(assignment, unit).select("l", "r", "n", owner), ["g"])
    stats = sums.join(irr, "g", "left")
    names = [c for c in stats.columns if c != "g"]
    want = spark.createDataFrame(list(targets.items()), "split string, target double")
    whole = F.broadcast(stats.filter("g = '*'").select(*[F.col(c).alias(f"all_{c}") for c in names]))  # one row
    t = want.join(stats.filter("g <> '*'"), F.col("split") == F.col("g"), "left").crossJoin(whole)
    sq = lambda c: c * c
    rate = lambda c, d: F.try_divide(F.col(c).cast("double"), F.col(d).cast("double"))
    known = lambda p: [F.col(f"{p}h{i}").cast("double") for i in range(len(edges) - 1)]
    total = lambda p: sum(known(p)[1:], known(p)[0])
    hist = sum((sq(F.coalesce(F.try_divide(a, total("")), F.lit(0.0)) - F.coalesce(F.try_divide(b, total("all_")), F.lit(0.0))) for a, b in zip(known(""), known("all_"), strict=True)), F.lit(0.0))
    overlap = F.coalesce(F.col("n_overlap"), F.lit(0))
    terms = {
        "share_term": W_SHARE * sq(rate("n", "all_n") - F.col("target")),
        "both_term": W_BOTH * sq(rate("both", "n") - rate("all_both", "all_n")),
        "one_term": W_ONE * sq(rate("one", "n") - rate("all_one", "all_n")),
        "agree_term": F.when((overlap > 0) & (F.coalesce(F.col("all_n_overlap"), F.lit(0)) > 0), W_AGREE * sq(F.col("exact_agreement") - F.col("all_exact_agreement"))).otherwise(NO_OVERLAP),
        "kappa_term": F.when((overlap > 0) & F.col("all_cohen_kappa").isNotNull(), W_KAPPA * sq(F.col("cohen_kappa") - F.col("all_cohen_kappa"))).otherwise(0.0),
        "age_term": F.when(F.col("mean_age").isNull(), NO_AGES).otherwise(W_AGE * sq(F.col("mean_age") - F.col("all_mean_age")) + W_HIST * hist),
    }
    cols = [F.when(F.coalesce("n", F.lit(0)) == 0, float("inf")).otherwise(c).alias(k) for k, c in terms.items()]
    out = t.select("split", F.coalesce("n", F.lit(0)).alias("n_rows"), *cols)
    return out.withColumn("score", sum((F.col(k) for k in list(terms)[1:]), F.col("share_term")))


def split_objective(table: DataFrame, pairs: DataFrame, assignment: DataFrame, targets: dict[str, float] | None = None, unit: str = "transcript_id") -> DataFrame:
    return objective_terms(table, pairs, assignment, targets, unit).agg(F.sum("score").alias("score"))


class Part:
    """The figures of some transcripts, in order, from which the sums of any assignment of them are made.

    A transcript keeps five numbers and those label pairs that it has: `owner` is a pair's
    place among the transcripts, `cell` the number of its two labels.
    """

    def __init__(self, n: np.ndarray, both: np.ndarray, one: np.ndarray, ages: np.ndarray, owner: np.ndarray, cell: np.ndarray, pairs: np.ndarray, edges: list[float], labels: int) -> None:
        known = ~np.isnan(ages)
        self.bins, self.cells = len(edges) - 1, labels * labels
        # rows without an age fall into a bin of their own
        self.bin = np.where(known, np.clip(np.searchsorted(edges, ages, "right") - 1, 0, self.bins - 1), self.bins)
        self.owner, self.cell, self.pairs = owner, cell, pairs
        aged = np.where(known, n, 0.0)
        self.plain = [n, both, one, aged, aged * np.where(known, ages, 0)]

    def sums(self, split: np.ndarray, splits: int) -> np.ndarray:
        """One row a split: sums, weighted age histogram, label pairs."""
        split = split.astype(np.int64)
        bins = self.bins + 1
        plain = [np.bincount(split, x, splits)[:, None] for x in self.plain]
        hist = np.bincount(split * bins + self.bin, self.plain[0], splits * bins).reshape(splits, bins)[:, :-1]
        counts = np.bincount(split[self.owner] * self.cells + self.cell, self.pairs, splits * self.cells).reshape(splits, self.cells)
        return np.hstack([*plain, hist, counts])


class Score:
    """The objective of assignments, from their sums and those of all transcripts."""

    def __init__(self, targets: dict[str, float], bins: int, labels: int, whole: np.ndarray) -> None:
        self.targets, self.bins, self.k = np.array(list(targets.values())), bins, labels
        self.whole = {k: v[..., 0] for k, v in self._figures(whole.reshape(1, -1)).items() if k != "hist"} | {"hist": self._figures(whole.reshape(1, -1))["hist"][0]}

    def _figures(self, sums: np.ndarray) -> dict[str, np.ndarray]:
        n, both, one, aged, months = np.moveaxis(sums[..., :5], -1, 0)
        hist, c = sums[..., 5 : 5 + self.bins], sums[..., 5 + self.bins :].reshape(*sums.shape[:-1], self.k, self.k)
        pairs, agree = c.sum((-1, -2)), np.trace(c, axis1=-2, axis2=-1)
        chance = (c.sum(-1) * c.sum(-2)).sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sure = pairs * pairs == chance
            kappa = np.where(pairs == 0, np.nan, np.where(sure, (agree == pairs).astype(float), (pairs * agree - chance) / (pairs * pairs - chance)))
            return {"n": n, "both": both / n, "one": one / n, "agree": agree / pairs, "kappa": kappa, "pairs": pairs, "aged": aged, "age": months / aged, "hist": np.nan_to_num(hist / hist.sum(-1, keepdims=True))}

    def of(self, sums: np.ndarray) -> np.ndarray:
        """The score of each assignment; sums has their splits' rows as its last two dimensions."""
        f, g = self._figures(sums), self.whole
        compared = (f["pairs"] > 0) & (g["pairs"] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = W_SHARE * (f["n"] / g["n"] - self.targets) ** 2 + W_BOTH * (f["both"] - g["both"]) ** 2 + W_ONE * (f["one"] - g["one"]) ** 2
            out += np.where(compared, W_AGREE * (f["agree"] - g["agree"]) ** 2, NO_OVERLAP)
            out += np.where(compared, W_KAPPA * (f["kappa"] - g["kappa"]) ** 2, 0.0)
            out += np.where(f["aged"] > 0, W_AGE * (f["age"] - g["age"]) ** 2 + W_HIST * ((f["hist"] - g["hist"]) ** 2).sum(-1), NO_AGES)
        return np.where((f["n"] == 0).any(-1), np.inf, out.sum(-1))


def greedy_assignment(rows: list[int], goals: list[float], rng: random.Random) -> list[int]:
    """Transcripts in random order, each to the split with the smallest filled share.

    Ties go to the smaller split, then to the first in an order shuffled each time.
    """
    order, names = list(range(len(rows))), list(range(len(goals)))
    rng.shuffle(order)
    filled, out = [0] * len(goals), [0] * len(rows)
    for t in order:
        tie = names[:]
        rng.shuffle(tie)
        pick = min(tie, key=lambda s: (filled[s] / goals[s], filled[s]))
        out[t] = pick
        filled[pick] += rows[t]
    return out


#: Transcripts of a part, trials of a block (and between two stored states of the generator), matrices that are added up at a time.
PART, BLOCK, FAN = 8192, 500, 32
#: Bytes of assignments that a task holds, about.
HELD = 16 << 20

_FIGURES = ["n_rows", "both_coders", "one_coder", "age_months"]


def numbered_transcripts(table: DataFrame, unit: str) -> DataFrame:
    """table with __t, numbers from 0 in the order in which transcripts were first seen, else by name; stored."""
    order = "first_seen" if "first_seen" in table.columns else unit
    tagged = cut(table.orderBy(order, unit).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return cut(tagged.withColumn("__part", part).join(starts, "__part").withColumn("__t", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__at"))


def packed_parts(numbered: DataFrame, pairs: DataFrame, edges: list[float], labels: list[str], unit: str, part: int) -> DataFrame:
    """(part, figures): each part's transcripts, pickled."""
    at = lambda t: [F.floor(t / part).alias("part"), (t % part).alias("at")]
    rows = numbered.select(*at(F.col("__t")), *_FIGURES)
    known = pairs.join(numbered.select(unit, "__t"), unit, "left")
    t = F.coalesce("__t", F.raise_error(F.lit("label pairs of a transcript that is not in the table")).cast("long"))
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1
    cells = known.select(t.alias("__t"), (place("l") * len(labels) + place("r")).alias("cell"), "n").select(*at(F.col("__t")), "cell", "n") if labels else numbered.limit(0).select(*at(F.col("__t")), F.lit(0).alias("cell"), F.lit(0).alias("n"))

    def pack(figures: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        f = figures.sort_values("at")
        numbers = [f[c].to_numpy(float) for c in _FIGURES]
        held = Part(*numbers, own["at"].to_numpy(np.int64), own["cell"].to_numpy(np.int64), own["n"].to_numpy(float), edges, len(labels))
        return pd.DataFrame({"part": [int(f["part"].iloc[0])], "figures": [pickle.dumps(held)]})

    return cut(rows.groupBy("part").cogroup(cells.groupBy("part")).applyInPandas(pack, "part long, figures binary"))


def generator_states(spark: SparkSession, transcripts: int, splits: int, iterations: int, seed: int, block: int) -> DataFrame:
    """(block, state): a generator's state before each block of trials that it draws one after the other; one task, stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            rng, order, names = random.Random(seed), list(range(transcripts)), list(range(splits))
            for i in range(iterations):
                if i % block == 0:
                    yield pd.DataFrame({"block": [i // block], "state": [pickle.dumps(rng.getstate())]})
                rng.shuffle(order)  # as greedy_assignment draws
                for _ in range(transcripts):
                    rng.shuffle(names)

    return cut(spark.range(0, 1, 1, 1).mapInPandas(run, "block long, state binary"))


def _trials(block: int, state: bytes | None, first: int, last: int, rows: list[int], goals: list[float], seed: int) -> Iterator[np.ndarray]:
    """The assignments of the trials first..last-1 of a block; without a state each has a generator of its own."""
    rng = random.Random()
    if state is not None:
        rng.setstate(pickle.loads(state))
    for i in range(block if state is not None else first, last):
        split = greedy_assignment(rows, goals, rng if state is not None else random.Random(seed * 1_000_003 + i))
        if i >= first:
            yield np.array(split, np.uint8)


def search_splits(table: DataFrame, pairs: DataFrame, targets: dict[str, float] | None = None, iterations: int = SPLIT_ITERATIONS, seed: int = SPLIT_SEED, sequential: bool = False, unit: str = "transcript_id", part: int = PART, block: int = BLOCK) -> DataFrame:
    """(unit, split, score, iteration) of the best of many random greedy assignments; the first of equal scores wins.

    Transcripts are taken in order of first_seen, if the table has it, else by name. Trials
    run in parallel, each seeded by its number. With `sequential` they are those of one generator that draws
    them all: one task draws, keeps the generator's state before each block of trials, and
    blocks are replayed in parallel from there.

    What a trial needs of all transcripts is their rows, 8 bytes each, which the driver
    hands out. All else stays in parts of `part` transcripts: a block's assignments are cut
    into parts, each part gives a matrix of sums for the block's trials, and the matrices are
    added up, FAN at a time. The best trial is run again to write its assignment.
    """
    targets = targets or SPLIT_TARGETS
    if len(targets) > 255:
        raise ValueError("too many splits")
    spark = table.sparkSession
    numbered = numbered_transcripts(table, unit)
    ends = numbered.agg(F.count(F.lit(1)), F.min("age_months"), F.max("age_months")).first()
    if not ends[0]:
        raise ValueError("no transcripts to split")
    if ends[1] is None:
        raise ValueError("no transcript has an age")
    edges = bin_edges(ends[1], ends[2])
    labels = sorted(r[0] for r in pairs.select("l").union(pairs.select("r")).distinct().collect())  # a row a label
    parts = packed_parts(numbered, pairs.select(unit, "l", "r", "n"), edges, labels, unit, part)
    rows = numbered.select("__t", "n_rows").orderBy("__t").select("n_rows").toArrow()["n_rows"].to_numpy()  # 8 bytes a transcript
    goals = [int(rows.sum()) * t for t in targets.values()]
    shared = spark.sparkContext.broadcast(rows.astype(np.int64))
    n, splits, n_blocks = len(rows), len(targets), -(-iterations // block)
    blocks = generator_states(spark, n, splits, iterations, seed, block) if sequential else spark.range(0, n_blocks, 1, n_blocks).select(F.col("id").alias("block"), F.lit(None).cast("binary").alias("state"))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value.tolist()
        for f in frames:
            for b, state in zip(f["block"], f["state"], strict=True):
                found, held = _trials(b * block, state, b * block, min(iterations, (b + 1) * block), own, goals, seed), []
                for i, split in enumerate(found, b * block):
                    held += [(p, b, i, split[p * part : (p + 1) * part].tobytes()) for p in range(-(-n // part))]
                    if n * len(held) >= HELD * -(-n // part):
                        yield pd.DataFrame(held, columns=["part", "block", "trial", "split"])
                        held = []
                yield pd.DataFrame(held, columns=["part", "block", "trial", "split"])

    def partial(trials: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = pickle.loads(held["figures"].iloc[0])
        sums = np.stack([own.sums(np.frombuffer(x, np.uint8), splits) for x in trials.sort_values("trial")["split"]])
        return pd.DataFrame({"part": [int(held["part"].iloc[0])], "block": [int(held["block"].iloc[0])], "sums": [sums.tobytes()]})

    def add(some: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in some.sort_values("part")["sums"])
        return pd.DataFrame({"part": [int(some["part"].iloc[0]) // FAN], "block": [int(some["block"].iloc[0])], "sums": [total.tobytes()]})

    tried = blocks.repartition(min(n_blocks, 4 * spark.sparkContext.defaultParallelism), "block").mapInPandas(assign, "part long, block long, trial long, split binary")
    replicated = parts.select("part", "figures", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    sums = tried.groupBy("part", "block").cogroup(replicated.groupBy("part", "block")).applyInPandas(partial, "part long, block long, sums binary")
    many = -(-n // part)
    while many > 1:
        sums = sums.groupBy("block", F.floor(F.col("part") / FAN)).applyInPandas(add, "part long, block long, sums binary")
        many = -(-many // FAN)
    sums = cut(sums)
    width = 5 + len(edges) - 1 + len(labels) ** 2
    one = sums.limit(1).select("sums").first()  # any trial's splits add up to the whole
    whole = np.frombuffer(one["sums"]).reshape(-1, splits, width)[0].sum(0)
    score = Score(targets, len(edges) - 1, len(labels), whole)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, x in zip(f["block"], f["sums"], strict=True):
                found = score.of(np.frombuffer(x).reshape(-1, splits, width))
                yield pd.DataFrame({"score": [found.min()], "iteration": [b * block + int(found.argmin())]})

    best = sums.select("block", "sums").mapInPandas(judge, "score double, iteration long").orderBy("score", "iteration").first()
    if best is None or best["score"] == float("inf"):
        raise ValueError("no assignment fills every split")
    trial = best["iteration"]

    def winner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value.tolist()
        for f in frames:
            for b, state in zip(f["block"], f["state"], strict=True):
                for split in _trials(b * block, state, trial, trial + 1, own, goals, seed):
                    for at in range(0, n, part):
                        some = split[at : at + part]
                        yield pd.DataFrame({"__t": np.arange(at, at + len(some)), "number": some.astype(np.int32)})

    chosen = blocks.filter(F.col("block") == trial // block).mapInPandas(winner, "__t long, number int")
    named = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("number") + 1).alias("split")
    return numbered.select(unit, "__t").join(chosen, "__t").select(unit, named, F.lit(best["score"]).alias("score"), F.lit(trial).cast("long").alias("iteration"))


def apply_splits(records: DataFrame, assignment: DataFrame, first: str = "coded_by_1", second: str = "coded_by_2", unit: str = "transcript_id") -> DataFrame:
    """Give coded records their transcript's split and all others the split of uncoded rows."""
    coded = codes(F.col(first)) | codes(F.col(second))
    joined = records.join(assignment.select(F.col(unit).alias("__unit"), F.col("split").alias("__split")), F.col(unit) == F.col("__unit"), "left")
    return joined.withColumn("split", F.when(coded, F.col("__split")).otherwise(NEITHER_SPLIT)).drop("__unit", "__split")


def split_summary(records: DataFrame, first: str = "coded_by_1", second: str = "coded_by_2", left: str = "bloom_1", right: str = "bloom_2", age: str = "child_age_months", unit: str = "transcript_id") -> DataFrame:
    """Size, ages, coding status, agreement and coder counts of each split."""
    a, b = F.col(first), F.col(second)
    status = coding_status(a, b)
    sizes = records.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(unit).alias("n_transcripts"),
        F.round(F.avg(age), 3).alias("mean_age_months"), F.round(F.min(age), 3).alias("min_age_months"), F.round(F.max(age), 3).alias("max_age_months"),
        *[F.count_if(status == s).alias(s) for s in ("both_coders", "one_coder", "neither")],
    )
    irr = agreement_stats(pair_counts(records, left, right, ["split"]), ["split"])
    irr = irr.select("split", F.col("n_overlap").alias("n_overlap_bloom"), F.round("exact_agreement", 4).alias("bloom_exact_agreement"), F.round("cohen_kappa", 4).alias("bloom_cohen_kappa"))
    coders = records.select("split", F.explode(F.array(a, b)).alias("coder")).filter(codes(F.col("coder")))
    pairs = records.select("split", overlap_pair(a, b).alias("pair"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = sizes.join(irr, "split", "left").join(sorted_counts(coders, "coder", ["split"], "coder_counts"), "split", "left").join(sorted_counts(pairs, "pair", ["split"], "overlap_counts"), "split", "left")
    return out.withColumns({"n_overlap_bloom": F.coalesce("n_overlap_bloom", F.lit(0)), "coder_counts": F.coalesce("coder_counts", empty), "overlap_counts": F.coalesce("overlap_counts", empty)})


def split_leaks(records: DataFrame, unit: str = "transcript_id") -> DataFrame:
    """Transcripts in more than one split, that of uncoded rows aside."""
    return records.filter(F.col("split") != NEITHER_SPLIT).groupBy(unit).agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def class_coverage(records: DataFrame, label: str, by: str = "split") -> DataFrame:
    return records.filter(F.col(label).isNotNull()).groupBy(by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def agreement_points(records: DataFrame, left: str = "bloom_1", right: str = "bloom_2", unit: str = "transcript_id") -> DataFrame:
    """(split, transcript, n_overlap, agreement) of the transcripts with overlap."""
    points = agreement_stats(pair_counts(records, left, right, ["split", unit]), ["split", unit])
    return points.select("split", unit, "n_overlap", "exact_agreement").filter("n_overlap > 0")


def transcript_manifest(records: DataFrame, unit: str = "transcript_id", **columns: str) -> DataFrame:
    """One row a coded transcript, in order: its figures, label counters and split."""
    coded = records.filter(F.col("split") != NEITHER_SPLIT)
    out = transcript_table(coded, unit, **columns).join(coded.select(unit, "split").distinct(), unit)
    both = coded.filter(F.col("bloom_1").isNotNull() & F.col("bloom_2").isNotNull())
    pair = F.concat_ws(" | ", "bloom_1", "bloom_2")
    for name, key in (("bloom_1_counts", F.col("bloom_1")), ("bloom_2_counts", F.col("bloom_2")), ("bloom_pair_counts", pair)):
        out = out.join(sorted_counts(both.select(unit, key.alias("__key")), "__key", [unit], name), unit, "left")
    return out.orderBy(unit)


def references_by_split(references: DataFrame, records: DataFrame) -> DataFrame:
    """Human references of the records that have a split, with that split."""
    return references.join(records.select("record_id", "split"), "record_id")
