"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary texts, over one vocabulary. In each class

    P(w | h) = max(n(h w) - D, 0) / n(h) + B(h) P(w)             raw counts on top
    P(w)     = max(N(w) - d, 0) / N + b S(w)                     N(w): different words before w
    S(w)     = (K(w) + 1) / (K + V + 1)                          K(w): classes that know w

B and b are what the discounts D and d free, so every distribution sums to one. S is
shared by the classes, so a rare expression is smoothed through shared counts. Each word
and each pair of the sample has its count; words that it doesn't hold share one place of S.

A word in its context tells log10 P(w | h), toxic less ordinary. A text is judged by
length-normalised sums of these: over the whole text, and over windows of 1, 2 and 4 words in
their contexts, of which the mean of the most toxic 1, 3 and 8 counts, so that insults
scattered over a long text aren't lost. In windows a word tells only as far as both orders of
the models agree: the lesser of the differences in P(w | h) and in P(w). (A pair that one class
has once and the other never is no evidence by itself, but gives P(w | h) alone a difference of
several powers of ten.) A logistic curve over the ten figures is the score; it is fitted on
models that left the row's own part of the sample out.

The models learn from a bounded sample of labelled rows (MAX_DOCS a class and MAX_BYTES
in all, chosen by hash), so what is gathered and broadcast is bounded too. Texts that
are equal have one vote. In the curve's fit the sample's rows weigh by their class's
share among all labelled rows, so the bounds don't change what a score means. One pass over the
sample counts each pair by class and part; the models of any parts are sums of those
counts, made on the driver. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, id_bucket, in_small_batches, row_hash, sliced, text_of

#: Labelled rows of each class, and bytes of text in all, that are learned from at most.
MAX_DOCS = 4000
MAX_BYTES = 12 << 20
#: Words of a window, and how many of the most toxic windows are averaged.
WINDOWS, BEST = (1, 2, 4), (1, 3, 8)
FOLDS = 3
THRESHOLD = 0.7
#: Parts of the sample that are left out in turn to fit the curve.
PARTS = 3
#: Hashes that stand for a text's end and for what is before its first word.
END, START = 1, 2
_EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_"

_SCORE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def words_of(text: str) -> list[bytes]:
    """Lower-cased words with punctuation at their ends removed."""
    return [w.strip(_EDGE.encode()) for w in text.encode("utf-8", "surrogatepass").lower().split()]


def hashed(text: str) -> np.ndarray:
    """The hashes of START, a text's words and END."""
    words = words_of(text)
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return out


def discount(ones: float, twos: float, most: float = 0.95) -> float:
    return min(most, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class Models:
    """Both classes' models, kept as differences of log10 likelihoods, toxic less ordinary.

    words are the vocabulary's hashes in order; the place after the last is the unknown
    word, and as a context the start has the place after that. keys are the pairs (place
    of context, place of word) that one of the classes knows, pair their differences;
    context and word add up to that of all other pairs, and word is that in P(w).
    """

    def __init__(self, words: np.ndarray, keys: np.ndarray, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> None:
        self.words, self.keys = words, keys
        self.pair, self.context, self.word = (x.astype(np.float32) for x in (pair, context, word))

    def differences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each word in its context, and of each word by the lower order; the end is a word."""
        tokens, size = hashed(text), len(self.words)
        at = np.minimum(np.searchsorted(self.words, tokens), size - 1)
        place = np.where(self.words[at] == tokens, at, size)
        place[0] = size + 1
        h, w = place[:-1], place[1:]
        key = (h << 32) | w
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.pair[at], self.context[h] + self.word[w]).astype(float), self.word[w].astype(float)


class Counts:
    """How often each pair of hashes (h, w) occurs, by part and class: column 2 * part + class."""

    def __init__(self, h: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        self.words = np.unique(w)
        context = np.where(h == START, len(self.words) + 1, np.searchsorted(self.words, h))
        keys = (context.astype(np.int64) << 32) | np.searchsorted(self.words, w)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]

    def probabilities(self, without: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(whether a pair is known, [(own share of each pair, freed share of each context, P(w))] of ordinary and toxic) from all parts but one."""
        h, w, size = self.keys >> 32, self.keys & 0xFFFFFFFF, len(self.words)
        parts = [p for p in range(self.n.shape[1] // 2) if p != without]
        counts = [self.n[:, [2 * p + c for p in parts]].sum(1).astype(float) for c in (0, 1)]
        before = [np.bincount(w[n > 0], minlength=size + 1) for n in counts]
        classes = (before[0] > 0).astype(float) + (before[1] > 0)
        shared = (classes + 1) / (classes.sum() + (classes > 0).sum() + 1)
        found = []
        for n, own in zip(counts, before, strict=True):
            total = max(1, own.sum())
            d = discount((own == 1).sum(), (own == 2).sum())
            word = np.maximum(own - d, 0) / total + (np.minimum(own, d).sum() / total if own.any() else 1.0) * shared
            d = discount((n == 1).sum(), (n == 2).sum())
            of_h, kinds = np.bincount(h, n, size + 2), np.bincount(h[n > 0], minlength=size + 2)
            freed = np.where(of_h > 0, d * kinds / np.maximum(of_h, 1), 1.0)
            found.append((np.where(n > 0, (n - d) / np.maximum(of_h[h], 1), 0.0), freed, word))
        return (counts[0] > 0) | (counts[1] > 0), found

    def fit(self, without: int | None = None) -> Models:
        known, (ordinary, toxic) = self.probabilities(without)
        h, w = self.keys >> 32, self.keys & 0xFFFFFFFF
        of = lambda own, freed, word: own + freed[h] * word[w]
        pair = np.log10(of(*toxic) / of(*ordinary))
        return Models(self.words, self.keys[known], pair[known], np.log10(toxic[1] / ordinary[1]), np.log10(toxic[2] / ordinary[2]))


def figures(models: Models, text: str) -> list[float]:
    """Toxic less ordinary log10 likelihood a word: of the whole text, and of its most toxic windows."""
    tells, lower = models.differences(text)
    out, n = [float(tells.mean())], len(tells)
    upto = np.concatenate([[0], np.cumsum(np.minimum(tells, lower))])
    for size in WINDOWS:
        size = min(size, n)
        starts = np.arange(0, n - size + 1, max(1, size // 2))
        means = (upto[starts + size] - upto[starts]) / size
        best = np.sort(means)[: -1 - BEST[-1] : -1]
        out += [float(best[:k].mean()) for k in BEST]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, share: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with bias first) by Newton steps on a ridge-penalised likelihood.

    With share, rows weigh as if that part of them were positive.
    """
    rate = y.mean()
    vote = np.ones(len(y)) if share is None or not 0 < rate < 1 else np.where(y > 0, share / rate, (1 - share) / (1 - rate))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, pen = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (vote * p * (1 - p))[:, None]) + pen, z.T @ (vote * (y - p)) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    """What scoring needs: the models and the curve; or one constant score."""

    def __init__(self, models: Models | None = None, curve: tuple | None = None, const: float | None = None) -> None:
        self.models, self.curve, self.const = models, curve, const

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.const is not None or not texts:
            return np.full(len(texts), self.const or 0.0)
        mean, scale, w = self.curve
        x = (np.array([figures(self.models, t) for t in texts]) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def learned_rows(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, float]:
    """((t, toxic, part) of the different texts to learn from, share of toxic rows among all that could be).

    At most max_docs rows a class and max_bytes of text; a row that doesn't fit is left
    out, those after it are not. A document with several labels is toxic if one of them
    says so; null labels don't count; of a repeated doc_id the text with the smallest
    hash counts. Equal texts are one row, toxic if one of them is. Rows are chosen by ids
    and hashes; only the texts of chosen ones are moved.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("mark"))
    marks = marks.filter(F.col("mark").isNotNull() & F.col("id").isNotNull() & (id_bucket(folds, "id") != 1)).groupBy("id").agg((F.max("mark") > 0).alias("toxic"))
    own = docs.select(F.col("doc_id").alias("id"), row_hash().alias("h"), text_of().alias("t")).filter(F.col("id").isNotNull() & (id_bucket(folds, "id") != 1))
    first = own.groupBy("id").agg(F.min(F.struct("h", F.octet_length("t").alias("size"))).alias("x"))
    there = marks.join(first.select("id", "x.*"), "id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("ids"), F.count_if("toxic").alias("toxic_ids"))
    there = cut(there.withColumn("o", F.xxhash64(F.col("id"), F.lit(8))))  # a few bytes a labelled text
    chosen = [r for t in (True, False) for r in there.filter(F.col("toxic") == t).orderBy("o", "id").limit(max_docs).collect()]
    all_ids, toxic_ids = there.agg(F.sum("ids"), F.sum("toxic_ids")).first()
    rows, size = [], 0
    for r in sorted(chosen, key=lambda r: (r["o"], r["id"])):
        if size + r["size"] <= max_bytes:
            size += r["size"]
            rows.append((r["id"], r["h"], r["toxic"]))
    if all_ids and not rows:
        raise ValueError(f"no labelled text fits in max_bytes={max_bytes}")
    few = F.broadcast(spark.createDataFrame(rows, "id long, h long, toxic boolean"))  # 2 * max_docs rows at most
    one = own.join(few, ["id", "h"]).dropDuplicates(["id", "h"])
    return one.select("t", "toxic", F.pmod("h", F.lit(PARTS)).cast("int").alias("part")), (toxic_ids or 0) / max(1, all_ids or 0)


def pair_counts(sample: DataFrame) -> Counts:
    """Counts of (t, toxic, part): one pass, summed in Spark; as many rows as the sample has different pairs come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [hashed(t) for t in b.column(0).to_pylist()]
            column = np.repeat([2 * p + c for c, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], [len(x) - 1 for x in texts])
            flat = np.stack([np.concatenate([x[:-1] for x in texts]), np.concatenate([x[1:] for x in texts]), column.astype(np.uint64)])
            found, times = np.unique(flat, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in found], pa.array(times)], names=["h", "w", "k", "n"])

    found = in_small_batches(sample.select("t", "toxic", "part")).mapInArrow(run, "h long, w long, k long, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).cast("int").alias(f"n{k}") for k in range(2 * PARTS)]
    held = found.groupBy("h", "w").agg(*sums).toArrow()  # bounded by the sample
    h, w = (held[c].to_numpy().view(np.uint64) for c in ("h", "w"))
    return Counts(h, w, np.stack([held[f"n{k}"].to_numpy() for k in range(2 * PARTS)], 1))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Models and curve from the bounded sample. Without texts of both classes, a model of one constant score."""
    rows, share = learned_rows(docs, labels, folds, max_docs, max_bytes)
    sample = cut(rows)
    by_class = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    there = {t for _, t in by_class}
    if len(there) < 2:
        return Model(const=float(there == {True}))
    counts = pair_counts(sample)
    whole = counts.fit()
    seen: list[tuple[tuple[float, ...], bool]] = []
    for k in range(PARTS):  # one part's models at a time
        # a part is judged by the models without it if these know both classes, else by those of the whole sample
        known = {t for p, t in by_class if p != k} == {True, False}
        shared = docs.sparkSession.sparkContext.broadcast(counts.fit(k) if known else whole)
        found = in_small_batches(sample.filter(F.col("part") == k).select("t", "toxic")).mapInArrow(_judge(shared), "x array<double>, toxic boolean")
        seen += ((tuple(r[0]), r[1]) for r in found.collect())  # ten numbers a row of the sample
        shared.destroy()
    seen.sort()  # so that the same sample gives the same curve to the last bit
    return Model(whole, fit_logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], float), share=share))


def _judge(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in sliced(batches):
            found = [figures(models, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """Score each row's whole text; learned from rows whose crc32(doc_id) mod folds is not 1.

    Null text is empty; an empty text is its end alone. Rows with a null doc_id are
    scored and never learned from; repeated rows are scored each. A very long text costs
    memory in proportion to it and is never cut; one that is larger than the sample's
    bytes isn't learned from. Without labels of both classes the score is constant (0,
    or 1 where all labels are toxic). An empty table gives no rows; other columns,
    whatever their names, are ignored.

    Returns doc_id, held_out, score, predicted, text_hash.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(m.scores(b.column(3).to_pylist()), pa.float64())], schema=_SCORE)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("text_hash"), (id_bucket(folds) == 1).alias("held_out"), text_of().alias("t"))
    found = in_small_batches(plain).mapInArrow(run, "doc_id long, text_hash long, held_out boolean, score double")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows not predicted toxic, with the columns of docs; repeated rows stay repeated."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in sliced(batches):
            ok = m.scores(["" if t is None else t for t in b.column("text").to_pylist()]) < THRESHOLD
            yield b.filter(pa.array(ok))

    return in_small_batches(docs.select(*names)).mapInArrow(run, docs.schema)
