"""Language-model scores by deleted interpolation.

    P(w | h) = l_n(b) c(h w) / c(h) + ... + l_1(b) c(w) / N + l_0(b) / (V + 1)

with maximum-likelihood n-gram estimates and weights by the frequency bucket b of the
context h, learned by expectation-maximisation on counts held out from the learned
rows: the estimates that EM sees come from the fit part alone, the tokens it explains
from the tune part. The scores use the counts of both parts.

The corpus's n-grams never become rows, and texts are never shuffled. Each task encodes
its texts once into blocks of numbered words, which are stored. A block asks for the
counts of its distinct n-grams with one compressed key list per key range, the range
adds up what all blocks hold and answers each list in the order in which it was asked.
So each distinct n-gram of a block crosses the network once, in a few bytes, and an
n-gram with very many occurrences costs no more than a rare one.

A range holds about `range_tokens` entries, so their number grows with the corpus, but
only as long as a block's lists have MIN_LIST entries on average. So rows are at most a
MIN_LISTth of the entries. With the sizes below that holds ranges to their size up to
3e10 tokens, 200 GB; beyond, ranges grow unless block_bytes is raised with the corpus: a
task's memory is some 15 times block_bytes or 50 bytes an entry of a range. Blocks of
64 MB, lists of 16 entries and ranges of 25 million reach 100 TB with about 1.3 GB a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, id_bucket, in_small_batches, mix64, sliced, text_of

ORDER = 2
FOLDS = 10
#: The learned rows in this remainder are the tune part.
TUNE = 9
#: Bytes of text in a block, about.
BLOCK_BYTES = 6 << 20
#: Entries (distinct n-grams of a block) in a key range, about.
RANGE_TOKENS = 1 << 21
#: Entries that a block's list for one range has at least, on average.
MIN_LIST = 64
#: Bytes of a long text that are split into words at a time.
PIECE = 1 << 20
#: Bits of an n-gram's key for n > 1; words have 64.
PAIR_BITS = 56
BUCKETS = 24
ADD = 0.1
EM_ROUNDS = 60
#: Cells a factor of two in a probability when held-out tokens are counted for EM.
CELLS = 8

FIT, TUNE_ROLE, EVAL = 0, 1, 2
#: No word holds white space, so these are no words. They have the numbers 0 and 1 in every block.
END, START = b" end", b" start"
_SPACE = b" \t\n\r\x0b\x0c"

_BLOCK_DDL = "block long, role int, ids array<long>, words binary, sizes binary, tokens binary, n_words long, n_tokens long"
_BLOCK = pa.schema([
    ("block", pa.int64()), ("role", pa.int32()), ("ids", pa.list_(pa.int64())), ("words", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()),
    ("n_words", pa.int64()), ("n_tokens", pa.int64()),
])
_REQUEST_DDL = "n int, part long, block long, role int, keys binary, counts binary"
_REQUEST = pa.schema([("n", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("role", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER_DDL = "block long, role int, n int, part long, fit binary, learned binary, types long, fit_tokens long, tokens long"
_ANSWER = pa.schema([
    ("block", pa.int64()), ("role", pa.int32()), ("n", pa.int32()), ("part", pa.int64()), ("fit", pa.binary()), ("learned", pa.binary()),
    ("types", pa.int64()), ("fit_tokens", pa.int64()), ("tokens", pa.int64()),
])


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(len(x).to_bytes(8, "little") + planes[:used].tobytes())


def unpack_ints(raw: bytes) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(raw[1:])
    n = int.from_bytes(body[:8], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[: raw[0]] = np.frombuffer(body, np.uint8, offset=8).reshape(raw[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def words_in(text: str) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some at a time."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in _SPACE:  # never within a word
            end += 1
        yield raw[at:end].split()
        at = end


class Encoder:
    """Gathers a block's texts as numbers of words, in order of first use."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.end, self.start = self.words[END], self.words[START]
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        get, n = self.words.__getitem__, 1
        for some in words_in(text):
            self.parts.append(np.fromiter(map(get, some), np.int32, len(some)))
            n += len(some)
        self.parts.append(np.array([self.end], np.int32))
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.bytes += len(text) + 8

    def row(self, block: int, role: int) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        tokens = np.concatenate(self.parts)
        cols = [block, role, self.ids, hashes.tobytes(), pack_ints(np.array(self.sizes)), pack_ints(tokens), len(hashes), len(tokens)]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, _BLOCK.types, strict=True)], schema=_BLOCK)


def _encoder(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        numbers = count((context.partitionId() if context else 0) << 32)
        held: defaultdict[int, Encoder] = defaultdict(Encoder)
        for b in sliced(batches):
            for doc_id, text, role in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[role].add(doc_id, text)
                if held[role].bytes >= block_bytes:
                    yield held.pop(role).row(next(numbers), role)
        for role in list(held):
            yield held.pop(role).row(next(numbers), role)

    return run


class Block:
    """The n-grams of a block's documents, n = 1..order.

    grams[n - 1] is (sorted distinct keys, index of each position's n-gram among
    them); positions run over all documents, with starts before and an end after each.
    """

    def __init__(self, words: bytes, sizes: bytes, tokens: bytes, order: int) -> None:
        pad = max(1, order - 1)
        plain, self.sizes = unpack_ints(tokens).astype(np.int32), unpack_ints(sizes).astype(np.int64) + pad
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        first = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.asked = np.arange(len(self.doc)) - first >= pad
        ids = np.ones(len(self.doc), np.int32)  # starts
        ids[self.asked] = plain
        del first, plain
        keys, at = np.unique(np.frombuffer(words, np.uint64), return_inverse=True)
        self.grams = [(keys, at.astype(np.int32)[ids])]
        for n in range(2, order + 1):
            # an n-gram is its (n-1)-gram one position before and its last word
            older, word = self.grams[-1], self.grams[0]
            codes = np.empty(len(ids), np.int64)
            codes[1:], codes[:1] = older[1][:-1], older[1][:1]
            codes *= len(word[0])
            codes += word[1]
            codes, at = np.unique(codes, return_inverse=True)
            head, tail = older[0][codes // len(word[0])], word[0][codes % len(word[0])]
            h = mix64(mix64(head + np.uint64(n)) ^ (tail * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - PAIR_BITS)
            del codes, head, tail
            keys, to = np.unique(h, return_inverse=True)
            self.grams.append((keys, to.astype(np.int32)[at]))

    def counts(self, n: int) -> np.ndarray:
        """Occurrences of each distinct n-gram, starts included."""
        keys, at = self.grams[n - 1]
        return np.bincount(at, minlength=len(keys))


def _parts(keys: np.ndarray, n: int, parts: int) -> np.ndarray:
    """First key number of each key range, and the end."""
    bits = 64 if n == 1 else PAIR_BITS
    edges = [min((i << bits) // parts, (1 << 64) - 1) for i in range(parts)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def _asker(order: int, parts: list[int]):
    """For each stored block, its key lists; parts[n - 1] is the number of key ranges of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, role, words, sizes, tokens = (batch.column(c)[i].as_py() for c in ("block", "role", "words", "sizes", "tokens"))
                b, rows = Block(words, sizes, tokens, order), []
                for n in range(1, order + 1):
                    keys, counts = b.grams[n - 1][0], b.counts(n)
                    edges = _parts(keys, n, parts[n - 1])
                    for p in range(parts[n - 1]):
                        lo, hi = edges[p], edges[p + 1]
                        if lo < hi:
                            gaps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                            rows.append((n, p, block, role, pack_ints(gaps), b"" if role == EVAL else pack_ints(counts[lo:hi])))
                del b
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REQUEST.types, strict=True)], schema=_REQUEST)

    return run


def _keys_of(packed: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack_ints(packed.as_py()), dtype=np.uint64)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of one key range, told to each block that asked. The range is held, one block's list at a time."""
    n, part = key[0].as_py(), key[1].as_py()
    blocks, roles = table.column("block").to_pylist(), table.column("role").to_pylist()
    asked, counts = table.column("keys"), table.column("counts")
    keys = np.unique(np.concatenate([_keys_of(k) for k in asked]))
    sums = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
    for k, c, role in zip(asked, counts, roles, strict=True):
        if role != EVAL:
            sums[role][np.searchsorted(keys, _keys_of(k))] += unpack_ints(c.as_py()).astype(np.int64)
    fit, learned = sums[FIT], sums[FIT] + sums[TUNE_ROLE]
    real = keys != np.uint64(xxhash.xxh64_intdigest(START)) if n == 1 else np.zeros(len(keys), bool)
    stats = ((learned > 0) & real).sum(), fit[real].sum(), learned[real].sum()
    rows = []
    for i, (k, block, role) in enumerate(zip(asked, blocks, roles, strict=True)):
        own = np.searchsorted(keys, _keys_of(k))
        rows.append((block, role, n, part, pack_ints(fit[own]) if role == TUNE_ROLE else b"", pack_ints(learned[own]), *(int(x) if i == 0 else 0 for x in stats)))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ANSWER.types, strict=True)], schema=_ANSWER)


def _stored(table: pa.Table, order: int) -> Block:
    return Block(*(table.column(c)[0].as_py() for c in ("words", "sizes", "tokens")), order)


def _answers(b: Block, table: pa.Table, name: str) -> list[np.ndarray]:
    """The corpus count of each of the block's distinct n-grams, for n = 1..order."""
    rows = sorted(zip(table.column("n").to_pylist(), table.column("part").to_pylist(), table.column(name).to_pylist(), strict=True), key=lambda r: r[:2])
    out = []
    for n, (keys, _) in enumerate(b.grams, 1):
        got = np.concatenate([np.empty(0, np.uint64), *(unpack_ints(r[2]) for r in rows if r[0] == n)])
        if len(got) != len(keys):
            raise RuntimeError(f"block has {len(keys)} {n}-grams, but {len(got)} were answered")
        out.append(got.astype(np.float64))
    return out


def _estimates(b: Block, got: list[np.ndarray], total: float, types: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asked position: components (order + 1 columns, uniform first), context counts, word counts.

    Context counts have a column for each n from 2.
    """
    per = [g[at] for g, (_, at) in zip(got, b.grams, strict=True)]
    comps = [np.full(len(b.asked), 1.0 / (types + 1)), per[0] / max(total, 1.0)]
    contexts = []
    for n in range(2, len(b.grams) + 1):
        ctx = np.concatenate(([0.0], per[n - 2][:-1])) if len(per[n - 2]) else per[n - 2]
        comps.append(np.where(ctx > 0, per[n - 1] / np.maximum(ctx, 1.0), 0.0))
        contexts.append(ctx)
    ctx = np.stack(contexts, 1) if contexts else np.zeros((len(b.asked), 1))
    return np.stack(comps, 1)[b.asked], ctx[b.asked], per[0][b.asked]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 count)."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def learn_weights(cells: list[tuple[int, float, list[float]]], order: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (buckets x order + 1) by EM over (bucket, tokens, mean components).

    Each bucket leans on the pooled weights with the strength of a few tokens, so one
    without held-out tokens takes those.
    """
    k = order + 1
    bucket = np.array([c[0] for c in cells], np.int64)
    n = np.array([c[1] for c in cells], float)
    p = np.array([c[2] for c in cells], float).reshape(-1, k)

    def em(w: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            post = p[rows] * w
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            w = (post * n[rows, None]).sum(0) + prior
            w /= w.sum()
        return w

    even = np.full(k, 1 / k)
    pooled = em(even, np.ones(len(n), bool), even)
    return np.stack([em(pooled, bucket == b, 5 * pooled) for b in range(BUCKETS)])


def _weights_at(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Each position's weights; an unseen context's weight goes to the next lower order, so they sum to one."""
    w = weights[bucket_of(context[:, -1])].copy()
    for n in range(w.shape[1] - 1, 1, -1):
        none = context[:, n - 2] == 0
        w[none, n - 1] += w[none, n]
        w[none, n] = 0
    return w


def _tune_cells(order: int, fit_total: float, types: float):
    def run(_: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        names = ["bucket", "cell", "tokens", *(f"p{i}" for i in range(order + 1))]
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.float64()] * (order + 1)]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        b = _stored(docs, order)
        comps, context, _ = _estimates(b, _answers(b, got, "fit"), fit_total, types)
        bucket, cell = bucket_of(context[:, -1]), np.zeros(len(comps), np.int64)
        for i in range(1, order + 1):
            step = np.where(comps[:, i] > 0, np.minimum(1 - CELLS * np.log2(np.maximum(comps[:, i], 1e-30)), 1000), 0)
            cell = cell * 1001 + np.round(step).astype(np.int64)
        both, at = np.unique(np.stack([bucket, cell], 1), axis=0, return_inverse=True)
        at = at.reshape(-1)
        cols = [both[:, 0], both[:, 1], np.bincount(at).astype(float), *(np.bincount(at, weights=comps[:, i]) for i in range(order + 1))]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _scorer(order: int, total: float, types: float, weights: np.ndarray):
    def run(_: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        b = _stored(docs, order)
        comps, context, word = _estimates(b, _answers(b, got, "learned"), total, types)
        p = (comps * _weights_at(weights, context)).sum(1)
        ids = docs.column("ids")[0].values
        doc, n = b.doc[b.asked], len(ids)
        base = np.log10((word + ADD) / (total + ADD * (types + 1)))
        sums = [np.bincount(doc, minlength=n), np.bincount(doc, weights=(word > 0).astype(float), minlength=n).astype(np.int64)]
        return pa.table(
            [ids, pa.array(sums[0]), pa.array(sums[1]), pa.array(np.bincount(doc, weights=base, minlength=n)), pa.array(np.bincount(doc, weights=np.log10(p), minlength=n))],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def key_ranges(tokens: int, words: int, blocks: int, order: int, range_tokens: int = RANGE_TOKENS, min_list: int = MIN_LIST) -> list[int]:
    """How many key ranges the n-grams of each n have: by their entries, as long as lists don't get too short."""
    return [max(1, min(-(-e // range_tokens), e // max(1, blocks) // min_list)) for e in (words, *[tokens] * (order - 1))]


def lm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS, min_list: int = MIN_LIST) -> DataFrame:
    """Score each row's whole text under a model learned from the rows whose crc32(id) mod folds is not 0.

    Words are lower-cased in A-Z and split at ASCII white space; a text ends with one
    end token. Null text is empty: one token. Rows with a null id are scored and never
    learned from; repeated rows are learned and scored as often as they occur. A long
    text is split into words a piece at a time. If nothing can be learned, every token
    has the uniform share of an unknown word. An empty table gives no rows; other
    columns are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    rest = id_bucket(folds, id_col)
    role = F.when(rest == 0, EVAL).when(rest == TUNE, TUNE_ROLE).otherwise(FIT)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"), role.alias("role"))
    # stored: a block keeps its number and its rows whatever happens to the task that made it
    blocks = cut(in_small_batches(plain).mapInArrow(_encoder(block_bytes), _BLOCK_DDL))
    size = blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.count(F.lit(1))).first()
    parts = key_ranges(size[0] or 0, size[1] or 0, size[2], order, range_tokens, min_list)

    asked = blocks.select("block", "role", "words", "sizes", "tokens").mapInArrow(_asker(order, parts), _REQUEST_DDL)
    answers = cut(asked.groupBy("n", "part").applyInArrow(_answer, _ANSWER_DDL))
    types, fit_total, total = (float(x or 0) for x in answers.agg(F.sum("types"), F.sum("fit_tokens"), F.sum("tokens")).first())

    def answered(of: DataFrame, rows: DataFrame, run, ddl: str) -> DataFrame:
        return of.select("block", "ids", "words", "sizes", "tokens").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, ddl)

    of_tune = F.col("role") == TUNE_ROLE
    tune = answered(blocks.filter(of_tune), answers.filter(of_tune).select("block", "n", "part", "fit"), _tune_cells(order, fit_total, types), "bucket long, cell long, tokens double, " + ", ".join(f"p{i} double" for i in range(order + 1)))
    cells = tune.groupBy("bucket", "cell").agg(F.sum("tokens"), *[F.sum(f"p{i}") for i in range(order + 1)]).collect()  # bounded by the cells
    weights = learn_weights([(r[0], r[2], [x / r[2] for x in r[3:]]) for r in cells], order)
    if not total:
        weights = np.eye(order + 1)[np.zeros(BUCKETS, int)]

    scored = answered(blocks, answers.select("block", "n", "part", "learned"), _scorer(order, total, types, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", (id_bucket(folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )
