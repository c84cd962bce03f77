"""Ranked lexical search by variable-block-max WAND.

Documents are indexed in shards: the postings of the searched items' terms, for each term
in order of the document. A shard's posting lists are cut into blocks of variable length by
dynamic programming: of all cuts into blocks of at most LONGEST postings, the one whose sum
of bound errors (how far each posting lies below its block's greatest score) and of a
price for each block is least.

A search adds up, at every place of the document order, the greatest scores of the item's
blocks that span it. Between two neighbouring block boundaries that sum is constant; it is
WAND's pivot test for a whole run of documents: if it lies below the k-th best score found
so far, the run is skipped in all lists. Runs are taken by falling bound, so the search of a
shard ends as soon as no bound reaches the k-th score. Bounds equal to it are still read, as
ties go by the smaller id; so the result is exact. What shards find is merged in Spark.

Searched items are the small side: they are taken in parts of bounded text, each of which
goes over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoweave.llm.base import cut, in_small_batches, sliced, text_of

TOP = 10
#: Bytes of the items' texts that are searched for at a time, about; what is broadcast grows with these only.
ITEM_BYTES = 16 << 20
#: Postings, and documents with postings, of a shard, about; a document is in one shard.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 17
#: A block's greatest length, and its price in mean bound errors of the list as one block.
LONGEST, PRICE = 64, 8.0
#: Runs that are read at first; each time after, twice as many.
RUNS = 16

#: Term characters stay, A-Z in lower case; all others of ASCII part terms.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_SHARD_DDL = "docs long, length long, ids binary, postings binary, terms binary"
_SHARD = pa.schema([("docs", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("postings", pa.binary()), ("terms", pa.binary())])
_HIT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


@dataclass
class Items:
    """Searched items: their ids, the terms' numbers, and each item's terms."""

    ids: list[int | None]
    number: dict[bytes, int]
    terms: list[np.ndarray]


def collect_items(part: DataFrame) -> Items:
    """Rows of one id are one item with the terms of all; null is an id of its own."""
    held: dict[int | None, set[bytes]] = {}
    for item, text in part.collect():  # ITEM_BYTES, about
        held.setdefault(item, set()).update(terms_of(text))
    number = {t: i for i, t in enumerate(sorted(set().union(*held.values())))}
    return Items(list(held), number, [np.array(sorted(number[t] for t in own), np.int64) for own in held.values()])


def item_parts(items: DataFrame, item_bytes: int = ITEM_BYTES, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """items(item_id, t) in parts of about item_bytes; all rows of an id are in one."""
    plain = items.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("t"))
    size = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // item_bytes)
    if n < 2:
        return [plain] * n
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [plain.filter(part == i) for i in range(n)]


class Shard:
    """Postings while they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.keys: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.size = self.docs = self.length = 0

    def add(self, ids: list[int | None], texts: list[str], number: dict[bytes, int]) -> None:
        found, at = [], []
        for doc_id, text in zip(ids, texts, strict=True):
            words = terms_of(text)
            if not words:
                continue
            self.docs += 1
            self.length += len(words)
            own = [x for x in map(number.get, words) if x is not None]
            if own:
                found.append(np.array(own, np.int64))
                at.append(len(self.ids))
                self.ids.append(doc_id)
                self.n.append(len(words))
        if found:
            doc = np.repeat(at, [len(x) for x in found])
            keys, tf = np.unique((np.concatenate(found) << 32) | doc, return_counts=True)
            self.keys.append(keys)
            self.tf.append(tf)
            self.size += len(keys)

    def row(self) -> pa.RecordBatch:
        keys, tf = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.keys, self.tf))
        order = np.argsort(keys)
        keys, tf = keys[order], tf[order]
        terms, df = np.unique(keys >> 32, return_counts=True)
        ids = pa.record_batch([pa.array(self.ids, pa.int64()), pa.array(self.n, pa.int64())], names=["doc_id", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(ids)
        postings = zstandard.ZstdCompressor(level=3).compress((keys & 0xFFFFFFFF).astype(np.int32).tobytes() + tf.astype(np.int64).tobytes())
        cells = [[self.docs], [self.length], [sink.getvalue().to_pybytes()], [postings], [np.concatenate([terms, df]).astype(np.int64).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _SHARD, strict=True)], schema=_SHARD)


def index_shards(docs: DataFrame, number: Broadcast, postings: int = SHARD_POSTINGS, most: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: documents with terms, their length, and the searched terms' postings, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Shard()
        for b in sliced(batches):
            now.add(b.column(0).to_pylist(), b.column(1).to_pylist(), number.value)
            if now.size >= postings or len(now.ids) >= most:
                yield now.row()
                now = Shard()
        if now.docs:
            yield now.row()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return in_small_batches(plain).mapInArrow(run, _SHARD_DDL)


def term_weights(shards: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, their length, weight of each term) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                terms, df = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], names=["term", "df"])

    sums = shards.agg(F.sum("docs"), F.sum("length")).first()
    n, length = (int(x or 0) for x in sums)
    held = shards.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # the items' terms
    weights = np.zeros(n_terms, np.int64)
    weights[held["term"].to_numpy()] = [math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in held["df"].to_pylist()]
    return n, length, weights


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a posting is worth besides its term's weight; n is its document's length."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        n = n.astype(object)
    m = (10 + (90 * n * docs) // max(1, length)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def block_ends(values: np.ndarray, starts: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Ends of the blocks (one past the last posting) of lists laid end to end, each from its start; in order.

    For each list, the cut of least sum of (greatest - value) over all values plus
    `price` times the list's mean error as one block, a block. All lists advance together.
    """
    sizes = np.diff(np.append(starts, len(values)))
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    if not len(order):
        return np.zeros(0, np.int64)
    high, mean = np.maximum.reduceat(values, starts)[order].astype(float), (np.add.reduceat(values, starts) / sizes)[order]
    cost_of_block = price * (high - mean) + 1
    width = np.arange(1, longest + 1, dtype=float)
    best = np.full((len(order), longest), np.inf)  # least cost of what ends 1..longest postings ago
    best[:, 0] = 0
    top, total = np.zeros((len(order), longest)), np.zeros((len(order), longest))
    chosen = np.zeros(len(values), np.int16)
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # lists longer than i
    for i in range(size[0]):
        k = active[i]
        s = values[first[:k] + i].astype(float)[:, None]
        b, t, w = best[:k], top[:k], total[:k]
        t[:, 1:] = t[:, :-1]
        t[:, 0] = 0
        np.maximum(t, s, out=t)
        w[:, 1:] = w[:, :-1]
        w[:, 0] = 0
        w += s
        cost = t * width
        cost -= w
        cost += b
        pick = cost.argmin(1)
        chosen[first[:k] + i] = pick + 1
        least = cost[np.arange(k), pick] + cost_of_block[:k]
        b[:, 1:] = b[:, :-1]
        b[:, 0] = least
    ends, at = [], size.copy()
    while (open_ := at > 0).any():
        first, at = first[open_], at[open_]
        ends.append(first + at)
        at = at - chosen[first + at - 1]
    return np.sort(np.concatenate(ends))


class Searcher:
    """One shard, ready to be searched."""

    def __init__(self, ids: pa.Table, postings: bytes, terms: bytes, docs: int, length: int, weights: np.ndarray, longest: int = LONGEST) -> None:
        number, df = np.frombuffer(terms, np.int64).reshape(2, -1)
        flat = zstandard.ZstdDecompressor().decompress(postings)
        size = int(df.sum())
        doc, tf = np.frombuffer(flat, np.int32, size).astype(np.int64), np.frombuffer(flat, np.int64, size, 4 * size)
        self.ids = ids["doc_id"].to_numpy(zero_copy_only=False) if not ids["doc_id"].null_count else ids["doc_id"].to_pandas().to_numpy(object)
        self.none = ids["doc_id"].is_null().to_numpy(zero_copy_only=False)
        self.rank = np.lexsort((ids["doc_id"].fill_null(0).to_numpy(), self.none)).argsort()  # place of each document by id, null last
        starts = np.cumsum(df) - df
        worth = impacts(tf, ids["n"].to_numpy()[doc], docs, length)
        ends = block_ends(worth, starts, longest) if size else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if size else ends
        own = np.repeat(np.arange(len(number)), df)
        #: Place of each term's list, or -1.
        self.list_of = np.full(len(weights), -1, np.int64)
        self.list_of[number] = np.arange(len(number))
        self.doc, self.score, self.key = doc, worth * weights[number[own]], (own << 32) | doc
        # of each block: its list, first and last document, greatest score
        self.first, self.last = (doc[begins], doc[ends - 1]) if size else (ends, ends)
        self.bound = np.maximum.reduceat(self.score, begins) if size else ends
        self.blocks = np.searchsorted(own[begins] if size else own, np.arange(len(number) + 1))
        #: Postings that searches have read, for tests and reports.
        self.read = 0

    def runs(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, bound) of the runs of documents between neighbouring boundaries of the lists' blocks, `to` not included."""
        of = _ranges(self.blocks[lists], self.blocks[lists + 1])
        at, change = np.concatenate([self.first[of], self.last[of] + 1]), np.concatenate([self.bound[of], -self.bound[of]])
        edges, where = np.unique(at, return_inverse=True)
        steps = np.zeros(len(edges), np.int64)
        np.add.at(steps, where, change)
        return edges[:-1], edges[1:], np.cumsum(steps)[:-1]

    def search(self, terms: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, scores): the best `top` of this shard, best first."""
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        docs = scores = np.zeros(0, np.int64)
        if not len(lists):
            return docs, scores
        lo, hi, bound = self.runs(lists)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], 0)]  # bounds above 0
        at, many, least = 0, RUNS, 1
        while at < len(order) and bound[order[at]] >= least:
            some = order[at : at + many]
            some = some[bound[some] >= least]
            at, many = at + many, 2 * many
            keys = lists[:, None] << 32
            a, b = np.searchsorted(self.key, keys | lo[some]), np.searchsorted(self.key, keys | hi[some])
            of = _ranges(a.ravel(), b.ravel())
            self.read += len(of)
            found, where = np.unique(self.doc[of], return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, where, self.score[of])
            docs, scores = np.concatenate([docs, found]), np.concatenate([scores, sums])
            best = np.lexsort((self.rank[docs], -scores))[:top]
            docs, scores = docs[best], scores[best]
            if len(scores) == top:
                least = max(1, int(scores[-1]))
        return docs[scores > 0], scores[scores > 0]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all ranges a..b-1, one range after the other."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _hits(shards: DataFrame, shared: Broadcast, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, docs, length, weights = shared.value
        for b in batches:
            for raw, postings, terms in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = pa.ipc.open_stream(raw).read_all()
                s, out = Searcher(ids, postings, terms, docs, length, weights), []
                for item, own in zip(items.ids, items.terms, strict=True):
                    places, scores = s.search(own, top)
                    out += [(item, None if s.none[p] else int(s.ids[p]), int(x)) for p, x in zip(places, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], schema=_HIT)

    return shards.select("ids", "postings", "terms").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The `top` documents of highest score above 0 for each item; equal scores by ascending doc_id, null last.

    Terms are runs of letters and figures of ASCII and of all other characters, A-Z in
    lower case. Null and empty texts have no terms: such documents don't count, such
    items find nothing. Rows of items with one item_id are one item with the terms of all;
    null is an id like others. Each row of docs is a document, also where ids or whole rows repeat. Very
    long texts cost memory in proportion and are read whole. Empty tables give no rows;
    other columns are ignored.

    Returns item_id, rank (from 1), doc_id, score.
    """
    spark, found = docs.sparkSession, []
    for part in item_parts(items, item_bytes):
        own = collect_items(part)
        number = spark.sparkContext.broadcast(own.number)  # ITEM_BYTES, about
        shards = cut(index_shards(docs, number, postings))
        n, length, weights = term_weights(shards, len(own.number))
        shared = spark.sparkContext.broadcast((Items(own.ids, {}, own.terms), n, length, weights))
        found.append(_hits(shards, shared, top))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
p AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {TOP}"""
