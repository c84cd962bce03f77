"""Exact deduplication by Patricia-trie owners.

Each map task first merges its own copies, so a text with a third of all rows
arrives at its partition a few times per task and not once per row. The distinct
texts are dealt by (byte length, content hash, salt), sorted by their bytes, and put
into a compressed radix trie; what the salts' tries own of one text is merged by its
digest, so even a long text that every task holds spreads over SALT partitions. Because they come in byte order, only the rightmost path
of the trie can still change: a subtree left behind is complete, so its terminals'
owners go out and its memory is freed (the spill by subtree; Spark's own sort
spills the unread input). A task never holds more than one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoweave.llm.base import ASCII_SPACE, cut, in_small_batches, keep_rows, row_hash, sliced, text_of

#: Bytes of distinct texts that a map task holds before it hands them on.
COMBINE_BYTES = 8 << 20
#: Partitions among which what tasks have merged of one text is dealt.
SALT = 16
#: A group with more than one in so many rows is joined by broadcast; there are fewer such groups than this.
HOT = 1000

_DROP = ASCII_SPACE.encode()
_OWNER = pa.schema([
    ("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("norm", pa.binary()),
    ("n_cp", pa.int64()), ("owner", pa.int64()), ("copies", pa.int64()),
])
_OWNER_DDL = "n_bytes long, content_hash long, norm binary, n_cp long, owner long, copies long"
_CLASS = pa.schema([
    ("digest", pa.string()), ("keep_id", pa.int64()), ("keep_cp", pa.int64()), ("group_size", pa.int64()),
])
_CLASS_DDL = "digest string, keep_id long, keep_cp long, group_size long"


def better(a: tuple[int, int | None], b: tuple[int, int | None]) -> tuple[int, int | None]:
    """The owner of two (code points, id): more code points, then the smaller id; null ids last."""
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    if a[1] is None or b[1] is None:
        return b if a[1] is None else a
    return a if a[1] <= b[1] else b


def combine_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the equal texts of one task; at most COMBINE_BYTES of text are held."""
    held: dict[bytes, list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        hashes = [int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in held]
        cols = [[len(k) for k in held], hashes, list(held), *([v[i] for v in held.values()] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OWNER.types, strict=True)], schema=_OWNER)

    for batch in sliced(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            norm = text.encode("utf-8", "surrogatepass").translate(None, _DROP)
            seen = held.get(norm)
            if seen is None:
                held[norm] = [len(text), doc, 1]
                size += len(norm)
                if size >= COMBINE_BYTES:
                    yield out()
                    held, size = {}, 0
            else:
                seen[0], seen[1] = better((seen[0], seen[1]), (len(text), doc))
                seen[2] += 1
    if held:
        yield out()


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling windows and bisection."""
    n, step, at = min(len(a), len(b)), 16, 0
    while at < n and a[at : at + step] == b[at : at + step]:
        at = min(n, at + step)
        step *= 2
    lo, hi = at, min(n, at + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[at:mid] == b[at:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaPath:
    """The rightmost path of a Patricia trie that gets its strings in byte order.

    A node is [start, end, terminal]: its edge label is the current string's bytes
    start..end. A terminal is [code points, owner, copies] or None.
    """

    def __init__(self) -> None:
        self.last = b""
        self.path: list[list] = [[0, 0, None]]

    def insert(self, s: bytes, n_cp: int, owner: int | None, copies: int) -> list[tuple[bytes, list]]:
        """Add one string; returns the terminals of the subtrees that this completes."""
        shared = common_prefix(self.last, s)
        done = self._close(shared)
        top = self.path[-1]
        if top[1] < len(s):
            self.path.append([top[1], len(s), None])
            top = self.path[-1]
        self.last = s
        if top[2] is None:
            top[2] = [n_cp, owner, copies]
        else:
            top[2][0], top[2][1] = better((top[2][0], top[2][1]), (n_cp, owner))
            top[2][2] += copies
        return done

    def _close(self, depth: int) -> list[tuple[bytes, list]]:
        done = []
        while self.path[-1][0] >= depth and len(self.path) > 1:
            node = self.path.pop()
            if node[2] is not None:
                done.append((self.last[: node[1]], node[2]))
        top = self.path[-1]
        if top[1] > depth:  # split the edge: its lower part is complete, a branching node stays
            if top[2] is not None:
                done.append((self.last[: top[1]], top[2]))
            top[1], top[2] = depth, None
        return done

    def finish(self) -> list[tuple[bytes, list]]:
        done = self._close(0)
        root = self.path[0]
        if root[2] is not None:
            done.append((b"", root[2]))
            root[2] = None
        return done


def trie_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a partition sorted by its bytes."""
    trie = PatriciaPath()

    def out(done: list[tuple[bytes, list]]) -> pa.RecordBatch:
        cols = [[hashlib.sha256(s).hexdigest() for s, _ in done], [t[1] for _, t in done], [t[0] for _, t in done], [t[2] for _, t in done]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CLASS.types, strict=True)], schema=_CLASS)

    for batch in batches:
        done: list[tuple[bytes, list]] = []
        for s, n_cp, owner, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            done += trie.insert(s, n_cp, owner, copies)
        if done:
            yield out(done)
    if done := trie.finish():
        yield out(done)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keep_id, keep_cp, group_size) for each distinct normalised text."""
    plain = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    local = in_small_batches(plain).mapInArrow(combine_copies, _OWNER_DDL)
    salted = local.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALT)))
    dealt = salted.repartition("n_bytes", "content_hash", "salt").sortWithinPartitions("norm")
    found = dealt.select("norm", "n_cp", "owner", "copies").mapInArrow(trie_owners, _CLASS_DDL)
    first = F.min(F.struct((-F.col("keep_cp")).alias("less"), F.col("keep_id").isNull().alias("none"), "keep_id")).alias("first")
    merged = found.groupBy("digest").agg(first, F.sum("group_size").alias("group_size"))
    return merged.select("digest", "first.keep_id", (-F.col("first.less")).alias("keep_cp"), "group_size")


def with_owners(members: DataFrame, own: DataFrame) -> DataFrame:
    """members joined with own by text_sha256 = digest. A hot group's members stay where they are and its one row goes to them."""
    total = own.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(own.filter(F.col("group_size") > total / HOT))  # fewer than HOT rows, since their sizes add up to total
    on = F.col("text_sha256") == F.col("digest")
    return members.join(hot, on).unionByName(members.join(hot.select("digest"), on, "left_anti").join(own, on))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when identical without white space. Of equal texts the row with
    the most code points stays, then the smallest id. Null text is the empty text; a
    null id counts as the largest. Of rows repeated with the same id and text one is
    kept. An empty table gives an empty result; other columns are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256, text_hash.
    """
    members = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.translate(text_of(text_col), ASCII_SPACE, ""), 256).alias("text_sha256"),
        F.length(text_of(text_col)).cast("long").alias("n_cp"),
        row_hash(text_col).alias("text_hash"),
    )
    repeated = Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("n_cp"), "text_hash")
    members = members.withColumn("nth", F.row_number().over(repeated))
    # both stored: they are read twice, and a row is thin
    return with_owners(cut(members), cut(owners(docs, id_col, text_col))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    return keep_rows(docs, exact_dedup(docs).filter("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
w AS (
  SELECT doc_id, sha256(n) AS text_sha256, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS r, xh FROM (SELECT *, 0 AS xh FROM d)
  WINDOW o AS (PARTITION BY n ORDER BY length(t) DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM w
"""
