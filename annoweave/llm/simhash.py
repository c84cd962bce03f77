"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that differ in at most `budget` bits are linked; components of links
are the groups. Copies share a fingerprint, so only distinct fingerprints are
joined. To deal the trie out, the 64 bits are cut into budget + k blocks: any two
linked fingerprints agree in at least k of them. Each choice of k blocks is one
table whose buckets hold the fingerprints that agree there. Within a bucket a
binary trie over the fingerprints is joined with itself: node pairs are descended
together, differing bits add up, and a pair is pruned when the budget is exceeded
or when all leaves under both are already in one component. A bucket gives its
spanning forest only, never its pairs. k grows with the number of fingerprints, so
that a bucket of unrelated fingerprints stays small; buckets that are still too
large are cut again by further blocks, which loses no link. What can't be cut far
enough that way, fingerprints that agree nearly everywhere, is dealt into parts that
meet in pairs, so no task ever holds more than LARGE_BUCKET fingerprints.

The nodes of the graph are fingerprints, not ids: any 64-bit id, and none, is fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, in_small_batches, keep_rows, row_hash, sliced, text_of
from annoweave.llm.components import connected_components

SEED = 42
SHINGLE = 5
BUDGET = 4
#: Aim for at most so many unrelated fingerprints in a bucket.
BUCKET = 64
#: Buckets above this are cut again.
LARGE_BUCKET = 20_000

_FP = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    toks = text.encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    flat = b" ".join(toks)
    digest = xxhash.xxh64_intdigest
    if len(toks) <= words:
        hashes = [digest(flat, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
        starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
        hashes = [digest(flat[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], schema=_FP)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("text_hash"), text_of(text_col).alias("t"))
    return in_small_batches(plain).mapInArrow(run, "doc_id long, text_hash long, fp long")


class Node:
    """A compressed binary trie node over the sorted fingerprints lo..hi."""

    __slots__ = ("bit", "leaf", "one", "prefix", "rep", "same", "zero")

    def __init__(self, fps: list[int], lo: int, hi: int) -> None:
        self.rep, self.prefix = lo, fps[lo]
        self.zero = self.one = None
        self.same = self.leaf = hi - lo == 1
        self.bit = 0
        if not self.leaf:
            self.bit = (fps[lo] ^ fps[hi - 1]).bit_length() - 1
            pivot = (fps[hi - 1] >> self.bit) << self.bit
            a, b = lo, hi
            while a < b:
                mid = (a + b) // 2
                if fps[mid] < pivot:
                    a = mid + 1
                else:
                    b = mid
            self.zero, self.one = Node(fps, lo, a), Node(fps, a, hi)


class Forest:
    """Disjoint sets of the numbers 0..n-1; a set's root is its smallest number."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.parent[j] = i


def trie_self_join(fps: list[int], budget: int = BUDGET) -> list[tuple[int, int]]:
    """(fingerprint, root) for each one linked to a smaller one; fps are distinct, unsigned and sorted.

    The root is the smallest fingerprint of the component within these.
    """
    if len(fps) < 2:
        return []
    forest = Forest(len(fps))
    find = forest.find

    def settled(n: Node) -> bool:
        if not n.same and n.zero.same and n.one.same and find(n.zero.rep) == find(n.one.rep):
            n.same = True
        return n.same

    root = Node(fps, 0, len(fps))
    inner, stack = [root], []
    while inner:  # children before parents, so that settled subtrees are known early
        n = inner.pop()
        if not n.leaf:
            stack.append(n)
            inner += (n.zero, n.one)
    while stack:
        n = stack.pop()
        pairs = [(n.zero, n.one)]
        while pairs:
            a, b = pairs.pop()
            # bits above both nodes' branching bits are common to all their leaves
            top = max(a.bit + 1 if not a.leaf else 0, b.bit + 1 if not b.leaf else 0)
            if ((a.prefix ^ b.prefix) >> top).bit_count() > budget:
                continue
            if settled(a) and settled(b) and find(a.rep) == find(b.rep):
                continue
            if a.leaf and b.leaf:
                forest.join(a.rep, b.rep)
            elif b.leaf or not a.leaf and a.bit >= b.bit:
                pairs += ((a.zero, b), (a.one, b))
            else:
                pairs += ((a, b.zero), (a, b.one))
    return [(fps[i], fps[r]) for i in range(len(fps)) if (r := find(i)) != i]


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that cover the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def table_masks(budget: int, k: int) -> list[int]:
    """Bit masks of each choice of k among budget + k blocks."""
    parts = [((1 << w) - 1) << s for s, w in blocks(budget + k)]
    return [sum(c) for c in combinations(parts, k)]


def blocks_needed(n: int, budget: int = BUDGET, bucket: int = BUCKET) -> int:
    """Fewest k for which n evenly spread fingerprints make buckets of at most `bucket`."""
    k = 1
    while k < 4 and n >> (64 * k // (budget + k)) > bucket:
        k += 1
    return k


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_edges(budget: int):
    """Edges within each run of rows with equal leading columns; the last column is the fingerprint, in unsigned order or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1)), strict=True)
            for k, fp in zip(keys, b.column("fp").to_pylist(), strict=True):
                if k != key:
                    found += trie_self_join(sorted(fps), budget)
                    key, fps = k, []
                fps.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _edges(found)
        yield _edges(trie_self_join(sorted(fps), budget))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in found], np.uint64).view(np.int64)) for i in (0, 1)], schema=_EDGE)


def _deal(nodes: DataFrame, masks: list[int], path: list[str], level: int) -> DataFrame:
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])).alias("x")
    keys: list[Column | str] = [*path, F.col("x.t").alias(f"t{level}"), F.expr("fp & x.m").alias(f"k{level}")]
    return nodes.select(*path, "fp", table).select(*keys, "fp")


def _in_pairs(heavy: DataFrame, sizes: DataFrame, path: list[str], large: int) -> DataFrame:
    """Rows of buckets that are too large, dealt into parts of half the size; each pair of parts is a bucket (p, q)."""
    parts = F.greatest(F.lit(2), F.ceil(F.col("count") / (large / 2))).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = heavy.join(sizes.select(*path, parts.alias("parts")), path).withColumn("own", own)
    met = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.select(*path, "own", met.alias("other"), "fp").select(*path, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")


def link_fingerprints(nodes: DataFrame, budget: int = BUDGET, bucket: int = BUCKET, large: int = LARGE_BUCKET) -> DataFrame:
    """Edges (a, b) that span the components of nodes(fp) within `budget` bits.

    fp is distinct. Buckets over `large` are dealt again by other blocks (k + 1, then
    k + 2 of them); those that still are too large are dealt into parts, and each pair
    of parts is joined by itself. So a task holds about `large` fingerprints at most.
    """
    k = blocks_needed(nodes.count(), budget, bucket)
    dealt, path, out = _deal(nodes.select("fp"), table_masks(budget, k), [], 0), ["t0", "k0"], None

    def joined(rows: DataFrame, keys: list[str]) -> None:
        nonlocal out
        part = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(_bucket_edges(budget), "a long, b long")
        out = part if out is None else out.unionByName(part)

    for level in (1, 2, 3):
        sizes = cut(dealt.groupBy(*path).count().filter(F.col("count") > large))
        if sizes.isEmpty():
            joined(dealt, path)
            break
        heavy = sizes.select(*path)
        joined(dealt.join(heavy, path, "left_anti"), path)
        dealt = dealt.join(heavy, path, "left_semi")
        if level == 3:
            joined(_in_pairs(dealt, sizes, path, large), [*path, "p", "q"])
        else:
            dealt = _deal(dealt, table_masks(budget, k + level), path, level)
            path = [*path, f"t{level}", f"k{level}"]
    return out


def _grouped(docs: DataFrame, words: int, budget: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each row; (fp, group) of each fingerprint, group being a fingerprint too."""
    marked = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(marked.select("fp").distinct())
    comps = connected_components(link_fingerprints(nodes, budget))
    return marked, nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"))


def simhash_groups(docs: DataFrame, words: int = SHINGLE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint and group.

    Texts (null: empty) are lower-cased in A-Z and split at ASCII white space; fewer
    words than a shingle make one shingle, no words make fingerprint 0, which links
    like any other. A very long text costs memory in proportion to it and is never cut.
    component_id is the smallest id that can be reached over links, any 64-bit number.
    A row with a null id gets the group of its fingerprint but never names it; where
    all ids of a group are null, component_id is null. Repeated rows stay repeated; an
    empty table gives no rows; other columns are ignored.

    Returns doc_id, fingerprint (16 hex digits), component_id, text_hash.
    """
    marked, groups = _grouped(docs, words, budget, id_col, text_col)
    # a partial minimum for each fingerprint, then for each group: no group is gathered
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = groups.join(least, "fp").groupBy("group").agg(F.min("least").alias("component_id"))
    labels = groups.join(named, "group").select(F.col("fp").alias("f"), "component_id")
    return marked.join(labels, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def drop_near_copies(docs: DataFrame, words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each group, with the columns of docs: that of its smallest id (null ids last), then of the smallest hash of its text."""
    marked, groups = _grouped(docs, words, budget, "doc_id", "text")
    # of a fingerprint's rows, then of a group's, the first: partial minima, no group is gathered
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = marked.groupBy("fp").agg(F.min(order).alias("row")).join(groups, "fp").groupBy("group").agg(F.min("row").alias("row"))
    return keep_rows(docs, first.select("row.doc_id", "row.text_hash"))
