"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the hashes of its distinct word shingles, in an order that is the same
everywhere: the commonest tokens of a sample of texts last, else by value. Any order gives all
links; this one keeps passages that many documents share out of most prefixes. A set of n tokens that is linked to another lacks at most d = n - ceil(n * percent /
100) of its own there, so of its first d + 1 tokens one is common to both, and lies in the
other's first tokens too. Single tokens are signatures of that kind; a frequent token is a
bad one, as all its documents meet. So tokens are classed by how many sets hold them: of
class k, signatures are combinations of k tokens. To keep these few, a class's tokens are
dealt into groups by value, and only tokens of one group are combined. As up to k - 1
common tokens of a group make no signature, prefixes are extended until the tokens that
count (all of class 1, from the k-th on in each group of class k) are d + 1; then a
signature of both is the same. Groups are as many as fit the sets' sizes: sizes fall into
classes such that linked ones are at most one apart, and a set signs for its own and the
next one. What is never common (a token of one set's prefix only) counts but isn't indexed.

Sets that share a signature are verified. Equal sets are one set; and no group of n copies
gives n * n pairs: as long as many pairs of a signature's sets aren't in one component yet,
all of its sets are compared with one of them and what links is joined, then with another
one; then all pairs that are left are compared. So no link between components is
lost, and a pair inside a component isn't asked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import TASK_BYTES, cut, few, in_small_batches, mix64, row_hash, shuffles_freed, sliced, text_of
from annoweave.llm.components import connected_components

#: Words of a shingle and least similarity, by default.
WORDS, PERCENT = 5, 80
#: (tokens that are combined, least number of sets that hold such a token, tokens of a group on average).
CLASSES = ((2, 64, 4), (3, 1 << 16, 8))
#: One of how many texts is looked at for common tokens, how many of these a common one is in, and how many are kept: 8 MB.
SAMPLE, COMMON, KEPT = 16, 4, 1 << 20
#: Longs of a set's bitmap, by which most pairs that can't be linked are told apart before their tokens are moved.
MAPS = 8
BITMAP = [f"m{i}" for i in range(MAPS)]
#: Longs of a second, wide bitmap, looked at for pairs that the first one leaves: long sets fill the first.
WIDE = 64
#: Rows up to which the rows to leave out, or to read again, are broadcast: 32 MB at most.
BROADCAST_ROWS = 1 << 20
#: Rounds of comparing with one set of each signature at most, and pairs a signature's set that may be left after them.
ROUNDS, LEFT = 8, 4
#: Comparisons of one set that one task makes, about.
SPREAD = 4096

#: Odd, so that words before count otherwise than words after.
_FOLD = 0x9E3779B97F4A7C15

_MARKED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SIGNED = pa.schema([("sig", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("over", pa.bool_())])


def shingle_sets(texts: list[str], words: int = WORDS, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes): each text's distinct word shingles as unsigned hashes, in order, text after text.

    A text with fewer words has one shingle of all of them; one without words has none.
    Hashes have 63 bits; those among common, which is in order, have the bit above too.
    """
    held = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.fromiter(map(len, held), np.int64, len(held))
    own = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(held)), np.uint64, int(count.sum()))
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(held)), shingles)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    at, left = first + (np.cumsum(count) - count)[doc], np.minimum(count[doc] - first, words)
    hashes = np.zeros(len(doc), np.uint64)
    for k in range(words):
        there = left > k
        hashes[there] = mix64((hashes[there] * np.uint64(_FOLD)) ^ own[at[there] + k])
    hashes >>= np.uint64(1)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes[common[at] == hashes] |= np.uint64(1 << 63)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(doc[new], minlength=len(held)), hashes[new]


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def lacking(n: int, percent: int) -> int:
    """How many of its n tokens a set linked to it may lack."""
    return n - -(-n * percent // 100)


def depth(n: int, percent: int) -> int:
    """Tokens of a set that are looked at first: enough for most, however its tokens are classed. 0 for sets that only equal ones link to."""
    need = lacking(n, percent) + 1
    return 0 if 100 * n < percent * (n + 1) else min(n, need + need // 2 + 8)


@cache
def size_bounds(percent: int, most: int = 1 << 40) -> list[int]:
    """Least size of each size class; sizes of linked sets are in one class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return bounds


def group_counts(level: int, percent: int, classes: tuple = CLASSES) -> list[int]:
    """Groups of each class at a level: so few that a whole set of that level always has a signature with each set linked to it."""
    least = max(size_bounds(percent)[max(0, level - 1)], percent // (100 - percent))
    spare = (least - lacking(least, percent) - 1) // sum(k - 1 for k, _, _ in classes)
    return [max(1, min(least // c, spare)) for _, _, c in classes]


def _group(tokens: np.ndarray, groups: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def signatures(n: int, seen: int, pos: np.ndarray, tokens: np.ndarray, df: np.ndarray, percent: int, classes: tuple = CLASSES) -> np.ndarray | None:
    """A set's signatures; None if its first `seen` tokens aren't enough.

    pos, tokens and df: places, in order, of those among them that other sets have too,
    their values, and how many sets have them.
    """
    kind = np.ones(len(pos), np.int64)
    for k, least, _ in classes:
        kind[df >= least] = k
    need, out, longest = lacking(n, percent) + 1, [], 0
    level = bisect_right(size_bounds(percent), n) - 1
    for at in (level, level + 1) if (kind > 1).any() else (level,):
        counts, own = np.ones(seen, np.int64), []
        for (k, _, _), groups in zip(classes, group_counts(at, percent, classes), strict=True):
            of = np.flatnonzero(kind == k)
            g = _group(tokens[of], groups)
            counts[pos[of]] = np.arange(len(of)) - np.searchsorted(g, g) >= k - 1
            own.append((k, of, g))
        reached = np.cumsum(counts)
        if reached[-1] < need:
            if seen == n:
                raise AssertionError("a whole set has too few tokens that count")
            return None
        end = int(np.searchsorted(reached, need)) + 1
        longest = max(longest, end)
        for k, of, g in own:
            of, g = of[pos[of] < end], g[pos[of] < end]
            for part in np.split(of, np.flatnonzero(np.diff(g.astype(np.int64))) + 1):
                if len(part) >= k:
                    chosen = tokens[np.array(list(combinations(part.tolist(), k)))]
                    out.append(reduce(lambda h, c: mix64(h ^ c), chosen.T, np.full(len(chosen), 2 * at + 3, np.uint64)))
    out.append(mix64(tokens[(kind == 1) & (pos < longest)]))
    return np.unique(np.concatenate(out))


def _sign(percent: int, classes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            found = []
            flat, ends = b.column(1).values, b.column(1).offsets.to_numpy()  # of the whole column, also in a slice
            at, token, times = (flat.field(c).to_numpy() for c in range(3))
            for number, x, y in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                order = x + np.argsort(at[x:y])
                pos, df, tokens = at[order] >> 32, times[order], token[order].view(np.uint64)
                n, whole = int(at[x] & 0xFFFFFFFF) >> 1, bool(at[x] & 1)
                sigs = signatures(n, n if whole else depth(n, percent), pos, tokens, df, percent, classes)
                over = sigs is None
                sigs = np.zeros(1, np.uint64) if over else sigs
                found.append((sigs, np.full(len(sigs), number), np.full(len(sigs), n), np.full(len(sigs), over)))
            if found:
                sig, number, n, over = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(number), pa.array(n), pa.array(over)], schema=_SIGNED)

    return run


def common_tokens(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """The hashes, in order, of the tokens that most of the different texts of a sample by hash have; at most KEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            found, times = np.unique(shingle_sets(b.column(0).to_pylist(), words)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["token", "n"])

    some = docs.select(row_hash(text_col).alias("h"), text_of(text_col).alias("t")).filter(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"])
    counts = in_small_batches(some.select("t")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(KEPT).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def mark(docs: DataFrame, words: int, percent: int, common: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_hash, n, digest, prefix) of each row, stored. digest tells different sets apart; null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            sizes, hashes = shingle_sets(b.column(2).to_pylist(), words, common.value)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            digests = [xxhash.xxh3_128_digest(hashes[x:y].tobytes()) if y > x else None for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            depths = np.array([depth(n, percent) for n in sizes.tolist()], np.int64)
            place = np.arange(len(hashes)) - np.repeat(starts, sizes)
            prefixes = _lists(depths, hashes[place < np.repeat(depths, sizes)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), prefixes], schema=_MARKED)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("text_hash"), text_of(text_col).alias("t"))
    found = in_small_batches(plain).mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, prefix array<long>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _held(df: DataFrame, size: int) -> DataFrame:
    """df, which has so many bytes at most, broadcast if a task can hold them."""
    return F.broadcast(df) if size <= TASK_BYTES else df


def _bitmaps(own: np.ndarray, hashes: np.ndarray, sets: int, longs: int) -> np.ndarray:
    """A row of longs a set: whether an odd number of its hashes falls on each bit. Sets differ in as many hashes as their bitmaps in bits at least."""
    bit = own * 64 * longs + (hashes % np.uint64(64 * longs)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * longs * sets) & 1).astype(np.uint8)).view(np.int64).reshape(-1, longs)


def _place(whole: bool) -> Column:
    """A token's place in its set, with the set's size and whether all of the set's tokens are looked at, in one number."""
    return (F.col("pos").cast("long") * (1 << 32) + F.col("n") * 2 + int(whole)).alias("at")


def whole_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, words: int, common: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set, n, tokens, bitmap columns) of the wanted(set), read from their texts again and stored; one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in sliced(batches, 128):
            rows = dict(zip(*(c.to_pylist() for c in b.columns), strict=True))  # rows repeated with one id and text are one
            numbers = [x for x in rows if x not in done]
            done.update(numbers)
            sizes, hashes = shingle_sets([rows[x] for x in numbers], words, common.value)
            own = np.repeat(np.arange(len(numbers)), sizes)
            narrow, wide = _bitmaps(own, hashes, len(numbers), MAPS), _bitmaps(own, hashes // np.uint64(64 * MAPS), len(numbers), WIDE)
            columns = [pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), _lists(sizes, hashes), _lists(np.full(len(numbers), WIDE), wide.ravel()), *map(pa.array, narrow.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "n", "tokens", "wide", *BITMAP])

    keys = marked.join(wanted, F.col("row") == F.col("set"), "left_semi").select(F.col("row").alias("set"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    plain = docs.select(F.col(id_col).cast("long").alias("__own"), row_hash(text_col).alias("__of"), text_of(text_col).alias("t"))
    met = plain.join(_small(few(keys)[0]), (F.col("__of") == F.col("__hash")) & F.col("__own").eqNullSafe(F.col("__id"))).select("set", "t")
    found = cut(in_small_batches(met).mapInArrow(run, "set long, n long, tokens array<long>, wide array<long>, " + ", ".join(f"{m} long" for m in BITMAP)))
    alone = found.groupBy("set").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    return found if alone else cut(found.dropDuplicates(["set"]))  # rows repeated in several tasks


def signed_sets(docs: DataFrame, marked: DataFrame, firsts: DataFrame, words: int, percent: int, classes: tuple, common: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(sig, set, n), stored: the signatures that more than one set has, one of those that the same sets have. firsts(set) are one row of marked for each set."""
    spark = docs.sparkSession
    copies, _ = few(marked.filter(F.size("prefix") > 0).select("row").join(firsts, F.col("row") == F.col("set"), "left_anti"))
    tokens = marked.join(_small(copies), "row", "left_anti").select(F.col("row").alias("set"), "n", F.posexplode("prefix").alias("pos", "token")).select("token", "set", _place(False))
    while True:
        # counted and joined under one partitioning: a token is in few of a set's many rows, so none is in many of all
        dealt = tokens.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
        # both sides need all columns, or they would be dealt twice
        df = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("at").alias("__at"), F.max("set").alias("__set")).filter("df > 1 AND __at >= 0 AND __set >= 0").select("token", "df")
        held = dealt.join(df.hint("merge"), "token").groupBy("set").agg(F.collect_list(F.struct("at", "token", "df")).alias("held"))  # a set's own
        found = cut(held.mapInArrow(_sign(percent, classes), "sig long, set long, n long, over boolean"))
        more = cut(found.filter("over").select("set"))
        if more.isEmpty():
            break
        # these need more tokens than were looked at: now all of theirs are
        more = whole_sets(docs, marked, more, words, common, id_col, text_col).select("set", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "set", _place(True))
        tokens = tokens.join(_small(more.select("set").distinct()), "set", "left_anti").unionByName(more)
    # of signatures that the very same sets have, such as those of a passage or of two near copies, one is enough
    who = [F.bit_xor(F.xxhash64("set", F.lit(i))).alias(f"who{i}") for i in range(2)]
    shared = found.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), *who).filter("times > 1")
    shared = shared.groupBy("times", "who0", "who1").agg(F.min("sig").alias("sig")).select("sig")
    return cut(found.select("sig", "set", "n").join(shared, "sig"))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs(a, b) whose similarity is percent at least, stored."""
    both = F.col("a_n") + F.col("b_n")
    least = F.ceil(both * percent / F.lit(100 + percent))
    likely, rows = few(pairs)
    if not rows:
        return likely
    # a set that is compared with very many gets several rows, so that these are spread over tasks
    many = likely.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / F.lit(SPREAD)).alias("salts"))
    asked = lambda: _small(few(likely.select(F.explode(F.array("a", "b")).alias("set")).distinct())[0])
    some, size = sets.select("set", "n", "wide").join(asked(), "set", "left_semi"), 2 * rows * 8 * WIDE
    other = lambda c: _held(some.select(F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")), size)
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    likely, rows = few(likely.join(other("a"), "a").join(other("b"), "b").filter(differ <= both - 2 * least).select("a", "b", both.alias("tokens")))
    if not rows:
        return likely.select("a", "b")
    size = 8 * likely.agg(F.sum("tokens")).first()[0]
    sets = sets.select("set", "tokens").join(asked(), "set", "left_semi")  # only these sets' tokens are moved
    own, others = (_held(sets.select(F.col("set").alias(c), F.col("tokens").alias(f"{c}_tokens")), size) for c in ("a", "b"))
    if size <= TASK_BYTES:
        met = likely.select("a", "b").join(own, "a")
    else:
        spread = many.join(own, "a").select("a", "a_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        met = likely.join(many, "a").select("a", "b", F.pmod(F.hash("b"), F.col("salts")).cast("long").alias("salt")).join(spread, ["a", "salt"])
    met = met.join(others, "b")
    common, all_ = F.size(F.array_intersect("a_tokens", "b_tokens")), F.size("a_tokens") + F.size("b_tokens")
    return few(met.filter(100 * common.cast("long") >= percent * (all_ - common)).select("a", "b"))[0]


def _contracted(comps: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """(node, component), stored: comps with the links (a, b) between them; as it was where there are none."""
    if edges.isEmpty():
        return comps
    if comps is None:
        return few(connected_components(edges))[0]
    named, known = edges, _small(comps)
    for side in ("a", "b"):
        named = named.join(known.select(F.col("node").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    more = few(connected_components(named))[0]
    moved = comps.join(_small(more).select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return few(moved.unionByName(more.join(known.select("node"), "node", "left_anti")))[0]


def _open(signed: DataFrame, comps: DataFrame | None) -> DataFrame:
    """signed with each set's component, stored; only signatures of more than one component stay."""
    if comps is None:
        return signed.withColumn("comp", F.col("set"))
    named = signed.join(_small(comps).withColumnRenamed("node", "set"), "set", "left").select("sig", "set", "n", *BITMAP, F.coalesce("component", "set").alias("comp"))
    mixed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    return cut(named.join(mixed, "sig"))


def _pairs(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of sets that meet in a signature, in different components, of sizes and bitmaps that fit; a < b.

    Bitmaps are compared while joining, so that of a large group whose sets aren't alike no pairs are made. Rows have
    them, or get them from sets.
    """
    both = F.col("l.n") + F.col("r.n")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"l.{m}").bitwiseXOR(F.col(f"r.{m}"))) for m in BITMAP])
    fits = _sizes_fit(F.col("l.n"), F.col("r.n"), percent) & (differ <= both - 2 * F.ceil(both * percent / F.lit(100 + percent)))
    left, right = (df if BITMAP[0] in df.columns else df.join(sets.select("set", *BITMAP), "set") for df in (left, right))
    met = left.alias("l").join(right.alias("r"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.comp") != F.col("r.comp")) & fits)
    return met.select(F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")).distinct()


def join_sets(signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the sets that are linked to another one; None if there are none. Sets that are linked share a signature."""
    # dealt by signature once, with what is compared, so that a round needs no more shuffles for it
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = cut(signed.join(sets.select("set", *BITMAP), "set").repartition(parts, "sig"))
    comps, open_, before = None, signed, float("inf")
    for n in range(ROUNDS):
        open_ = _open(signed if n == 0 else open_, comps)
        by_comp = open_.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
        many = F.col("c").cast("double")
        left = by_comp.groupBy("sig").agg(F.sum(many).alias("all"), F.sum(many * many).alias("inside")).agg(F.sum(F.col("all") * F.col("all") - F.col("inside")) / 2, F.sum("all")).first()
        if not left[1]:
            return comps
        if left[0] <= LEFT * left[1] or left[0] > 0.9 * before:
            break
        before = left[0]
        one = open_.groupBy("sig").agg(F.min_by(F.struct("set", "n", "comp", *BITMAP), F.xxhash64("set", F.lit(n))).alias("x")).select("sig", "x.*")
        new = linked(_pairs(open_, one, sets, percent), sets, percent)
        if new.isEmpty():
            break
        comps = _contracted(comps, new)
        open_ = open_.drop("comp")
    else:
        open_ = _open(open_, comps)
        by_comp = open_.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
    # in each signature the largest component's sets meet the others, and these each other; none meets its own component's
    most = by_comp.groupBy("sig").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
    told = open_.join(most, "sig")
    rest = _pairs(told.filter("comp <> most"), told, sets, percent)
    return _contracted(comps, linked(rest, sets, percent))


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, classes: tuple = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's number of distinct shingles, and its component of links.

    Two rows are linked if 100 * common >= percent * all of their sets' tokens; percent is
    80 to 100. Texts (null: empty) are lower-cased in A-Z and split at ASCII white space;
    fewer words than a shingle make one of them all, none make an empty set, which is linked
    with nothing. component_id is the smallest id that can be reached over links; a row
    with a null id is in its component but never names it, and where all ids are null
    component_id is null. Repeated rows stay repeated; rows of one id with different texts
    are different sets. A very long text costs memory in proportion to it and is never
    cut. An empty table gives no rows; other columns are ignored.

    Returns doc_id, n_shingles, component_id, text_hash.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    with shuffles_freed(docs.sparkSession):
        common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, words, text_col))  # 8 MB at most
        marked = mark(docs, words, percent, common, id_col, text_col)
        firsts = cut(marked.filter("n > 0").groupBy("digest").agg(F.min("row").alias("set"), F.min("doc_id").alias("least")))
        signed = signed_sets(docs, marked, firsts.select("set"), words, percent, classes, common, id_col, text_col)
        sets = whole_sets(docs, marked, signed.select("set").distinct(), words, common, id_col, text_col)
        comps = join_sets(signed, sets, percent)
    # a partial minimum for each set, then for each component: no group is gathered
    own = firsts.withColumn("component", F.col("set")) if comps is None else firsts.join(comps, F.col("set") == F.col("node"), "left")
    own = own.select("digest", "least", F.coalesce("component", "set").alias("comp"))
    named = own.join(own.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select(F.col("digest").alias("d"), "component_id")
    shown = lambda df, c: df.select("doc_id", F.col("n").alias("n_shingles"), F.col(c).alias("component_id"), "text_hash")
    return shown(marked.join(named, F.col("digest") == F.col("d")), "component_id").unionByName(shown(marked.filter("n = 0"), "doc_id"))


def oracle_sql(words: int, percent: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + {words - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON a = p.r JOIN n q ON b = q.r WHERE 100 * x >= {percent} * (p.n + q.n - x)),
t AS (SELECT r, r AS x FROM w UNION SELECT t.r, e.b FROM t JOIN e ON t.x = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM w LEFT JOIN n USING (r) JOIN t USING (r) JOIN w o ON t.x = o.r GROUP BY w.r, w.doc_id, n.n"""
