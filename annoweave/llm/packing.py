"""Best-fit packing by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the histogram of piece lengths has
at most `capacity` entries however many pieces there are. The plan is made on that
histogram alone: large lengths are cut into groups of equal cardinality and rounded
up to their group's largest; bins of these few sizes are configured by
subset-sum patterns, each used as often as its sizes last; the actual lengths then
take their group's slots (a piece is never longer than its slot), and small lengths
fill the room that is left, longest first, each into the tightest bin. Bins with
equal contents are one entry with a count, so the plan has a bounded number of
entries. Each piece finds its place by its rank within its length; ranks come from
per-partition counts, so no length is gathered into one task.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoweave.llm.base import cut, in_small_batches, sliced, text_of

CAPACITY = 4096
#: (groups, longest small length as a share of the capacity): the plan with the fewest bins counts.
GROUPINGS = ((200, 1 / 8), (200, 1 / 4), (1000, 1 / 2))
END_ID = 1
#: A worker remembers the ids of so many words of each of two generations.
CACHE_WORDS = 300_000
#: Short pieces that aren't words, such as marks, that a worker remembers.
CACHE_PARTS = 50_000

_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("part", pa.int32()), ("nth", pa.int64()),
])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"

_tokenizers: dict[int, WordIds] = {}


# The pre-tokenizer pattern whose pieces never cross white space.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are the same in every Unicode normal form and have simple lower case.
_PLAIN_WORD = regex.compile(r"[!-~\xa1-\u012f\u0131-\u017f]+")
_PIECES = regex.compile(WORD_PIECES)
#: The same for words of printable ASCII, in lower case.
_PLAIN_BYTES = re.compile(rb"[!-~]+")
_BYTE_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_characters() -> dict[int, str]:
    """Byte-level BPE's characters for bytes: printable ones themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCache(dict):
    """Ids of words by their bytes; one that is missing is taken from the older generation or made."""

    def __init__(self, make: Callable[[bytes], bytes], older: dict[bytes, bytes]) -> None:
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, w: bytes) -> bytes:
        ids = self.older.get(w)
        if ids is None:
            ids = self.make(w)
        self[w] = ids
        return ids


class WordIds:
    """Token ids of whole texts by way of their words.

    Where the tokenizer drops white space and its pieces never cross it, a text's ids
    are its words' ids in order, remembered as little-endian 32-bit integers; common
    kinds of words go straight to its model. Any other tokenizer encodes whole texts.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.special = [t["content"].encode() for t in json.loads(definition).get("added_tokens") or []]
        self.by_word = self._drops_space(json.loads(definition))
        self.chars = byte_characters()
        self.bytes_of = [struct.pack("<I", i) for i in range(self.tok.get_vocab_size())]
        self.tokenize = self.tok.model.tokenize
        self.parts: dict[bytes, bytes] = {}
        self.seen = WordCache(self.word, {})

    @staticmethod
    def _drops_space(d: dict) -> bool:
        steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        forms = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers") or []]
        split = steps[0]
        return (
            forms == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and split.get("pattern") == {"Regex": WORD_PIECES}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and not any(steps[1].get(k) for k in ("add_prefix_space", "use_regex"))
        )

    def _packed(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def word(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters only
            return self._packed([k.id for k in self.tokenize(w.lower().decode())])
        if any(x in w for x in self.special):
            return self._packed(self.tok.encode(w.decode(), add_special_tokens=False).ids)
        if _PLAIN_BYTES.fullmatch(w):
            return b"".join(map(self._piece, _BYTE_PIECES.findall(w.lower())))
        t = w.decode("utf-8", "replace")
        if _PLAIN_WORD.fullmatch(t):
            return b"".join([self._piece(p.encode()) for p in _PIECES.findall(t.lower())])
        return self._packed(self.tok.encode(t, add_special_tokens=False).ids)

    def _piece(self, p: bytes) -> bytes:
        """Ids of one pre-token in lower case; those of words met by themselves are known already."""
        ids = self.seen.get(p) if p.isalpha() else self.parts.get(p)
        if ids is None:
            ids = self._packed([k.id for k in self.tokenize(p.decode("latin-1").translate(self.chars))])
            if len(p) <= 4 and len(self.parts) < CACHE_PARTS:
                self.parts[p] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids, each as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            out.append(b"".join(map(self.seen.__getitem__, t.encode("utf-8", "surrogatepass").split())))
            if len(self.seen) > CACHE_WORDS:  # words used again come over from the older generation
                self.seen = WordCache(self.word, dict(self.seen))
        return out


def word_ids(definition: str) -> WordIds:
    """A worker's tokenizer, kept from task to task."""
    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordIds(definition)
    return _tokenizers[key]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece; (part, nth) is its number within its length and partition.

    The vocabulary file is read on the driver and broadcast: its size doesn't grow with the data.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, nth, wide = word_ids(definition.value), TaskContext.get().partitionId(), Counter(), 4 * capacity
        for b in sliced(batches, 256):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist()), strict=True):
                raw += end
                for k, i in enumerate(range(0, len(raw), wide)):
                    own = raw[i : i + wide]
                    n = len(own) // 4
                    rows.append((doc, k, i // 4, n, zlib.crc32(own), part, nth[n]))
                    nth[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    return in_small_batches(docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))).mapInArrow(run, _PIECE_DDL)


def _patterns(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size index -> copies, times) that use up all counts: fullest pattern first for the largest size left."""
    left, out = counts[:], []
    while any(left):
        big = max(i for i, n in enumerate(left) if n)
        room = capacity - sizes[big]
        # how[r] = (size index, copies): a last step that reaches sum r with bounded copies
        how: list[tuple[int, int] | None] = [None] * (room + 1)
        how[0] = (-1, 0)
        for i in range(big, -1, -1):
            have = left[i] - (i == big)
            if have <= 0 or sizes[i] > room:
                continue
            before = [r for r, h in enumerate(how) if h is not None]
            for r in before:
                for c in range(1, min(have, (room - r) // sizes[i]) + 1):
                    if how[r + c * sizes[i]] is None:
                        how[r + c * sizes[i]] = (i, c)
        r = max(r for r, h in enumerate(how) if h is not None)
        use = Counter({big: 1})
        while r:
            i, c = how[r]
            use[i] += c
            r -= c * sizes[i]
        times = min(left[i] // c for i, c in use.items())
        for i, c in use.items():
            left[i] -= c * times
        out.append((dict(use), times))
    return out


def _runs(lengths: list[tuple[int, int]], at: int, n: int) -> list[tuple[int, int]]:
    """Items at..at+n of a run-length list, as runs."""
    out = []
    for length, c in lengths:
        take = min(max(0, c - at), n)
        if take:
            out.append((length, take))
        n -= take
        at = max(0, at - c)
        if not n:
            break
    return out


def plan_bins(hist: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of bin, [((length, copies), ...), times], that hold each length of hist as often as it occurs.

    Lengths above `small` are grouped.
    """
    large = sorted((x, n) for x, n in hist.items() if x > small and n)
    kinds: Counter[tuple[tuple[int, int], ...]] = Counter()
    if large:
        total, members, cum = sum(n for _, n in large), [[]], 0
        for x, n in large:  # a length stays in one group, so groups are equal up to one length's count
            if cum >= total * len(members) / groups:
                members.append([])
            members[-1].append((x, n))
            cum += n
        sizes, counts = [m[-1][0] for m in members], [sum(n for _, n in m) for m in members]
        longest_first = [m[::-1] for m in members]
        used = [0] * len(sizes)
        for use, times in _patterns(sizes, counts, capacity):
            slots = []
            for i, c in sorted(use.items(), reverse=True):
                for _ in range(c):
                    slots.append(_runs(longest_first[i], used[i], times))
                    used[i] += times
            at, pos = [0] * len(slots), [0] * len(slots)
            done = 0
            while done < times:  # stretches in which each slot holds one length
                step = min(s[a][1] - p for s, a, p in zip(slots, at, pos, strict=True))
                kinds[_kind(s[a][0] for s, a in zip(slots, at, strict=True))] += step
                done += step
                for j, s in enumerate(slots):
                    pos[j] += step
                    if pos[j] == s[at[j]][1]:
                        at[j], pos[j] = at[j] + 1, 0
    room: dict[int, Counter] = {}
    for kind, n in kinds.items():
        room.setdefault(capacity - sum(x * c for x, c in kind), Counter())[kind] += n
    open_rooms = sorted(room)
    for x, n in sorted(((x, n) for x, n in hist.items() if x <= small and n), reverse=True):
        while n:
            k = bisect.bisect_left(open_rooms, x)
            if k == len(open_rooms):  # no bin has room: open new ones
                r, kind, have = capacity, (), n
            else:
                r = open_rooms[k]
                kind, have = next(iter(room[r].items()))
            q = min(r // x, n)
            times = min(have, n // q)
            if r < capacity or kind:
                room[r][kind] -= times
                if not room[r][kind]:
                    del room[r][kind]
                if not room[r]:
                    del room[r]
                    open_rooms.pop(k)
            n -= q * times
            rest = r - q * x
            if rest not in room:
                room[rest] = Counter()
                bisect.insort(open_rooms, rest)
            room[rest][_kind([*(y for y, c in kind for _ in range(c)), *[x] * q])] += times
    return [(kind, n) for of in room.values() for kind, n in of.items()]


def best_plan(hist: dict[int, int], capacity: int = CAPACITY, groupings: tuple[tuple[int, float], ...] = GROUPINGS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    plans = [plan_bins(hist, capacity, groups, int(capacity * share)) for groups, share in groupings]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _kind(lengths) -> tuple[tuple[int, int], ...]:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def place_table(bins: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first bin, first offset), sorted: where each rank of a length goes."""
    rank: Counter[int] = Counter()
    rows, first = [], 0
    for kind, times in sorted(bins, reverse=True):
        at = 0
        for x, c in kind:
            rows.append((x, rank[x], c, first, at))
            rank[x] += c * times
            at += x * c
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces(length, part, nth, ...)."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").count()
    hist = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(place_table(best_plan(hist, capacity)))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    out = pa.schema([*(f for f in _PIECE if f.name not in ("part", "nth")), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, r0, copies, first, at = table.value.T
        key = (x << 44) + r0
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            j = rank - r0[k]
            seq, off = first[k] + j // copies[k], at[k] + (j % copies[k]) * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema=out)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A document is its token ids and then END_ID; only longer ones are cut, into
    capacity-sized pieces. Null text is empty (one token). Rows repeated with one id
    are packed each; an empty table gives no rows; other columns are ignored.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack_pieces(cut(tokenized_pieces(docs, tokenizer_path, capacity, id_col, text_col)), capacity)
