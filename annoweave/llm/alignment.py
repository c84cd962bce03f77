"""Alignment of two tokenizers' tokens by union-find over the graph of overlapping tokens.

A byte-level BPE (A) and a piece vocabulary (B) cut the same bytes, a space and the text.
Tokens of A and of B are the two sides of a graph; an edge, a link, joins those whose
bytes overlap. Its connected components, found by union-find, are exactly the least groups
of tokens that both cut at the same two places; a component's members expand into its links.

In both vocabularies a space that follows a word begins a token. So a text falls into
stretches from one such space to the next whose graphs have no edge between them, and
equal stretches have equal graphs: each task solves a stretch once and remembers it.

How often a pair of ids is linked is counted over the corpus. Documents are taken in
blocks; a block holds its distinct pairs, its stretches as lists of pairs and its
documents as lists of stretches, compressed and stored. The pairs of the blocks are
counted in Spark, and each block gets the counts of its own pairs back; no table of all
pairs is ever in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoweave.llm.base import cut, in_small_batches, sliced, text_of

#: Stretches of the documents of one block, about; a document is never divided.
BLOCK = 1 << 21
#: Different stretches, and characters of them, that a task remembers; then its block ends and it forgets them.
REMEMBERED, CHARACTERS = 1 << 19, 16 << 20

#: How the byte-level vocabulary cuts a text before its merges. Fixed value: the public vocabulary's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A stretch begins at a space after a word, if a word follows; where spaces stand alone between words that is every space.
_BEGINS, _ODD = re.compile(r"(?<=\S)(?= +\S)"), re.compile(r"\s | \s| $")
_BLOCK_ROW = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("stretches", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_DOC = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])
_DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    # Bytes that stand for themselves; the others have the characters from 256, in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in A and in B, and ends, of all overlaps of two tokens' byte ranges, in order; both sides cover the same bytes."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs are merged
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends  # each piece between two ends is the overlap of one pair
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), ends


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components under the edges (u, v).

    All edges that join two components are taken at once: the greater root is put under the
    least root that it meets, and all paths are shortened to their roots.
    """
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


class Tokenizers:
    """Both tokenizers, and how stretches are solved."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken
        import tokenizers

        held = tokenizers.Tokenizer.from_file(byte_bpe)
        of = byte_characters()
        ranks = {bytes(of[c] for c in token): i for token, i in held.get_vocab(with_added_tokens=False).items()}
        #: The same vocabulary: its ids are the ranks of its merges.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.width = max(ranks.values()) + 1, len(named)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.a_length = np.zeros(self.a_size, np.int64)
        self.a_length[list(ranks.values())] = [len(t) for t in ranks]
        self.b_length = np.array([len(t) for t in self.b_bytes])
        #: Whether no piece goes on over a space that follows something else; else texts are one stretch each.
        self.divisible = not any(re.search("[^▁]▁", p) for p in named)
        # an id as it is shown, at its even place, and the last one of its side of a group, at the next
        self.shown = [f"{i}{end}" for n, last in ((self.a_size, "|"), (self.width, ";")) for i in range(n) for end in (",", last)]
        self.shown_length = np.array([len(x) for x in self.shown])

    def stretches(self, text: str) -> list[str]:
        """A space and the text, divided."""
        if not self.divisible:
            return [" " + text]
        if _ODD.search(text) or text[0] == " ":
            return _BEGINS.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def _encoded(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, B's ids, B's ids a stretch, bytes of a stretch, whether B gives it back), one stretch after the other."""
        raw = [s.encode() for s in some]
        if all(s[-1].strip() for s in some) and self.divisible:
            a = self.a.encode_ordinary("".join(some))
        else:  # what ends in white space would go on in the next one
            a = list(chain.from_iterable(map(self.a.encode_ordinary, some)))
        b = self.b.encode([s[1:] for s in some], num_threads=1)
        flat, held = list(chain.from_iterable(b)), np.array(list(map(len, b)), np.int64)
        ids = np.array(flat, np.int64)
        size = np.array(list(map(len, raw)), np.int64)
        ok = _sums(self.b_length[ids], np.cumsum(held)) == size
        if not ok.all() or b"".join(map(self.b_bytes.__getitem__, flat)) != b"".join(raw):
            ok = np.array([b"".join([self.b_bytes[i] for i in own]) == r for own, r in zip(b, raw, strict=True)])
        return np.array(a, np.int64), ids, held, size, ok

    def solve(self, some: list[str]) -> Solved:
        a, b, held, size, ok = self._encoded(some)
        ends = np.cumsum(size)
        a_ends = np.cumsum(self.a_length[a])
        if not ok.all():  # B's tokens of a stretch that it doesn't give back are left out: its links are never looked at
            a_ok, b_ok = ok[np.searchsorted(ends, a_ends)], np.repeat(ok, held)
            a, b, size = a[a_ok], b[b_ok], np.where(ok, size, 0)
            ends, a_ends = np.cumsum(size), np.cumsum(self.a_length[a])
        b_ends = np.cumsum(self.b_length[b])
        i, j, both_ends = overlaps(a_ends, b_ends)
        n_a, n_b = len(a), len(b)
        root = union_find(n_a + n_b, i, n_a + j)
        first = root[:n_a] == np.arange(n_a)  # a component's root is its first token of A
        group = np.cumsum(first) - 1
        of_a, of_b = group[root[:n_a]], group[root[n_a:]]
        # A's tokens of a group, then B's, group by group
        counts_a, counts_b = np.bincount(of_a, minlength=first.sum()), np.bincount(of_b, minlength=first.sum())
        upto_a, upto_b = np.cumsum(counts_a), np.cumsum(counts_b)
        codes = np.empty(n_a + n_b, np.int64)
        codes[np.arange(n_a) + (upto_b - counts_b)[of_a]] = 2 * a
        codes[np.arange(n_b) + upto_a[of_b]] = 2 * (self.a_size + b)
        codes[upto_a + upto_b - counts_b - 1] += 1
        codes[upto_a + upto_b - 1] += 1
        text = "".join(map(self.shown.__getitem__, codes.tolist()))
        # every count by stretch: how many tokens, groups and links end up to its end
        group_ends = b_ends[upto_b - 1]
        tokens = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, group_ends, both_ends)]
        upto_text = np.concatenate([[0], np.cumsum(self.shown_length[codes])])[tokens[0] + tokens[1]]
        texts = [text[x:y] for x, y in zip([0, *upto_text.tolist()], upto_text.tolist(), strict=False)]
        return Solved(ok, np.stack([np.diff(t, prepend=0) for t in tokens], 1), texts, a[i] * self.width + b[j])


@cache
def tokenizers_of(byte_bpe: str, pieces: str) -> Tokenizers:
    """Loaded once a worker."""
    return Tokenizers(byte_bpe, pieces)


class Solved:
    """Solved stretches: whether B gives each back, its counts of tokens, groups and links, its groups as text, and all links as pair keys."""

    def __init__(self, ok: np.ndarray, counts: np.ndarray, texts: list[str], links: np.ndarray) -> None:
        self.ok, self.counts, self.texts, self.links = ok, counts, texts, links


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, each after its length."""
    flat = b"".join(np.int64(len(x)).tobytes() + np.asarray(x, np.int32).tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(flat)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    flat, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    while at < len(flat):
        n = int(np.frombuffer(flat, np.int64, 1, at)[0])
        out.append(np.frombuffer(flat, np.int32, n, at + 8))
        at += 8 + 4 * n
    return out


def _table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(t)
    return sink.getvalue().to_pybytes()


class Known:
    """The stretches that a task remembers, by number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ok: list[bool] = []
        self.all_ok = True
        self.texts: list[str] = []
        self.counts: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        self.links: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.characters = 0

    def learn(self, tools: Tokenizers, some: list[str]) -> None:
        if some:
            found = tools.solve(some)
            self.number.update(zip(some, range(len(self.ok), len(self.ok) + len(some)), strict=True))
            self.ok += found.ok.tolist()
            self.all_ok = self.all_ok and bool(found.ok.all())
            self.texts += found.texts
            self.counts.append(found.counts)
            self.links.append(found.links)
            self.characters += sum(map(len, some))

    def full(self, most: int) -> bool:
        return len(self.ok) >= most or self.characters >= CHARACTERS


class Block:
    """The documents of a block while it is filled, as numbers of stretches."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.groups: list[str] = []
        self.held: list[list[int]] = []
        self.size = 0

    def add(self, doc_id: int | None, parts: list[str], known: Known, keep_groups: bool) -> None:
        """A document with its stretches; without tokens if B doesn't give one of them back."""
        numbers = list(map(known.number.__getitem__, parts))
        if not (known.all_ok or all(map(known.ok.__getitem__, numbers))):
            numbers = []
        shown = "".join(map(known.texts.__getitem__, numbers))[:-1]
        self.groups.append(shown if keep_groups or not shown else hashlib.sha256(shown.encode()).hexdigest())
        self.ids.append(doc_id)
        self.held.append(numbers)
        self.size += len(numbers)

    def row(self, number: int, known: Known) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in self.held], np.int64)
        uses, in_docs = np.unique(np.fromiter(chain.from_iterable(self.held), np.int64, self.size), return_inverse=True)
        counts, links = np.concatenate(known.counts), np.concatenate(known.links)
        sizes, starts = counts[uses, 3], (np.cumsum(counts[:, 3]) - counts[:, 3])[uses]
        keys = links[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        pairs, place = np.unique(keys, return_inverse=True)
        times = np.bincount(place, np.repeat(np.bincount(in_docs, minlength=len(uses)), sizes), len(pairs)).astype(np.int64)
        ends = np.cumsum(lengths)
        sums = [_sums(counts[uses, c][in_docs], ends) for c in range(4)]
        docs = pa.table([pa.array(self.ids, pa.int64()), *[pa.array(s) for s in sums], pa.array(self.groups, pa.string())], names=["doc_id", *_COUNTS, "groups"])
        cells = [[number], [_table(docs)], [_packed(lengths, in_docs, sizes, place)], [pairs.tobytes()], [times.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _BLOCK_ROW, strict=True)], schema=_BLOCK_ROW)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end before `ends`; runs may be empty."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(upto[np.concatenate([[0], ends]).astype(np.int64)])


def aligned_blocks(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = False, block: int = BLOCK, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, docs, stretches, pairs, times): whole documents in blocks of about `block` stretches, solved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, known, now, made = tokenizers_of(byte_bpe, pieces), Known(), Block(), TaskContext.get().partitionId() << 32
        for b in sliced(batches, 256):
            divided = [tools.stretches(t) if t else [] for t in b.column(1).to_pylist()]
            known.learn(tools, list({p for parts in divided for p in parts if p not in known.number}))
            for doc_id, parts in zip(b.column(0).to_pylist(), divided, strict=True):
                now.add(doc_id, parts, known, keep_groups)
            if now.size >= block or known.full(remembered):
                yield now.row(made, known)
                known, now, made = Known() if known.full(remembered) else known, Block(), made + 1
        if now.ids:
            yield now.row(made, known)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return in_small_batches(plain).mapInArrow(run, "block long, docs binary, stretches binary, pairs binary, times binary")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, times) of stored blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pairs, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array(keys), pa.array(np.frombuffer(times, np.int64))], names=["block", "pair", "times"])

    return blocks.select("block", "pairs", "times").mapInArrow(run, "block long, pair long, times long")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked, and whether none of its B id's pairs is linked more often.

    A pair's key is its A id times `width` plus its B id.
    """
    total = rows.groupBy("pair").agg(F.sum("times").alias("n"))
    most = total.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("n").alias("most"))
    most = F.broadcast(most)  # at most a row an id of B's vocabulary
    return total.join(most, F.pmod("pair", F.lit(width)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _told(held: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block, with what its pairs' counts sum up to."""
    out = []
    for k in range(held.num_rows):  # one
        docs = pa.ipc.open_stream(held["docs"][k].as_py()).read_all()
        lengths, in_docs, sizes, place = _unpacked(held["stretches"][k].as_py())
        order = np.argsort(counts["pair"].to_numpy())
        links = np.cumsum(sizes)
        sums = []
        for c in ("best", "n"):
            of_pair = counts[c].to_numpy().astype(np.int64)[order]
            sums.append(pa.array(_sums(_sums(of_pair[place], links)[in_docs], np.cumsum(lengths))))
        out.append(pa.table([docs["doc_id"], *[docs[c] for c in _COUNTS], *sums, docs["groups"]], schema=_DOC))
    return pa.concat_tables(out) if out else _DOC.empty_table()


def align(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = False, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens of both kinds, their groups and links.

    byte_bpe and pieces are the files of the two tokenizers, on every machine. A
    document's text is encoded whole, without special tokens; their strings are plain
    text. Null and empty texts, and texts that one of the tokenizers doesn't give back
    byte by byte, have no tokens: counts are 0 and groups is ''. Repeated rows stay
    repeated and count each; a null id stays null; an empty table gives no rows; other
    columns are ignored. A very long text costs memory in proportion to it, is never cut
    and is in one block.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's
    most frequent), count_sum (of the links' pairs) and groups: the groups' ids such as
    `a1,a2|b1;a3|b2,b3`, with keep_groups as that text, else as its SHA-256.
    """
    blocks = cut(aligned_blocks(docs, byte_bpe, pieces, keep_groups, block, id_col=id_col, text_col=text_col))
    rows = block_pairs(blocks)
    counted = rows.select("block", "pair").join(pair_counts(rows, tokenizers_of(byte_bpe, pieces).width), "pair")
    return blocks.select("block", "docs", "stretches").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_told, _DOC_DDL)


def pair_table(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n, best): the corpus's linked pairs of ids, for a map from one vocabulary to the other."""
    width = tokenizers_of(byte_bpe, pieces).width
    counts = pair_counts(block_pairs(cut(aligned_blocks(docs, byte_bpe, pieces, id_col=id_col, text_col=text_col))), width)
    return counts.select(F.floor(F.col("pair") / width).alias("a_id"), F.pmod("pair", F.lit(width)).alias("b_id"), "n", "best")
