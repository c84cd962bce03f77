from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from annoweave.llm import alignment as X
from annoweave.llm import queries
from hypothesis import given, settings
from hypothesis import strategies as st

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


class Whole:
    """The tokenizers as their libraries have them."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        of = X.byte_characters()
        self.a_bytes = [bytes(of.get(c, 0) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.b_bytes = X.Tokenizers(A, B).b_bytes


@pytest.fixture(scope="module")
def tools():
    return Whole()


def whole(tools, text):
    """(groups, links as id pairs, n_a, n_b) from the definition, for the whole text at once."""
    none = ([], [], 0, 0)
    if not text:
        return none
    a = tools.a.encode(" " + text, add_special_tokens=False).ids
    b = tools.b.encode(text)
    spans = []
    for ids, of in ((a, tools.a_bytes), (b, tools.b_bytes)):
        if b"".join(of[i] for i in ids) != (" " + text).encode():
            return none
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(of[i]), i))
            at += len(of[i])
        spans.append(own)
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, start = [], 0
    for e in ends:
        groups.append(tuple([i for s, t, i in own if s >= start and t <= e] for own in spans))
        start = e
    links = [(i, j) for s, t, i in spans[0] for u, v, j in spans[1] if max(s, u) < min(t, v)]
    return groups, links, len(a), len(b)


def brute(tools, rows):
    done = [(i, whole(tools, t)) for i, t in rows]
    count = Counter(x for _, (_, links, _, _) in done for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, (groups, links, n_a, n_b) in done:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


ODD = [
    (1, "Hello world, hello wörld!"), (1, "Hello world, hello wörld!"), (2, None), (3, ""), (4, " "), (5, "\n\n x  y \t z "), (6, "a▁b"), (None, "no id <|endoftext|> <s> </s> <unk> <0x41>"),
    (7, "日本語 と 🙂🙂 é"), (8, "x" * 3000), (9, "word " * 500), (10, "\x00 \x1c a \xa0 b　c"), (-5, "trailing  "), (1, "another text of id 1"),
]


def test_odd_rows_against_brute_force(spark, tools):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, block int")
    assert rows_of(X.align(docs, A, B)) == sorted(map(repr, brute(tools, ODD)))
    # blocks of a few stretches: counts still are the corpus's
    assert rows_of(X.align(docs, A, B, block=4)) == sorted(map(repr, brute(tools, ODD)))


def test_query_against_brute_force(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [(i, t) for i, t in docs if len(t or "") < 500]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert rows_of(X.align(df, A, B)) == sorted(map(repr, brute(tools, short)))
    got = queries.op11_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: r for r in got.collect()}
    assert set(got) == {i for i, _ in docs}
    sizes = {i: whole(tools, t) for i, t in short[:40]}
    assert all((got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links) == (a, b, len(g), len(x)) for i, (g, x, a, b) in sizes.items())


def test_groups_are_texts_on_request_and_pairs_a_table(spark, tools):
    docs = spark.createDataFrame([(1, "unbelievable things")], "doc_id long, text string")
    groups, links, _, _ = whole(tools, "unbelievable things")
    assert X.align(docs, A, B, keep_groups=True).first().groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert {(r.a_id, r.b_id): r.n for r in X.pair_table(docs, A, B).collect()} == Counter(links)


def test_empty_table(spark):
    assert X.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_a_hot_text_and_a_very_long_one(spark, tools):
    rows = [(i, "the same words again") for i in range(300)] + [(1000, " ".join(f"w{i}" for i in range(30_000)))]
    got = {r.doc_id: r for r in X.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), A, B).collect()}
    groups, links, n_a, _ = whole(tools, "the same words again")
    assert all(got[i].n_links == len(links) and got[i].count_sum >= 300 * len(links) for i in range(300))
    assert len(got) == 301 and got[1000].n_a > 30_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab  ñ.\n\t'  1日🙂<s>_-▁"), max_size=40) | st.text(max_size=20), min_size=1, max_size=4))
def test_stretches_are_independent(texts):
    own = test_stretches_are_independent
    own.tools = getattr(own, "tools", None) or (X.Tokenizers(A, B), Whole())
    tools, plain = own.tools
    texts = [t for t in texts if t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    divided = [tools.stretches(t) for t in texts]
    assert ["".join(d) for d in divided] == [" " + t for t in texts]
    parts = [p for d in divided for p in d]
    if not parts:
        return
    found = tools.solve(parts)
    at, links = 0, np.concatenate([[0], np.cumsum(found.counts[:, 3])])
    for t, d in zip(texts, divided, strict=True):
        groups, pairs, n_a, n_b = whole(plain, t)
        to = at + len(d)
        if not found.ok[at:to].all():
            assert not groups
        else:
            assert found.counts[at:to].sum(0).tolist() == [n_a, n_b, len(groups), len(pairs)]
            assert found.links[links[at] : links[to]].tolist() == [a * tools.width + b for a, b in pairs]
            assert "".join(found.texts[at:to])[:-1] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        at = to


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    want = list(range(n))
    for _ in range(n):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert X.union_find(n, u, v).tolist() == want


def test_a_task_that_forgets_gives_the_same(spark, tools):
    got = X.aligned_blocks(spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1), A, B, remembered=1)
    assert got.count() == 1  # the documents of one slice stay together
    assert sum(len(X._unpacked(r.stretches)[0]) for r in got.collect()) == len(ODD)
