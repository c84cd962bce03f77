from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from annoweave.llm import packing as X
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 12), st.integers(0, 64))
def test_plan_holds_every_length_once(lengths, groups, small):
    hist = Counter(lengths)
    plan = X.plan_bins(hist, 64, groups, small)
    used = Counter()
    for kind, times in plan:
        assert times > 0 and sum(x * c for x, c in kind) <= 64
        for x, c in kind:
            used[x] += c * times
    assert used == hist


def test_plan_is_close_to_the_least():
    rng = np.random.default_rng(0)
    hist = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1).tolist())
    least = -(-sum(k * v for k, v in hist.items()) // 4096)
    plan = X.best_plan(hist)
    assert sum(n for _, n in plan) <= 1.002 * least
    assert len(plan) < 20_000


def test_words_make_the_ids_of_the_text():
    exact, quick = Tokenizer.from_file(PATH), X.WordIds(open(PATH, encoding="utf-8").read())
    for t in ["Hello World", "", " \n", "don't é İSTANBUL ΣΑΣ\x1cq 12ab　日本", "a<|startoftext|> b\u0085c <|endoftext|>", "é x", "word " * 3000]:
        assert np.frombuffer(quick.encode([t])[0], "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids


def test_odd_words_and_other_tokenizers():
    exact, quick = Tokenizer.from_file(PATH), X.WordIds(open(PATH, encoding="utf-8").read())
    assert quick.by_word
    rng = np.random.default_rng(3)
    kinds = [(0x21, 0x7F), (0x80, 0x180), (0x27, 0x28), (0x300, 0x3FF), (0x2000, 0x2100)]
    for _ in range(3000):
        t = "".join(chr(rng.integers(*kinds[rng.integers(len(kinds))])) for _ in range(rng.integers(1, 9)))
        assert np.frombuffer(quick.encode([t])[0], "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, ascii(t)
    other = public_tokenizers.path("byte_bpe_50k.json")
    exact, whole = Tokenizer.from_file(other), X.WordIds(open(other, encoding="utf-8").read())
    assert not whole.by_word
    assert np.frombuffer(whole.encode(["Some  text\n here"])[0], "<u4").tolist() == exact.encode("Some  text\n here", add_special_tokens=False).ids


def test_word_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(X, "CACHE_WORDS", 3)
    exact, quick = Tokenizer.from_file(PATH), X.WordIds(open(PATH, encoding="utf-8").read())
    for t in ["a b c d e", "c d f g", "a g h", "a b c d e f g h"] * 2:
        assert np.frombuffer(quick.encode([t])[0], "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    exact = Tokenizer.from_file(PATH)
    texts = ["some words here " * n for n in (0, 1, 5, 40, 700, 3000)] * 3 + [None, "", "x"]
    docs = spark.createDataFrame([(i % 17, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 5)], "doc_id long, text string, offset int").repartition(5)
    rows = X.pack(docs, PATH).collect()
    want = Counter()
    for i, t in [(i % 17, t) for i, t in enumerate(texts)] + [(None, "null id")]:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_empty_table(spark):
    assert X.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
