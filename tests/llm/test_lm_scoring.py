from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from annoweave.llm import lm_scoring as X

DDL = "doc_id long, text string, block string, score int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(40)]
    out = [(i, " ".join(rng.choice(words[: 5 + i % 36]) for _ in range(rng.randrange(60)))) for i in range(300)]
    return [*out, (300, None), (300, ""), (None, "W1 W2"), (301, "only\x0bonce\tévér  W1"), (302, "W1 " * 30_000)]


def brute(rows, weights):
    """Scores with the given weights, straight from the definition."""
    toks = [(i, (t or "").encode().lower().split()) for i, t in rows]
    learned = [w for i, w in toks if i is not None and zlib.crc32(str(i).encode()) % 10]
    c1, c2 = Counter(), Counter()
    for w in learned:
        seq = ["<s>", *w, "</s>"]
        c1.update(seq)
        c2.update(zip(seq, seq[1:], strict=False))
    total, types = sum(c1.values()) - c1["<s>"], len(c1) - 1
    out = []
    for i, w in toks:
        seq, base, score = ["<s>", *w, "</s>"], 0.0, 0.0
        for h, x in zip(seq, seq[1:], strict=False):
            base += math.log10((c1[x] + 0.1) / (total + 0.1 * (types + 1)))
            l0, l1, l2 = weights[int(X.bucket_of(np.array([c1[h]]))[0])]
            if not c1[h]:
                l1, l2 = l1 + l2, 0
            score += math.log10(l0 / (types + 1) + l1 * c1[x] / total + (l2 * c2[h, x] / c1[h] if c1[h] else 0))
        out.append((i, len(w) + 1, sum(c1[x] > 0 for x in seq[1:]), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows, monkeypatch):
    held = []
    learn = X.learn_weights
    monkeypatch.setattr(X, "learn_weights", lambda *a: held.append(learn(*a)) or held[-1])
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DDL)
    found = {}
    for size in (1 << 20, 3000):
        got = X.lm_scores(docs, block_bytes=size, range_tokens=size // 8, min_list=4).collect()
        found[size] = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr)
    assert found[1 << 20] == brute(rows, held[0])
    assert found[3000] == found[1 << 20]
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None}


def test_probabilities_sum_to_one():
    cells = [(b, 10.0, [1 / 11, 0.2, 0.5 if b else 0.0]) for b in range(0, X.BUCKETS, 3)]
    w = X.learn_weights(cells, 2)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    at = X._weights_at(w, np.array([[0.0], [1.0], [100.0]]))
    assert np.allclose(at.sum(1), 1) and at[0, 2] == 0


def test_weights_rise_the_held_out_likelihood():
    cells = [(3, 50.0, [0.001, 0.01, 0.4]), (3, 50.0, [0.001, 0.05, 0.0])]
    w = X.learn_weights(cells, 2)[3]
    of = lambda v: sum(n * math.log(sum(a * b for a, b in zip(p, v, strict=True))) for _, n, p in cells)
    assert of(w) > of([1 / 3] * 3)


def test_trigrams_and_packing_of_integers(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DDL)
    assert X.lm_scores(docs, order=3, block_bytes=4000).count() == len(rows)
    for x in ([], [0], [1, 2**64 - 1, 7], list(range(1000))):
        assert X.unpack_ints(X.pack_ints(np.array(x, np.uint64))).tolist() == x


def test_rows_grow_with_blocks_and_not_with_their_square():
    """Lists, a row each, for corpora of 1 to 10,000,000 blocks of the default size: in proportion, and of MIN_LIST entries at least."""
    tokens, words = 1_000_000, 60_000
    for blocks in (1, 10, 1000, 100_000, 10_000_000):
        parts = X.key_ranges(tokens * blocks, words * blocks, blocks, 2)
        assert blocks * sum(parts) <= blocks * (tokens + words) / X.MIN_LIST
        assert blocks > 10**5 or tokens * blocks / parts[1] <= 1.01 * max(X.RANGE_TOKENS, tokens * X.MIN_LIST / 10)
    assert X.key_ranges(0, 0, 0, 3) == [1, 1, 1]
    # 100 TB in blocks of 64 MB: ranges stay at the size asked for
    tokens, blocks = 17 * 10**12, 100 * 10**12 // (64 << 20)
    assert tokens / X.key_ranges(tokens, 10**11, blocks, 2, range_tokens=26_000_000, min_list=16)[1] < 27_000_000


def test_lists_in_practice(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows for _ in range(3)], DDL).repartition(4)
    plain = docs.selectExpr("doc_id", "coalesce(text, '') AS t", "0 AS role")
    made = {}
    for size in (40_000, 10_000):
        blocks = plain.mapInArrow(X._encoder(size), X._BLOCK_DDL).cache()
        n, tokens, words = blocks.count(), *blocks.selectExpr("sum(n_tokens)", "sum(n_words)").first()
        parts = X.key_ranges(tokens, words, n, 2, range_tokens=1000, min_list=16)
        asked = blocks.select("block", "role", "words", "sizes", "tokens").mapInArrow(X._asker(2, parts), X._REQUEST_DDL)
        made[size] = (n, asked.count())
        assert asked.count() <= (tokens + words) / 16
    assert made[10_000][0] > made[40_000][0]


def test_a_long_text_is_split_at_white_space():
    text = ("Wort\t" * 7 + "é" * 50 + " ") * 60_000
    parts = list(X.words_in(text))
    assert len(parts) > 3 and [w for p in parts for w in p] == text.encode().lower().split()
    assert [w for p in X.words_in("x" * 3_000_000) for w in p] == [b"x" * 3_000_000] and list(X.words_in("")) == []


def test_blocks_that_are_made_anew_are_the_same(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, t string, role int").na.fill("")
    a, b = (sorted(map(tuple, docs.mapInArrow(X._encoder(3000), X._BLOCK_DDL).select("block", "words", "tokens", "ids").collect())) for _ in range(2))
    assert a == b and len({r[0] for r in a}) == len(a)


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b", "x", 1)], DDL)
    r = X.lm_scores(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert X.lm_scores(docs.limit(0)).count() == 0
