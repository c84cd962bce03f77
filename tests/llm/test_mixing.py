from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from annoweave.llm import mixing as X

DDL = "doc_id long, text string, source string, rate double"


def u(i, j=1, text=None):
    key = i if i is not None else "null:" + hashlib.md5((text or "").encode()).hexdigest()
    return (int(hashlib.md5(f"{X.SEED}:{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def draw(mean, x):
    k, p = 0, math.exp(-mean)
    c = p
    while c < x:
        k += 1
        p *= mean / k
        c += p
    return k


def test_counts_by_inversion(spark):
    rows = [(i, "x" * (1 + i % 5), f"s{min(i % 10, 4)}", 0.0) for i in range(3000)] + [(None, "abc", None, 0.0), (None, None, None, 0.0)]
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(t or "")
    total, want = sum(size.values()), {s: n**0.5 for s, n in size.items()}
    rate = {s: want[s] / sum(want.values()) * total / n for s, n in size.items()}
    expected = Counter({(i, t): 0 for i, t, _, _ in rows})
    for i, t, s, _ in rows:
        m = max(1, math.ceil(rate[s] / X.DRAW))
        expected[(i, t)] += sum(draw(rate[s] / m, u(i, j, t)) for j in range(1, m + 1))
    out = X.replicate(spark.createDataFrame(rows, DDL), number="replica")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +expected
    assert out.columns == ["doc_id", "text", "source", "rate", "replica"]


def test_weights_and_large_rates(spark):
    rows = [(i, "abcd", "a", 0.0) for i in range(2000)] + [(5000 + i, "abcd", "b", 0.0) for i in range(10)] + [(9000, "abcd", "c", 0.0)]
    n = Counter(r.source for r in X.mix(spark.createDataFrame(rows, DDL), {"a": 1, "b": 3}).collect())
    assert set(n) == {"a", "b"}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.04


def test_shuffled_and_reproducible(spark):
    docs = spark.createDataFrame([(i, "abc", f"s{i % 3}", 0.0) for i in range(500)], DDL)
    a, b = ([r.doc_id for r in X.mix(docs).collect()] for _ in range(2))
    assert a == b and a != sorted(a)


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 0.0), (2, "", "b", 0.0)]])
def test_no_characters(spark, rows):
    out = X.mix(spark.createDataFrame(rows, DDL))
    assert out.count() == sum(draw(1.0, u(i)) for i, *_ in rows)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, "abcd", "ab"[i % 2], 77, i) for i in range(300)], "doc_id long, text string, source string, replica int, size long")
    out = X.mix(docs, {"a": 1, "b": 5})
    assert out.columns == docs.columns and {r.replica for r in out.collect()} == {77}
    assert all(r.size == r.doc_id for r in out.collect())
    with pytest.raises(ValueError, match="replica"):
        X.replicate(docs, number="replica")


def test_null_source_with_weights_and_hot_null_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i:05d}", None if i % 3 else "a", 0.0) for i in range(1500)], DDL)
    n = Counter(r.source for r in X.mix(docs, {"a": 1, None: 1}).collect())
    assert abs(n[None] / (n["a"] + n[None]) - 0.5) < 0.05
    assert set(r.source for r in X.mix(docs, {"a": 1}).collect()) == {"a"}
    out = X.replicate(docs)
    counts = Counter(r.text for r in out.collect())
    assert len(set(counts.values())) > 2  # each text has a draw of its own
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = X.replicate(docs).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.5 * sum(sizes)


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, "x" * 1_000_000, "a", 0.0), (1, "x" * 1_000_000, "a", 0.0), (2, "y", "b", 0.0)]
    out = X.mix(spark.createDataFrame(rows, DDL), {"a": 1, "b": 0}, budget=1.0)
    n = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert set(n) <= {1} and n[1] % 2 == 0
