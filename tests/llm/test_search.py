from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from annoweave.llm import queries
from annoweave.llm import search as X
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return out


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


DOCS = [
    (1, "one two THREE"), (2, "one-two_three, four"), (2, "one-two_three, four"), (3, None), (4, ""), (5, " .,;"), (6, "Äpfel äpfel größe 12a 12A"), (None, "one two"), (7, "one " * 5000),
    (8, " ".join(f"w{i}" for i in range(20_000)) + " four"), (-9, "one two"), (2, "four other text of id 2"),
]
ITEMS = [(1, "One, two!"), (2, "THREE four"), (2, "größe"), (3, ""), (4, None), (5, "nowhere"), (None, "w77 äpfel Äpfel"), (6, "one one one")]


@pytest.mark.parametrize("postings", [1, 5, 1 << 20])
def test_odd_rows_against_brute_force(spark, postings):
    docs = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, score int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    want = sorted(map(repr, brute(DOCS, ITEMS)))
    assert rows_of(X.search(docs, items, postings=postings)) == want
    assert rows_of(X.search(docs.repartition(5), items, item_bytes=20, postings=postings)) == want  # items in parts


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs, items.limit(0)), (docs.limit(0), items), (docs.limit(0), items.limit(0))):
        found = X.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_a_hot_term_and_many_ties(spark):
    rows = [(i, "common words here") for i in range(500)] + [(1000 + i, f"common {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "common words"), (2, "common"), (3, "here 5")]
    assert rows_of(X.search(docs, spark.createDataFrame(items, "item_id long, text string"), postings=64)) == sorted(map(repr, brute(rows, items)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    sql = c.sql(X.ORACLE_SQL)
    got = queries.op12_search(spark, f"/root/testdata/{sf}")
    assert got.columns == sql.columns and got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def least_cost(values, longest, price):
    base = price * (max(values) - sum(values) / len(values)) + 1
    cost = [0.0] + [math.inf] * len(values)
    for i in range(1, len(values) + 1):
        for j in range(max(0, i - longest), i):
            own = values[j:i]
            cost[i] = min(cost[i], cost[j] + len(own) * max(own) - sum(own) + base)
    return cost[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 1000), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 8))
def test_blocks_have_the_least_cost(lists, longest):
    sizes = [len(x) for x in lists]
    starts = np.cumsum(sizes) - sizes
    ends = X.block_ends(np.array([v for x in lists for v in x]), starts, longest, 2.0).tolist()
    assert set(np.cumsum(sizes).tolist()) <= set(ends)
    for x, at in zip(lists, starts.tolist(), strict=True):
        own = [at] + [e for e in ends if at < e <= at + len(x)]
        cost = 0.0
        for a, b in zip(own, own[1:], strict=False):
            part = x[a - at : b - at]
            assert 0 < len(part) <= longest
            cost += len(part) * max(part) - sum(part) + 2.0 * (max(x) - sum(x) / len(x)) + 1
        assert cost == pytest.approx(least_cost(x, longest, 2.0))


def shard_of(docs, number):
    s = X.Shard()
    s.add([i for i, _ in docs], [t for _, t in docs], number)
    row = s.row().to_pylist()[0]
    return s.docs, s.length, pa.ipc.open_stream(row["ids"]).read_all(), row["postings"], row["terms"]


def test_search_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(1)
    docs = [(int(i), " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 40) % 300)) for i in range(4000)]
    docs[1234] = (1234, "t1 t2 t250 t251 t252 t253")
    number = {f"t{i}".encode(): i for i in range(300)}
    n, length, ids, postings, own = shard_of(docs, number)
    weights = np.arange(300, dtype=np.int64) * 10
    s = X.Searcher(ids, postings, own, n, length, weights)
    total = 0
    for terms_ in ([1, 2, 250, 251, 252, 253], [1], [0, 299, 298], [5, 6, 7, 8]):
        places, scores = s.search(np.array(terms_), 10)
        sums = np.zeros(len(docs), np.int64)
        for t in terms_:
            if (at := s.list_of[t]) >= 0:
                of = (s.key >> 32) == at
                np.add.at(sums, s.doc[of], s.score[of])
                total += int(of.sum())
        best = np.lexsort((np.arange(len(docs)), -sums))[:10]
        assert places.tolist() == [b for b in best.tolist() if sums[b] > 0] and scores.tolist() == [int(sums[b]) for b in best if sums[b] > 0]
    assert s.read < total


def test_only_the_place_in_a_shard_of_ids_matters():
    docs = [(i, "a b") for i in (9, 3, 7)]
    n, length, ids, postings, own = shard_of(docs, {b"a": 0})
    s = X.Searcher(ids, postings, own, n, length, np.array([5]))
    assert [int(s.ids[p]) for p in s.search(np.array([0]), 2)[0]] == [3, 7]
