from __future__ import annotations

import random
import time
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from annoweave.llm import jaccard as X
from annoweave.llm import queries
from annoweave.llm.base import cut, few
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

#: Classes that small tables reach.
FEW = ((2, 2, 4), (3, 5, 8))


def shingles(text, words):
    toks = (text or "").encode().lower().split()
    if not toks:
        return frozenset()
    return frozenset(b" ".join(toks[i : i + words]) for i in range(max(1, len(toks) - words + 1)))


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(j)] = find(i)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def check(spark, rows, words=4, percent=85, classes=X.CLASSES):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = X.jaccard_groups(docs, words, percent, classes)
    assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, brute(rows, words, percent)))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed, hot=40):
    """Groups of near copies, one of them large, and documents that share long passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 7, 9, 12, 25, 60, 150, 400]))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for _ in range(rng.choice([1, 2, 3, 8]))]
    base = [word() for _ in range(90)]
    texts += [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(hot)]
    passage = [word() for _ in range(50)]
    for n in (0, 2, 5, 8, 10, 14, 20, 40):
        for _ in range(3):
            own = [word() for _ in range(n)]
            texts.append(" ".join(own + passage))
            texts.append(" ".join(passage + own))
    texts += [" ".join(passage[:k]) for k in range(1, 50, 3)]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "percent", "classes"), [(1, 85, X.CLASSES), (2, 85, FEW)])
def test_components_against_brute_force(spark, seed, percent, classes):
    check(spark, corpus(seed), 4, percent, classes)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (1, "a b c"), (4, "A B  C"), (5, "a b c"), (None, "a b c"), (6, "one two three four five"), (6, "one two three four five"), (None, ""), (-9, "ONE two\nthree four five"),
        (None, "x y z u v w"), (7, "ä Ä"), (8, "Ä ä"), (9, " ".join(f"v{i}" for i in range(30_000))), (10, " ".join(f"v{i}" for i in range(29_000))), (6, "another text of id six"),
    ]
    check(spark, rows)
    assert X.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        X.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)


def test_a_hot_group_of_copies_and_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(200)] + [(1000 + i, " ".join(edited(rng, base, 1))) for i in range(80)]
    check(spark, rows)


def test_rounds_end_before_all_pairs(spark, monkeypatch):
    """Near copies of one text are joined by comparisons in proportion to their number."""
    asked = []
    plain = X.linked
    monkeypatch.setattr(X, "linked", lambda pairs, *a: asked.append(pairs.count()) or plain(pairs, *a))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in X.jaccard_groups(docs, 4, 85).collect()} == {0}
    assert sum(asked) < 20 * len(rows) < len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    sql = c.sql(X.oracle_sql(4, 85))
    got = queries.op13_jaccard(spark, f"/root/testdata/{sf}")
    assert got.columns == ["doc_id", "n_shingles", "component_id"] == sql.columns and {k for _, k in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(6, 400), st.sampled_from([80, 85, 90]), st.sampled_from([X.CLASSES, FEW, ((2, 2, 4),)]))
def test_linked_sets_share_a_signature(seed, n, percent, classes):
    """However tokens are classed, for a pair at the threshold."""
    rng = random.Random(seed)
    tokens = [rng.getrandbits(64) for _ in range(2 * n)]
    lost = rng.randrange(X.lacking(n, percent) + 1)
    a, b = set(tokens[:n]), set(tokens[lost:n])
    while 100 * len(a & b) >= percent * (len(a | b) + 1) and rng.random() < 0.9:
        b.add(rng.getrandbits(64))
    if 100 * len(a & b) < percent * len(a | b) or a == b:
        return
    df = {t: rng.choice([1, 1, 2, 3, 5, 100, 10**6]) for t in a | b}
    for t in a & b:
        df[t] = max(df[t], 2)
    found = []
    for s in (a, b):
        own = np.array(sorted(s), np.uint64)
        shared = np.array([i for i, t in enumerate(own.tolist()) if df[t] > 1], np.int64)
        counts = np.array([df[t] for t in own[shared].tolist()], np.int64)
        seen = X.depth(len(own), percent)
        near = shared < seen
        sigs = X.signatures(len(own), seen, shared[near], own[shared[near]], counts[near], percent, classes)
        if sigs is None:  # the whole set always does
            sigs = X.signatures(len(own), len(own), shared, own[shared], counts, percent, classes)
        found.append(set(sigs.tolist()))
    assert found[0] & found[1]


def test_shingles_of_many_texts():
    texts = ["", "a b c d e", " x\ty ", "a b c d A B C d", "Ä ä b", "q", "a b c d e"] + [" ".join(f"w{i * i % 17}" for i in range(n)) for n in range(30)]
    sizes, hashes = X.shingle_sets(texts, 4)
    at, seen = 0, {}
    for t, n in zip(texts, sizes.tolist(), strict=True):
        want, own = shingles(t, 4), hashes[at : at + n]
        assert n == len(want) and (np.diff(own.astype(object)) > 0).all()
        assert seen.setdefault(want, own.tolist()) == own.tolist()
        at += n
    assert len({tuple(v) for v in seen.values()}) == len(seen)
    assert X.shingle_sets([], 4)[0].tolist() == X.shingle_sets([], 4)[1].tolist() == []


def test_size_classes_and_groups():
    for percent in (80, 85, 90):
        bounds = X.size_bounds(percent)
        level = lambda n: X.bisect_right(bounds, n) - 1
        for n in range(1, 2000):
            most = n * 100 // percent
            assert level(most) - level(n) <= 1
            if X.depth(n, percent):
                for at in (level(n), level(n) + 1):
                    groups = X.group_counts(at, percent, FEW)
                    assert sum(g * (k - 1) for g, (k, _, _) in zip(groups, FEW, strict=True)) <= n - X.lacking(n, percent) - 1


def test_near_copies_share_one_signature_and_unlike_sets_make_no_pairs(spark):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:399], "x"]))], "doc_id long, text string")
    common = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    marked = X.mark(docs, 4, 85, common)
    signed = X.signed_sets(docs, marked, marked.select(F.col("row").alias("set")), 4, 85, X.CLASSES, common, "doc_id", "text")
    assert signed.count() == 2  # a row a set
    maps = [f"m{i}" for i in range(X.MAPS)]
    sets = spark.range(4).select(F.col("id").alias("set"), *[F.when(F.col("id") < 2, F.lit(-1)).otherwise(F.xxhash64("id", F.lit(m))).cast("long").alias(m) for m in maps])
    met = sets.select(F.lit(7).cast("long").alias("sig"), "set", F.lit(300).cast("long").alias("n"), F.col("set").alias("comp"))
    assert [tuple(r) for r in X._pairs(met, met, sets, 85).collect()] == [(0, 1)]


def test_stored_tables_leave_no_shuffle_files_and_few_rows_few_parts(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    stored = cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 500).alias("k")).count())
    for _ in range(50):  # files are deleted a little later
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and len(stored.collect()) == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    table, rows = few(spark.range(100).repartition(50))
    assert (rows, table.rdd.getNumPartitions(), table.count()) == (100, 1, 100)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(40)
    found = X.connected_components(edges)
    assert found.rdd.getNumPartitions() <= 2 and {tuple(r) for r in found.collect()} == {(i, 0) for i in range(41)}
