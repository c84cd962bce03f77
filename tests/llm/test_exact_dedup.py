from __future__ import annotations

import random

import pytest
from annoweave.llm import exact_dedup as X
from hypothesis import given, settings
from hypothesis import strategies as st

DDL = "doc_id long, text string, kept string, n_cp int"


def brute(rows):
    """(doc_id, keep_id, group_size) by the contract, as a sorted list."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((i, t or ""))
    out = []
    for g in groups.values():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(g)) for i, _ in g]
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_trie_counts_each_string_once(strings):
    trie, done = X.PatriciaPath(), []
    for i, s in enumerate(sorted(strings)):
        done += trie.insert(s, 1, i, 1)
    done += trie.finish()
    assert {s: t[2] for s, t in done} == {s: strings.count(s) for s in strings}
    assert len(done) == len(set(strings))


@pytest.mark.parametrize(("a", "b", "n"), [(b"", b"x", 0), (b"abc", b"abd", 2), (b"a" * 1000, b"a" * 1000, 1000), (b"a" * 999 + b"b", b"a" * 1000, 999)])
def test_common_prefix(a, b, n):
    assert X.common_prefix(a, b) == n


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randrange(6)))) for i in range(400)]
    rows += [(None, None), (None, "a b"), (401, "é x"), (402, "éx"), (403, " "), (404, "long " * 20_000), (405, "long" * 20_000)]
    found = X.exact_dedup(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DDL)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == brute(rows)
    per_group = {}
    for r in found:
        per_group[r.text_sha256] = per_group.get(r.text_sha256, 0) + r.kept
    assert set(per_group.values()) == {1}


def test_small_combine_buffers_change_nothing(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, X.exact_dedup(docs).collect()))
    monkeypatch.setattr(X, "COMBINE_BYTES", 1)
    assert sorted(map(tuple, X.exact_dedup(docs).collect())) == want


def test_repeated_rows_keep_one_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "ab", "x", 1), (1, "ab", "x", 1), (1, "a b", "y", 2), (2, "", None, 3)], DDL)
    kept = X.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a b", "y", 2), (2, "", None, 3)]


def test_empty_table(spark):
    assert X.exact_dedup(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("hot", [2, 20, 10**6])
def test_hot_groups_are_joined_alike(spark, monkeypatch, hot):
    rng = random.Random(7)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {rng.randrange(60)}") for i in range(300)] + [(None, "the same text"), (None, None)]
    monkeypatch.setattr(X, "HOT", hot)
    found = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == brute(rows)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
