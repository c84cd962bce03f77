from __future__ import annotations

import random

import xxhash
from annoweave.llm import simhash as X
from annoweave.llm.components import connected_components
from hypothesis import given, settings
from hypothesis import strategies as st

MASK = (1 << 64) - 1


def roots(fps, budget):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def cluster(rng, n, centres=5, flips=5):
    c = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(c)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint_by_definition():
    text = "One two THREE\tfour five\nsix ÄB"
    words = ["one", "two", "three", "four", "five", "six", "Äb"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert X.fingerprint(text, 4) == want
    assert X.fingerprint("a B", 4) == xxhash.xxh64_intdigest(b"a b", 42)
    assert X.fingerprint(" \n", 4) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 8))
def test_trie_join_finds_the_components(seed, budget):
    fps = cluster(random.Random(seed), 60)
    edges = dict(X.trie_self_join(fps, budget))
    want = [fps[r] for r in roots(fps, budget)]
    assert [edges.get(f, f) for f in fps] == want


def test_masks_catch_every_link():
    rng = random.Random(1)
    for k in (1, 2, 3, 4):
        masks = X.table_masks(4, k)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_large_buckets_lose_no_link(spark):
    fps = cluster(random.Random(3), 500)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = roots(fps, 4)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for large in (10, 40, 10**6):  # 10: most are left after all cuts and meet in pairs of parts
        found = {r.node: r.component for r in connected_components(X.link_fingerprints(nodes, large=large)).collect()}
        groups = [found.get(signed(f), signed(f)) for f in fps]
        assert len(set(zip(groups, want, strict=True))) == len(set(groups)) == len(set(want))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (500, 400)]
    rng = random.Random(2)
    rng.shuffle(edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_nulls_and_repeats(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", None), (None, "zz yy xx ww vv uu", ""), (5, "  ", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = sorted(((r.doc_id, r.component_id) for r in X.simhash_groups(docs, 4).collect()), key=repr)
    assert found == sorted([(1, 1), (1, 1), (None, 3), (3, 3), (None, None), (5, 3)], key=repr)
    kept = X.drop_near_copies(docs, 4)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a b", "x"), (3, "", None), (None, "zz yy xx ww vv uu", "")], key=repr)
    assert X.simhash_groups(docs.limit(0), 4).count() == 0


def test_near_copies_group(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(6)]
    rows = [(10 * i, t) for i, t in enumerate(base)] + [(10 * i + 1, t + " extra") for i, t in enumerate(base)]
    found = {r.doc_id: r.component_id for r in X.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert all(found[10 * i + 1] == 10 * i for i in range(6))


def brute(rows, words, budget):
    """(doc_id, fingerprint, component_id) of each row, straight from the definition."""
    fps = [X.fingerprint(t or "", words) for _, t in rows]
    group = roots(fps, budget)
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True)), key=repr)


def test_whole_result_by_brute_force(spark):
    rng = random.Random(12)
    rows, top = [], (1 << 63) - 1
    for i in range(40):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(1, 400))]
        for j in range(rng.randrange(1, 4)):
            rows.append((rng.choice([top - 10 * i - j, -top + 10 * i + j, 10 * i + j]), " ".join(words) + " x" * j))
    rows += [(None, rows[0][1]), (None, None), (None, "all alone here"), (rows[3][0], rows[3][1]), (5, "w1 " * 60_000), (2**62 + 5, "q"), (2**62 + 9, "r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in X.simhash_groups(docs, 4).collect()), key=repr)
    assert found == brute(rows, 4, 4)


def test_large_ids_stay_and_one_row_of_a_group_is_kept(spark):
    rows = [(2**62 + 5, "one two three four five six"), (2**62 + 9, "quite another text of more words than that"), (7, "nothing in common with either of those"), (-(2**63), "a b c d e f g h")]
    rows += [(7, "nothing in common with either of those "), (None, "nothing in common with either of those")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, `group` int")
    kept = X.drop_near_copies(docs, 4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows[:4])
