from __future__ import annotations

import math

import numpy as np
from annoweave.llm import ann as X

DDL = "vec_id long, embedding array<float>, score double"


def brute(rows, k=5, nth=50):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q % nth == 0:
            near = [(-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in ok if i != q and len(a) == len(b)]
            out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


def close(found, want):
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert [f[:2] for f in found] == sorted(w[:2] for w in want)
    by = {w[:2]: w for w in want}
    for f in found:
        w = by[f[:2]]
        assert abs(f[3] + w[3]) < 1e-9
        assert f[2] == w[2] or any(abs(x[3] - w[3]) < 1e-12 for x in want if x[0] == f[0] and x[1] != f[1])


def test_against_brute_force_for_any_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0.0) for i in range(400)]
    rows += [(1000 + i, rows[50][1], 0.0) for i in range(60)]  # copies of a query
    rows += [(600, None, 0.0), (650, [0.0] * 16, 0.0), (700, [1.0, None], 0.0), (750, [math.nan, 1.0], 0.0), (800, [math.inf, 1.0], 0.0), (850, [1.0, 2.0], 0.0), (None, [1.0] * 16, 0.0)]
    v = X.usable_vectors(spark.createDataFrame(rows, DDL))
    q = v.filter("vec_id % 50 = 0")
    want = brute(rows)
    close(X.nearest(q, v).collect(), want)
    close(X.nearest(q, v, query_block=4, candidate_block=37).collect(), want)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 2.0], 0.0), *[(i, [1.0, 2.0], 0.0) for i in (9, 3, 7, 5, 11, 4, 8)]]
    found = X.nearest_to_every_nth(spark.createDataFrame(rows, DDL)).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [3, 4, 5, 7, 8]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 1500):
        a, b = rng.normal(size=(40, dim)), rng.normal(size=(50, dim)) * 1e-3
        x, y = X.Quantised(a), X.Quantised(b)
        off = x.norm[:, None] * y.error[None, :] + x.error[:, None] + X.SLACK
        true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        assert (np.abs(X.tile_cosines(x, y) - true) <= off).all()


def test_few_candidates_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0], 0.0)], DDL)
    assert X.nearest_to_every_nth(one).count() == 0
    assert X.nearest_to_every_nth(one.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0.0), (50, [-3.0], 0.0)], DDL)
    assert sorted((r.query_id, r.vec_id, r.score) for r in X.nearest_to_every_nth(two).collect()) == [(0, 50, -1.0), (50, 0, -1.0)]


def test_huge_tiny_and_repeated_vectors(spark):
    rng = np.random.default_rng(5)
    plain = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v * (10.0 ** [0, 200, -200, 300][i % 4])]) for i, v in enumerate(plain)]
    rows += [(50, rows[3][1]), (7, rows[7][1]), (7, rows[9][1])]  # ids with several rows
    flat = [(i, np.array(v) / np.abs(v).max()) for i, v in rows]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = X.nearest_to_every_nth(docs).collect()
    for q in (0, 50):
        own = [v for i, v in flat if i == q]
        want = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for a in own for i, b in flat if i != q)[:5]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert np.allclose([g[2] for g in got], [-s for s, _ in want], atol=1e-12) and np.isfinite([g[2] for g in got]).all()


def test_scaling_changes_no_bit():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(200, 64))
    cos = lambda x, y: X.row_dots(x, y) / (np.sqrt(X.row_dots(x, x)) * np.sqrt(X.row_dots(y, y)))
    assert (cos(a, b) == cos(X.scaled(a), X.scaled(b))).all()


def test_blocks_grow_with_the_vectors_up_to_what_a_task_holds():
    assert X.block_sizes(1000, 50_000, 64, 12) == (32_768, 4167)
    for n in (10**6, 10**9, 10**12):
        q, c = X.block_sizes(n // 50, n, 64, 4000)
        sent = n * -(-(n // 50) // q) + n // 50 * -(-n // c)
        assert q * 64 <= X.BLOCK_VALUES and c * 64 <= X.BLOCK_VALUES
        assert n < 10**9 or sent <= 2.1 * n * (n // 50) / 32_768
    assert X.block_sizes(0, 0, 0, 1)[0] > 0 and X.block_sizes(10, 10, 10**9, 1) == (1, 1)
