"""Nearest neighbours by block matrix join.

Queries and candidates are cut into blocks by hash, as large as a task can hold, and
each pair of blocks is a tile. In a tile the vectors are scaled to unit length and quantised to
int8; one matrix product gives all approximate cosines, and the quantisation errors'
norms bound how far each may be off. Only pairs whose upper bound reaches the k-th
best lower bound of their query are recomputed in double precision from the original
vectors, so no neighbour can be lost. Survivors go through a heap for each query, and
the tiles' heaps are merged by rank.

The int8 product is carried out in float32, where sums of int8 products are exact
integers up to DIMS_EXACT dimensions at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Components of a block's vectors, at most.
BLOCK_VALUES = 1 << 21
#: Blocks of candidates have so many vectors at least, where more blocks than that would only be for the sake of more tasks.
LEAST_BLOCK = 4096
#: Approximate cosines held at a time.
HELD = 1 << 21
#: 127 * 127 * 1024 < 2 ** 24
DIMS_EXACT = 1024
#: Room for rounding in the bounds themselves.
SLACK = 1e-6

_PAIR_DDL = "query_id long, vec_id long, score double"
_PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay the same to the last bit, and no square over- or underflows."""
    _, exponent = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -exponent)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the dimensions: equal rows give equal sums."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Quantised:
    """Unit vectors as int8 times a scale, with the norms of what rounding took away."""

    def __init__(self, x: np.ndarray) -> None:
        x = scaled(x)  # squares of huge or tiny vectors stay finite
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.scale = np.abs(unit).max(1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(1))
        self.norm = np.sqrt((near * near).sum(1))


def tile_cosines(a: Quantised, b: Quantised) -> np.ndarray:
    """Approximate cosines of all rows of a with all rows of b, from int8 products."""
    dots = np.zeros((len(a.q), len(b.q)))
    for at in range(0, a.q.shape[1], DIMS_EXACT):
        dots += a.q[:, at : at + DIMS_EXACT].astype(np.float32) @ b.q[:, at : at + DIMS_EXACT].astype(np.float32).T
    return dots * a.scale[:, None] * b.scale[None, :]


def tile_neighbours(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of each query's k nearest in the tile, itself left out."""
    out: list[tuple[int, int, float]] = []
    q, c = scaled(q), scaled(c)
    cq = Quantised(c)
    c_norm = np.sqrt(row_dots(c, c))
    step = max(1, HELD // max(1, len(c)))
    for at in range(0, len(q), step):
        ids, part = qid[at : at + step], q[at : at + step]
        qq, q_norm = Quantised(part), np.sqrt(row_dots(part, part))
        near = tile_cosines(qq, cq)
        # u.w - u'.w' = u'.(w - w') + (u - u').w with |w| = 1
        off = qq.norm[:, None] * cq.error[None, :] + qq.error[:, None] + SLACK
        near[ids[:, None] == cid[None, :]] = -np.inf
        low = near - off
        n = min(k, low.shape[1])
        floor = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        i, j = np.nonzero((near + off >= floor[:, None]) & (near > -np.inf))
        for s in range(0, len(i), 1 << 18):  # survivors in bounded pieces
            a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            exact = row_dots(part[a], c[b]) / (q_norm[a] * c_norm[b])
            best: dict[int, list] = {}
            for x, v, y in zip(a.tolist(), exact.tolist(), cid[b].tolist(), strict=True):
                heap = best.setdefault(x, [])
                if len(heap) < k:
                    heapq.heappush(heap, (v, -y))
                elif (v, -y) > heap[0]:
                    heapq.heapreplace(heap, (v, -y))
            out += [(int(ids[x]), -y, v) for x, heap in best.items() for v, y in heap]
    return out


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, a vector, finite components, not all zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # float vectors stay float until a tile turns them into doubles: half the shuffle
    kept = v if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), kept.alias("v")
    )


def block_sizes(queries: int, candidates: int, dim: int, tasks: int) -> tuple[int, int]:
    """Vectors in a block of queries and of candidates.

    Each side crosses the network once for every block of the other one, so blocks are as
    large as a task can hold; only candidates are cut finer where there would be fewer
    blocks than tasks, since that repeats nothing but the few queries.
    """
    most = max(1, BLOCK_VALUES // max(1, dim))
    fine = -(-candidates // max(1, tasks)) if queries <= most else most
    return most, min(most, max(LEAST_BLOCK, fine))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """Each query's k nearest candidates of another id by cosine.

    Both have columns (vec_id, v) as usable_vectors gives them. Vectors of different
    lengths aren't compared; components of any finite size are. Ties go to the smaller vec_id. Rows repeated with one id
    count as rows of their own, except that a query never meets its own id; a query
    id with several rows is ranked over all its rows' neighbours. With fewer than k
    candidates all are returned; no queries or no candidates give no rows.

    Returns query_id, rank, vec_id, score.
    """
    n, dims = zip(*(df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first() for df in (queries, candidates)), strict=True)
    sizes = block_sizes(*n, max(dims), 2 * queries.sparkSession.sparkContext.defaultParallelism)
    blocks = [max(1, -(-many // (given or size))) for many, given, size in zip(n, (query_block, candidate_block), sizes, strict=True)]

    def dealt(df: DataFrame, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        # by id and vector: a repeated id's vectors don't meet in one block
        part: Column = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks[own])).alias(own_name)
        return df.select("vec_id", "v", F.size("v").alias("dim"), part).withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[other] - 1).cast("long"))))

    q, c = dealt(queries, 0, 1, "qb", "cb"), dealt(candidates, 1, 0, "cb", "qb")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dim = key[2].as_py()
            rows = tile_neighbours(left.column("vec_id").to_numpy(), matrix(left.column("v"), dim), right.column("vec_id").to_numpy(), matrix(right.column("v"), dim), k)
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(cols, _PAIR.types, strict=True)], schema=_PAIR)

    tiles = q.groupBy("qb", "cb", "dim").cogroup(c.groupBy("qb", "cb", "dim")).applyInArrow(run, _PAIR_DDL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_to_every_nth(vectors: DataFrame, nth: int = 50, k: int = K) -> DataFrame:
    """The neighbours of each row whose vec_id is divisible by nth, among all rows."""
    rows = usable_vectors(vectors)
    return nearest(rows.filter(F.pmod("vec_id", F.lit(nth)) == 0), rows, k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
