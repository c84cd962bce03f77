"""Digests of rows and of whole tables that don't depend on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a Merkle leaf, about, and children of a node above (one hexadecimal digit).
LEAF, NONE, MARK = 4096, "\x00", "\x1f"


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text, in the order given; null differs from every text."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return F.sha2(F.concat_ws(MARK, *[F.coalesce(c.cast("string"), F.lit(NONE)) for c in quoted]), 256)


def digest_sum(digest: Column) -> Column:
    """Sum over rows of the first 60 bits of their digests: equal for equal rows in any order, repeats included."""
    return F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, digest_sum, merkle_root of the named columns (default: all, by name).

    Leaves of the Merkle tree are the different row digests that begin alike, each with its
    number of rows, in order; so the root is the same under any partitioning, and rows
    repeated any number of times are one entry. How many digits a leaf's rows share
    follows from their number. Each level is a grouping; no task sees more than a leaf or sixteen children.
    """
    rows = df.select(row_digest(columns or sorted(df.columns)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)") * F.col("n")), F.lit(0)).cast("decimal(38,0)").alias("digest_sum"), F.count(F.lit(1)).alias("different"))
    return merkle(rows, rows.count()).join(sums.drop("different"), how="cross")  # one row each


def digits(n: int, leaf: int = LEAF) -> int:
    """Hexadecimal digits by which n digests fall into leaves of about `leaf`."""
    d = 0
    while n > leaf * 16**d:
        d += 1
    return d


def merkle(rows: DataFrame, n: int) -> DataFrame:
    """(merkle_root) of rows(d, n), n of them."""
    entry = F.concat_ws(":", "d", F.col("n").cast("string"))
    depth = digits(n)
    level = rows.groupBy(F.substring("d", 1, depth).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("node"))
    for k in reversed(range(depth)):
        child = F.concat_ws(":", "at", "node")
        level = level.groupBy(F.substring("at", 1, k).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("node"))
    return level.agg(F.coalesce(F.max("node"), F.sha2(F.lit(""), 256)).alias("merkle_root"))  # of an empty table: the digest of nothing
