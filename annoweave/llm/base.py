"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.session import TASK_BYTES as TASK_BYTES
from annoweave.session import cut as cut
from annoweave.session import ensure_checkpoint_dir as ensure_checkpoint_dir
from annoweave.session import few as few
from annoweave.session import gathered as gathered
from annoweave.session import shuffles_freed as shuffles_freed

#: Characters the contracts call white space: space and TAB..CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(n: int, id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod n; a null id falls into bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n)), F.lit(0))


def row_hash(text_col: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text_of(text_col))


#: Bytes of rows that are handed to Python at a time, about; Spark's own limit is 10,000 rows of any length.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(texts: DataFrame) -> DataFrame:
    """texts, unchanged; its session hands rows to Python in batches of BATCH_BYTES from now on, unless a limit is set."""
    conf = texts.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return texts


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that what Python makes of a batch's texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose (id, text) is among kept's (id, text_hash), one row for each.

    Null ids match null ids. Columns of docs come back unchanged. The texts cross the
    network once: the join and the choice among repeated rows share one partitioning.
    """
    names = docs.columns
    keys = ["__aw_id", "__aw_none", "__aw_hash"]

    def keyed(df: DataFrame, name: str, of_text: Column) -> DataFrame:
        number = F.col(name).cast("long")
        return df.withColumns({"__aw_id": F.coalesce(number, F.lit(0).cast("long")), "__aw_none": F.col(name).isNull(), "__aw_hash": of_text})

    left = keyed(docs, id_col, row_hash(text_col))
    wanted = keyed(kept, id_col, F.col("text_hash")).select(*keys)
    return left.join(wanted, keys, "left_semi").dropDuplicates(keys).select(*names)
