"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Only a session of one machine may do without: it gets a folder there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "annoweave-checkpoints"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Whether an action's shuffle files are deleted when it ends, and not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside gives its shuffle files back when it ends. A DataFrame made inside shouldn't be run twice: it would be shuffled again."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Store df in the shared checkpoint folder and go on from there; its shuffle files are freed."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as a DataFrame keeps the setting it was made under


#: Bytes of a stored table that one task takes, about, and its parts that one task counts.
TASK_BYTES, COUNTED = 16 << 20, 8


def gathered(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """df, which has so many rows, in as many partitions as these ask for: what one task can do isn't shuffled."""
    return df.coalesce(max(1, -(-rows * row_bytes // TASK_BYTES)))


def few(df: DataFrame) -> tuple[DataFrame, int]:
    """df, which has narrow rows, stored, by as many tasks as its rows ask for; and their number."""
    stored = cut(df)
    with shuffles_freed(df.sparkSession):
        rows = stored.coalesce(max(1, -(-stored.rdd.getNumPartitions() // COUNTED))).count()
    return gathered(stored, rows), rows
