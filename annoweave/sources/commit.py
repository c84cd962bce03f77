"""Several outputs as one commit.

Each table is written beside its place, with its rows counted and digested on the way.
Then each gets a marker that names the run and all its tables, and is renamed into place.
Readers look at the markers first: a folder without one, or one whose run's other tables
aren't there, is refused. Whatever fails before the last rename leaves what was there before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.digests import digest_sum
from annoweave.functions.text import json_text
from annoweave.sources.sinks import Refused, path_exists, read_text, remove, write_text

MARKER = "_COMMIT"
#: (what is written and where) -> writes it
Write = Callable[[DataFrame, str], object]


def rename(spark: SparkSession, old: str, new: str) -> None:
    src, dst = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not src.getFileSystem(spark._jsc.hadoopConfiguration()).rename(src, dst):
        raise OSError(f"{old} can't be renamed to {new}")


def observed(df: DataFrame, **more: Column) -> tuple[DataFrame, Observation]:
    """df, and what will be known of it once it has been written: rows, digest, and what else is asked."""
    seen = Observation()
    digest = F.sha2(json_text(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])), 256)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), digest_sum(digest).cast("string").alias("digest"), *[c.alias(k) for k, c in more.items()]), seen


def commit_together(spark: SparkSession, tables: dict[str, tuple[DataFrame, Write]], overwrite: bool = False, more: dict[str, dict[str, Column]] | None = None) -> dict[str, dict]:
    """Write tables(path -> frame, in its order, and how to write it) so that all are there or none; returns what was observed of each.

    `more` names further sums by path, taken in the same pass as the write.
    """
    held = [p for p in tables if path_exists(spark, p)]
    if held and not overwrite:
        raise Refused(f"outputs exist: {held}")
    run = uuid.uuid4().hex
    beside = {p: f"{p}.staged-{run}" for p in tables}
    old = {p: f"{p}.replaced-{run}" for p in held}
    gone: list[str] = []
    placed: list[str] = []
    try:
        told = {}
        for path, (df, write) in tables.items():
            out, seen = observed(df, **(more or {}).get(path, {}))
            write(out, beside[path])
            told[path] = seen.get
        marker = json.dumps({"run": run, "tables": told}, ensure_ascii=False, default=str)
        for path in tables:
            write_text(spark, f"{beside[path]}/{MARKER}", marker)
        for path in tables:
            if path in old:
                rename(spark, path, old[path])
                gone.append(path)
            rename(spark, beside[path], path)
            placed.append(path)
    except BaseException:
        for path in placed:
            remove(spark, path)
        for path in gone:
            rename(spark, old[path], path)
        for path in beside.values():
            remove(spark, path)
        raise
    for path in old.values():
        remove(spark, path)
    return told


def _marker(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, f"{path}/{MARKER}"):
        raise Refused(f"{path} was never committed")
    return json.loads(read_text(spark, f"{path}/{MARKER}"))


def committed(spark: SparkSession, path: str) -> dict[str, dict]:
    """What the commit that wrote path says of all its tables; raises Refused where it isn't whole."""
    own = _marker(spark, path)
    for other in own["tables"]:
        if _marker(spark, other)["run"] != own["run"]:
            raise Refused(f"{path} and {other} are of different runs")
    return own["tables"]
