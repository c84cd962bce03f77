"""Sinks: JSON lines, flat CSV, summaries, names and guards.

Every write is one Spark job and commits as a whole. Files keep the stated order; with
one_file they are one part file, for tables that are known to be small.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.digests import table_digest
from annoweave.functions.text import json_text, model_slug
from annoweave.operators.ordering import record_number, sorted_by
from annoweave.schemas import LOCKBOX_SPLIT


class Refused(ValueError):
    """A precondition doesn't hold; nothing was read or written."""


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One small file, such as a chart, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8") if isinstance(content, str) else content))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file back."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def guard_outputs(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    held = [p for p in paths if path_exists(spark, p)]
    if held and not overwrite:
        raise Refused(f"outputs exist: {held}")


def guard_lockbox(split: str, allowed: bool = False) -> None:
    """Held-out data needs an override, by whatever path or derived name it is asked for."""
    if LOCKBOX_SPLIT in split and not allowed:
        raise Refused(f"{split} is held out")


def guard_numbers(limit: int | None = None, batch_size: int = 1, max_retries: int = 0) -> None:
    if limit is not None and limit < 1:
        raise Refused("limit must be positive")
    if batch_size < 1:
        raise Refused("batch size must be positive")
    if max_retries < 0:
        raise Refused("max retries must not be negative")


def refusal(split: Column, allowed: Column, limit: Column, batch_size: Column, max_retries: Column) -> Column:
    """Why a run asked for by a row would be refused, by the guards above in their order; null if it isn't."""
    told = F.when(split.contains(LOCKBOX_SPLIT) & ~F.coalesce(allowed, F.lit(False)), F.concat(split, F.lit(" is held out")))
    told = told.when(limit < 1, "limit must be positive").when(batch_size < 1, "batch size must be positive")
    return told.when(max_retries < 0, "max retries must not be negative")


def output_names(split: Column, model: Column, schema: Column, prompt: Column, kind: Column, limit: Column) -> Column:
    """output_name of each row; a null limit is none."""
    tail = F.when(limit.isNotNull(), F.concat(F.lit("limit-"), limit.cast("string")))
    return F.concat(F.concat_ws("_", split, model_slug(model), schema, prompt, tail, kind), F.lit(".jsonl"))


def output_name(split: str, model: str, schema: str, prompt: str, kind: str, limit: int | None = None) -> str:
    slug = re.sub("[^A-Za-z0-9_.-]+", "_", model).strip("_") or "model"
    tail = [] if limit is None else [f"limit-{limit}"]
    return "_".join([split, slug, schema, prompt, *tail, kind]) + ".jsonl"


#: What a sink's rows are sorted by: columns or their names.
Order = list[str | Column]


def _keys(order: Order) -> list[str | Column]:
    return [k for c in order for k in ([record_number(F.col(c)), c] if isinstance(c, str) and c == "record_id" else [c])]


def ordered(df: DataFrame, order: Order, one_file: bool = False) -> DataFrame:
    """df in the order of a sink's rows. Record ids are sorted by their number."""
    if one_file:
        return (df.orderBy(*_keys(order)) if order else df).coalesce(1)
    return sorted_by(df, *_keys(order)) if order else df


def save_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with nulls written out and other scripts as they are, in the order that df has."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_json_lines(df: DataFrame, path: str, order: Order, one_file: bool = False, overwrite: bool = False) -> None:
    save_json_lines(ordered(df, order, one_file), path, overwrite)


def flat_dataset(records: DataFrame) -> DataFrame:
    """Records with contexts as JSON text and the source row as a column."""
    source = F.col("source.source_row") if "source" in records.columns else F.col("source_row")
    names = ["record_id", "language", "transcript_id", "half", "line", "speaker", "child_id", "target_negator", "target_utterance", "coded_by_1", "coded_by_2"]
    extra = [c for c in ("split", "child_age_months", "child_age_raw") if c in records.columns]
    return records.select(
        *names, *extra, source.alias("source_row"), json_text(F.col("context_before")).alias("context_before_json"), json_text(F.col("context_after")).alias("context_after_json")
    )


def write_csv(df: DataFrame, path: str, order: Order, one_file: bool = False, overwrite: bool = False) -> bool:
    """CSV with doubled quotes and a header; maps become JSON text. No rows, no file: False."""
    if df.isEmpty():
        return False
    flat = df.select(*[json_text(F.col(c)).alias(c) if k.startswith(("map", "array", "struct")) else F.col(f"`{c}`") for c, k in df.dtypes])
    ordered(flat, order, one_file).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, escape='"', emptyValue="")
    return True


PROBLEMS = ("key_mismatch_1", "key_mismatch_2", "context_missing")


def problem_rows(records: DataFrame) -> DataFrame:
    """(problem, source_row) for each row with a mismatched key or without context: a table, however many there are."""
    named = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in PROBLEMS]), lambda x: x.isNotNull())).alias("problem")
    return records.select(named, "source_row")


def build_summary(records: DataFrame, dropped: DataFrame, rows: bool = False, **about: object) -> DataFrame:
    """One row: counts, and what else is told.

    records has source_row, key_mismatch_1, key_mismatch_2 and context_missing. With
    `rows` the numbers of those rows are listed too, which is for what comes out of one
    workbook; problem_rows has them as a table.
    """
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("source_row"))))
    sums = records.agg(F.count(F.lit(1)).alias("n_records"), *[F.count_if(c).alias(f"n_{c}") for c in PROBLEMS], *[listed(c).alias(f"{c}_rows") for c in PROBLEMS if rows])
    return sums.crossJoin(dropped.agg(F.count(F.lit(1)).alias("n_dropped"))).select("*", *[F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v).alias(k) for k, v in about.items()])


def freeze_values(values: DataFrame) -> DataFrame:
    """(item, sha256, value) of small inputs(item, value), such as a prompt or a model's name."""
    return values.select("item", F.sha2("value", 256).alias("sha256"), "value")


def freeze_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(item, n_rows, digest_sum, merkle_root) of each table: the same however its rows are ordered or dealt out."""
    digests = [table_digest(df).select(F.lit(name).alias("item"), "n_rows", F.col("digest_sum").cast("string").alias("digest_sum"), "merkle_root") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, digests)


def freeze_files(spark: SparkSession, folder: str) -> DataFrame:
    """(item, sha256, value) of each file under a folder: its path there, its digest and its length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_extract("path", re.escape(folder.rstrip("/").split("://")[-1].split(":", 1)[-1]) + "/(.*)$", 1)
    return files.select(inside.alias("item"), F.sha2("content", 256).alias("sha256"), F.col("length").cast("string").alias("value"))


def freeze_manifest(spark: SparkSession, **inputs: str) -> DataFrame:
    """freeze_values of the inputs that are named."""
    return freeze_values(spark.createDataFrame(sorted(inputs.items()), "item string, value string"))
