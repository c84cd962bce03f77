"""The three stages over whole tables: build a dataset, split it, run a model on a split."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.functions.coding import assigned_coder, is_coded
from annoweave.functions.text import pick
from annoweave.operators.ages import child_ages
from annoweave.operators.inference import Client, code_batches, failed_batches, predictions_of, require_all_ok, run_counts
from annoweave.operators.linking import alignment_mismatch, with_reference
from annoweave.operators.ordering import context_missing, contexts_at, dense_number, head, last_by, record_id, record_number
from annoweave.operators.splits import apply_splits, label_counts, search_splits, transcript_table
from annoweave.schemas import CONTEXT_LINES, SCHEMA_VERSION
from annoweave.sources.commit import commit_together
from annoweave.sources.sinks import guard_lockbox, guard_numbers, guard_outputs, ordered, save_json_lines, write_json_lines
from annoweave.sources.tables import coder_records, row_key, speaker_lines


def keep_row(master: DataFrame, dropped: str) -> Column:
    """Whether a master row stays: its exclusion isn't exactly the one class that is dropped."""
    return ~pick(master, "exclusion").eqNullSafe(F.lit(dropped))


def token_contexts(tokens: DataFrame, lines: DataFrame, size: int = CONTEXT_LINES) -> DataFrame:
    """(half, transcript_id, line, context_before, context_after) for the lines that hold tokens.

    Of several lines of one number the last counts. Which line that is, and whether a
    token stands there, is settled on keys alone; windows are built in chunks that hold a token.
    """
    keys = ["half", "transcript_id", "line"]
    wanted = tokens.select(*keys).distinct()
    last = lines.groupBy(*keys).agg(F.max("ord").alias("ord")).join(wanted, keys, "left_semi")
    item = F.struct("line", "speaker", "utterance", "transcript_line")
    windows = contexts_at(lines, last.select("half", "transcript_id", "ord"), ["half", "transcript_id"], "ord", item, size)
    return windows.select(*keys, "context_before", "context_after")


def build_dataset(master: DataFrame, coder_1: DataFrame, coder_2: DataFrame, transcripts: DataFrame, exclusion: str, owners: tuple[str, str], language: str = "English", workbook: str = "", sheet: str = "Code", size: int = CONTEXT_LINES) -> DataFrame:
    """Token records with contexts, coders and checks.

    master and coder sheets have source_row; transcripts has half and ord (order in its
    sheet). Rows whose exclusion equals the constant are dropped and use no id. Coder
    rows are found by source_row even where their keys differ; that is flagged.
    """
    rows = dense_number(master.filter(keep_row(master, exclusion)), "source_row", "__n")
    rows = rows.select(
        "__n",
        "source_row", row_key(rows).alias("key"), pick(rows, "Transcript").alias("transcript_id"), pick(rows, "Half").cast("int").alias("half"),
        pick(rows, "Line").cast("long").alias("line"), pick(rows, "Speaker").alias("speaker"), pick(rows, "Child_ID").cast("string").alias("child_id"),
        pick(rows, "Negation").alias("target_negator"), pick(rows, "Utterance").alias("target_utterance"),
    )
    for i, (coder, owner) in enumerate(zip((coder_1, coder_2), owners, strict=True), 1):
        c = last_by(coder_records(coder), ["source_row"], "source_row")
        c = c.select("source_row", F.struct(*[x for x in c.columns if x != "source_row"]).alias(f"coder_{i}"))
        rows = rows.join(c, "source_row", "left")
        theirs = F.col(f"coder_{i}")
        rows = rows.withColumn(f"coded_by_{i}", assigned_coder(theirs.isNotNull(), theirs["bloom_label"], theirs["coded_by_raw"], owner)).withColumn(
            f"key_mismatch_{i}", alignment_mismatch(theirs.isNotNull(), F.col("key"), theirs["key"])
        )
    rows = rows.join(token_contexts(rows, speaker_lines(transcripts), size), ["half", "transcript_id", "line"], "left")
    none = F.array().cast("array<struct<line:bigint,speaker:string,utterance:string,transcript_line:string>>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("context_before", "context_after")})
    return rows.select(
        record_id(F.col("__n")).alias("record_id"), F.lit(language).alias("language"), F.struct(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "source_row").alias("source"),
        "source_row", "transcript_id", "half", "line", "speaker", "child_id", "target_negator", "target_utterance", F.lit(size).alias("context_window_size"), "context_before", "context_after",
        "coded_by_1", "coded_by_2", "coder_1", "coder_2", "key_mismatch_1", "key_mismatch_2", context_missing(F.col("context_before"), F.col("context_after")).alias("context_missing"),
    )


def human_reference(built: DataFrame, owners: tuple[str, str]) -> DataFrame:
    """(record_id, source_row, each coder's sheet owner and record)."""
    cols = [c for i, o in enumerate(owners, 1) for c in (F.lit(o).alias(f"coder_{i}_sheet"), F.col(f"coder_{i}"))]
    return built.select("record_id", "source_row", *cols)


def with_ages(records: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Records with their child's age, null where the transcript has none."""
    return records.join(child_ages(transcripts), "transcript_id", "left")


def split_dataset(records: DataFrame, references: DataFrame, transcripts: DataFrame, targets: dict[str, float] | None = None, **search: object) -> DataFrame:
    """Records with labels, ages and their split."""
    labels = references.select("record_id", F.col("coder_1.bloom_label").alias("bloom_1"), F.col("coder_2.bloom_label").alias("bloom_2"))
    labelled = with_reference(records, last_by(labels, ["record_id"], "record_id"))
    aged = with_ages(labelled, transcripts)
    coded = aged.filter(is_coded(F.col("coded_by_1"), F.col("coded_by_2")))
    found = search_splits(transcript_table(coded, order=record_number(F.col("record_id"))), label_counts(coded), targets, **search)
    return apply_splits(aged, found.select("transcript_id", "split"))


def run_model(
    records: DataFrame, split: str, client: Client, prompt: str, out: str, raw_out: str, limit: int | None = None, batch_size: int = 5, max_retries: int = 2, allow_lockbox: bool = False, overwrite: bool = False,
    order: str | None = None, fail_fast: bool = True, store: str | None = None, parallel: int | None = None, **about: str,
) -> dict[str, int]:
    """Code a split and write predictions and replies as one commit; if any batch fails, only failures are written.

    Records are taken, and a limit counts, by the integer column `order` (the row in the
    file they come from), else by the number in their id. The run stops soon after its first
    dead batch unless fail_fast is off. `store` is a folder of replies that are used again. What
    else is told (model, versions, the prompt's path) goes into replies and failures.

    Returns the run's counts, taken while the outputs were written.
    """
    guard_lockbox(split, allow_lockbox)
    guard_numbers(limit, batch_size, max_retries)
    guard_outputs(records.sparkSession, [out, raw_out], overwrite)
    chosen = records.filter(F.col("split") == split).withColumn("number", F.col(order) if order else record_number(F.col("record_id")))
    chosen = head(chosen, limit, "number") if limit else chosen
    if chosen.isEmpty():
        raise ValueError(f"no records in {split}")
    told = {"schema_version": SCHEMA_VERSION} | about
    results = code_batches(chosen, client, prompt, batch_size, max_retries, fail_fast=fail_fast, store=store, settings=json.dumps(told, sort_keys=True), parallel=parallel)
    results = results.withColumns({k: F.lit(v) for k, v in told.items()})
    failed = failed_batches(results)
    if not failed.isEmpty():
        write_json_lines(failed, f"{out}.failed", ["batch_number"], overwrite=True)
    require_all_ok(results)
    replies = ordered(results.withColumn("raw_response", F.col("response")), ["batch_number"])
    shown = ["batch_number", "record_ids", *told, "raw_response"]
    seen = commit_together(
        records.sparkSession,
        {
            out: (ordered(predictions_of(results), ["batch_number", "pos"]), save_json_lines),
            raw_out: (replies, lambda df, path: save_json_lines(df.select(*shown), path)),
        },
        overwrite,
        {raw_out: run_counts()},
    )
    return {"n_predictions": seen[out]["rows"]} | {k: seen[raw_out][k] for k in run_counts()}
