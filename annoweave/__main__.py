"""Command line: build a dataset from workbooks, split it, run a model on a split.

    python -m annoweave build --master m.xlsx --coder-1 a.xlsx --coder-2 b.xlsx --owner-1 Ann --owner-2 Bo --out datasets
    python -m annoweave split --data datasets --master m.xlsx --out splits
    python -m annoweave run --split dev_train --model stub --limit 20 --split-dir splits --results-dir results --prompt prompt.md
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annoweave import schemas
from annoweave.operators.ages import age_histogram
from annoweave.operators.inference import ChatClient, stub_client
from annoweave.operators.splits import agreement_points, references_by_split, split_summary, transcript_manifest
from annoweave.plans import charts, pipeline
from annoweave.sources import sinks
from annoweave.sources.spreadsheet import read_sheet
from annoweave.sources.tables import read_json_lines, read_whole_text, transcript_halves

MASTER_COLUMNS = [*schemas.KEY_COLUMNS, "Child_ID", "exclusion"]
CODER_COLUMNS = [*schemas.KEY_COLUMNS, *schemas.CODER_FIELDS.values(), *schemas.FLAG_COLUMNS.values()]
LINE_COLUMNS = ["Transcript", "Speaker", "Utterance", "Line", "transcript_line"]


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return transcript_halves(*[read_sheet(spark, path, s, LINE_COLUMNS).withColumnRenamed("source_row", "ord") for s in schemas.TRANSCRIPT_SHEETS])


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    owners = (a.owner_1, a.owner_2)
    master = read_sheet(spark, a.master, schemas.CODE_SHEET, MASTER_COLUMNS)
    coders = [read_sheet(spark, p, schemas.CODE_SHEET, CODER_COLUMNS) for p in (a.coder_1, a.coder_2)]
    built = pipeline.build_dataset(master, *coders, transcripts(spark, a.master), schemas.EXCLUSION, owners, workbook=Path(a.master).name).cache()
    names = [f.name for f in schemas.TOKEN.fields]
    sinks.write_json_lines(built.select(*names), f"{a.out}/dataset.jsonl", ["record_id"], overwrite=a.overwrite)
    sinks.write_json_lines(pipeline.human_reference(built, owners), f"{a.out}/reference.jsonl", ["record_id"], overwrite=a.overwrite)
    sinks.write_csv(sinks.flat_dataset(built), f"{a.out}/dataset.csv", ["record_id"], overwrite=a.overwrite)
    dropped = master.filter(~pipeline.keep_row(master, schemas.EXCLUSION))
    summary = sinks.build_summary(built, dropped, rows=True, exclusion=schemas.EXCLUSION, context_window_size=schemas.CONTEXT_LINES)
    sinks.write_json_lines(summary, f"{a.out}/summary.json", [], one_file=True, overwrite=a.overwrite)
    return summary.first().asDict()


def split(spark: SparkSession, a: argparse.Namespace) -> dict:
    records = read_json_lines(spark, f"{a.data}/dataset.jsonl", schemas.TOKEN)
    coder = "struct<bloom_label:string>"
    refs = read_json_lines(spark, f"{a.data}/reference.jsonl", f"record_id string, source_row int, coder_1_sheet string, coder_1 {coder}, coder_2_sheet string, coder_2 {coder}")
    out = pipeline.split_dataset(records, refs, transcripts(spark, a.master), iterations=a.iterations, seed=a.seed, sequential=a.sequential).cache()
    names = [*schemas.SPLIT_TARGETS, schemas.NEITHER_SPLIT]
    labelled = references_by_split(refs, out)
    for name in names:
        own = out.filter(F.col("split") == name)
        sinks.write_json_lines(own, f"{a.out}/{name}.jsonl", ["record_id"], overwrite=a.overwrite)
        sinks.write_csv(sinks.flat_dataset(own), f"{a.out}/{name}.csv", ["record_id"], overwrite=a.overwrite)
        sinks.write_json_lines(labelled.filter(F.col("split") == name), f"{a.out}/{name}_human_reference.jsonl", ["record_id"], overwrite=a.overwrite)
    sinks.write_csv(transcript_manifest(out), f"{a.out}/manifest.csv", ["transcript_id"], one_file=True, overwrite=a.overwrite)
    summary = split_summary(out).cache()
    sinks.write_json_lines(summary, f"{a.out}/summary.json", ["split"], one_file=True, overwrite=a.overwrite)
    sinks.write_csv(summary, f"{a.out}/summary.csv", ["split"], one_file=True, overwrite=a.overwrite)
    rows = [r.asDict() for r in summary.orderBy("split").collect()]  # a row a split
    ages: dict[str, list[float]] = {}
    for r in age_histogram(out, "child_age_months", by=["split"]).collect():
        ages.setdefault(r["split"], [0.0] * 6)[r["bin"]] = r["weight"]
    for name, svg in (("dashboard", charts.split_dashboard(rows, ages)), ("agreement", charts.agreement_scatter(agreement_points(out)))):
        sinks.write_text(spark, f"{a.out}/{name}.svg", svg)
    return {"splits": {r["split"]: r["n_rows"] for r in rows}}


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    began = time.time()
    sinks.guard_lockbox(a.split, a.allow_lockbox)
    sinks.guard_numbers(a.limit, a.batch_size, a.max_retries)
    path = f"{a.split_dir}/{a.split}.jsonl"
    for p in (path, a.prompt):
        if not sinks.path_exists(spark, p):
            raise sinks.Refused(f"{p} doesn't exist")
    records = read_json_lines(spark, path, StructType([*schemas.TOKEN.fields, StructField("split", StringType())]), strict=False, ordinal="file_row")
    client = stub_client if a.model == "stub" else ChatClient(a.url, a.model, a.temperature, a.timeout)
    name = lambda kind: f"{a.results_dir}/" + sinks.output_name(a.split, a.model, schemas.SCHEMA_VERSION, schemas.PROMPT_VERSION, kind, a.limit)
    counts = pipeline.run_model(
        records, a.split, client, read_whole_text(spark, a.prompt), name("predictions"), name("raw_responses"), a.limit, a.batch_size, a.max_retries, a.allow_lockbox, a.overwrite,
        order="file_row", store=a.replies, parallel=a.parallel, model=a.model, prompt_version=schemas.PROMPT_VERSION, prompt_path=a.prompt,
    )
    return {"split": a.split, "model": a.model, **counts, "predictions": name("predictions"), "elapsed_seconds": round(time.time() - began, 2)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annoweave")
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    for o in ("--master", "--coder-1", "--coder-2", "--owner-1", "--owner-2", "--out"):
        b.add_argument(o, required=True)
    s = commands.add_parser("split")
    for o in ("--data", "--master", "--out"):
        s.add_argument(o, required=True)
    s.add_argument("--iterations", type=int, default=schemas.SPLIT_ITERATIONS)
    s.add_argument("--seed", type=int, default=schemas.SPLIT_SEED)
    s.add_argument("--sequential", action="store_true")
    r = commands.add_parser("run")
    r.add_argument("--split", default="dev_train")
    r.add_argument("--model", default="llama3.2", help="'stub' needs no server")
    r.add_argument("--limit", type=int)
    r.add_argument("--batch-size", type=int, default=5)
    r.add_argument("--max-retries", type=int, default=2)
    r.add_argument("--temperature", type=float, default=0.0)
    r.add_argument("--timeout", type=int, default=300)
    r.add_argument("--prompt", required=True)
    r.add_argument("--split-dir", default="splits")
    r.add_argument("--results-dir", default="results")
    r.add_argument("--url", default="http://localhost:11434/api/chat")
    r.add_argument("--replies", help="a folder of replies to use again and add to")
    r.add_argument("--parallel", type=int, help="requests at a time; one a core without it")
    r.add_argument("--allow-lockbox", action="store_true")
    for x in (b, s, r):
        x.add_argument("--overwrite", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("annoweave").getOrCreate()
    try:
        done = {"build": build, "split": split, "run": run}[a.command](spark, a)
    except sinks.Refused as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(done, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
