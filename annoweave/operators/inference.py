"""Batched model coding with validation, retries and all-or-nothing results.

A run goes in rounds. A round asks the model once for each open batch, stores the
replies and judges them as a table; batches whose reply breaks the contract go into the
next round together with the fault. Only the asking is Python.

A run that shall stop at its first dead batch goes in slices of batches that grow as long as
all is well, two at a time under one job tag; a dead batch interrupts what is tagged. A
store of replies, keyed by all that a reply depends on, is looked up before asking.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoweave.functions.text import json_text
from annoweave.operators.ordering import batch_number, dense_number
from annoweave.operators.validation import NOT_JSON, with_verdict
from annoweave.schemas import FLAGS, LABELS, PROMPT_FIELDS, SCHEMA_VERSION
from annoweave.session import cut
from annoweave.sources.sinks import path_exists

#: (system prompt, user message) -> the model's reply text
Client = Callable[[str, str], str]

TASK = "Here are the records of one batch. Answer with one JSON object in the agreed form and nothing else."
AGAIN = "The last answer for this batch broke the agreed form. Answer once more for all of its records. What was wrong:"

RESULT_DDL = "batch_number long, record_ids array<string>, status string, attempts int, error string, response string, predictions string"
_NAMES = [c.split()[0] for c in RESULT_DDL.split(", ")]


def prompt_records(records: DataFrame) -> DataFrame:
    """Only the fields a model may see; a missing one is null. Labels and splits can't pass."""
    there = set(records.columns)
    return records.select(*[F.col(f) if f in there else F.lit(None).cast("string").alias(f) for f in PROMPT_FIELDS])


def user_message(records: list[dict], fault: str | None = None) -> str:
    shown = f"{TASK}\n\n{json.dumps(records, ensure_ascii=False, indent=2)}"
    return shown if fault is None else f"{shown}\n\n{AGAIN} {fault}"


class ChatClient:
    """A client of a chat endpoint with JSON messages; whatever goes wrong on the way is a RuntimeError."""

    def __init__(self, url: str, model: str, temperature: float = 0.0, timeout: int = 300) -> None:
        self.url, self.timeout = url, timeout
        # The endpoint's settings.
        self.settings = {"model": model, "stream": False, "format": "json", "options": {"temperature": temperature}}

    def body(self, system: str, user: str) -> bytes:
        turns = [{"role": who, "content": what} for who, what in (("system", system), ("user", user))]
        return json.dumps(self.settings | {"messages": turns}).encode()

    @staticmethod
    def content(raw: bytes) -> str:
        """The model's text in the endpoint's answer."""
        answer = json.loads(raw)
        said = answer.get("message") if isinstance(answer, dict) else None
        text = said.get("content") if isinstance(said, dict) else None
        if not isinstance(text, str) or not text:
            raise RuntimeError("the endpoint's answer holds no text of the model")
        return text

    def __call__(self, system: str, user: str) -> str:
        post = urllib.request.Request(self.url, self.body(system, user), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(post, timeout=self.timeout) as http:
                return self.content(http.read())
        except (OSError, ValueError) as e:  # unreachable, cut off, or not JSON
            raise RuntimeError(f"{self.url} gave no answer: {e}") from e


def stub_client(system: str, user: str) -> str:
    """A model for tests: codes by the length of the utterance, always by the contract."""
    records = json.JSONDecoder().raw_decode(user[user.index("[") :])[0]
    rows = [{"record_id": r["record_id"], "bloom_label": LABELS[len(r.get("target_utterance") or "") % len(LABELS)], "flags": dict.fromkeys(FLAGS, "No"), "comments": ""} for r in records]
    return json.dumps({"schema_version": SCHEMA_VERSION, "predictions": rows})


def prompt_batches(records: DataFrame, batch_size: int, order: str = "number") -> DataFrame:
    """(batch_number, record_ids, records): each batch's ids and its prompt records as JSON texts, in order."""
    batches = dense_number(records, order, "__n").withColumn("batch_number", batch_number(F.col("__n"), batch_size))
    shown = prompt_records(batches)
    record = json_text(F.struct(*[F.col(c) if c in batches.columns else F.lit(None).cast("string").alias(c) for c in shown.columns]))
    rows = F.array_sort(F.collect_list(F.struct("__n", F.col("record_id").alias("id"), record.alias("record"))))  # batch_size rows
    return batches.groupBy("batch_number").agg(rows.alias("rows")).select("batch_number", F.col("rows.id").alias("record_ids"), F.col("rows.record").alias("records"))


def ask(open_batches: DataFrame, client: Client, prompt: str, stop: bool = False, parallel: int | None = None) -> DataFrame:
    """Add the model's response to each batch, or the error with which it could not be reached; stored at once.

    `fault` is what was wrong with the batch's last response, or null. With `stop` a task
    asks nothing more once it couldn't reach the model: `asked` is false for the rest.
    At most `parallel` requests are made at a time; else one a core.
    """

    def one(records: list[str], fault: str | None) -> tuple[str | None, str | None]:
        rows = [{f: r.get(f) for f in PROMPT_FIELDS} for r in map(json.loads, records)]
        try:
            return client(prompt, user_message(rows, fault)), None
        except RuntimeError as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dead = False
        for f in frames:
            said, asked = [], []
            for records, fault in zip(f["records"], f["fault"], strict=True):
                asked.append(not (dead and stop))
                said.append(one(list(records), fault) if asked[-1] else (None, None))
                dead = dead or said[-1][1] is not None
            yield f.assign(response=[s[0] for s in said], error=[s[1] for s in said], asked=asked)

    dealt = open_batches.repartition(parallel) if parallel else open_batches
    ddl = "batch_number long, record_ids array<string>, records array<string>, fault string"
    in_order = dealt.select(*[c.split()[0] for c in ddl.split(", ")]).sortWithinPartitions("batch_number")  # so whatever comes before a dead batch is asked
    return cut(in_order.mapInPandas(run, f"{ddl}, response string, error string, asked boolean"))


def reply_key(settings: str, prompt: str) -> Column:
    """Digest of all that a batch's reply depends on: the model's settings, the prompt, the records and the fault that is told."""
    return F.sha2(json_text(F.struct(F.lit(settings).alias("settings"), F.lit(prompt).alias("prompt"), "records", "fault")), 256)


def asked_or_stored(open_batches: DataFrame, client: Client, prompt: str, store: str, settings: str, stop: bool = False, parallel: int | None = None) -> DataFrame:
    """As `ask`, but batches whose reply is in the store aren't asked, and what is newly replied is added to it.

    store is a folder; each call adds a folder of (key, response) rows of its own, so calls
    may run side by side. Of several replies to one key the least counts, so a rerun tells the same.
    """
    spark = open_batches.sparkSession
    keyed = open_batches.withColumn("key", reply_key(settings, prompt))
    if path_exists(spark, store):
        known = spark.read.option("recursiveFileLookup", "true").schema("key string, response string").parquet(store)
        known = known.groupBy("key").agg(F.min("response").alias("response"))
    else:
        known = spark.createDataFrame([], "key string, response string")
    met = cut(keyed.join(known, "key", "left"))
    names = ["batch_number", "record_ids", "records", "fault", "response"]
    there = met.filter(F.col("response").isNotNull()).select(*names, F.lit(None).cast("string").alias("error"), F.lit(True).alias("asked"))
    new = met.filter(F.col("response").isNull()).drop("response")
    if new.isEmpty():
        return there
    found = ask(new, client, prompt, stop, parallel)
    found.withColumn("key", reply_key(settings, prompt)).filter(F.col("response").isNotNull()).select("key", "response").write.parquet(f"{store}/{uuid.uuid4().hex}")
    return there.unionByName(found)


def _rounds(waiting: DataFrame, asking: Callable[[DataFrame], DataFrame], max_retries: int) -> DataFrame:
    """The results of the batches that were asked."""
    done: list[DataFrame] = []
    for n in range(1, max_retries + 2):
        judged = with_verdict(asking(waiting).filter("asked"), "response", "record_ids")
        status = F.when(F.col("error").isNotNull(), "unreachable").when(F.col("v.code").isNull(), "ok").when(F.col("v.code") == NOT_JSON, "not_json").otherwise("invalid")
        found = json_text(F.transform("v.predictions", lambda p: p.dropFields("pos")))
        judged = cut(
            judged.withColumn("status", status).select(
                "batch_number", "record_ids", "status", F.lit(n).alias("attempts"), F.coalesce("error", "v.message").alias("error"), "response",
                F.when(F.col("status") == "ok", found).alias("predictions"), "records",
            )
        )
        again = F.col("status") == "invalid"
        if n > max_retries or judged.filter(again).isEmpty():
            done.append(judged)
            break
        done.append(judged.filter(~again))
        waiting = judged.filter(again).select("batch_number", "record_ids", "records", F.col("error").alias("fault"))
    return reduce(DataFrame.unionByName, done).select(*_NAMES)


#: Batches of a stopping run's first slice and of its largest, and slices at a time.
FIRST_SLICE, LAST_SLICE, AHEAD = 16, 1 << 14, 2


def _until_dead(waiting: DataFrame, asking: Callable[[DataFrame], DataFrame], max_retries: int) -> DataFrame:
    """The results of slices of batches up to the first slice with a dead one; slices after it are interrupted."""
    spark, tag = waiting.sparkSession, f"annoweave-run-{uuid.uuid4().hex}"
    batches = cut(waiting)
    last = batches.agg(F.max("batch_number")).first()[0] or 0

    def run(low: int, high: int) -> tuple[DataFrame, bool]:
        spark.addTag(tag)
        found = _rounds(batches.filter(F.col("batch_number").between(low, high)), asking, max_retries)
        return found, failed_batches(found).isEmpty()

    done, open_, at, size, dead = [], set[Future](), 1, FIRST_SLICE, False
    with ThreadPoolExecutor(AHEAD) as pool:
        while open_ or (at <= last and not dead) or not (done or dead):
            while not dead and len(open_) < AHEAD and (at <= last or not (done or open_)):
                open_.add(pool.submit(run, at, at + size - 1))
                at, size = at + size, min(LAST_SLICE, 2 * size)
            over, open_ = wait(open_, return_when=FIRST_COMPLETED)
            for slice_ in over:
                if dead and slice_.exception() is not None:
                    continue  # interrupted
                found, well = slice_.result()
                done.append(found)
                if not well and not dead:
                    dead = True
                    spark.interruptTag(tag)
    return reduce(DataFrame.unionByName, done)


def code_batches(records: DataFrame, client: Client, prompt: str = "", batch_size: int = 5, max_retries: int = 2, order: str = "number", fail_fast: bool = False, store: str | None = None, settings: str = "", parallel: int | None = None) -> DataFrame:
    """One row a batch with the model's reply and its fate.

    status is ok, unreachable, not_json or invalid. Only a reply that breaks the contract
    is asked for again, max_retries times, with its fault. `order` is an integer column.
    Replies are stored before they are judged, so a lost executor later doesn't ask the
    model again; run without speculation. With fail_fast the run stops soon after the first
    batch that is dead for good, and batches that weren't asked have no row. With `store`, a
    folder, replies of earlier runs with the same settings, prompt and records are used.
    """
    if batch_size < 1 or max_retries < 0:
        raise ValueError("batch_size must be positive and max_retries not negative")
    waiting = prompt_batches(records, batch_size, order).withColumn("fault", F.lit(None).cast("string"))

    def asking(some: DataFrame) -> DataFrame:
        return asked_or_stored(some, client, prompt, store, settings, fail_fast, parallel) if store else ask(some, client, prompt, fail_fast, parallel)

    return (_until_dead if fail_fast else _rounds)(waiting, asking, max_retries)


def predictions_of(results: DataFrame) -> DataFrame:
    """Predictions in order of batch and of the model's reply."""
    ddl = "array<struct<record_id:string,bloom_label:string,flags:struct<" + ",".join(f"{f}:string" for f in FLAGS) + ">,comments:string>>"
    rows = results.filter("status = 'ok'").select("batch_number", F.posexplode(F.from_json("predictions", ddl)).alias("pos", "p"))
    return rows.select("batch_number", "pos", "p.*")


def failed_batches(results: DataFrame) -> DataFrame:
    return results.filter("status <> 'ok'")


def require_all_ok(results: DataFrame) -> None:
    """Raise for the first failed batch, if any."""
    bad = failed_batches(results).orderBy("batch_number").first()
    if bad is not None:
        raise RuntimeError(f"batch {bad['batch_number']} failed after {bad['attempts']} attempts: {bad['error']}")


def run_counts() -> dict[str, Column]:
    """Batches, records, attempts and failures of a run's results, as sums that a write can take on its way."""
    return {
        "n_batches": F.count(F.lit(1)),
        "n_records": F.coalesce(F.sum(F.size("record_ids")), F.lit(0)).cast("long"),
        "n_attempts": F.coalesce(F.sum("attempts"), F.lit(0)).cast("long"),
        "n_failed": F.count_if(F.col("status") != "ok"),
    }


def run_summary(results: DataFrame, **about: object) -> DataFrame:
    """One row: batches, records, attempts and failures of a run, and what else is told."""
    return results.agg(*[c.alias(k) for k, c in run_counts().items()]).select("*", *[F.lit(v).alias(k) for k, v in about.items()])
