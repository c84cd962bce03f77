"""The build, split and run stages as queries over stand-in sheets, with their SQL.

A transcript is a conversation, cut into halves; a line is a turn; the master sheet has
a row for each turn, coder sheets have some of them. Files go to the shared folder, are
read back and stored as a checkpoint, and are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoweave.functions.text import json_safe, json_text, pick, xml_text
from annoweave.operators import splits as sp
from annoweave.operators.inference import TASK, code_batches, predictions_of, stub_client, user_message
from annoweave.operators.ordering import dense_number, record_id
from annoweave.operators.validation import with_verdict
from annoweave.plans import charts, pipeline
from annoweave.queries import UNITS_SQL, agreement_sql, coded_units, fixed_split, prompt_units, query, split_units, synthetic_response, table, through_files, units
from annoweave.schemas import FLAGS, LOCKBOX_SPLIT, NEITHER_SPLIT, PROMPT_FIELDS, SPLIT_TARGETS, TOKEN
from annoweave.session import cut, shared_folder
from annoweave.sources import sinks
from annoweave.sources.spreadsheet import read_sheet, workbook
from annoweave.sources.tables import read_json_lines, read_whole_texts
from annoweave.sources.workbooks import WorkbookSource

DROPPED = "left out"
OWNERS = ("Ann", "Bo")


def master_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") + F.col("turn")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("source_row"), F.concat(F.lit("t"), "conv_id").alias("Transcript"), F.lit(" no ").alias("Negation"),
        F.when(F.col("turn") < 3, "1").otherwise("2").alias("Half"), F.col("turn").cast("string").alias("Line"), F.concat(F.lit("*"), F.upper("role"), F.lit(":")).alias("Speaker"),
        F.concat(F.lit("u"), "turn").alias("Utterance"), (F.col("conv_id") % 50).alias("Child_ID"), F.when(k % 9 == 0, f" {DROPPED} ").when(k % 9 == 1, "otherwise").alias("exclusion"),
    )


def coder_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sheets in which rows are missing, differ in a key field, or have a header with spaces around it."""
    m, k = master_sheet(spark, sf_dir), F.col("source_row")
    changed = F.when(k % 13 == 0, "other words").otherwise(F.col("Utterance"))
    label = F.when(k % 4 == 1, "Denial").when(k % 4 == 2, "Rejection").when(k % 4 == 3, " Nonexistence ")
    first = m.withColumns({"Utterance": changed, "Bloom": label, "coded_by": F.when(k % 5 == 0, " Cy "), "Singing?": F.when(k % 3 == 0, "y").when(k % 3 == 1, "0")}).filter(k % 11 != 0)
    second = m.withColumn(" Bloom ", F.when(k % 3 == 0, "Denial")).filter(k % 2 == 0)
    return first, second


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header row with an age, and all turns; every fifth is a comment and no speaker's line."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") < 3, 1).otherwise(2).alias("half"))
    name = F.concat(F.lit("t"), "conv_id").alias("Transcript")
    lines = c.select("half", F.col("turn").cast("int").alias("ord"), name, F.when(F.col("turn") % 5 == 4, "@Comment").otherwise(F.concat(F.lit("*"), F.upper("role"), F.lit(":"))).alias("Speaker"), F.concat(F.lit("u"), "turn").alias("Utterance"), F.col("turn").alias("Line"))
    age = F.concat_ws("|", F.lit("eng"), F.lit("c"), F.lit("CHI"), F.concat((1 + F.col("conv_id") % 4).cast("string"), F.lit(";0"), (F.col("conv_id") % 9).cast("string"), F.lit(".")), F.lit("f"), F.lit(""), F.lit(""), F.lit("Target_Child"))
    headers = c.filter((F.col("turn") == 0) & (F.col("conv_id") % 6 != 5)).select("half", F.lit(-1).alias("ord"), name, F.lit("@ID:").alias("Speaker"), age.alias("Utterance"), F.lit(None).cast("long").alias("Line"))
    return lines.unionByName(headers)


def built(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    return pipeline.build_dataset(master_sheet(spark, sf_dir), *coder_sheets(spark, sf_dir), transcript_lines(spark, sf_dir), DROPPED, OWNERS, workbook="m.xlsx", size=size)


def built_sql(size: int = 20) -> str:
    frame = "OVER (PARTITION BY conv_id, half ORDER BY turn ROWS BETWEEN {} AND {})"
    before, after = frame.format(f"{size} PRECEDING", "1 PRECEDING"), frame.format("1 FOLLOWING", f"{size} FOLLOWING")
    return f"""
m AS (SELECT *, conv_id * 1000 + turn AS k, CASE WHEN turn < 3 THEN 1 ELSE 2 END AS half, '*' || upper(role) || ':' AS speaker FROM conversations),
w AS (SELECT conv_id, turn, list(turn) {before} AS b, list(turn) {after} AS a FROM m WHERE turn % 5 <> 4),
t AS (
  SELECT printf('eng_%06d', row_number() OVER (ORDER BY k)) AS record_id, k::INTEGER AS source_row, m.conv_id, m.turn, 't' || m.conv_id AS transcript_id, half, speaker,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN 'NA' WHEN k % 5 = 0 THEN 'Cy' ELSE 'Ann' END AS coded_by_1,
    CASE WHEN k % 2 <> 0 THEN NULL WHEN k % 3 <> 0 THEN 'NA' ELSE 'Bo' END AS coded_by_2,
    CASE WHEN k % 11 <> 0 THEN CASE k % 4 WHEN 1 THEN 'Denial' WHEN 2 THEN 'Rejection' WHEN 3 THEN 'Nonexistence' END END AS bloom_1,
    CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'Denial' END AS bloom_2,
    CASE WHEN k % 11 <> 0 THEN CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END END AS singing_1,
    k % 11 = 0 OR k % 13 = 0 AS key_mismatch_1, k % 2 <> 0 AS key_mismatch_2, coalesce(len(b), 0) = 0 AND coalesce(len(a), 0) = 0 AS context_missing, coalesce(b, []) AS b, coalesce(a, []) AS a
  FROM m LEFT JOIN w ON m.conv_id = w.conv_id AND m.turn = w.turn WHERE (m.conv_id + m.turn) % 9 <> 0)"""


_LINES = lambda c: F.array_join(F.transform(c, lambda x: x["line"].cast("string")), ",")
_BUILT = "record_id, source_row, transcript_id, half, turn AS line, speaker, coded_by_1, coded_by_2, bloom_1, bloom_2, singing_1, key_mismatch_1, key_mismatch_2, context_missing, array_to_string(b, ',') AS before_lines, array_to_string(a, ',') AS after_lines"


def _shown(b: DataFrame) -> DataFrame:
    return b.select(
        "record_id", "source_row", "transcript_id", "half", "line", "speaker", "coded_by_1", "coded_by_2", F.col("coder_1.bloom_label").alias("bloom_1"), F.col("coder_2.bloom_label").alias("bloom_2"),
        F.col("coder_1.flags.singing").alias("singing_1"), "key_mismatch_1", "key_mismatch_2", "context_missing", _LINES("context_before").alias("before_lines"), _LINES("context_after").alias("after_lines"),
    )


# -- build -------------------------------------------------------------------


@query(f"WITH {built_sql()} SELECT {_BUILT} FROM t")
def build_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(built(spark, sf_dir))


@query(f"WITH {built_sql(2)} SELECT {_BUILT}, 2 AS context_window_size FROM t")
def build_small_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir, 2)
    return _shown(b).join(b.select("record_id", "context_window_size"), "record_id")


@query(f"""WITH {built_sql()} SELECT count(*) AS n_records, count(*) FILTER (WHERE key_mismatch_1) AS n_key_mismatch_1, count(*) FILTER (WHERE key_mismatch_2) AS n_key_mismatch_2,
  count(*) FILTER (WHERE context_missing) AS n_context_missing, (SELECT count(*) FROM conversations WHERE (conv_id + turn) % 9 = 0) AS n_dropped, '{DROPPED}' AS exclusion FROM t""")
def build_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = master_sheet(spark, sf_dir)
    return sinks.build_summary(built(spark, sf_dir), m.filter(~pipeline.keep_row(m, DROPPED)), exclusion=DROPPED)


@query(f"""WITH {built_sql()} SELECT unnest(list_filter([CASE WHEN key_mismatch_1 THEN 'key_mismatch_1' END, CASE WHEN key_mismatch_2 THEN 'key_mismatch_2' END,
  CASE WHEN context_missing THEN 'context_missing' END], lambda x: x IS NOT NULL)) AS problem, source_row FROM t""")
def build_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.problem_rows(built(spark, sf_dir))


@query(f"WITH {built_sql()} SELECT record_id, 'Ann' AS coder_1_sheet, bloom_1, 'Bo' AS coder_2_sheet, bloom_2 FROM t")
def human_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline.human_reference(built(spark, sf_dir), OWNERS)
    return r.select("record_id", "coder_1_sheet", F.col("coder_1.bloom_label").alias("bloom_1"), "coder_2_sheet", F.col("coder_2.bloom_label").alias("bloom_2"))


@query("SELECT n_nationkey + 2 AS source_row, n_name AS Bloom, n_regionkey::VARCHAR AS Line, NULL::VARCHAR AS Gone FROM nation")
def sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [[r["n_name"], str(r["n_regionkey"])] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows

    def work(folder: str) -> DataFrame:
        sinks.write_text(spark, f"{folder}/coder.xlsx", workbook({"Other": [["x"]], "Code": [[" Bloom ", "Line"], *rows]}))
        return read_sheet(spark, f"{folder}/coder.xlsx", "Code", ["Bloom", "Line", "Gone"])

    return through_files(spark, work)


@query("""SELECT 'region ' || n_regionkey || '.xlsx' AS source_file, 'Code' AS sheet, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1)::INTEGER AS source_row, n_name AS Bloom, n_nationkey::VARCHAR AS Line FROM nation
UNION ALL SELECT DISTINCT 'region ' || n_regionkey || '.xlsx', 'Other', 2, NULL, 'x' FROM nation""")
def workbook_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several workbooks of two sheets each, read as a data source; a sheet without a column has nulls there."""
    spark.dataSource.register(WorkbookSource)
    rows: dict[int, list[list[str]]] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        rows.setdefault(r["n_regionkey"], []).append([r["n_name"], str(r["n_nationkey"])])

    def work(folder: str) -> DataFrame:
        for region, own in rows.items():
            sinks.write_text(spark, f"{folder}/region {region}.xlsx", workbook({"Code": [[" Bloom ", "Line"], *own], "Other": [["Line"], ["x"]]}))
        return spark.read.format("workbook").option("sheets", "Code|Other").load(folder)

    return through_files(spark, work)


@query(f"WITH {built_sql()} SELECT record_id, transcript_id, half, turn AS line, source_row, coded_by_1, coded_by_2, 'no' AS target_negator, len(b)::INTEGER AS n_before, len(a)::INTEGER AS n_after FROM t")
def dataset_as_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(folder: str) -> DataFrame:
        sinks.write_json_lines(built(spark, sf_dir).select(*[f.name for f in TOKEN.fields]), f"{folder}/dataset.jsonl", ["record_id"])
        return read_json_lines(spark, f"{folder}/dataset.jsonl", TOKEN)

    r = through_files(spark, work)
    return r.select("record_id", "transcript_id", "half", "line", F.col("source.source_row").alias("source_row"), "coded_by_1", "coded_by_2", "target_negator", F.size("context_before").alias("n_before"), F.size("context_after").alias("n_after"))


def _csv_back(spark: SparkSession, flat: DataFrame) -> DataFrame:
    def work(folder: str) -> DataFrame:
        sinks.write_csv(flat, f"{folder}/dataset.csv", ["record_id"])
        return spark.read.csv(f"{folder}/dataset.csv", header=True, escape='"')

    r = through_files(spark, work)
    n = lambda c: F.json_array_length(c).alias(c.replace("context", "n").removesuffix("_json"))
    return r.select("record_id", "source_row", "coded_by_1", "coded_by_2", n("context_before_json"), n("context_after_json"), *[c for c in r.columns if c in ("split", "child_age_raw")], F.lit(len(r.columns)).alias("n_columns"))


@query(f"WITH {built_sql()} SELECT record_id, source_row::VARCHAR AS source_row, coded_by_1, coded_by_2, len(b)::INTEGER AS n_before, len(a)::INTEGER AS n_after, 14 AS n_columns FROM t")
def dataset_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_back(spark, sinks.flat_dataset(built(spark, sf_dir)))


_PICK = "('0x' || substr(md5(transcript_id), 1, 4))::INTEGER % 100"
_FIXED = f"CASE WHEN {_PICK} < 20 THEN 'dev_train' WHEN {_PICK} < 45 THEN 'dev_check_1' WHEN {_PICK} < 70 THEN 'dev_check_2' ELSE 'test_lockbox' END"
_AGE_SQL = "CASE WHEN conv_id % 6 <> 5 THEN (1 + conv_id % 4) || ';0' || (conv_id % 9) || '.' END"
_SPLIT_SQL = f"CASE WHEN coded_by_1 = 'NA' AND coded_by_2 = 'NA' THEN '{NEITHER_SPLIT}' ELSE {_FIXED} END"


def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    assigned = b.select("transcript_id").distinct().withColumn("split", fixed_split(F.col("transcript_id")))
    return sp.apply_splits(pipeline.with_ages(b, transcript_lines(spark, sf_dir)), assigned)


@query(f"""WITH {built_sql()} SELECT record_id, source_row::VARCHAR AS source_row, coded_by_1, coded_by_2, len(b)::INTEGER AS n_before, len(a)::INTEGER AS n_after, {_SPLIT_SQL} AS split, {_AGE_SQL} AS child_age_raw, 17 AS n_columns FROM t""")
def split_dataset_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_back(spark, sinks.flat_dataset(split_tokens(spark, sf_dir)))


@query(f"""WITH {built_sql()} SELECT {_SPLIT_SQL} AS split, {_AGE_SQL} IS NULL AS no_age, count(*) AS n, round(sum((1 + conv_id % 4) * 12 + conv_id % 9) FILTER (WHERE conv_id % 6 <> 5), 6)::DOUBLE AS months FROM t GROUP BY ALL""")
def tokens_by_split_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = split_tokens(spark, sf_dir)
    return t.groupBy("split", F.col("child_age_raw").isNull().alias("no_age")).agg(F.count(F.lit(1)).alias("n"), F.sum("child_age_months").alias("months"))


@query("SELECT conv_id, turn FROM conversations")
def blank_tolerant_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(folder: str) -> DataFrame:
        c = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn")).alias("value"), "turn")
        c.select(F.explode(F.when(F.col("turn") == 0, F.array(F.lit(""), "value")).otherwise(F.array("value"))).alias("value")).write.text(f"{folder}/x.jsonl")
        return read_json_lines(spark, f"{folder}/x.jsonl", "conv_id long, turn long", strict=False)

    return through_files(spark, work)


@query("SELECT n_nationkey, n_name || chr(10) || 'é' || chr(10) || chr(10) || n_regionkey || chr(10) AS prompt FROM nation")
def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a row, of several lines, each read back as one string."""
    prompt = F.concat_ws("\n", "n_name", F.lit("é"), F.lit(""), F.col("n_regionkey").cast("string"))

    def work(folder: str) -> DataFrame:
        table(spark, sf_dir, "nation").select("n_nationkey", prompt.alias("value")).write.partitionBy("n_nationkey").text(f"{folder}/prompts")
        return read_whole_texts(spark, f"{folder}/prompts").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("text").alias("prompt"))

    return through_files(spark, work)


# -- split -------------------------------------------------------------------


@query(f"WITH {UNITS_SQL} SELECT record_id, split FROM u")
def applied_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    assigned = u.select("transcript_id").distinct().withColumn("split", fixed_split(F.col("transcript_id")))
    return sp.apply_splits(u, assigned).select("record_id", "split")


@query(f"""WITH {UNITS_SQL} SELECT count(DISTINCT transcript_id) AS n_transcripts, {len(SPLIT_TARGETS)}::BIGINT AS n_splits, true AS each_once, true AS score_is_its_objective, true AS no_worse_than_fixed,
  true AS best_is_the_first_least FROM u WHERE status <> 'neither'""")
def split_search_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the whole search: every transcript once, all splits filled, the score of its own assignment, the least of all trials."""
    coded = cut(coded_units(spark, sf_dir).select("transcript_id", "coded_by_1", "coded_by_2", "bloom_1", "bloom_2", "child_age_months"))
    t, pairs = sp.transcript_table(coded), sp.label_counts(coded)
    found = cut(sp.search_splits(t, pairs))
    fewer = sp.search_splits(t, pairs, iterations=200).select("score", "iteration").first()
    best = found.select("score", "iteration").first()
    own = sp.split_objective(t, pairs, found.select("transcript_id", "split")).select(F.col("score").alias("own"))
    fixed = sp.split_objective(t, pairs, t.select("transcript_id", fixed_split(F.col("transcript_id")).alias("split"))).select(F.col("score").alias("fixed"))
    first = best["score"] < fewer["score"] or (best["score"], best["iteration"]) == tuple(fewer)
    sums = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("transcript_id").alias("n_transcripts"), F.countDistinct("split").alias("n_splits"), F.max("score").alias("score"))
    return sums.crossJoin(own).crossJoin(fixed).select(  # one row each
        "n_transcripts", "n_splits", (F.col("n") == F.col("n_transcripts")).alias("each_once"), (F.abs(F.col("own") - F.col("score")) < 1e-9).alias("score_is_its_objective"),
        (F.col("score") <= F.col("fixed") + 1e-9).alias("no_worse_than_fixed"), F.lit(first).alias("best_is_the_first_least"),
    )


_POINTS = f"{UNITS_SQL}, {agreement_sql('split, transcript_id', of='u')}, pts AS (SELECT * FROM irr WHERE n_overlap > 0)"


@query(f"""WITH {_POINTS}, d AS (SELECT split, round((list_sum(list_transform(string_split(transcript_id, ''), lambda c: unicode(c))) % 1000 / 999 - 0.5) * 180 * 0.68) AS x,
  round(320 - 280 * exact_agreement) AS y, round(2.2 + 5.8 * sqrt(n_overlap / (SELECT max(n_overlap) FROM pts)), 2) AS r FROM pts)
SELECT split, x, y, max(r) AS r, count(*) AS n FROM d GROUP BY ALL""")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.scatter_points(sp.agreement_points(split_units(spark, sf_dir)))


@query(f"""WITH {UNITS_SQL}, s AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE status = 'both_coders') AS b, count(*) FILTER (WHERE status = 'one_coder') AS o, count(*) FILTER (WHERE status = 'neither') AS z FROM u GROUP BY split)
SELECT split, unnest(['both_coders', 'one_coder', 'neither']) AS status, unnest([0, b * 440 / n, (b + o) * 440 / n])::DOUBLE AS x, unnest([b * 440 / n, o * 440 / n, z * 440 / n])::DOUBLE AS width FROM s""")
def dashboard_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.status_bars(sp.split_summary(split_units(spark, sf_dir)))


@query(f"""WITH {UNITS_SQL}, s AS (SELECT split, count(*) AS n, count(DISTINCT transcript_id) AS t FROM u GROUP BY split)
SELECT split || ': ' || n || ' rows, ' || t || ' transcripts' AS title, true AS well_formed FROM s""")
def dashboard_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels of the drawn dashboard, read back from its XML."""
    summary = sp.split_summary(split_units(spark, sf_dir))
    svg = charts.split_dashboard([r.asDict() for r in summary.orderBy("split").collect()], {})  # a row a split
    titles = [t.text for t in ElementTree.fromstring(svg).iter("{http://www.w3.org/2000/svg}text") if (t.text or "").endswith(" transcripts")]
    return spark.createDataFrame([(t, True) for t in titles], "title string, well_formed boolean")


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS content FROM pages")
def escaped_for_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", xml_text(F.col("html")).alias("content"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, json_object('event_id', event_id, 'none', NULL)::VARCHAR AS record FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.select("event_id", json_safe(e, "day").alias("day"), json_text(F.struct(json_safe(e, "event_id").alias("event_id"), F.lit(None).cast("string").alias("none"))).alias("record"))


# -- run ---------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 18 WHEN 0 THEN NULL WHEN 17 THEN 'V-16' WHEN 16 THEN 'json' ELSE 'V-' || (doc_id % 18) END AS code,
  CASE doc_id % 18 WHEN 5 THEN 'keys that a prediction can''t have: why' WHEN 6 THEN 'keys that a prediction lacks: bloom_label, comments, flags' WHEN 15 THEN 'records without a prediction: ' || printf('eng_%06d', doc_id)
    WHEN 11 THEN printf('eng_%06d', doc_id) || ': the flags must be these: foreign_language_negation, mimicry, not_a_negation, repetition, singing, tag_question' END AS listed FROM documents""")
def fault_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check's code, with an id asked for twice for the last one, and the messages that list names."""
    i, rid = F.col("doc_id"), record_id(F.col("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", synthetic_response(i, i % 18).alias("reply"), F.when(i % 18 == 17, F.array(rid, rid)).otherwise(F.array(rid)).alias("ids"))
    return with_verdict(d, "reply", "ids").select("doc_id", "v.code", F.when((i % 18).isin(5, 6, 11, 15), F.col("v.message")).alias("listed"))


def _answer(kind: int, ids: list[str]) -> str:
    rows = [{"record_id": i, "bloom_label": "Denial" if kind == 0 else "denial", "flags": dict.fromkeys(FLAGS, "No"), "comments": ""} for i in ids]
    return json.dumps({"schema_version": "bloom_v1", "predictions": rows[::-1]})


def moody_client(system: str, user: str) -> str:
    """Answers by the first record's line: well, well when told what was wrong, never well, not in JSON, or not at all."""
    records = json.JSONDecoder().raw_decode(user[user.index("[") :])[0]
    kind, told = int(records[0]["line"]) % 5, "no such label" in user
    if kind == 4:
        raise RuntimeError("out of order")
    if kind == 3:
        return "I can't say."
    return _answer(0 if kind == 0 or (kind == 1 and told) else 1, [r["record_id"] for r in records])


def _numbered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_units with a dense number as line, so that batches of two have every mood."""
    return dense_number(prompt_units(spark, sf_dir).drop("line"), "number", "n").withColumn("line", F.floor((F.col("n") - 1) / 2)).drop("n")


_BATCHES = """n AS (SELECT 'eng_' || conv_id || '_' || turn AS record_id, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS n FROM conversations),
b AS (SELECT n // 2 + 1 AS batch_number, list(record_id ORDER BY n) AS ids, min(n) // 2 % 5 AS kind FROM n GROUP BY ALL)"""


@query(f"""WITH {_BATCHES} SELECT batch_number, array_to_string(ids, ',') AS ids, ['ok', 'ok', 'invalid', 'not_json', 'unreachable'][kind + 1] AS status, [1, 2, 3, 1, 1][kind + 1] AS attempts,
  CASE kind WHEN 2 THEN ids[-1] || ': no such label as "denial"' WHEN 3 THEN 'the reply holds no JSON' WHEN 4 THEN 'out of order' END AS error FROM b""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = code_batches(_numbered_units(spark, sf_dir), moody_client, "p", batch_size=2)
    return r.select("batch_number", F.array_join("record_ids", ",").alias("ids"), "status", "attempts", "error")


@query(f"""WITH {_BATCHES} SELECT batch_number, unnest(range(len(ids)))::INTEGER AS pos, unnest(list_reverse(ids)) AS record_id, 'Denial' AS bloom_label FROM b WHERE kind < 2""")
def prediction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = predictions_of(code_batches(_numbered_units(spark, sf_dir), moody_client, "p", batch_size=2))
    return r.select("batch_number", "pos", "record_id", "bloom_label")


def _run(spark: SparkSession, sf_dir: str, folder: str, client: Callable[[str, str], str]) -> None:
    u = prompt_units(spark, sf_dir).withColumn("split", F.when(F.col("line") == 0, "dev_train").otherwise("dev_check_1"))
    u = u.withColumn("record_id", F.format_string("eng_%06d", F.col("number")))
    pipeline.run_model(u, "dev_train", client, "prompt", f"{folder}/p.jsonl", f"{folder}/r.jsonl", fail_fast=False, model="stub", prompt_version="p001")


@query("""WITH n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS n FROM conversations WHERE turn = 0)
SELECT n // 5 + 1 AS batch_number, (n % 5)::INTEGER AS pos, printf('eng_%06d', conv_id * 1000) AS record_id, 'stub' AS model, 'bloom_v1' AS schema_version, 'p001' AS prompt_version FROM n""")
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined with the raw replies of their batch, both read back from files."""
    def work(folder: str) -> DataFrame:
        _run(spark, sf_dir, folder, stub_client)
        p = spark.read.schema("batch_number long, pos int, record_id string").json(f"{folder}/p.jsonl")
        r = spark.read.schema("batch_number long, record_ids array<string>, model string, schema_version string, prompt_version string").json(f"{folder}/r.jsonl")
        return p.join(r, "batch_number").filter(F.array_contains("record_ids", F.col("record_id"))).drop("record_ids")

    return through_files(spark, work)


@query("""SELECT false AS predictions_written, count(*) AS n_records, true AS failures_written, 'bloom_v1' AS schema_version FROM conversations WHERE turn = 0""")
def failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches fail: failures are written, predictions and replies are not."""
    folder = shared_folder(spark, "files")
    try:
        _run(spark, sf_dir, folder, lambda system, user: _answer(1, []))
        failed = False
    except RuntimeError:
        failed = True
    f = spark.read.schema("batch_number long, record_ids array<string>, status string, schema_version string").json(f"{folder}/p.jsonl.failed")
    sums = cut(f.agg(F.sum(F.size("record_ids")).alias("n_records"), F.max("schema_version").alias("schema_version")))
    written = sinks.path_exists(spark, f"{folder}/p.jsonl") or sinks.path_exists(spark, f"{folder}/r.jsonl")
    sinks.remove(spark, folder)
    return sums.select(F.lit(written).alias("predictions_written"), "n_records", F.lit(failed).alias("failures_written"), "schema_version")


_ASKED = "CASE doc_id % 4 WHEN 0 THEN 'dev_train' WHEN 1 THEN 'test_lockbox' WHEN 2 THEN 'x/test_lockbox.jsonl' ELSE 'dev_check_1' END"


@query(f"""SELECT doc_id, CASE WHEN {_ASKED} LIKE '%test_lockbox%' AND doc_id % 3 <> 0 THEN {_ASKED} || ' is held out' WHEN doc_id % 5 = 0 AND doc_id % 10 < 5 THEN 'limit must be positive'
  WHEN doc_id % 7 = 0 THEN 'batch size must be positive' WHEN doc_id % 11 = 0 THEN 'max retries must not be negative' END AS refused, doc_id % 2 = 0 AND doc_id % 13 <> 0 AS outputs_refused FROM documents""")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the run that a row asks for is refused: by its arguments, and by outputs that are there and may not be replaced."""
    i = F.col("doc_id")
    split = F.when(i % 4 == 0, "dev_train").when(i % 4 == 1, LOCKBOX_SPLIT).when(i % 4 == 2, f"x/{LOCKBOX_SPLIT}.jsonl").otherwise("dev_check_1")
    limit = F.when(i % 5 == 0, F.when(i % 10 < 5, 0).otherwise(3))
    d = table(spark, sf_dir, "documents").select("doc_id", sinks.refusal(split, i % 3 == 0, limit, F.when(i % 7 == 0, 0).otherwise(5), F.when(i % 11 == 0, -1).otherwise(2)).alias("refused"))
    held = {r: _refused(lambda o=o, p=p: sinks.guard_outputs(spark, [p], o)) for r, (p, o) in {"there": (f"{sf_dir}/documents.parquet", False), "replaced": (f"{sf_dir}/documents.parquet", True), "free": (f"{sf_dir}/nothing.jsonl", False)}.items()}
    kind = F.when(i % 2 == 1, "free").when(i % 13 == 0, "replaced").otherwise("there")
    return d.withColumn("outputs_refused", F.element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), kind))


def _refused(call: Callable[[], object]) -> bool:
    try:
        call()
    except sinks.Refused:
        return True
    return False


@query("""SELECT doc_id, 'dev_' || doc_id % 9 || '_' || CASE WHEN lang IS NULL THEN 'model' ELSE 'm_' || lang || '_' || source END || '_bloom_v1_p001_' || CASE WHEN doc_id % 2 = 0 THEN 'limit-' || (doc_id + 1) || '_' ELSE '' END || 'predictions.jsonl' AS name FROM documents""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    model = F.when(F.col("lang").isNull(), "/:/").otherwise(F.concat(F.lit("/m: "), "lang", F.lit(" é "), "source", F.lit("/")))
    name = sinks.output_names(F.concat(F.lit("dev_"), (i % 9).cast("string")), model, F.lit("bloom_v1"), F.lit("p001"), F.lit("predictions"), F.when(i % 2 == 0, i + 1))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


@query("SELECT 'document ' || doc_id AS item, sha256(coalesce(text, '')) AS sha256, coalesce(text, '') AS value FROM documents")
def frozen_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return sinks.freeze_values(d.select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("item"), F.coalesce("text", F.lit("")).alias("value")))


_FIELDS_SQL = " || ',' || chr(10) || ".join(
    f"""'    "{f}": ' || """ + {"record_id": "'\"eng_' || conv_id || '_' || turn || '\"'", "language": "'\"English\"'", "transcript_id": "'\"' || conv_id || '\"'", "line": "turn", "speaker": "'\"' || role || '\"'"}.get(f, "'null'") for f in PROMPT_FIELDS
)


@query(f"SELECT conv_id, turn, '{TASK}' || chr(10) || chr(10) || '[' || chr(10) || '  {{' || chr(10) || {_FIELDS_SQL} || chr(10) || '  }}' || chr(10) || ']' AS message FROM conversations")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = prompt_units(spark, sf_dir).drop("target_utterance").withColumns({"conv_id": F.floor(F.col("number") / 1000), "turn": F.col("number") % 1000})

    def run(frames):
        for f in frames:
            rows = [{k: r.get(k) for k in PROMPT_FIELDS} for r in f[["record_id", "language", "transcript_id", "line", "speaker"]].to_dict("records")]
            yield pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "message": [user_message([r]) for r in rows]})

    return u.select("conv_id", "turn", "record_id", "language", "transcript_id", "line", "speaker").mapInPandas(run, "conv_id long, turn long, message string")


@query("""SELECT l.conv_id, l.turn, l.turn % 2 = 0 AS there, CASE WHEN l.turn % 2 = 0 THEN 'v' || l.turn END AS last_of_equal, NULL::VARCHAR AS gone FROM conversations l""")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by header: spaces around it, dots and question marks in it, two that are equal once stripped, one that isn't there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, " x ").alias("Is.it?"), F.lit("first").alias("Twice"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("v"), "turn", F.lit(" "))).alias(" Twice "))
    return c.select("conv_id", "turn", F.coalesce(pick(c, "Is.it?") == "x", F.lit(False)).alias("there"), pick(c, "Twice").alias("last_of_equal"), pick(c, "Gone").alias("gone"))
