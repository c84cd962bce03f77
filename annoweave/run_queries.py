"""Contexts of long transcripts, file order, and how a run ends, as queries with their SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annoweave.functions.digests import table_digest
from annoweave.functions.text import prejacent, same_prejacent, words_of
from annoweave.operators import splits as sp
from annoweave.operators.inference import code_batches, predictions_of, reply_key, stub_client
from annoweave.operators.inference import prompt_batches as batches_of
from annoweave.operators.ordering import contexts_at, dense_number, head, record_id, record_number
from annoweave.plans import pipeline
from annoweave.queries import UNITS_SQL, coded_units, prompt_units, query, table, through_files
from annoweave.schemas import FLAGS
from annoweave.session import cut, shared_folder
from annoweave.sources import commit, sinks
from annoweave.sources.tables import read_json_lines

# -- contexts ----------------------------------------------------------------

_FRAME = "OVER (ORDER BY o ROWS BETWEEN {} AND {})"
_B, _A = _FRAME.format("20 PRECEDING", "1 PRECEDING"), _FRAME.format("1 FOLLOWING", "20 FOLLOWING")


@query(f"""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS o, max(l_partkey) AS l_partkey FROM lineitem GROUP BY o),
w AS (SELECT o, l_partkey, count(*) {_B} AS n_before, count(*) {_A} AS n_after, sum(o) {_B} AS sum_before, sum(o) {_A} AS sum_after FROM l)
SELECT o AS line, n_before::INTEGER AS n_before, n_after::INTEGER AS n_after, coalesce(sum_before, 0)::BIGINT AS sum_before, coalesce(sum_after, 0)::BIGINT AS sum_after FROM w WHERE l_partkey % 40 = 0""")
def long_transcript_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of lineitem as one transcript, contexts for those of some parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")).agg(F.max("l_partkey").alias("l_partkey")).withColumn("transcript_id", F.lit("t"))
    hits = lines.filter("l_partkey % 40 = 0").select("transcript_id", "line")
    found = contexts_at(lines, hits, ["transcript_id"], "line", F.col("line"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("line", F.size("context_before").alias("n_before"), F.size("context_after").alias("n_after"), total("context_before").alias("sum_before"), total("context_after").alias("sum_after"))


_NEGATORS = ("la", "the", "der", "le", "and", "de", "und", "et")
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}''’]+')"


@query(f"""WITH c AS (SELECT conv_id, turn, {_WORDS.format('text')} AS ws FROM conversations),
n AS (SELECT *, list_filter(ws, lambda w: w IN {_NEGATORS})[1] AS neg FROM c),
p AS (SELECT *, CASE WHEN neg IS NOT NULL THEN ws[list_position(ws, neg) + 1:] END AS pre FROM n),
w AS (SELECT conv_id, turn, neg, pre, lag(neg) OVER o AS neg0, lag(pre) OVER o AS pre0, lag(ws) OVER o AS ws0 FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, neg AS negator, len(pre)::INTEGER AS n_prejacent, coalesce(neg = neg0 AND pre = pre0, false) AS repeats FROM w WHERE neg IS NOT NULL""")
def repeated_prejacents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's first word of a list stands in for its negator; a turn repeats the one before if what follows it is the same."""
    negator = F.get(F.filter(words_of(F.col("text")), lambda w: w.isin(*_NEGATORS)), F.lit(0))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", negator.alias("negator"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"negator_0": F.lag("negator").over(w), "text_0": F.lag("text").over(w)}).filter("negator IS NOT NULL")
    repeats = same_prejacent(F.col("negator"), F.col("text"), F.col("negator_0"), F.col("text_0"))
    return c.select("conv_id", "turn", "negator", F.size(prejacent(F.col("text"), F.col("negator"))).alias("n_prejacent"), repeats.alias("repeats"))


# -- file order --------------------------------------------------------------

#: Records are numbered from here, so that some tens of them have six figures and all others seven.
_FROM = 999_990


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"))
    return dense_number(lines, "o", "n").select(record_id(F.col("n") + _FROM).alias("record_id"), "o")


def _back_in_file_order(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    sinks.write_json_lines(_numbered_lines(spark, sf_dir), f"{folder}/records.jsonl", ["record_id"])
    return read_json_lines(spark, f"{folder}/records.jsonl", "record_id string, o long", strict=False, ordinal="file_row")


_RECORDS = f"""SELECT row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) AS file_row, printf('eng_%06d', {_FROM} + row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber)) AS record_id,
  l_orderkey * 8 + l_linenumber AS o FROM lineitem"""


@query(_RECORDS)
def records_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose ids pass a million, written in order and read back with their row in the file."""
    return through_files(spark, lambda folder: _back_in_file_order(spark, sf_dir, folder)).select("file_row", "record_id", "o")


@query(f"SELECT record_id FROM ({_RECORDS}) WHERE file_row <= 25")
def limit_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(spark, lambda folder: head(_back_in_file_order(spark, sf_dir, folder), 25, "file_row").select("record_id"))


# -- how a run ends ----------------------------------------------------------


def _dense_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_units with a dense number as line and in the record's id."""
    u = dense_number(prompt_units(spark, sf_dir).drop("line", "record_id"), "number", "n")
    return u.withColumns({"line": F.col("n"), "record_id": record_id(F.col("n")), "number": F.col("n")}).drop("n")


def dead_at_third(system: str, user: str) -> str:
    """A model that is there for the first two records and never again."""
    if int(json.JSONDecoder().raw_decode(user[user.index("[") :])[0][0]["line"]) > 2:
        raise RuntimeError("gone")
    return stub_client(system, user)


@query("""SELECT 3::BIGINT AS first_dead, 'gone' AS error, 2::BIGINT AS n_ok, true AS few_asked, count(*) AS n_batches FROM conversations""")
def stopped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one record, the third of which is dead: at most some tens are asked, however many there are."""
    units = cut(_dense_units(spark, sf_dir))
    r = cut(code_batches(units, dead_at_third, "p", batch_size=1, fail_fast=True))
    dead = r.filter("status = 'unreachable'").agg(F.min("batch_number").alias("first_dead"), F.min_by("error", "batch_number").alias("error"))
    asked = r.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), (F.count(F.lit(1)) < 100).alias("few_asked"))
    return dead.join(asked, how="cross").join(units.agg(F.count(F.lit(1)).alias("n_batches")), how="cross")  # one row each


def _reply(label: str, ids: F.Column) -> F.Column:
    one = lambda i: F.concat(F.lit('{"record_id":"'), i, F.lit(f'","bloom_label":"{label}","flags":' + json.dumps(dict.fromkeys(FLAGS, "No")) + ',"comments":""}'))
    return F.concat(F.lit('{"schema_version":"bloom_v1","predictions":['), F.array_join(F.transform(ids, one), ","), F.lit("]}"))


def odd_only(system: str, user: str) -> str:
    """A model that says Rejection and may not be asked for batches of even number."""
    records = json.JSONDecoder().raw_decode(user[user.index("[") :])[0]
    if (int(records[0]["line"]) - 1) // 4 % 2:
        raise RuntimeError("this reply is stored")
    return json.dumps({"schema_version": "bloom_v1", "predictions": [{"record_id": r["record_id"], "bloom_label": "Rejection", "flags": dict.fromkeys(FLAGS, "No"), "comments": ""} for r in records]})


@query("""SELECT printf('eng_%06d', n) AS record_id, (n - 1) // 4 + 1 AS batch_number, CASE WHEN (n - 1) // 4 % 2 = 1 THEN 'Denial' ELSE 'Rejection' END AS bloom_label, true AS again_without_asking
FROM (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) AS n FROM conversations)""")
def stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of even batches come from a store, those of odd ones from the model; run again, all come from the store."""
    units, settings = cut(_dense_units(spark, sf_dir)), '{"model":"m"}'

    def never(system: str, user: str) -> str:
        raise RuntimeError("all replies are stored")

    def work(folder: str) -> DataFrame:
        store = f"{folder}/replies"
        waiting = batches_of(units, 4).withColumn("fault", F.lit(None).cast("string"))
        known = waiting.filter("batch_number % 2 = 0").select(reply_key(settings, "p").alias("key"), _reply("Denial", F.col("record_ids")).alias("response"))
        known.write.parquet(f"{store}/before")
        first = code_batches(units, odd_only, "p", batch_size=4, store=store, settings=settings)
        again = code_batches(units, never, "p", batch_size=4, store=store, settings=settings)
        shown = lambda r, name: predictions_of(r).select("record_id", "batch_number", F.col("bloom_label").alias(name))
        both = shown(first, "bloom_label").join(shown(again, "again"), ["record_id", "batch_number"], "left")
        return both.select("record_id", "batch_number", "bloom_label", F.col("again").eqNullSafe(F.col("bloom_label")).alias("again_without_asking"))

    return through_files(spark, work)


@query("""SELECT count(*) AS n_predictions, (count(*) + 4) // 5 AS n_batches, count(*) AS n_records, (count(*) + 4) // 5 AS n_attempts, 0::BIGINT AS n_failed, true AS markers_agree, true AS rows_agree FROM conversations""")
def committed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run counted while writing, what its markers say and what stands in its outputs."""
    folder = shared_folder(spark, "files")
    out, raw = f"{folder}/p.jsonl", f"{folder}/r.jsonl"
    units = _dense_units(spark, sf_dir).withColumn("split", F.lit("dev_train"))
    counts = pipeline.run_model(units, "dev_train", stub_client, "prompt", out, raw, fail_fast=False, model="stub")
    told = commit.committed(spark, raw)
    there = cut(spark.read.json(out).agg(F.count(F.lit(1)).alias("p")).join(spark.read.json(raw).agg(F.count(F.lit(1)).alias("r")), how="cross"))  # one row each
    sinks.remove(spark, folder)
    agree = told == commit_of(counts, told, out, raw)
    return there.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], F.lit(agree).alias("markers_agree"), ((F.col("p") == told[out]["rows"]) & (F.col("r") == told[raw]["rows"])).alias("rows_agree"))


def commit_of(counts: dict[str, int], told: dict[str, dict], out: str, raw: str) -> dict[str, dict]:
    """told, with the figures that a run returned in their places."""
    return {out: told[out] | {"rows": counts["n_predictions"]}, raw: told[raw] | {k: v for k, v in counts.items() if k != "n_predictions"}}


@query("""SELECT count(*) AS n_records, false AS first_visible, false AS second_visible, true AS nothing_left, true AS old_kept FROM conversations""")
def interrupted_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two writes fails: neither is there, and what an earlier commit wrote still is."""
    folder = shared_folder(spark, "files")
    units = cut(_dense_units(spark, sf_dir).select("record_id", "line"))
    a, b, old = f"{folder}/a", f"{folder}/b", f"{folder}/old"
    commit.commit_together(spark, {old: (units, sinks.save_json_lines)})

    def broken(df: DataFrame, path: str) -> None:
        df.select(F.raise_error(F.lit("disk full")).alias("x")).write.json(path)

    for tables in ({a: (units, sinks.save_json_lines), b: (units, broken)}, {old: (units.limit(0), sinks.save_json_lines), b: (units, broken)}):
        try:
            commit.commit_together(spark, tables, overwrite=True)
        except Exception as e:
            if "disk full" not in str(e):
                raise
    left = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in left.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(left))
    kept = commit.committed(spark, old)[old]["rows"] == units.count() == spark.read.json(old).count()
    found = cut(units.agg(F.count(F.lit(1)).alias("n_records")))
    visible = [sinks.path_exists(spark, p) for p in (a, b)]
    sinks.remove(spark, folder)
    return found.select("n_records", F.lit(visible[0]).alias("first_visible"), F.lit(visible[1]).alias("second_visible"), F.lit(names == ["old"]).alias("nothing_left"), F.lit(kept).alias("old_kept"))


# -- manifest of inputs ------------------------------------------------------

_ROW = {
    "documents": "concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(lang, chr(0)), coalesce(n_chars::VARCHAR, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))",
    "labels": "concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(quality::VARCHAR, chr(0)), coalesce(toxic::VARCHAR, chr(0)))",
}


#: Characters of a table's rows that are dealt to one task, about.
_PART = 1 << 25


def _parts(df: DataFrame) -> int:
    """Five parts, and more for large tables."""
    long = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns])
    return 5 + (df.agg(F.sum(long)).first()[0] or 0) // _PART


@query(" UNION ALL ".join(f"SELECT '{t}' AS item, count(*) AS n_rows, sum(('0x' || substr(sha256({row}), 1, 15))::HUGEINT)::VARCHAR AS digest_sum, true AS same_root FROM {t}" for t, row in _ROW.items()))
def frozen_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two input tables; same_root tells whether the Merkle root is that of the rows in another order and partitioning."""
    tables = {t: table(spark, sf_dir, t) for t in _ROW}
    frozen = sinks.freeze_tables(tables)
    dealt = [table_digest(df.repartition(_parts(df), F.xxhash64(*df.columns))).select(F.lit(t).alias("item"), F.col("merkle_root").alias("other")) for t, df in tables.items()]
    return frozen.join(dealt[0].unionByName(dealt[1]), "item").select("item", "n_rows", "digest_sum", (F.col("merkle_root") == F.col("other")).alias("same_root"))


# -- split search ------------------------------------------------------------


@query(f"""WITH {UNITS_SQL} SELECT count(DISTINCT transcript_id) AS n_transcripts, true AS each_once, true AS score_is_its_objective FROM u WHERE status <> 'neither'""")
def replayed_split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that draws all trials from one generator, replayed in blocks; transcripts in order of their first record."""
    coded = cut(coded_units(spark, sf_dir).select("record_id", "transcript_id", "coded_by_1", "coded_by_2", "bloom_1", "bloom_2", "child_age_months"))
    t, pairs = cut(sp.transcript_table(coded, order=record_number(F.col("record_id")))), cut(sp.label_counts(coded))
    found = cut(sp.search_splits(t, pairs, sequential=True))
    own = sp.split_objective(t, pairs, found.select("transcript_id", "split")).select(F.col("score").alias("own"))
    sums = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("transcript_id").alias("n_transcripts"), F.max("score").alias("score"))
    return sums.join(own, how="cross").select("n_transcripts", (F.col("n") == F.col("n_transcripts")).alias("each_once"), (F.abs(F.col("own") - F.col("score")) < 1e-9).alias("score_is_its_objective"))  # one row each
