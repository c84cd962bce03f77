"""The operators as queries over the driver tables, each with its SQL where SQL can express it.

Stand-ins: a coded unit is a document with its label row, a transcript is language and
source, a transcript line is a conversation turn, ages come from the source's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annoweave.functions.coding import both_labelled, coding_status, is_coded, overlap_pair
from annoweave.functions.text import age_in_months, clean, json_text, mimicry_candidate, model_slug, normalize_flag, repetition_candidate
from annoweave.operators import agreement as ag
from annoweave.operators import splits as sp
from annoweave.operators.ages import age_histogram, child_ages, weighted_mean
from annoweave.operators.inference import code_batches, predictions_of, prompt_records, run_summary, stub_client
from annoweave.operators.linking import alignment_mismatch, duplicates, line_lookup, missing_from, with_reference
from annoweave.operators.linking import key_differences as key_differences_of
from annoweave.operators.ordering import batch_number, context_missing, context_windows, dense_number, head, record_id, top_counts
from annoweave.operators.validation import extracted_json, policy_violations, with_verdict
from annoweave.schemas import FLAGS, NEITHER_SPLIT, PREDICTION_KEYS, SPLIT_TARGETS
from annoweave.session import cut, shared_folder
from annoweave.sources.sinks import remove
from annoweave.sources.tables import transcript_halves

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_files(spark: SparkSession, work: Callable[[str], DataFrame]) -> DataFrame:
    """What `work` reads back from the folder that it is given; the folder is deleted."""
    folder = shared_folder(spark, "files")
    found = cut(work(folder))
    remove(spark, folder)
    return found


# -- stand-ins ---------------------------------------------------------------

UNITS_SQL = """
u0 AS (
  SELECT d.doc_id, printf('eng_%06d', d.doc_id) AS record_id, lang, lang || '/' || source AS transcript_id, n_chars,
    substr(source, 4)::INTEGER AS k,
    CASE l.quality WHEN 1 THEN 'Rejection' WHEN 0 THEN 'Denial' END AS bloom_1,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN 'Nonexistence' WHEN n_chars >= 500 THEN 'Rejection' ELSE 'Denial' END AS bloom_2,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN 'Uncoded' WHEN d.doc_id % 5 = 0 THEN 'Denial' ELSE 'Rejection' END AS model,
    CASE WHEN d.doc_id % 9 = 0 THEN 'Yes' ELSE 'No' END AS repetition_1,
    CASE WHEN d.doc_id % 10 = 0 THEN 'Yes' WHEN d.doc_id % 8 = 0 THEN 'maybe' ELSE 'No' END AS repetition_2
  FROM documents d LEFT JOIN labels l USING (doc_id)),
u1 AS (
  SELECT *, CASE WHEN bloom_1 IS NULL THEN 'NA' ELSE 'coder_' || (doc_id % 3) END AS coded_by_1,
    CASE WHEN bloom_2 IS NULL THEN 'NA' ELSE 'coder_' || (3 + doc_id % 2) END AS coded_by_2,
    printf('%d;%02d.%02d', 1 + k % 3, k % 12, 1 + k % 28) AS child_age_raw,
    (1 + k % 3) * 12 + k % 12 + (1 + k % 28) / 30.4375::DOUBLE AS child_age_months,
    ('0x' || substr(md5(transcript_id), 1, 4))::INTEGER % 100 AS pick
  FROM u0),
u AS (
  SELECT *, CASE WHEN coded_by_1 = 'NA' AND coded_by_2 = 'NA' THEN 'uncoded_by_neither' WHEN pick < 20 THEN 'dev_train'
    WHEN pick < 45 THEN 'dev_check_1' WHEN pick < 70 THEN 'dev_check_2' ELSE 'test_lockbox' END AS split,
    CASE WHEN coded_by_1 = 'NA' AND coded_by_2 = 'NA' THEN 'neither' WHEN coded_by_1 = 'NA' OR coded_by_2 = 'NA' THEN 'one_coder' ELSE 'both_coders' END AS status,
    CASE WHEN coded_by_1 <> 'NA' AND coded_by_2 <> 'NA' THEN coded_by_1 || ' + ' || coded_by_2 END AS pair
  FROM u1)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), F.col("doc_id")
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    k = F.substring("source", 4, 9).cast("int")
    u = d.select(
        "doc_id",
        record_id(i).alias("record_id"),
        "lang",
        F.concat_ws("/", "lang", "source").alias("transcript_id"),
        "n_chars",
        F.when(F.col("quality") == 1, "Rejection").when(F.col("quality") == 0, "Denial").alias("bloom_1"),
        F.when(i % 7 == 0, None).when(i % 11 == 0, "Nonexistence").when(F.col("n_chars") >= 500, "Rejection").otherwise("Denial").alias("bloom_2"),
        F.when(i % 17 == 0, None).when(i % 13 == 0, "Uncoded").when(i % 5 == 0, "Denial").otherwise("Rejection").alias("model"),
        F.when(i % 9 == 0, "Yes").otherwise("No").alias("repetition_1"),
        F.when(i % 10 == 0, "Yes").when(i % 8 == 0, "maybe").otherwise("No").alias("repetition_2"),
        F.format_string("%d;%02d.%02d", 1 + k % 3, k % 12, 1 + k % 28).alias("child_age_raw"),
    )
    coder = lambda label, n: F.when(F.col(label).isNull(), "NA").otherwise(F.concat(F.lit("coder_"), n.cast("string")))
    return u.withColumns({"coded_by_1": coder("bloom_1", i % 3), "coded_by_2": coder("bloom_2", 3 + i % 2), "child_age_months": age_in_months(F.col("child_age_raw"))})


def fixed_split(transcript: Column) -> Column:
    pick = F.conv(F.substring(F.md5(transcript), 1, 4), 16, 10).cast("int") % 100
    return F.when(pick < 20, "dev_train").when(pick < 45, "dev_check_1").when(pick < 70, "dev_check_2").otherwise("test_lockbox")


def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    coded = is_coded(F.col("coded_by_1"), F.col("coded_by_2"))
    return u.withColumn("split", F.when(coded, fixed_split(F.col("transcript_id"))).otherwise(NEITHER_SPLIT))


def agreement_sql(by: str, left: str = "bloom_1", right: str = "bloom_2", of: str = "u", extra: str = "") -> str:
    keys = f"{by}, " if by else ""
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM a.{k.strip()}" for k in by.split(",")) if by else "true"
    picked = "".join(f"s.{k.strip()}, " for k in by.split(",")) if by else ""
    return f"""
p AS (SELECT {keys}{left} AS l, {right} AS r, count(*) AS n FROM {of} WHERE {left} IS NOT NULL AND {right} IS NOT NULL {extra} GROUP BY ALL),
m AS (SELECT {keys}label, sum(ln) AS ln, sum(rn) AS rn FROM (
  SELECT {keys}l AS label, n AS ln, 0 AS rn FROM p UNION ALL SELECT {keys}r AS label, 0 AS ln, n AS rn FROM p) GROUP BY ALL),
s AS (SELECT {keys}sum(ln)::BIGINT AS n, sum(ln * rn)::HUGEINT AS c FROM m GROUP BY ALL),
a AS (SELECT {keys}coalesce(sum(CASE WHEN l = r THEN n END), 0)::BIGINT AS a FROM p GROUP BY ALL),
irr AS (SELECT {picked}n AS n_overlap, a AS n_agree, a::DOUBLE / n AS exact_agreement,
  CASE WHEN n = 0 THEN NULL WHEN n::HUGEINT * n = c THEN CASE WHEN a = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE (n::HUGEINT * a - c)::DOUBLE / (n::HUGEINT * n - c)::DOUBLE END AS cohen_kappa FROM s JOIN a ON {on})"""


# -- agreement ---------------------------------------------------------------


@query(f"WITH {UNITS_SQL}, {agreement_sql('')} SELECT * FROM irr")
def kappa_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.agreement_stats(ag.pair_counts(units(spark, sf_dir), "bloom_1", "bloom_2"))


@query(f"WITH {UNITS_SQL}, {agreement_sql('lang')} SELECT * FROM irr")
def kappa_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.agreement_stats(ag.pair_counts(units(spark, sf_dir), "bloom_1", "bloom_2", ["lang"]), ["lang"])


@query(f"WITH {UNITS_SQL}, {agreement_sql('lang')} SELECT * FROM irr")
def kappa_from_merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = ag.pair_counts(units(spark, sf_dir), "bloom_1", "bloom_2", ["lang", "transcript_id"])
    return ag.agreement_stats(ag.merge_counts(fine, ["lang"]), ["lang"])


@query(f"WITH {UNITS_SQL}, {agreement_sql('split, transcript_id', of='u')} SELECT split, transcript_id, n_overlap, exact_agreement FROM irr WHERE n_overlap > 0")
def agreement_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.agreement_points(split_units(spark, sf_dir))


@query(f"WITH {UNITS_SQL} SELECT bloom_1 AS l, bloom_2 AS r, count(*) AS n FROM u WHERE bloom_1 IS NOT NULL AND bloom_2 IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.confusion_matrix(units(spark, sf_dir), "bloom_1", "bloom_2")


@query(f"""WITH {UNITS_SQL},
p AS (SELECT lang, bloom_1 AS l, model AS r, count(*) AS n FROM u WHERE bloom_1 IS NOT NULL AND model IS NOT NULL GROUP BY ALL),
m AS (SELECT lang, label, sum(tp)::BIGINT AS tp, sum(pn)::BIGINT AS predicted, sum(an)::BIGINT AS actual FROM (
  SELECT lang, l AS label, CASE WHEN l = r THEN n ELSE 0 END AS tp, 0 AS pn, n AS an FROM p UNION ALL SELECT lang, r, 0, n, 0 FROM p) GROUP BY ALL)
SELECT lang, label, tp, predicted, actual, tp::DOUBLE / nullif(predicted, 0) AS precision, tp::DOUBLE / nullif(actual, 0) AS recall,
  (2 * tp)::DOUBLE / nullif(predicted + actual, 0) AS f1 FROM m""")
def per_label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.label_scores(ag.pair_counts(units(spark, sf_dir), "bloom_1", "model", ["lang"]), ["lang"])


@query(f"""WITH {UNITS_SQL}, v AS (
  SELECT unnest(['coder_1', 'coder_2']) AS coder, unnest([bloom_1, bloom_2]) AS human, model FROM u), {agreement_sql('coder', 'human', 'model', 'v')}
SELECT * FROM irr""")
def model_vs_each_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    rows = F.explode(F.array(*[F.struct(F.lit(f"coder_{i}").alias("coder"), F.col(f"bloom_{i}").alias("human")) for i in (1, 2)]))
    v = u.select(rows.alias("x"), "model").select("x.*", "model")
    return ag.agreement_stats(ag.pair_counts(v, "human", "model", ["coder"]), ["coder"])


@query(f"WITH {UNITS_SQL}, {agreement_sql('lang', 'bloom_1', 'model', 'u', 'AND bloom_1 = bloom_2')} SELECT * FROM irr")
def agreed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.agreement_where_agreed(units(spark, sf_dir), "bloom_1", "bloom_2", "model", ["lang"])


@query(f"""WITH {UNITS_SQL}, v AS (
  SELECT CASE WHEN bloom_1 IN ('Rejection', 'Denial') THEN 'negation' ELSE 'other' END AS a,
    CASE WHEN model IN ('Rejection', 'Denial') THEN 'negation' ELSE 'other' END AS b FROM u WHERE bloom_1 IS NOT NULL AND model IS NOT NULL), {agreement_sql('', 'a', 'b', 'v')}
SELECT * FROM irr""")
def binary_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.binary_agreement(units(spark, sf_dir), "bloom_1", "model", ("Rejection", "Denial"))


@query(f"""WITH {UNITS_SQL} SELECT lang, CASE WHEN model = bloom_1 THEN 'sides_with_1' WHEN model = bloom_2 THEN 'sides_with_2'
  WHEN model IN ('Uncoded', 'Excluded') THEN 'uncoded_or_excluded' ELSE 'neither' END AS side, count(*) AS n
FROM u WHERE bloom_1 <> bloom_2 AND model IS NOT NULL GROUP BY ALL""")
def siding(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = ag.siding(F.col("model"), F.col("bloom_1"), F.col("bloom_2"))
    return units(spark, sf_dir).withColumn("side", side).filter("side IS NOT NULL").groupBy("lang", "side").agg(F.count(F.lit(1)).alias("n"))


BUCKETS = {"rejection_denial": ("Rejection", "Denial"), "nonexistence_nonpossession": ("Nonexistence", "Nonpossession"), "excluded_uncoded": ("Excluded", "Uncoded")}


@query(f"""WITH {UNITS_SQL} SELECT CASE WHEN (bloom_2 = 'Rejection' AND model = 'Denial') OR (bloom_2 = 'Denial' AND model = 'Rejection') THEN 'rejection_denial'
  WHEN (bloom_2 = 'Nonexistence' AND model = 'Nonpossession') OR (bloom_2 = 'Nonpossession' AND model = 'Nonexistence') THEN 'nonexistence_nonpossession'
  WHEN (bloom_2 = 'Excluded' AND model = 'Uncoded') OR (bloom_2 = 'Uncoded' AND model = 'Excluded') THEN 'excluded_uncoded' ELSE 'other' END AS bucket, count(*) AS n
FROM u WHERE bloom_2 <> model GROUP BY ALL ORDER BY n DESC, bucket LIMIT 50""")
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(units(spark, sf_dir).withColumn("bucket", ag.error_bucket(F.col("bloom_2"), F.col("model"), BUCKETS)), "bucket", 50)


@query(f"""WITH {UNITS_SQL}, v AS (SELECT 'all' AS rows_used, * FROM u UNION ALL SELECT 'without_repetition', * FROM u WHERE repetition_1 <> 'Yes'), {agreement_sql('rows_used', of='v')}
SELECT * FROM irr""")
def repetition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.with_and_without(units(spark, sf_dir), "bloom_1", "bloom_2", F.col("repetition_1") == "Yes", ("all", "without_repetition"))


@query(f"""WITH {UNITS_SQL}, v AS (SELECT 'repetition' AS flag, CASE WHEN repetition_1 IN ('Yes', 'No') THEN repetition_1 END AS a, CASE WHEN repetition_2 IN ('Yes', 'No') THEN repetition_2 END AS b FROM u),
{agreement_sql('flag', 'a', 'b', 'v')} SELECT * FROM irr""")
def flag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ag.unpivot_flags(units(spark, sf_dir), [], {"repetition": ("repetition_1", "repetition_2")})
    return ag.agreement_stats(ag.pair_counts(flags, "left", "right", ["flag"]), ["flag"])


@query(f"""WITH {UNITS_SQL}, v AS (SELECT lang, count(*) FILTER (WHERE bloom_1 = model)::DOUBLE / nullif(count(*) FILTER (WHERE bloom_1 IS NOT NULL AND model IS NOT NULL), 0) AS m1,
  count(*) FILTER (WHERE bloom_2 = model)::DOUBLE / nullif(count(*) FILTER (WHERE bloom_2 IS NOT NULL AND model IS NOT NULL), 0) AS m2 FROM u GROUP BY lang)
SELECT lang, m1 AS exact_agreement_1, m2 AS exact_agreement_2, m2 - m1 AS exact_agreement_delta FROM v""")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    runs = [ag.agreement_stats(ag.pair_counts(u, c, "model", ["lang"]), ["lang"]) for c in ("bloom_1", "bloom_2")]
    return ag.run_delta(*runs, ["lang"], ["exact_agreement"])


@query(f"""WITH {UNITS_SQL}, h AS (WITH {agreement_sql('lang')} SELECT * FROM irr), g AS (WITH {agreement_sql('lang', 'bloom_1', 'model')} SELECT * FROM irr)
SELECT h.lang, h.cohen_kappa AS human_kappa, g.cohen_kappa AS model_kappa, g.cohen_kappa - h.cohen_kappa AS gap FROM h JOIN g USING (lang)""")
def gap_to_humans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.gap_to_humans(units(spark, sf_dir), "bloom_1", "bloom_2", "model", ["lang"])


# -- coding status -----------------------------------------------------------


@query(f"WITH {UNITS_SQL} SELECT lang, status, count(*) AS n FROM u GROUP BY ALL")
def coding_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = coding_status(F.col("coded_by_1"), F.col("coded_by_2")).alias("status")
    return units(spark, sf_dir).groupBy("lang", status).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS_SQL} SELECT split, coder, count(*) AS n FROM (SELECT split, unnest([coded_by_1, coded_by_2]) AS coder FROM u) WHERE coder <> 'NA' GROUP BY ALL")
def coder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_units(spark, sf_dir).select("split", F.explode(F.array("coded_by_1", "coded_by_2")).alias("coder"))
    return rows.filter("coder <> 'NA'").groupBy("split", "coder").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS_SQL} SELECT pair, count(*) AS n FROM u WHERE pair IS NOT NULL GROUP BY ALL")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = overlap_pair(F.col("coded_by_1"), F.col("coded_by_2")).alias("pair")
    return units(spark, sf_dir).groupBy(pair).agg(F.count(F.lit(1)).alias("n")).filter("pair IS NOT NULL")


@query(f"WITH {UNITS_SQL} SELECT coded, labelled, count(*) AS n FROM (SELECT status <> 'neither' AS coded, bloom_1 IS NOT NULL AND bloom_2 IS NOT NULL AS labelled FROM u) GROUP BY ALL")
def coded_and_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.groupBy(is_coded(F.col("coded_by_1"), F.col("coded_by_2")).alias("coded"), both_labelled(F.col("bloom_1"), F.col("bloom_2")).alias("labelled")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS_SQL} SELECT coder, count(*) AS n FROM (SELECT unnest([coded_by_1, coded_by_2]) AS coder FROM u) WHERE coder <> 'NA' GROUP BY ALL ORDER BY n DESC, coder LIMIT 7")
def top_coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(units(spark, sf_dir).select(F.explode(F.array("coded_by_1", "coded_by_2")).alias("coder")).filter("coder <> 'NA'"), "coder", 7)


@query(f"""WITH {UNITS_SQL}, t AS (SELECT pair, count(*) AS n FROM u WHERE pair IS NOT NULL GROUP BY ALL ORDER BY n DESC, pair LIMIT 4)
SELECT string_agg(pair || ' (' || n || ')', '; ' ORDER BY n DESC, pair) AS top_pairs FROM t""")
def top_overlap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_counts(units(spark, sf_dir).withColumn("pair", overlap_pair(F.col("coded_by_1"), F.col("coded_by_2"))), "pair", 4)
    first = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "pair")))  # four rows
    return top.agg(F.array_join(F.transform(first, lambda x: F.concat(x["pair"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), "; ").alias("top_pairs"))


# -- ordering and context ----------------------------------------------------

_WINDOW = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {} AND {})"
_BEFORE, _AFTER = _WINDOW.format("20 PRECEDING", "1 PRECEDING"), _WINDOW.format("1 FOLLOWING", "20 FOLLOWING")


@query(f"""WITH w AS (SELECT conv_id, turn, role || ': ' || text AS x FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list(x) {_BEFORE}, ' | '), '') AS before_text, coalesce(array_to_string(list(x) {_AFTER}, ' | '), '') AS after_text FROM w""")
def context_windows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context_windows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.concat_ws(": ", "role", "text"))
    return c.select("conv_id", "turn", F.array_join("context_before", " | ").alias("before_text"), F.array_join("context_after", " | ").alias("after_text"))


@query("""SELECT turn // 7 AS piece, conv_id, turn FROM conversations
QUALIFY count(*) OVER (PARTITION BY conv_id, turn // 7) = 1""")
def context_missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").withColumn("piece", F.floor(F.col("turn") / 7))
    c = context_windows(lines, ["conv_id", "piece"], "turn", F.col("text"))
    return c.filter(context_missing(F.col("context_before"), F.col("context_after"))).select("piece", "conv_id", "turn")


@query("""SELECT doc_id, printf('eng_%06d', row_number() OVER (ORDER BY doc_id)) AS record_id FROM documents WHERE lang IS DISTINCT FROM 'fr'""")
def dense_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").filter(~F.col("lang").eqNullSafe("fr"))
    return dense_number(kept.select("doc_id"), "doc_id", "n", width=256).select("doc_id", record_id(F.col("n")).alias("record_id"))


@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 5 + 1 AS batch_number FROM documents""")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "n")
    return d.select("doc_id", batch_number(F.col("n"), 5).alias("batch_number"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def limit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, "doc_id")


@query("""WITH b AS (SELECT conv_id, turn, lower(split_part(text, ' ', 1)) AS word FROM conversations)
SELECT conv_id, turn, word = lag(word) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM b QUALIFY same""")
def repetition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring_index("text", " ", 1)
    c = table(spark, sf_dir, "conversations").withColumn("word", word)
    same = repetition_candidate(F.col("word"), F.lag("word").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.withColumn("same", same).filter("same").select("conv_id", "turn", "same")


@query("""WITH w AS (SELECT conv_id, turn, role, lower(string_split(text, ' ')[1])[1:2] AS said FROM conversations) SELECT a.conv_id, a.turn FROM w a WHERE EXISTS (
  SELECT 1 FROM w b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 20 AND b.said = a.said AND b.role <> a.role)""")
def mimicry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the first two letters of a turn as what was said, so that some turns repeat another's."""
    lines = table(spark, sf_dir, "conversations").withColumn("said", F.substring(F.lower(F.substring_index("text", " ", 1)), 1, 2))
    c = context_windows(lines, ["conv_id"], "turn", F.struct(F.col("said").alias("utterance"), F.col("role").alias("speaker")))
    return c.filter(mimicry_candidate(F.col("said"), F.col("role"), F.col("context_before"))).select("conv_id", "turn")


# -- joins -------------------------------------------------------------------


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.doc_id IS NULL OR (CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END) IS DISTINCT FROM l.quality""")
def alignment_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    expected = F.when(F.col("n_chars") >= 500, 1).otherwise(0)
    return joined.filter(alignment_mismatch(F.col("there"), F.struct(expected), F.struct("quality"))).select("doc_id")


@query("""WITH l AS (SELECT conv_id, turn // 2 AS line, max_by(text, turn) AS utterance FROM conversations GROUP BY ALL)
SELECT c.conv_id, c.turn, l.utterance FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.line = c.turn""")
def line_lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", F.floor(F.col("turn") / 2).alias("line"), F.col("turn").alias("ord"), F.col("text").alias("utterance"))
    found = line_lookup(c.select("conv_id", "turn", F.col("turn").alias("line")), lines, ["conv_id", "line"], "ord", ["utterance"])
    return found.select("conv_id", "turn", "utterance")


@query("SELECT d.doc_id, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id)")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return with_reference(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_from(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT DISTINCT doc_id + 7 AS doc_id FROM labels WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def unexpected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "labels").select((F.col("doc_id") + 7).alias("doc_id")).distinct()
    return missing_from(seen, table(spark, sf_dir, "documents").filter("doc_id % 3 = 0"), ["doc_id"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT conv_id, turn, CASE WHEN turn < 3 THEN 1 ELSE 2 END AS half FROM conversations")
def union_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return transcript_halves(c.filter("turn < 3"), c.filter("turn >= 3")).select("conv_id", "turn", "half")


@query(f"WITH {UNITS_SQL} SELECT lang, bloom_1 AS label FROM u WHERE bloom_1 IS NOT NULL UNION SELECT lang, bloom_2 FROM u WHERE bloom_2 IS NOT NULL")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.label_set(units(spark, sf_dir), ["bloom_1", "bloom_2"], ["lang"])


@query("""WITH k AS (SELECT doc_id, list_concat(['record_id', 'flags'], CASE WHEN doc_id % 2 = 0 THEN ['comments', 'why'] ELSE ['bloom_label', 'comments'] END) AS keys FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'why' ELSE '' END AS extra, CASE WHEN doc_id % 2 = 0 THEN 'bloom_label' ELSE '' END AS missing, doc_id % 2 = 1 AS exact FROM k""")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    keys = F.concat(lits("record_id", "flags"), F.when(F.col("doc_id") % 2 == 0, lits("comments", "why")).otherwise(lits("bloom_label", "comments")))
    extra, missing, exact = key_differences_of(keys, lits(*PREDICTION_KEYS))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extra, ",").alias("extra"), F.array_join(missing, ",").alias("missing"), exact.alias("exact"))


# -- scalars -----------------------------------------------------------------

_MESSY = "CASE doc_id % 8 WHEN 0 THEN '  YES ' WHEN 1 THEN 'y' WHEN 2 THEN chr(9) || '1' || chr(10) WHEN 3 THEN '1.0' WHEN 4 THEN ' ' WHEN 5 THEN 'No' WHEN 6 THEN 'maybe ' END"


@query(f"""WITH m AS (SELECT doc_id, nullif(regexp_replace({_MESSY}, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'), '') AS stripped FROM documents)
SELECT doc_id, stripped, CASE WHEN lower(stripped) IN ('yes', 'y', 'true', '1') THEN 'Yes' WHEN lower(stripped) IN ('no', 'n', 'false', '0') THEN 'No' ELSE stripped END AS flag FROM m""")
def clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.expr(_MESSY.replace("chr(", "char("))
    return table(spark, sf_dir, "documents").select("doc_id", clean(messy).alias("stripped"), normalize_flag(messy).alias("flag"))


@query("""SELECT DISTINCT source || ' : ' || lang AS model, coalesce(nullif(trim(regexp_replace(source || ' : ' || lang, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'model') AS slug FROM documents""")
def model_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" : ", "source", "lang")
    return table(spark, sf_dir, "documents").select(name.alias("model"), model_slug(name).alias("slug")).distinct()


_AGE = "CASE doc_id % 6 WHEN 0 THEN (doc_id % 9) || ';' || (doc_id % 12) || '.' || (doc_id % 29) WHEN 1 THEN ' ' || (doc_id % 5) || ';0' || (doc_id % 10) || '. ' WHEN 2 THEN '2;' WHEN 3 THEN 'x' WHEN 4 THEN (doc_id % 7) || ';11.05 or so' END"


@query(f"""WITH a AS (SELECT doc_id, trim({_AGE}) AS t FROM documents),
p AS (SELECT doc_id, try_cast(regexp_extract(t, '^([0-9]+);([0-9]+)', 1) AS INTEGER) AS y, try_cast(regexp_extract(t, '^([0-9]+);([0-9]+)', 2) AS INTEGER) AS m,
  coalesce(try_cast(regexp_extract(t, '^[0-9]+;[0-9]+\\.([0-9]+)', 1) AS INTEGER), 0) AS d FROM a)
SELECT doc_id, y * 12 + m + d / 30.4375::DOUBLE AS months FROM p""")
def parse_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", age_in_months(F.expr(_AGE)).alias("months"))


@query("""WITH h AS (SELECT conv_id, turn % 2 AS half, turn, conv_id % 4 AS k, (turn % 5) || ';' || (turn % 12) AS age FROM conversations WHERE turn % 3 <> 0),
c AS (SELECT * FROM h WHERE k <> 3)
SELECT conv_id::VARCHAR AS transcript_id, max_by((turn % 5) * 12 + turn % 12 + 0::DOUBLE, half * 100000 + turn) AS child_age_months, max_by(age, half * 100000 + turn) AS child_age_raw
FROM c WHERE k <> 2 GROUP BY conv_id""")
def age_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 4
    age = F.concat_ws(";", (F.col("turn") % 5).cast("string"), (F.col("turn") % 12).cast("string"))
    who, role = F.when(k == 0, "CHI").otherwise("MOT"), F.when(k == 1, "Target_Child").otherwise("Mother")
    line = F.concat_ws("|", F.lit("eng"), F.lit("corpus"), who, age, F.lit("female"), F.lit(""), F.lit(""), role)
    few = F.when(k == 3, F.concat_ws("|", F.lit("eng"), F.lit("corpus"), F.lit("CHI"), age)).otherwise(line)
    headers = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("Transcript"), F.when(F.col("turn") % 3 == 0, "*CHI:").otherwise("@ID:").alias("Speaker"), few.alias("Utterance"), (F.col("turn") % 2).alias("half"), F.col("turn").alias("ord")
    )
    return child_ages(headers)


# -- ages and splits ---------------------------------------------------------

_TRANSCRIPTS = """
t AS (SELECT transcript_id, count(*) AS n_rows, min(child_age_months) AS age_months, count(*) FILTER (WHERE status = 'both_coders') AS both_coders,
  count(*) FILTER (WHERE status = 'one_coder') AS one_coder, count(*) FILTER (WHERE bloom_1 IS NOT NULL AND bloom_2 IS NOT NULL) AS n_overlap_bloom,
  count(*) FILTER (WHERE bloom_1 = bloom_2) AS n_bloom_agree, any_value(pick) AS pick FROM u WHERE status <> 'neither' GROUP BY transcript_id)"""
_EDGES = """
e0 AS (SELECT floor(min(age_months)) AS lo, ceil(max(age_months)) AS hi FROM t),
e AS (SELECT i, lo + i * ((hi - lo) / 6) AS low, CASE WHEN i = 5 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 6) END AS high FROM e0, range(0, 6) r(i)),
b AS (SELECT t.*, i FROM t JOIN e ON age_months >= low AND (age_months < high OR (i = 5 AND age_months <= high)))"""


def coded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).filter(is_coded(F.col("coded_by_1"), F.col("coded_by_2")))


@query(f"WITH {UNITS_SQL}, {_TRANSCRIPTS} SELECT * EXCLUDE (pick, age_months), round(age_months, 6) AS age_months FROM t")
def transcript_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.transcript_table(coded_units(spark, sf_dir)).withColumn("age_months", F.round("age_months", 6))


@query(f"WITH {UNITS_SQL} SELECT transcript_id, bloom_1 AS l, bloom_2 AS r, count(*) AS n FROM u WHERE bloom_1 IS NOT NULL AND bloom_2 IS NOT NULL GROUP BY ALL")
def transcript_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.label_counts(units(spark, sf_dir))


@query(f"""WITH {UNITS_SQL}, {_TRANSCRIPTS}, {_EDGES}
SELECT i::INTEGER AS bin, sum(n_rows)::BIGINT AS weight, round(sum(n_rows)::DOUBLE / (SELECT sum(n_rows) FROM b), 6) AS share FROM b GROUP BY ALL""")
def age_histogram_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sp.transcript_table(coded_units(spark, sf_dir))
    return age_histogram(t, "age_months", F.col("n_rows")).select("bin", "weight", F.round("share", 6).alias("share"))


@query(f"WITH {UNITS_SQL}, {_TRANSCRIPTS}, {_EDGES} SELECT i::INTEGER AS bin, count(*) AS weight FROM b GROUP BY ALL")
def age_histogram_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return age_histogram(sp.transcript_table(coded_units(spark, sf_dir)), "age_months").select("bin", "weight")


@query(f"WITH {UNITS_SQL}, {_TRANSCRIPTS} SELECT round(sum(age_months * n_rows) / sum(n_rows), 6) AS mean_age FROM t WHERE age_months IS NOT NULL")
def weighted_mean_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.transcript_table(coded_units(spark, sf_dir)).agg(F.round(weighted_mean(F.col("age_months"), F.col("n_rows")), 6).alias("mean_age"))


_SPLIT_OF = "CASE WHEN pick < 20 THEN 'dev_train' WHEN pick < 45 THEN 'dev_check_1' WHEN pick < 70 THEN 'dev_check_2' ELSE 'test_lockbox' END"


@query(f"""WITH {UNITS_SQL}, {_TRANSCRIPTS}, {_EDGES},
x AS (SELECT *, unnest([{_SPLIT_OF}, '*']) AS g FROM t),
st AS (SELECT g, sum(n_rows) AS n, sum(both_coders) AS bo, sum(one_coder) AS o, sum(n_overlap_bloom) AS ov, sum(n_bloom_agree) AS ag, sum(age_months * n_rows) / sum(n_rows) AS ma FROM x GROUP BY g),
hi AS (SELECT g, i, sum(n_rows) AS h FROM (SELECT n_rows, i, unnest([{_SPLIT_OF}, '*']) AS g FROM b) GROUP BY ALL),
hn AS (SELECT g, i, h / sum(h) OVER (PARTITION BY g) AS h FROM hi),
gs AS (SELECT DISTINCT g FROM st WHERE g <> '*'),
hd AS (SELECT gs.g, sum(pow(coalesce(a.h, 0) - coalesce(w.h, 0), 2)) AS d FROM gs CROSS JOIN range(0, 6) r(i) LEFT JOIN hn a ON a.g = gs.g AND a.i = r.i LEFT JOIN hn w ON w.g = '*' AND w.i = r.i GROUP BY gs.g),
v AS (SELECT unnest([{_SPLIT_OF}, '*']) AS g, bloom_1, bloom_2 FROM u), {agreement_sql('g', of='v')},
tg(g, target) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in SPLIT_TARGETS.items())})
SELECT tg.g AS split, round(35 * pow(st.n::DOUBLE / w.n - target, 2) + 18 * pow(st.bo::DOUBLE / st.n - w.bo::DOUBLE / w.n, 2) + 18 * pow(st.o::DOUBLE / st.n - w.o::DOUBLE / w.n, 2)
  + 16 * pow(k.exact_agreement - kw.exact_agreement, 2) + 10 * pow(k.cohen_kappa - kw.cohen_kappa, 2) + 0.035 * pow(st.ma - w.ma, 2) + 8 * hd.d, 6) AS score
FROM tg JOIN st USING (g) JOIN hd USING (g) JOIN irr k USING (g) JOIN st w ON w.g = '*' JOIN irr kw ON kw.g = '*'""")
def split_score_fixed_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_units(spark, sf_dir)
    assigned = coded.select("transcript_id").distinct().withColumn("split", fixed_split(F.col("transcript_id")))
    terms = sp.objective_terms(sp.transcript_table(coded), sp.label_counts(coded), assigned)
    return terms.select("split", F.round("score", 6).alias("score"))


def _sorted_map_sql(of: str, name: str) -> str:
    return f"SELECT split, string_agg(k || '=' || n, ', ' ORDER BY k) AS {name} FROM ({of}) GROUP BY split"


@query(f"""WITH {UNITS_SQL}, {agreement_sql('split')},
c AS ({_sorted_map_sql("SELECT split, k, count(*) AS n FROM (SELECT split, unnest([coded_by_1, coded_by_2]) AS k FROM u) WHERE k <> 'NA' GROUP BY ALL", "coder_counts")}),
o AS ({_sorted_map_sql("SELECT split, pair AS k, count(*) AS n FROM u WHERE pair IS NOT NULL GROUP BY ALL", "overlap_counts")}),
z AS (SELECT split, count(*) AS n_rows, count(DISTINCT transcript_id) AS n_transcripts, round(avg(child_age_months), 3) AS mean_age_months, round(min(child_age_months), 3) AS min_age_months,
  round(max(child_age_months), 3) AS max_age_months, count(*) FILTER (WHERE status = 'both_coders') AS both_coders, count(*) FILTER (WHERE status = 'one_coder') AS one_coder,
  count(*) FILTER (WHERE status = 'neither') AS neither FROM u GROUP BY split)
SELECT z.*, coalesce(n_overlap, 0) AS n_overlap_bloom, round(exact_agreement, 4) AS bloom_exact_agreement, round(cohen_kappa, 4) AS bloom_cohen_kappa,
  coalesce(coder_counts, '') AS coder_counts, coalesce(overlap_counts, '') AS overlap_counts
FROM z LEFT JOIN irr USING (split) LEFT JOIN c USING (split) LEFT JOIN o USING (split)""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sp.split_summary(split_units(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", ").alias(c)
    return s.select(*[c for c in s.columns if not c.endswith("counts")], text("coder_counts"), text("overlap_counts"))


@query(f"""WITH {UNITS_SQL}, v AS (SELECT transcript_id, CASE WHEN doc_id % 97 = 0 THEN 'dev_train' ELSE split END AS split FROM u)
SELECT transcript_id, count(DISTINCT split) AS n_splits FROM v WHERE split <> 'uncoded_by_neither' GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.split_leaks(split_units(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 97 == 0, "dev_train").otherwise(F.col("split"))))


@query(f"""WITH {UNITS_SQL}, c AS (SELECT * FROM u WHERE split <> 'uncoded_by_neither'),
n AS (SELECT transcript_id, string_agg(k || '=' || n, ', ' ORDER BY k) AS pairs FROM (
  SELECT transcript_id, bloom_1 || ' | ' || bloom_2 AS k, count(*) AS n FROM c WHERE bloom_1 IS NOT NULL AND bloom_2 IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT transcript_id, any_value(split) AS split, count(*) AS n_rows, any_value(pairs) AS pairs FROM c LEFT JOIN n USING (transcript_id) GROUP BY transcript_id""")
def transcript_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sp.transcript_manifest(split_units(spark, sf_dir))
    pairs = F.array_join(F.transform(F.map_entries("bloom_pair_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", ")
    return m.select("transcript_id", "split", "n_rows", pairs.alias("pairs"))


@query(f"WITH {UNITS_SQL} SELECT record_id, bloom_1, split FROM u WHERE bloom_1 IS NOT NULL")
def references_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = split_units(spark, sf_dir)
    return sp.references_by_split(u.filter("bloom_1 IS NOT NULL").select("record_id", "bloom_1"), u)


@query(f"WITH {UNITS_SQL} SELECT split, bloom_2 AS label, count(*) AS n FROM u WHERE bloom_2 IS NOT NULL GROUP BY ALL")
def split_class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.class_coverage(split_units(spark, sf_dir), "bloom_2")


@query()
def split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_units(spark, sf_dir)
    return sp.search_splits(sp.transcript_table(coded), sp.label_counts(coded))


# -- model runs --------------------------------------------------------------


def prompt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("number"), F.concat_ws("_", F.lit("eng"), "conv_id", "turn").alias("record_id"), F.lit("English").alias("language"),
        F.col("conv_id").cast("string").alias("transcript_id"), F.col("turn").alias("line"), F.col("role").alias("speaker"), F.col("text").alias("target_utterance"), F.lit("secret").alias("bloom_1"),
    )


@query("SELECT 'eng_' || conv_id || '_' || turn AS record_id, 'English' AS language, conv_id::VARCHAR AS transcript_id, turn AS line, role AS speaker, text AS target_utterance, 12 AS n_fields FROM conversations")
def prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = prompt_records(prompt_units(spark, sf_dir))
    return shown.select("record_id", "language", "transcript_id", "line", "speaker", "target_utterance", F.lit(len(shown.columns)).alias("n_fields"))


_FLAGS_JSON = "{" + ",".join(f'"{f}":"No"' for f in FLAGS) + "}"


def synthetic_response(i: Column, case: Column) -> Column:
    """A reply for record i, broken in one way for each case from 1 to 16."""
    rid = record_id(i)

    def one(label: str = '"Denial"', flags: str = _FLAGS_JSON, comments: str = '""', extra: str = "", rid: Column = rid) -> Column:
        return F.concat(F.lit('{"record_id":"'), rid, F.lit(f'","bloom_label":{label},"flags":{flags},"comments":{comments}{extra}}}'))

    def reply(*predictions: Column, version: str = "bloom_v1") -> Column:
        return F.concat(F.lit(f'{{"schema_version":"{version}","predictions":['), F.concat_ws(",", *predictions), F.lit("]}"))

    other = F.concat(rid, F.lit("x"))
    cases = {
        1: F.lit("[1]"), 2: reply(one(), version="v0"), 3: F.lit('{"schema_version":"bloom_v1","predictions":{}}'), 4: reply(F.lit("5")), 5: reply(one(extra=',"why":1')),
        6: reply(F.concat(F.lit('{"record_id":"'), rid, F.lit('"}'))), 7: reply(one(rid=other)), 8: reply(one(), one()), 9: reply(one(label='"denial"')), 10: reply(one(flags="[]")),
        11: reply(one(flags='{"singing":"No"}')), 12: reply(one(flags=_FLAGS_JSON.replace('"No"', '"yes"', 1))), 13: reply(one(comments="3")), 14: reply(one(comments='"' + "c" * 301 + '"')), 15: reply(), 16: F.lit("no braces here"),
    }
    out = F.concat(F.lit("Here it is:\n```json\n"), reply(one()), F.lit("\n```"))
    for k, v in cases.items():
        out = F.when(case == k, v).otherwise(out)
    return out


@query("SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 17 = 16 THEN 'json' ELSE 'V-' || (doc_id % 17) END AS code, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS n_predictions FROM documents")
def validate_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", synthetic_response(F.col("doc_id"), F.col("doc_id") % 17).alias("reply"), F.array(record_id(F.col("doc_id"))).alias("ids"))
    v = with_verdict(d, "reply", "ids")
    return v.select("doc_id", "v.code", F.coalesce(F.size("v.predictions"), F.lit(0)).alias("n_predictions"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL ELSE '{"id":' || doc_id || '}' END AS found FROM documents""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}"))
    kind = F.col("doc_id") % 5
    reply = F.when(kind == 0, obj).when(kind == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```\n"), obj, F.lit("```")))
    reply = reply.when(kind == 3, F.concat(F.lit("Sure! "), obj, F.lit(" Done."))).otherwise(F.lit("nothing"))
    return table(spark, sf_dir, "documents").select("doc_id", extracted_json(reply).alias("found"))


@query("""SELECT record_id, label AS bloom_label, forcing FROM (SELECT printf('eng_%06d', doc_id) AS record_id, CASE WHEN doc_id % 4 = 0 THEN 'Excluded' ELSE 'Denial' END AS label,
  array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'singing' END, CASE WHEN doc_id % 5 = 0 THEN 'not_a_negation' END], lambda x: x IS NOT NULL), ',') AS forcing FROM documents) WHERE forcing <> '' AND label <> 'Excluded'""")
def policy_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, no = F.col("doc_id"), F.lit("No")
    yes = {"singing": F.when(i % 3 == 0, "Yes").otherwise("No"), "not_a_negation": F.when(i % 5 == 0, "Yes").otherwise("No"), "repetition": F.when(i % 2 == 0, "Yes").otherwise("No")}
    p = table(spark, sf_dir, "documents").select(record_id(i).alias("record_id"), F.when(i % 4 == 0, "Excluded").otherwise("Denial").alias("bloom_label"), F.struct(*[yes.get(f, no).alias(f) for f in FLAGS]).alias("flags"))
    return policy_violations(p).select("record_id", "bloom_label", F.array_join("forcing_flags", ",").alias("forcing"))


@query()
def stub_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(code_batches(prompt_units(spark, sf_dir), stub_client, "Code the tokens.")).withColumn("flags", json_text(F.col("flags")))


@query("SELECT (count(*) + 4) // 5 AS n_batches, count(*) AS n_records, (count(*) + 4) // 5 AS n_attempts, 0::BIGINT AS n_failed, 'stub' AS model FROM conversations")
def stub_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(code_batches(prompt_units(spark, sf_dir), stub_client, "Code the tokens."), model="stub")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# the queries of whole stages register themselves here too
from annoweave import run_queries as run_queries  # noqa: E402
from annoweave import stage_queries as stage_queries  # noqa: E402
