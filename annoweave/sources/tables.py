"""Scans: coder sheets, transcripts, JSON lines and whole files, and the order of rows in files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annoweave.functions.text import clean, normalize_flag, pick
from annoweave.schemas import CODER_FIELDS, FLAG_COLUMNS, KEY_COLUMNS


def with_source_row(df: DataFrame, ordinal: str, first: int = 2) -> DataFrame:
    """Add source_row, numbered as in a sheet whose header is row 1, from an ordinal from 0."""
    return df.withColumn("source_row", (F.col(ordinal) + first).cast("int"))


def row_key(df: DataFrame) -> F.Column:
    """The fields by which a row of two sheets is checked to be the same one."""
    return F.array(*[pick(df, c).cast("string") for c in KEY_COLUMNS])


def coder_records(sheet: DataFrame) -> DataFrame:
    """(source_row, key, ten coder fields, flags): one coder's sheet. Of equal source rows the last read counts."""
    flags = F.struct(*[normalize_flag(pick(sheet, h)).alias(f) for f, h in FLAG_COLUMNS.items()])
    fields = [pick(sheet, h).cast("string").alias(f) for f, h in CODER_FIELDS.items()]
    return sheet.select("source_row", row_key(sheet).alias("key"), *fields, flags.alias("flags"))


def transcript_halves(*halves: DataFrame) -> DataFrame:
    """Union of a transcript's parts, tagged with half from 1; columns missing in one are null."""
    tagged = [h.withColumn("half", F.lit(i)) for i, h in enumerate(halves, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def speaker_lines(lines: DataFrame) -> DataFrame:
    """Lines of speakers, not headers: the speaker begins with a star. Text is cleaned."""
    speaker = pick(lines, "Speaker")
    return lines.filter(speaker.startswith("*")).select(
        "half",
        "ord",
        pick(lines, "Transcript").alias("transcript_id"),
        pick(lines, "Line").cast("long").alias("line"),
        speaker.alias("speaker"),
        pick(lines, "Utterance").alias("utterance"),
        pick(lines, "transcript_line").cast("string").alias("transcript_line"),
    )


def with_file_row(scan: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan from 1 in the order in which they stand in its files.

    Files follow each other by path (of two names the longer one is later, as part files
    are numbered), a file's blocks by their start, a block's rows as they are read. Rows
    never move: a block's rows have consecutive numbers in their partition, and the
    blocks' counts, one row a block, say where each of them begins; these are broadcast. scan is a file
    source as read, without a filter or limit yet.
    """
    tagged = scan.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = tagged.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    upto = lambda by, order: F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = [F.regexp_extract("__path", "^(.*/)?", 1), F.length("__path"), F.col("__path")]
    files = blocks.groupBy("__path").agg(F.sum("__n").alias("__n")).select("__path", upto([], place).alias("__files"))  # a row a file
    begins = blocks.withColumn("__own", upto(["__path"], ["__block"])).join(files, "__path").select("__path", "__block", (F.col("__files") + F.col("__own") - F.col("__first") + 1).alias("__shift"))
    return tagged.join(F.broadcast(begins), ["__path", "__block"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__path", "__block", "__at", "__shift")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True, ordinal: str | None = None) -> DataFrame:
    """JSON lines of a fixed schema. Strict: a blank or broken line fails the read; else blank lines are skipped.

    With `ordinal` a column of that name numbers the lines that were read, from 1, in file order.
    """
    if not strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return with_file_row(rows, ordinal) if ordinal else rows
    lines = spark.read.text(path)
    if ordinal:
        lines = with_file_row(lines, "__row")
    whole = F.when(F.length(clean(F.col("value"))) > 0, F.col("value")).otherwise(F.raise_error(F.lit("blank line in JSON lines")).cast("string"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    numbered = [F.col("__row").alias(ordinal)] if ordinal else []
    return lines.select(F.from_json(whole, kind, {"mode": "FAILFAST"}).alias("r"), *numbered).select("r.*", *([ordinal] if ordinal else []))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file that path names, and the columns of its folders; a file is one string."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), "*").drop("value")


def read_whole_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a prompt, as one string."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} isn't one file")
    return rows[0][0]
