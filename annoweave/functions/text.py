"""Scalar functions on text columns (Column to Column, no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
DAYS_A_MONTH = 30.4375


def clean(c: Column) -> Column:
    """Strip Unicode white space at both ends; nothing left means null."""
    return F.nullif(F.regexp_replace(c, _EDGE_SPACE, ""), F.lit(""))


def pick(df: DataFrame, name: str) -> Column:
    """A column by its header, cleaned if text; null where the table doesn't have it.

    Headers may hold dots and question marks. Of headers that are equal once stripped
    the last counts.
    """
    held = [c for c in df.columns if c.strip() == name]
    if not held:
        return F.lit(None).cast("string")
    found = F.col("`" + held[-1].replace("`", "``") + "`")
    return clean(found) if df.schema[held[-1]].dataType.simpleString() == "string" else found


def normalize_flag(c: Column) -> Column:
    """Yes/No for their usual spellings in any case; other text stays, stripped; blank is null."""
    text = clean(c.cast("string"))
    low = F.lower(text)
    return F.when(low.isin("yes", "y", "true", "1"), "Yes").when(low.isin("no", "n", "false", "0"), "No").otherwise(text)


def age_in_months(c: Column) -> Column:
    """Months from a `Y;MM.DD` age at the start of the text; the days may be missing."""
    text = clean(c)
    part = lambda i: F.regexp_extract(text, r"^([0-9]+);([0-9]+)(?:\.([0-9]+))?", i).try_cast("int")
    return part(1) * 12 + part(2) + F.coalesce(part(3), F.lit(0)) / F.lit(DAYS_A_MONTH)


def model_slug(c: Column) -> Column:
    """A model's name as part of a file name."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.btrim(safe, F.lit("_")), F.lit("")), F.lit("model"))


def pipe_field(c: Column, i: int, least: int = 8) -> Column:
    """The i-th field (from 0) of a pipe-delimited line with at least so many fields, else null."""
    parts = F.split(c, "[|]")
    return F.when(F.size(parts) >= least, F.get(parts, F.lit(i)))


def json_text(c: Column) -> Column:
    """JSON with nulls written out."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def repetition_candidate(negator: Column, previous_negator: Column) -> Column:
    """Whether a token may repeat the one before: the same word. The meaning is for a coder to judge."""
    return F.coalesce(F.lower(clean(negator)) == F.lower(clean(previous_negator)), F.lit(False))


def words_of(utterance: Column) -> Column:
    """Lower-cased words: runs of letters, figures and apostrophes."""
    return F.regexp_extract_all(F.lower(utterance), F.lit(r"[\p{L}\p{M}\p{N}'’]+"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: a column named inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prejacent(utterance: Column, negator: Column) -> Column:
    """The words that follow the first place of the negator, of one word or several, in an utterance; null where it isn't there."""

    def after(both: Column) -> Column:
        words, held = both["words"], both["held"]
        n = F.size(held)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.slice(words, i, n) == held)
        return bound(F.get(starts, F.lit(0)), lambda at: F.when((n > 0) & at.isNotNull(), F.slice(words, at + n, F.greatest(F.size(words), F.lit(1)))))

    return bound(F.struct(words_of(utterance).alias("words"), words_of(negator).alias("held")), after)


def same_prejacent(negator: Column, utterance: Column, previous_negator: Column, previous_utterance: Column) -> Column:
    """Whether a token repeats the one before: the same negator, and after it the same words in both utterances."""
    own, before = prejacent(utterance, negator), prejacent(previous_utterance, previous_negator)
    return F.coalesce((words_of(negator) == words_of(previous_negator)) & (own == before), F.lit(False))


def mimicry_candidate(utterance: Column, speaker: Column, before: Column) -> Column:
    """Whether another speaker said exactly this within the context before."""
    return F.coalesce(F.exists(before, lambda x: (x["utterance"] == utterance) & (x["speaker"] != speaker)), F.lit(False))


def json_safe(df: DataFrame, name: str) -> Column:
    """A column as JSON can hold it: text, numbers and booleans as they are, all else as text."""
    kind = df.schema[name].dataType
    plain = isinstance(kind, (T.StringType, T.BooleanType, T.NumericType)) and not isinstance(kind, T.DecimalType)
    return F.col(f"`{name}`") if plain else F.col(f"`{name}`").cast("string")


def xml_text(c: Column) -> Column:
    """Text as the content of an XML element."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c
