"""Schemas and fixed vocabularies of annotated-token data."""

from __future__ import annotations

from pyspark.sql import types as T

# Label set, flags and record layout of the annotation contract.
SCHEMA_VERSION = "bloom_v1"
PROMPT_VERSION = "p001"
CODE_SHEET = "Code"
TRANSCRIPT_SHEETS = ("Transcript - First half", "Transcript - Second half")
EXCLUSION = "RED: INCLUDED AS TT5 FOR SYNTACTIC CODING"
LABELS = ("Nonexistence", "Rejection", "Denial", "Nonpossession", "Uncoded", "Excluded")
FLAGS = ("foreign_language_negation", "singing", "mimicry", "tag_question", "repetition", "not_a_negation")
FLAG_VALUES = ("Yes", "No")
EXCLUDING_FLAGS = ("singing", "mimicry", "not_a_negation")
PREDICTION_KEYS = ("record_id", "bloom_label", "flags", "comments")
MAX_COMMENT = 300
NOT_CODED = "NA"
CONTEXT_LINES = 20
SPLIT_TARGETS = {"dev_train": 0.20, "dev_check_1": 0.25, "dev_check_2": 0.25, "test_lockbox": 0.30}
NEITHER_SPLIT = "uncoded_by_neither"
LOCKBOX_SPLIT = "test_lockbox"
SPLIT_SEED = 20260527
SPLIT_ITERATIONS = 20_000
PROMPT_FIELDS = (
    "record_id",
    "language",
    "transcript_id",
    "half",
    "line",
    "speaker",
    "child_id",
    "target_negator",
    "target_utterance",
    "context_window_size",
    "context_before",
    "context_after",
)

CONTEXT_LINE = T.StructType([
    T.StructField("line", T.LongType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("utterance", T.StringType()),
    T.StructField("transcript_line", T.StringType()),
])

TOKEN = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("source", T.StructType([
        T.StructField("workbook", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("source_row", T.IntegerType()),
    ])),
    T.StructField("transcript_id", T.StringType()),
    T.StructField("half", T.IntegerType()),
    T.StructField("line", T.LongType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("child_id", T.StringType()),
    T.StructField("target_negator", T.StringType()),
    T.StructField("target_utterance", T.StringType()),
    T.StructField("context_window_size", T.IntegerType()),
    T.StructField("context_before", T.ArrayType(CONTEXT_LINE)),
    T.StructField("context_after", T.ArrayType(CONTEXT_LINE)),
    T.StructField("coded_by_1", T.StringType()),
    T.StructField("coded_by_2", T.StringType()),
])

FLAG_STRUCT = T.StructType([T.StructField(f, T.StringType()) for f in FLAGS])

PREDICTION = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("bloom_label", T.StringType()),
    T.StructField("flags", FLAG_STRUCT),
    T.StructField("comments", T.StringType()),
])

CODER_FIELDS = {
    "bloom_label": "Bloom",
    "certain_bloom": "Certain.-.Bloom",
    "other_possibility_bloom": "Other.Possibility.-.Bloom",
    "definitely_one_of_two_bloom": "Is.it.definitely.one.of.those.two?.-.Bloom",
    "choi_label": "Choi",
    "certain_choi": "Certain.-.Choi",
    "other_possibility_choi": "Other.Possibility.-.Choi",
    "definitely_one_of_two_choi": "Is.it.definitely.one.of.those.two?.-.Choi",
    "comments": "Comments",
    "coded_by_raw": "coded_by",
}
FLAG_COLUMNS = {
    "foreign_language_negation": "Foreign.Language.Negation?",
    "singing": "Singing?",
    "mimicry": "Mimicry?",
    "tag_question": "Tag.Question?",
    "repetition": "Repetition?",
    "not_a_negation": "Not.a.negation?",
}
KEY_COLUMNS = ("Transcript", "Negation", "Half", "Line", "Speaker", "Utterance")
