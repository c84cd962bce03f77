from __future__ import annotations

import pytest
from annoweave.functions import coding, text
from pyspark.sql import functions as F


def one(spark, rows, ddl, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*[c.alias(k) for k, c in cols.items()]).collect()]


def test_clean_and_flags(spark):
    cases = [(None, None, None), ("", None, None), ("  ", None, None), ("\t x  \x1c", "x", "x"), ("YES", "YES", "Yes"), ("y", "y", "Yes"), (" 1\n", "1", "Yes"), ("1.0", "1.0", "1.0"), ("0", "0", "No"), ("False", "False", "No"), ("maybe ", "maybe", "maybe")]
    found = one(spark, [(c[0],) for c in cases], "a string", c=text.clean(F.col("a")), f=text.normalize_flag(F.col("a")))
    assert found == [c[1:] for c in cases]


def test_pick_headers(spark):
    df = spark.createDataFrame([(" a ", 1, "z")], "` Bloom ` string, n int, `Is.it?` string")
    assert df.select(text.pick(df, "Bloom"), text.pick(df, "Is.it?"), text.pick(df, "gone"), text.pick(df, "n")).first() == ("a", "z", None, 1)


@pytest.mark.parametrize(
    ("age", "months"),
    [("2;04.16", 2 * 12 + 4 + 16 / 30.4375), ("1;07.", 19.0), (" 3;00", 36.0), ("2;", None), ("x", None), (None, None), ("4;11.05 and more", 59 + 5 / 30.4375)],
)
def test_ages(spark, age, months):
    assert one(spark, [(age,)], "a string", m=text.age_in_months(F.col("a"))) == [(months,)]


def test_slugs_and_pipes(spark):
    assert one(spark, [("gemma2:9b",), ("::",), ("a b/c.d_",)], "a string", s=text.model_slug(F.col("a"))) == [("gemma2_9b",), ("model",), ("a_b_c.d",)]
    rows = [("a|b|CHI|2;00|e|f|g|Target_Child|",), ("a|b|CHI",)]
    assert one(spark, rows, "a string", p=text.pipe_field(F.col("a"), 3), q=text.pipe_field(F.col("a"), 7)) == [("2;00", "Target_Child"), (None, None)]


def test_coding_predicates(spark):
    a, b = F.col("a"), F.col("b")
    rows = [("NA", "NA"), ("x", "NA"), ("x", "y"), (None, "NA"), (None, None)]
    found = one(spark, rows, "a string, b string", c=coding.is_coded(a, b), s=coding.coding_status(a, b), p=coding.overlap_pair(a, b))
    assert found == [(False, "neither", None), (True, "one_coder", None), (True, "both_coders", "x + y"), (True, "one_coder", None), (True, "both_coders", None)]


def test_assigned_coder(spark):
    rows = [(True, None, "r"), (True, "L", "r"), (True, "L", None), (None, None, None), (True, "L", "NA")]
    c = F.col
    found = one(spark, rows, "there boolean, label string, raw string", x=coding.assigned_coder(F.coalesce(c("there"), F.lit(False)), c("label"), c("raw"), "owner"))
    assert found == [("NA",), ("r",), ("owner",), (None,), ("NA",)]


def test_candidates(spark):
    rows = [("No", "no ", "hi", "A", [("hi", "B")]), ("no", None, "hi", "A", [("hi", "A")])]
    found = one(
        spark, rows, "n string, p string, u string, s string, ctx array<struct<utterance:string,speaker:string>>",
        r=text.repetition_candidate(F.col("n"), F.col("p")), m=text.mimicry_candidate(F.col("u"), F.col("s"), F.col("ctx")),
    )
    assert found == [(True, True), (False, False)]
