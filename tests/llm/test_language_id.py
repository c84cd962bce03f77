from __future__ import annotations

import random
import zlib

import pytest
from annoweave.llm import language_id as X

SYLLABLES = {"aa": "ka lo mi tan ser", "bb": "shu gre wolt blin zor", "cc": "ñu íra ção mente ito"}
DDL = "doc_id long, text string, lang string, lang_pred int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(400):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        parts = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 400))), lang, 0))
    return out


def test_held_out_accuracy(spark, rows):
    found = {r.doc_id: r for r in X.identify(spark.createDataFrame(rows, DDL)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert sum(found[i].lang_pred == lang for i, _, lang, _ in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_held_out_languages_are_not_learned(spark, rows):
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, 0) for i, t, lang, _ in rows]
    a, b = (sorted(map(tuple, X.identify(spark.createDataFrame(x, DDL)).collect())) for x in (rows, changed))
    assert a == b


def test_undetermined_nulls_and_long_texts(spark, rows):
    more = [(1000, None, "aa", 0), (1001, "12 34 !", "aa", 0), (None, rows[0][1], None, 0), (1002, "shu grewolt " * 40_000, None, 0), (1003, "", "bb", 0)]
    found = {r.doc_id: r for r in X.identify(spark.createDataFrame(rows + more, DDL)).collect()}
    assert [found[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3
    assert found[None].lang_pred == rows[0][2] and found[1002].lang_pred == "bb"


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None, 0)], DDL)
    assert X.identify(docs).first().lang_pred == "und"
    assert X.identify(docs.limit(0)).count() == 0


def test_narrow_margins_are_rejected():
    c = X.Compressors({"a": b"the same words here " * 40, "b": b"the same words here " * 40})
    lang, score, rejected = c.predict("the same words")
    assert lang == "a" and rejected and score == 0.5


@pytest.mark.parametrize("text", ["²", "½ ①", "12 ٣", "_ -", " ", "😀"])
def test_figures_and_marks_are_no_letters(text):
    c = X.Compressors({"a": b"some text", "b": b"other text"})
    assert c.predict(text)[0] == "und" and c.predict(text + "é")[0] in "ab"


def test_sizes_by_brute_force(spark, rows):
    import zstandard

    learned = X.learn_dictionaries(spark.createDataFrame(rows, DDL))
    c = X.Compressors(learned)
    for _, text, *_ in [*rows[:60], (0, rows[0][1] * 40, "", 0)]:  # one segment and many
        raw = " ".join(text.lower().split()).encode()
        sizes = {}
        for lang, d in learned.items():
            params = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, strategy=X.STRATEGY, write_content_size=0, write_checksum=0, write_dict_id=0)
            fresh = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(fresh.compress(raw[i : i + X.SEGMENT])) for i in range(0, len(raw), X.SEGMENT))
        assert c.predict(text)[0] == min(sizes, key=lambda k: (sizes[k], list(learned).index(k)))


def test_pieces_come_from_whole_texts(spark):
    # the languages differ in the second half of their texts only
    docs = [(i, "x" * 3000 + " " + ("left " if i % 2 else "right ") * 600, "lr"[i % 2], 0) for i in range(200)]
    learned = X.learn_dictionaries(spark.createDataFrame(docs, DDL))
    assert all(len(d) <= X.PIECES * (X.PIECE * 4 + 1) for d in learned.values())
    assert b"right right" in learned["l"] and b"left left" in learned["r"]


def test_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows[:50]], DDL + ", u int, l string, t double").withColumnRenamed("u", "id")
    assert X.identify(docs).count() == 50
