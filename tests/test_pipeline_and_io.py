from __future__ import annotations

import csv
import io
import json
import zipfile
from pathlib import Path

import pytest
from annoweave.operators import ordering
from annoweave.operators.inference import code_batches, stub_client
from annoweave.plans import charts, pipeline
from annoweave.sources import commit, sinks, spreadsheet, tables
from pyspark.sql import functions as F

MASTER = "source_row int, Transcript string, Negation string, Half string, Line string, Speaker string, Utterance string, Child_ID string, exclusion string"
CODER = "source_row int, Transcript string, Negation string, Half string, Line string, Speaker string, Utterance string, Bloom string, coded_by string, `Singing?` string"
LINES = "ord int, Transcript string, Speaker string, Utterance string, Line long"


@pytest.fixture(scope="module")
def sheets(spark):
    master = [(i, f"t{i % 3}", "no", "1", str(i), "*CHI:", f"u{i}", "k", " gone " if i == 4 else None if i == 5 else "kept") for i in range(2, 32)]
    coder = [(i, f"t{i % 3}", "no", "1", str(i), "*CHI:", "other" if i == 6 else f"u{i}", None if i % 4 == 0 else "Denial", None, "y") for i in range(2, 32) if i != 7]
    lines = [(i, f"t{i % 3}", "@Comment" if i % 10 == 9 else "*CHI:", f"u{i}", i) for i in range(1, 40)]
    lines += [(50 + i, f"t{i}", "@ID:", f"eng|c|CHI|{i + 2};0{i}.|f|||Target_Child|", None) for i in range(3)]
    return spark.createDataFrame(master, MASTER), spark.createDataFrame(coder, CODER), spark.createDataFrame(lines, LINES).withColumn("half", F.lit(1))


@pytest.fixture(scope="module")
def built(sheets):
    m, c, t = sheets
    return pipeline.build_dataset(m, c, c.filter("source_row % 2 = 0"), t, "gone", ("Ann", "Bo")).cache()


def test_build(built):
    rows = {r.source_row: r for r in built.collect()}
    assert len(rows) == 29 and 4 not in rows and rows[5].record_id == "eng_000003"
    assert rows[2].coded_by_1 == "Ann" and rows[8].coded_by_1 == "NA" and rows[7].coded_by_1 is None and rows[3].coded_by_2 is None
    assert sorted(i for i, r in rows.items() if r.key_mismatch_1) == [6, 7]
    assert [x.line for x in rows[11].context_before] == [2, 5, 8] and rows[11].context_after[0].line == 14
    assert rows[9].context_missing and not rows[8].context_missing  # a line that isn't a speaker's has no context
    assert rows[2].coder_1.flags.singing == "Yes"


def test_split_run_and_guards(spark, built, sheets, tmp_path):
    refs = pipeline.human_reference(built, ("Ann", "Bo"))
    split = pipeline.split_dataset(built.drop("coder_1", "coder_2"), refs, sheets[2], {"dev_train": 0.5, "test_lockbox": 0.5}, iterations=20).cache()
    assert split.count() == 29 and {r[0] for r in split.select("split").distinct().collect()} >= {"dev_train", "test_lockbox"}
    assert split.filter("child_age_months IS NULL").count() == 0
    out, raw = str(tmp_path / "p.jsonl"), str(tmp_path / "r.jsonl")
    found = pipeline.run_model(split, "dev_train", stub_client, "prompt", out, raw, batch_size=4)
    n = split.filter("split = 'dev_train'").count()
    assert found == {"n_predictions": n, "n_batches": -(-n // 4), "n_records": n, "n_attempts": -(-n // 4), "n_failed": 0}
    assert commit.committed(spark, out) == commit.committed(spark, raw) and spark.read.json(out).count() == n
    with pytest.raises(sinks.Refused, match="exist"):
        pipeline.run_model(split, "dev_train", stub_client, "prompt", out, raw)
    with pytest.raises(sinks.Refused, match="held out"):
        pipeline.run_model(split, "test_lockbox", stub_client, "prompt", out + "2", raw + "2")
    bad = str(tmp_path / "bad")
    with pytest.raises(RuntimeError):
        pipeline.run_model(split, "dev_train", lambda s, u: "{}", "prompt", bad, bad + "raw", max_retries=0)
    assert not Path(bad).exists() and Path(bad + ".failed").exists()


def test_sinks(spark, built, tmp_path):
    path = str(tmp_path / "d")
    sinks.write_json_lines(built.select("record_id", "coded_by_1", F.lit("é\"x").alias("t")), path, ["record_id"], one_file=True)
    text = next(Path(path).glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert len(text) == 29 and "é" in text[0] and json.loads(text[4]) == {"record_id": "eng_000005", "coded_by_1": None, "t": 'é"x'}
    flat = sinks.flat_dataset(built)
    assert len(flat.columns) == 14
    assert sinks.write_csv(flat, path + "c", ["record_id"], one_file=True)
    with next(Path(path + "c").glob("part-*")).open(encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert len(json.loads(rows[9]["context_before_json"])) == built.orderBy("record_id").select(F.size("context_before")).collect()[9][0]
    assert not sinks.write_csv(flat.limit(0), path + "e", []) and not Path(path + "e").exists()
    s = sinks.build_summary(built, built.limit(1), rows=True, rule="x", paths=["a"]).first()
    assert (s.n_records, s.n_dropped, s.key_mismatch_1_rows, s.paths) == (29, 1, [6, 7], '["a"]')
    assert sinks.output_name("dev", "a:b", "s", "p", "predictions", 3) == "dev_a_b_s_p_limit-3_predictions.jsonl"
    assert sinks.freeze_manifest(spark, prompt="x", model="m").count() == 2


def test_json_scans(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\n{"a":2}\n')
    assert tables.read_json_lines(spark, str(p), "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="blank line"):
        tables.read_json_lines(spark, str(p), "a int").collect()
    p.write_text('{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        tables.read_json_lines(spark, str(p), "a int").collect()
    q = tmp_path / "prompt.md"
    q.write_text("one\ntwo\n")
    assert tables.read_whole_text(spark, str(q)) == "one\ntwo\n"


def test_a_million_records_keep_their_order(spark, tmp_path):
    path, n = str(tmp_path / "many.jsonl"), 1_000_005
    records = spark.range(1, n + 1).select(ordering.record_id(F.col("id")).alias("record_id"), F.col("id").alias("i"))
    sinks.write_json_lines(records.repartition(7), path, ["record_id"])
    found = tables.read_json_lines(spark, path, "record_id string, i long", strict=False, ordinal="file_row")
    assert found.filter("file_row = i").count() == n == found.select("file_row").distinct().count()
    last = ordering.head(found.filter("file_row > 999997"), 5, "file_row").select("record_id").collect()
    assert [r[0] for r in last] == ["eng_999998", "eng_999999", "eng_1000000", "eng_1000001", "eng_1000002"]


def test_file_rows_count_what_was_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, lines in (("b.jsonl", ['{"a":3}', "", '{"a":4}']), ("a.jsonl", ['{"a":1}', '{"a":2}']), ("aa.jsonl", ['{"a":5}'])):
        (tmp_path / "d" / name).write_text("\n".join(lines) + "\n")
    rows = tables.read_json_lines(spark, str(tmp_path / "d"), "a int", strict=False, ordinal="row")
    assert sorted(map(tuple, rows.select("row", "a").collect())) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]  # shorter names first
    (tmp_path / "d" / "b.jsonl").unlink()
    assert sorted(map(tuple, tables.read_json_lines(spark, str(tmp_path / "d"), "a int", ordinal="row").select("row", "a").collect())) == [(1, 1), (2, 2), (3, 5)]


def _records(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("number"), ordering.record_id(F.col("id")).alias("record_id"), F.col("id").alias("line"), F.lit("no").alias("target_utterance"))


def test_a_run_stops_soon_after_a_dead_batch(spark, tmp_path):
    """Batch 3 of 10,000 is dead: fewer than 100 are asked, and the failure is stored."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def client(system, user):
        ids = json.JSONDecoder().raw_decode(user[user.index("[") :])[0]
        (asked / ids[0]["record_id"]).touch()
        if ids[0]["line"] == 3:
            raise RuntimeError("dead")
        return stub_client(system, user)

    records = _records(spark, 10_000).withColumn("split", F.lit("dev_train"))
    with pytest.raises(RuntimeError, match="batch 3 failed"):
        pipeline.run_model(records, "dev_train", client, "p", str(tmp_path / "p"), str(tmp_path / "r"), batch_size=1)
    assert len(list(asked.iterdir())) < 100
    assert [r.batch_number for r in spark.read.json(str(tmp_path / "p.failed")).collect()] == [3]
    assert not (tmp_path / "p").exists() and not (tmp_path / "r").exists()


def test_a_whole_run_is_all_slices(spark):
    found = code_batches(_records(spark, 200), stub_client, batch_size=1, fail_fast=True)
    assert found.count() == 200 == found.filter("status = 'ok'").select("batch_number").distinct().count()


def test_stored_replies_are_not_asked_for_again(spark, tmp_path):
    store, asked = str(tmp_path / "store"), tmp_path / "asked"
    asked.mkdir()

    def client(system, user):
        (asked / f"{len(list(asked.iterdir()))}").touch()
        told = "broke the agreed form" in user
        return stub_client(system, user) if told else "{}"  # right only when told what was wrong

    run = lambda settings: code_batches(_records(spark, 6).coalesce(1), client, "p", batch_size=2, store=store, settings=settings, parallel=1).filter("status = 'ok'").count()
    assert run("a") == 3 and len(list(asked.iterdir())) == 6  # the first answer and the one after the fault are different keys
    assert run("a") == 3 and len(list(asked.iterdir())) == 6
    assert run("b") == 3 and len(list(asked.iterdir())) == 12


def test_two_outputs_are_one_commit(spark, tmp_path):
    a, b = (str(tmp_path / x) for x in "ab")
    df = spark.range(10)
    told = commit.commit_together(spark, {a: (df, sinks.save_json_lines), b: (df.limit(3), sinks.save_json_lines)})
    assert (told[a]["rows"], told[b]["rows"]) == (10, 3) and commit.committed(spark, b)[a]["digest"] == told[a]["digest"]
    with pytest.raises(sinks.Refused, match="exist"):
        commit.commit_together(spark, {a: (df, sinks.save_json_lines)})

    def fails(frame, path):
        raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        commit.commit_together(spark, {a: (df.limit(1), sinks.save_json_lines), b: (df, fails)}, overwrite=True)
    assert commit.committed(spark, a)[a]["rows"] == 10 == spark.read.json(a).count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    commit.commit_together(spark, {a: (df.limit(2), sinks.save_json_lines)}, overwrite=True)
    with pytest.raises(sinks.Refused, match="different runs"):
        commit.committed(spark, b)  # its run's other table was replaced
    (tmp_path / "a" / commit.MARKER).unlink()
    with pytest.raises(sinks.Refused, match="never committed"):
        commit.committed(spark, a)


def test_files_of_a_folder_are_frozen(spark, tmp_path):
    import hashlib

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p.md").write_text("é")
    (tmp_path / "q.bin").write_bytes(b"\x00\x01")
    found = {r["item"]: (r["sha256"], r["value"]) for r in sinks.freeze_files(spark, str(tmp_path)).collect()}
    assert found == {"x/p.md": (hashlib.sha256("é".encode()).hexdigest(), "2"), "q.bin": (hashlib.sha256(b"\x00\x01").hexdigest(), "2")}


def test_spreadsheet(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Line</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5.0</v></c></row><row r="4"><c r="C4"><v>2.5</v></c></row>'
    plain = spreadsheet.workbook({"Code": [["x"]]})
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            z.writestr(name, old.read(name))
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t> Bloom </t></si><si><r><t>De</t></r><r><t>nial</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    df = spreadsheet.read_sheet(spark, str(tmp_path / "w.xlsx"), "Code", ["Bloom", "Line", "Gone"])
    assert [tuple(r) for r in df.orderBy("source_row").collect()] == [(2, None, None, None), (3, "Denial", "5", None), (4, None, "2.5", None)]
    with pytest.raises(ValueError, match="no sheet"):
        list(spreadsheet.sheet_rows(plain, "Other"))


def test_wide_sheets_and_odd_text(spark, tmp_path):
    rows = [[f"c{i}" for i in range(30)], *[[f"<{i}&\"{j}" if j % 7 else None for j in range(30)] for i in range(40)]]
    sinks.write_text(spark, str(tmp_path / "w.xlsx"), spreadsheet.workbook({"A & B": rows}))
    found = spreadsheet.read_sheet(spark, str(tmp_path / "w.xlsx"), "A & B", ["c1", "c7", "c29"]).orderBy("source_row").collect()
    assert [tuple(r) for r in found] == [(i + 2, r[1], r[7], r[29]) for i, r in enumerate(rows[1:])]


def test_workbooks_as_a_data_source(spark, tmp_path):
    from annoweave.sources.workbooks import WorkbookSource

    spark.dataSource.register(WorkbookSource)
    for name, rows in (("b.xlsx", [["Line", "Bloom"], ["5", None], [None, "x"]]), ("a.xlsx", [["Bloom", "Line", " Bloom "], ["y", "1", "z"]]), ("~a.xlsx", [["no"]])):
        (tmp_path / name).write_bytes(spreadsheet.workbook({"Code": rows, "More": [["Line"], ["9"]]}))
    read = spark.read.format("workbook")
    found = read.load(str(tmp_path))
    assert found.columns == ["source_file", "sheet", "source_row", "Bloom", "Line"] and found.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, found.collect()), key=repr) == [("a.xlsx", "Code", 2, "z", "1"), ("b.xlsx", "Code", 2, None, "5"), ("b.xlsx", "Code", 3, "x", None)]
    few = spark.read.format("workbook").schema("Line string, source_row int").option("sheets", "More|Code").load(str(tmp_path / "b.xlsx"))
    assert sorted(map(tuple, few.collect()), key=repr) == [("5", 2), ("9", 2), (None, 3)]


def test_halves(spark):
    a = spark.createDataFrame([(1, "x")], "ord int, Speaker string")
    b = spark.createDataFrame([(1,)], "ord int")
    assert sorted((r.half, r.Speaker) for r in tables.transcript_halves(a, b).collect()) == [(1, "x"), (2, None)]


def test_charts(spark):
    s = {"split": "a<b", "n_rows": 3, "n_transcripts": 1, "both_coders": 1, "one_coder": 1, "neither": 1, "coder_counts": {"x": 2}, "overlap_counts": {"x + y": 1}}
    svg = charts.split_dashboard([s], {"a<b": [0.5, 0.5]})
    assert svg.startswith("<svg") and "a&lt;b" in svg and svg.count("<rect") >= 6
    points = spark.createDataFrame([("s", "té", 4, 0.5), ("s", "tz", 1, 0.5), ("s", "tz", 2, 0.5), ("q", "u", 4, 1.0)], "split string, transcript_id string, n_overlap long, exact_agreement double")
    dots = {(r.split, r.x): tuple(r)[2:] for r in charts.scatter_points(points).collect()}
    at = lambda t: round((sum(map(ord, t)) % 1000 / 999 - 0.5) * 180 * 0.68)
    assert dots == {("s", at("té")): (180.0, 8.0, 1), ("s", at("tz")): (180.0, round(2.2 + 5.8 * 0.5**0.5, 2), 2), ("q", at("u")): (40.0, 8.0, 1)}
    assert charts.agreement_scatter(points).count("<circle") == 3
    assert all(abs(x) <= 62 for _, x in dots)


def test_command_line(spark, tmp_path, capsys):
    from annoweave.__main__ import main
    from annoweave.schemas import CODE_SHEET, TRANSCRIPT_SHEETS

    key = ["Transcript", "Negation", "Half", "Line", "Speaker", "Utterance"]
    rows = [[f"t{i % 12}", "no", "1", str(i), "*CHI:", f"u{i}"] for i in range(2, 122)]
    lines = [["Transcript", "Speaker", "Utterance", "Line"], *[[f"t{i}", "@ID:", f"eng|c|CHI|{1 + i % 4};0{i % 9}.|f|||Target_Child|", None] for i in range(12)], *[[r[0], r[4], r[5], r[3]] for r in rows]]
    book = lambda name, sheets: (tmp_path / name).write_bytes(spreadsheet.workbook(sheets))
    book("m.xlsx", {CODE_SHEET: [[*key, "exclusion"], *[[*r, None] for r in rows]], TRANSCRIPT_SHEETS[0]: lines, TRANSCRIPT_SHEETS[1]: lines[:1]})
    for c, labels in (("a", ["Denial", "Rejection", None]), ("b", ["Denial", None, None, "Denial"])):
        book(f"{c}.xlsx", {CODE_SHEET: [[*key, "Bloom"], *[[*r, labels[i % len(labels)]] for i, r in enumerate(rows)]]})
    (tmp_path / "prompt.md").write_text("Code these.")
    at = lambda *x: str(tmp_path.joinpath(*x))
    told = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert main(["build", "--master", at("m.xlsx"), "--coder-1", at("a.xlsx"), "--coder-2", at("b.xlsx"), "--owner-1", "Ann", "--owner-2", "Bo", "--out", at("data")]) == 0
    assert told()["n_records"] == 120
    assert main(["split", "--data", at("data"), "--master", at("m.xlsx"), "--out", at("splits"), "--iterations", "40"]) == 0
    assert sum(told()["splits"].values()) == 120 and Path(at("splits", "dashboard.svg")).exists()
    ran = ["run", "--split", "dev_train", "--model", "stub", "--limit", "7", "--prompt", at("prompt.md"), "--split-dir", at("splits"), "--results-dir", at("results")]
    assert main(ran) == 0
    assert told()["n_predictions"] == 7
    assert main(ran) == main(["run", "--split", "test_lockbox", *ran[3:]]) == main([*ran, "--batch-size", "0"]) == 2
