from __future__ import annotations

import re

from annoweave.llm import licenses as X

DDL = "doc_id long, text string, license_id string"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DDL)
    return {r.doc_id: r.license_id for r in X.scan_licenses(docs).collect()}


def test_variants_of_known_texts(spark):
    mit = dict(X.KNOWN_TEXTS[::-1])["MIT"]
    assert mit.startswith("Permission is hereby granted")
    texts = [
        "The MIT License (MIT)\r\n\r\nCopyright (c) 2020 Jane Doe\r\nAll rights reserved.\r\n\r\n" + mit.replace(", ", ",\r\n").upper(),
        "# " + mit.replace("\n", "\n# "),
        mit.replace('"', "“"),
        mit + " One more term.",
        "Released under the MIT LICENCE",
        "",
        None,
    ]
    assert scan(spark, texts) == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: "MIT", 5: None, 6: None}


def test_every_known_text_finds_itself(spark):
    found = scan(spark, [t for _, t in X.KNOWN_TEXTS])
    assert [found[i] for i in range(len(X.KNOWN_TEXTS))] == [i for i, _ in X.KNOWN_TEXTS]


def test_lines_that_only_mention_copyright_stay(spark):
    docs = spark.createDataFrame([(1, "keep\ncopyright holders be liable\ncopyright notice", ""), (2, "keep\nCopyright 2001-2005 X\nCopyright © Y\nend", "")], DDL)
    forms = {r.doc_id: r.c for r in docs.select("doc_id", X.canonical(docs.text).alias("c")).collect()}
    assert forms == {1: "keep copyright holders be liable copyright notice", 2: "keep end"}


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], DDL)
    out = X.scan_licenses(docs)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_whole_licences_titled_and_untitled(spark):
    whole = {}
    for i, t in X.full_texts():
        whole.setdefault(i, t)  # the first variant is the text itself
    apache, gpl2 = whole["Apache-2.0"], whole["GPL-2.0"]
    texts = [
        *whole.values(),
        apache[apache.index("1. Definitions.") :],
        apache[: apache.index("END OF TERMS")].replace("http:", "https:"),
        apache.replace("[yyyy] [name of copyright owner]", "2020 Jane Doe"),
        gpl2.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"),
        gpl2[gpl2.index("Preamble") :],
        whole["GPL-3.0"].replace("https:", "http:"),
        apache + " One more term.",
    ]
    found = scan(spark, texts)
    want = [*whole, "Apache-2.0", "Apache-2.0", "Apache-2.0", "GPL-2.0", "GPL-2.0", "GPL-3.0", None]
    assert [found[i] for i in range(len(texts))] == want
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl"} <= set(whole)


def test_lines_that_start_with_the_holder(spark):
    short = dict(X.KNOWN_TEXTS[::-1])
    lines = [
        "Copyright Joyent, Inc. and other Node contributors.", "Copyright The X Authors", "Copyright Jane Doe 2020", "COPYRIGHT: Müller GmbH, 2019", "# Copyright Örn",
        "Copyright {yyyy} {name of copyright owner}", "Copyright Ondrej X\nCopyright (c) 2001 Y\nAll rights reserved.",
    ]
    found = scan(spark, [f"{x}\n\n{short[k]}" for x in lines for k in ("MIT", "ISC", "BSD-3-Clause")])
    assert [found[i] for i in range(len(found))] == ["MIT", "ISC", "BSD-3-Clause"] * len(lines)


def test_terms_at_a_line_start_stay_however_a_text_is_wrapped(spark):
    # a break before each "copyright" and list mark, none before a holder
    texts = []
    for i, t in [*X.KNOWN_TEXTS, *{i: t for i, t in X.full_texts()[::-1]}.items()]:
        plain = "\n".join(x for x in t.split("\n") if not re.match(r"(?i)\W*copyright\s+(\(c\)|\[)", x))
        texts += [(i, plain), (i, re.sub(r"(?i)(?<!copyright)\s+(copyright\s(?!\s*\(c\))|\(c\)\s)", r"\n\1", plain))]
    docs = spark.createDataFrame([(n, t, i) for n, (i, t) in enumerate(texts)], DDL)
    forms = {r.doc_id: r.c for r in docs.select("doc_id", X.canonical(docs.text).alias("c")).collect()}
    assert [texts[n][0] for n in range(0, len(texts), 2) if forms[n] != forms[n + 1]] == []
    mpl = next(t for i, t in X.full_texts() if i == "MPL-2.0")
    assert scan(spark, [" ".join(mpl.split())]) == {0: "MPL-2.0"}
    changed = mpl.replace("under Patent Claims infringed by Covered Software", "under no Patent Claims at all")
    assert changed != mpl and scan(spark, [changed]) == {0: None}


def test_adjacent_equal_words_and_phrases(spark):
    docs = spark.createDataFrame([(1, "licence licence licence, LABOUR", ""), (2, "Copyright owner copyright owner's per cent non-commercial sub-licence", "")], DDL)
    forms = {r.doc_id: r.c for r in docs.select("doc_id", X.canonical(docs.text).alias("c")).collect()}
    assert forms[1] == "license license license labor"
    docs = spark.createDataFrame([(2, "the copyright owner copyright owner, per cent non-commercial sub-licence", "")], DDL)
    assert docs.select(X.canonical(docs.text)).first()[0] == "the copyright holder copyright holder percent noncommercial sublicense"


def test_closing_lines_repeats_nulls_and_long_texts(spark):
    long = "some words of a text " * 100_000
    rows = [(1, "A text.\nReleased under the MIT Licence.\n \n", "x"), (1, "A text.\nReleased under the MIT Licence.\n \n", "x"), (None, long + "\r\nLicensed under CC BY 4.0.\r\n", None), (None, None, None), (2, long, ""), (3, "Released under the MIT License.\nand more", "")]
    found = ((repr(r.doc_id), r.license_id, r.is_license, r.closing_license_id) for r in X.scan_licenses(spark.createDataFrame(rows, DDL)).collect())
    assert sorted(found, key=repr) == sorted([("1", None, False, "MIT"), ("1", None, False, "MIT"), ("None", None, False, "CC-BY-4.0"), ("None", None, False, None), ("2", None, False, None), ("3", None, False, None)], key=repr)


def test_the_query_finds_notices_as_its_sql_does(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(X.ORACLE_SQL).fetchall(), key=repr)
    found = sorted(map(tuple, X.scan_licenses(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()), key=repr)
    assert found == want and any(r[4] for r in found)
