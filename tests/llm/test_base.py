from __future__ import annotations

import pyarrow as pa
from annoweave.llm import base as X


def test_slices_cover_a_batch_in_order():
    b = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(X.sliced([b, b.slice(0, 0), b.slice(0, 3)], 300))
    assert [p.num_rows for p in parts] == [300, 300, 300, 100, 3]
    assert [x for p in parts[:4] for x in p.column(0).to_pylist()] == list(range(1000))


def test_python_gets_small_batches_unless_a_limit_is_set(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    own = spark.newSession()
    df = own.range(4000).selectExpr("repeat('x', 8000) AS t").coalesce(1)
    run = lambda: sorted(r.n for r in df.mapInArrow(sizes, "n long").collect())
    own.conf.unset(X._LIMIT)
    assert X.in_small_batches(df) is df and max(run()) * 8000 < 2 * X.BATCH_BYTES and sum(run()) == 4000
    own.conf.set(X._LIMIT, str(64 << 20))
    X.in_small_batches(df)
    assert own.conf.get(X._LIMIT) == str(64 << 20)


def test_kept_rows_match_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, None, 4), (None, "", 5), (0, "", 6)], "doc_id long, text string, n int")
    kept = docs.filter("n IN (1, 4)").select("doc_id", X.row_hash().alias("text_hash"))
    found = X.keep_rows(docs, kept)
    assert found.columns == docs.columns
    assert sorted((repr(r.doc_id), r.text or "") for r in found.collect()) == [("1", "a"), ("None", "")]
    plan = X.keep_rows(docs, kept)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
