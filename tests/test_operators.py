from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from annoweave.operators import agreement as ag
from annoweave.operators import ages, linking, ordering
from annoweave.operators import splits as sp
from annoweave.schemas import SPLIT_ITERATIONS
from pyspark.sql import functions as F


def kappa(pairs):
    n = len(pairs)
    if not n:
        return None
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    chance = sum(left[x] * right[x] for x in left)
    agree = sum(a == b for a, b in pairs)
    return (1.0 if agree == n else 0.0) if chance == n * n else (n * agree - chance) / (n * n - chance)


def stats(spark, pairs):
    df = spark.createDataFrame(pairs or [(None, None)], "l string, r string")
    return ag.agreement_stats(ag.pair_counts(df, "l", "r")).collect()


@pytest.mark.parametrize("pairs", [[("a", "a")], [("a", "a")] * 5, [("a", "b")] * 3, [("a", "b"), ("b", "a")], [("a", "a"), ("b", "b"), ("a", "b")], [("a", "c"), ("b", "c")]])
def test_kappa(spark, pairs):
    r = stats(spark, [*pairs, ("a", None), (None, "b")])[0]
    assert (r.n_overlap, r.n_agree) == (len(pairs), sum(a == b for a, b in pairs))
    assert r.cohen_kappa == pytest.approx(kappa(pairs), abs=1e-15)


def test_kappa_without_pairs(spark):
    r = stats(spark, [])[0]
    assert (r.n_overlap, r.exact_agreement, r.cohen_kappa) == (0, None, None)


def test_kappa_is_symmetric_invariant_and_mergeable(spark):
    rng = random.Random(1)
    pairs = [(rng.choice("abc"), rng.choice("abc"), i % 7) for i in range(500)]
    df = spark.createDataFrame(pairs, "l string, r string, g int")
    whole = ag.agreement_stats(ag.pair_counts(df, "l", "r")).first()
    assert ag.agreement_stats(ag.pair_counts(df, "r", "l")).first() == whole
    assert ag.agreement_stats(ag.merge_counts(ag.pair_counts(df, "l", "r", ["g"]))).first() == whole
    renamed = df.select(F.concat(F.lit("z"), "l").alias("l"), F.concat(F.lit("z"), "r").alias("r"))
    assert ag.agreement_stats(ag.pair_counts(renamed, "l", "r")).first() == whole


def test_large_counts_do_not_overflow(spark):
    pairs = spark.createDataFrame([("a", "a", 6_000_000_000), ("b", "b", 4_000_000_000), ("a", "b", 1_000_000_000)], "l string, r string, n long")
    n, a = 11.0, 10.0
    chance = 7 * 6 + 4 * 5
    assert ag.agreement_stats(pairs).first().cohen_kappa == pytest.approx((n * a - chance) / (n * n - chance))


def test_siding_and_buckets(spark):
    rows = [("a", "a", "b"), ("b", "a", "b"), ("Uncoded", "a", "b"), ("c", "a", "b"), ("a", "a", "a"), (None, "a", "b"), ("a", None, "b")]
    df = spark.createDataFrame(rows, "m string, x string, y string")
    side = ag.siding(F.col("m"), F.col("x"), F.col("y"))
    assert [r[0] for r in df.select(side).collect()] == ["sides_with_1", "sides_with_2", "uncoded_or_excluded", "neither", None, None, None]
    bucket = ag.error_bucket(F.col("x"), F.col("m"), {"ab": ("a", "b")})
    assert [r[0] for r in df.select(bucket).collect()] == [None, "ab", "other", "other", None, None, None]


def test_context_windows(spark):
    rows = [("t", i, f"u{i}") for i in range(1, 51)] + [("alone", 1, "x")]
    c = {(r.t, r.i): r for r in ordering.context_windows(spark.createDataFrame(rows, "t string, i int, u string"), ["t"], "i", F.col("u")).collect()}
    assert c["t", 30].context_before == [f"u{i}" for i in range(10, 30)]
    assert c["t", 30].context_after == [f"u{i}" for i in range(31, 51)]
    assert c["t", 1].context_before == [] and len(c["t", 1].context_after) == 20
    assert c["alone", 1].context_before == c["alone", 1].context_after == []


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_dense_numbers(spark, width):
    keys = random.Random(2).sample(range(1000), 200)
    found = ordering.dense_number(spark.createDataFrame([(k,) for k in keys], "k int").repartition(5), "k", "n", width).collect()
    assert [r.n for r in sorted(found)] == list(range(1, 201))


@pytest.mark.parametrize(("size", "chunk", "reach"), [(20, 4096, 512), (3, 7, 5), (2, 2, 1), (5, 5, 64)])
def test_contexts_at_are_those_of_plain_windows(spark, size, chunk, reach):
    rng = random.Random(4)
    rows = [(t, o, f"{t}{o}") for t, n, most in (("a", 700, 800), ("b", 40, 10**9), ("c", 1, 5)) for o in rng.sample(range(-most, most), n)]
    lines = spark.createDataFrame(rows, "t string, o long, u string").repartition(4).cache()
    hits = lines.filter(F.xxhash64("t", "o") % 9 == 0).unionByName(lines.filter("t = 'c'")).select("t", "o").distinct()
    want = ordering.context_windows(lines, ["t"], "o", F.col("u"), size).join(hits, ["t", "o"], "left_semi")
    found = ordering.contexts_at(lines, hits, ["t"], "o", F.col("u"), size, chunk, reach)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    assert ordering.contexts_at(lines.limit(0), hits.limit(0), ["t"], "o", F.col("u")).count() == 0
    with pytest.raises(ValueError):
        ordering.contexts_at(lines, hits, ["t"], "o", F.col("u"), 20, 19)


def test_a_long_transcript_is_dealt_out(spark):
    """A million lines of one transcript: windows only in chunks with a hit, no task holds more than a few chunks."""
    lines = spark.range(1_000_000).select(F.lit("t").alias("t"), F.col("id").alias("o"))
    hits = lines.filter("o % 100000 = 4095 OR o BETWEEN 500000 AND 500004")
    found = ordering.contexts_at(lines, hits, ["t"], "o", F.col("o")).collect()
    assert len(found) == 15
    for r in found:
        assert r.context_before == list(range(max(0, r.o - 20), r.o)) and r.context_after == list(range(r.o + 1, min(10**6, r.o + 21)))
    plan = ordering.contexts_at(lines, hits, ["t"], "o", F.col("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("LeftSemi")  # windows stand above the choice of chunks


def test_record_numbers(spark):
    df = spark.createDataFrame([("eng_999999",), ("eng_1000000",), ("x",), (None,)], "r string")
    assert [r[0] for r in df.select(ordering.record_number(F.col("r"))).collect()] == [999999, 1000000, None, None]


def test_prejacents(spark):
    from annoweave.functions.text import prejacent, same_prejacent

    rows = [("No, I don't want it!", "don't"), ("no no no", "no"), ("No", "NO"), ("nothing", "no"), ("do not go", "do not"), ("I do", "do not"), (None, "no"), ("x", None), ("x", ""), ("", "no")]
    df = spark.createDataFrame(rows, "u string, n string")
    assert [r[0] for r in df.select(prejacent(F.col("u"), F.col("n"))).collect()] == [["want", "it"], ["no", "no"], [], None, ["go"], None, None, None, None, None]
    pairs = spark.createDataFrame([("No more", "no", "no  MORE!", "no"), ("no more", "no", "not more", "not"), ("no more", "no", "no less", "no"), ("no", "no", None, None)], "u string, n string, u0 string, n0 string")
    assert [r[0] for r in pairs.select(same_prejacent(F.col("n"), F.col("u"), F.col("n0"), F.col("u0"))).collect()] == [True, False, False, False]


def test_words_are_split_once_an_utterance(spark, capsys):
    """Named inside a lambda, the split would run for each word of the utterance."""
    from annoweave.functions.text import prejacent, same_prejacent

    df = spark.createDataFrame([("x " * 5000 + "do not " + "y " * 5000, "do not")], "u string, n string")
    found = df.select(prejacent(F.col("u"), F.col("n")).alias("p"))
    assert found.first().p == ["y"] * 5000
    for shown, splits in ((found, 2), (df.select(same_prejacent(F.col("n"), F.col("u"), F.col("n"), F.col("u")).alias("s")), 6)):
        capsys.readouterr()
        shown.explain()
        assert 1 <= capsys.readouterr().out.count("regexp_extract_all") <= splits


def test_table_digests_do_not_hang_on_order(spark):
    import hashlib

    from annoweave.functions import digests

    rows = [(i % 700, f"t{i % 900}" if i % 7 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "b int, a string")
    found = {tuple(digests.table_digest(x).first().asDict().items()) for x in (df, df.repartition(11), df.orderBy("a").coalesce(1), df.select("b", "a"))}
    assert len(found) == 1
    plain = [hashlib.sha256(f"{chr(0) if a is None else a}\x1f{b}".encode()).hexdigest() for b, a in rows]
    one = dict(found.pop())
    assert one["n_rows"] == 20_000 and int(one["digest_sum"]) == sum(int(d[:15], 16) for d in plain)
    level = {}
    depth = digests.digits(len(set(plain)))
    for d in set(plain):
        level.setdefault(d[:depth], []).append(f"{d}:{plain.count(d)}")
    level = {k: hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in level.items()}
    for k in reversed(range(depth)):
        up = {}
        for at, node in level.items():
            up.setdefault(at[:k], []).append(f"{at}:{node}")
        level = {k: hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in up.items()}
    assert one["merkle_root"] == level[""]
    assert digests.table_digest(df.union(df.limit(1))).first().merkle_root != one["merkle_root"]
    assert digests.table_digest(df.limit(0)).first().n_rows == 0


def test_ids_batches_and_limits(spark):
    df = spark.createDataFrame([(n,) for n in (1, 5, 6, 1234567)], "n long")
    assert [tuple(r) for r in df.select(ordering.record_id(F.col("n")), ordering.batch_number(F.col("n"), 5)).collect()] == [("eng_000001", 1), ("eng_000005", 1), ("eng_000006", 2), ("eng_1234567", 246914)]
    assert [r.n for r in ordering.head(df, 2, "n").collect()] == [1, 5]
    with pytest.raises(ValueError):
        ordering.head(df, 0, "n")
    with pytest.raises(ValueError):
        ordering.batch_number(F.col("n"), 0)


def test_last_line_wins_and_no_match(spark):
    tokens = spark.createDataFrame([("t", 5), ("t", 9)], "t string, line long")
    lines = spark.createDataFrame([("t", 5, 1, "old"), ("t", 5, 8, "new"), ("s", 9, 1, "other")], "t string, line long, ord int, u string")
    assert sorted(map(tuple, linking.line_lookup(tokens, lines, ["t", "line"], "ord", ["u"]).collect())) == [("t", 5, "new"), ("t", 9, None)]


def test_alignment(spark):
    rows = [(True, "a", "a"), (True, None, None), (True, "a", "b"), (None, "a", None), (True, "a", None)]
    df = spark.createDataFrame(rows, "there boolean, x string, y string")
    assert [r[0] for r in df.select(linking.alignment_mismatch(F.col("there"), F.struct("x"), F.struct("y"))).collect()] == [False, False, True, True, True]


def test_reference_must_exist(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "record_id string"), spark.createDataFrame([("1", "x")], "record_id string, l string")
    assert linking.with_reference(a.filter("record_id = '1'"), b).collect() == [("1", "x")]
    with pytest.raises(Exception, match="no reference for 2"):
        linking.with_reference(a, b).collect()


def test_child_ages(spark):
    line = "eng|c|{}|{}|f|||{}|"
    rows = [
        ("t", "@ID:", line.format("CHI", "2;00.", "x"), 1, 1), ("t", "@ID:", line.format("MOT", "30;00.", "Mother"), 1, 2), ("t", "@ID:", line.format("KID", "2;06.", "Target_Child"), 2, 1),
        ("t", "@ID:", "eng|c|CHI|9;00|f", 2, 9), ("t", "*CHI:", line.format("CHI", "5;00", "x"), 2, 9), ("s", "@ID:", line.format("CHI", "", "x"), 1, 1), (None, "@ID:", line.format("CHI", "1;00", "x"), 1, 1),
    ]
    df = spark.createDataFrame(rows, "Transcript string, Speaker string, Utterance string, half int, ord int")
    assert [tuple(r) for r in ages.child_ages(df).collect()] == [("t", 30.0, "2;06.")]


def test_histogram_edges(spark):
    edges = ages.bin_edges(14.2, 29.7)
    assert edges == pytest.approx(np.linspace(14, 30, 7).tolist(), abs=0)
    for v in (13.9, 14.0, edges[1], 29.99, 30.0, 30.1, None):
        got = spark.createDataFrame([(v,)], "v double").select(ages.bin_of(F.col("v"), edges)).first()[0]
        want = None if v is None or not 14 <= v <= 30 else min(5, int(np.searchsorted(edges, v, "right")) - 1)
        assert got == want
    assert ages.bin_edges(None, None) == [0.0, 1.0]
    df = spark.createDataFrame([(12.0, 3), (12.0, 4), (None, 9)], "a double, n long")
    assert [tuple(r) for r in ages.age_histogram(df, "a", F.col("n")).select("weight", "share").collect()] == [(7, 1.0)]


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        t = f"t{rng.randrange(60):02d}"
        a, b = (rng.choice([None, "Denial", "Rejection", "Excluded"]) for _ in range(2))
        rows.append((f"eng_{i:06d}", t, "NA" if a is None else "c1", "NA" if b is None else "c2", a, b, None if t == "t07" else 14.0 + int(t[1:]) % 17))
    return spark.createDataFrame(rows, "record_id string, transcript_id string, coded_by_1 string, coded_by_2 string, bloom_1 string, bloom_2 string, child_age_months double")


def test_search_and_objective_agree(spark, records):
    coded = records.filter("coded_by_1 <> 'NA' OR coded_by_2 <> 'NA'")
    table, pairs = sp.transcript_table(coded).cache(), sp.label_counts(coded).cache()
    found = sp.search_splits(table, pairs, iterations=60).cache()
    again = sp.search_splits(table, pairs, iterations=60)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    score = found.first().score
    assert sp.split_objective(table, pairs, found.select("transcript_id", "split")).first().score == pytest.approx(score, rel=1e-9)
    assert found.count() == table.count()
    one = sp.search_splits(table, pairs, iterations=1)
    assert score <= one.first().score
    assert sp.search_splits(table, pairs, iterations=20, sequential=True).count() == table.count()


def test_search_preconditions(spark, records):
    table, pairs = sp.transcript_table(records), sp.label_counts(records)
    with pytest.raises(ValueError, match="age"):
        sp.search_splits(table.withColumn("age_months", F.lit(None).cast("double")), pairs, iterations=2)
    with pytest.raises(ValueError, match="fills every split"):
        sp.search_splits(table.limit(2), pairs.limit(0), iterations=2)
    with pytest.raises(ValueError, match="no transcripts"):
        sp.search_splits(table.limit(0), pairs, iterations=2)


def test_summary_invariants(spark, records):
    found = sp.search_splits(sp.transcript_table(records), sp.label_counts(records), iterations=10)
    split = sp.apply_splits(records, found)
    rows = {r.split: r for r in sp.split_summary(split).collect()}
    assert sum(r.n_rows for r in rows.values()) == records.count()
    for r in rows.values():
        assert r.both_coders + r.one_coder + r.neither == r.n_rows
        assert sum(r.coder_counts.values()) == 2 * r.both_coders + r.one_coder
        assert sum(r.overlap_counts.values()) == r.both_coders == r.n_overlap_bloom
        assert list(r.coder_counts) == sorted(r.coder_counts)
    none = rows[sp.NEITHER_SPLIT]
    assert none.bloom_cohen_kappa is None and none.coder_counts == {} and none.neither == none.n_rows
    assert sp.split_leaks(split).count() == 0


def test_penalties():
    numbers = lambda *x: np.array(x, float)
    part = sp.Part(numbers(5, 5), numbers(5, 0), numbers(0, 5), numbers(20, np.nan), np.array([0]), np.array([0]), numbers(5), [20.0, 20.5, 21.0], 1)
    goal = sp.Score({"p": 0.5, "q": 0.5}, 2, 1, part.sums(np.array([0, 0]), 1)[0])
    both = 2 * (sp.W_BOTH + sp.W_ONE) * 0.25
    scores = goal.of(np.stack([part.sums(np.array(split), 2) for split in ([0, 1], [0, 0])]))
    assert scores[0] == pytest.approx(both + sp.NO_OVERLAP + sp.NO_AGES) and scores[1] == float("inf")


def test_replay_is_one_plain_loop(spark, records):
    """The sequential search against one loop with one generator over all transcripts, in order of first appearance."""
    coded = records.filter("coded_by_1 <> 'NA' OR coded_by_2 <> 'NA'").withColumn("seen", F.xxhash64("transcript_id", "coded_by_1")).cache()
    table, pairs = sp.transcript_table(coded, order=F.col("seen")).cache(), sp.label_counts(coded).cache()
    rows = sorted(table.collect(), key=lambda r: r.first_seen)
    labels = sorted({x for r in pairs.collect() for x in (r.l, r.r)})
    at = {r.transcript_id: i for i, r in enumerate(rows)}
    held = pairs.collect()
    column = lambda c: np.array([np.nan if r[c] is None else r[c] for r in rows], float)
    ages_ = column("age_months")
    edges = ages.bin_edges(np.nanmin(ages_), np.nanmax(ages_))
    cells = np.array([labels.index(r.l) * len(labels) + labels.index(r.r) for r in held])
    part = sp.Part(column("n_rows"), column("both_coders"), column("one_coder"), ages_, np.array([at[r.transcript_id] for r in held]), cells, np.array([r.n for r in held], float), edges, len(labels))
    n = len(rows)
    goal = sp.Score(sp.SPLIT_TARGETS, len(edges) - 1, len(labels), part.sums(np.zeros(n), 1)[0])
    goals = [sum(r.n_rows for r in rows) * t for t in sp.SPLIT_TARGETS.values()]
    rng, best = random.Random(sp.SPLIT_SEED), None
    for i in range(1100):
        split = sp.greedy_assignment([r.n_rows for r in rows], goals, rng)
        score = float(goal.of(part.sums(np.array(split), len(goals))[None])[0])
        if best is None or score < best[0] - 1e-12:
            best = (score, i, split)
    found = sp.search_splits(table, pairs, iterations=1100, sequential=True, part=5, block=300).collect()
    assert {r.iteration for r in found} == {best[1]} and found[0].score == pytest.approx(best[0], rel=1e-9)
    assert {r.transcript_id: r.split for r in found} == {r.transcript_id: list(sp.SPLIT_TARGETS)[k] for r, k in zip(rows, best[2], strict=True)}


def test_registered_search_runs_all_trials(monkeypatch):
    from annoweave import queries

    asked = {}
    monkeypatch.setattr(queries, "coded_units", lambda *a: None)
    monkeypatch.setattr(sp, "transcript_table", lambda *a: None)
    monkeypatch.setattr(sp, "label_counts", lambda *a: None)
    monkeypatch.setattr(sp, "search_splits", lambda *a, iterations=SPLIT_ITERATIONS, **k: asked.update(n=iterations))
    queries.split_search(None, "")
    assert asked == {"n": 20_000}


def test_many_transcripts_are_searched_one_by_one(spark):
    many = spark.range(60_000).select(F.col("id").cast("string").alias("transcript_id"), (F.col("id") % 5 + 1).alias("n_rows"), F.when(F.col("id") % 7 > 0, F.col("id") % 20 + 14.5).alias("age_months"), F.lit(1).alias("both_coders"), (F.col("id") % 5).alias("one_coder"), F.lit(1).alias("n_overlap_bloom"), (F.col("id") % 2).alias("n_bloom_agree")).cache()
    labels = many.select("transcript_id", F.lit("a").alias("l"), F.when(F.col("n_bloom_agree") == 1, "a").otherwise("b").alias("r"), F.lit(1).alias("n")).cache()
    found = sp.search_splits(many, labels, iterations=2).cache()
    assert found.count() == 60_000
    assert sp.split_objective(many, labels, found.select("transcript_id", "split")).first().score == pytest.approx(found.first().score, rel=1e-9)


def test_sparse_ordinals_are_numbered_without_one_window(spark):
    rng = np.random.default_rng(8)
    ords = sorted({int(x) for x in rng.integers(-(2**62), 2**62, 400)} | {0, 1, 2, 10**6, 2**62, -(2**62)})
    df = spark.createDataFrame([(x, i % 3) for i, x in enumerate(ords)], "o long, g int").repartition(4)
    for width in (1, 1 << 20, 1 << 50):
        assert {r.o: r.n for r in ordering.dense_number(df, "o", "n", width=width).collect()} == {x: i for i, x in enumerate(ords, 1)}
    within = {r.o: r.n for r in ordering.dense_number(df, "o", "n", width=1 << 30, within=["g"]).collect()}
    assert within == {x: i // 3 + 1 for i, x in enumerate(ords)}
    assert ordering.dense_number(df.limit(0), "o", "n").count() == 0


def test_contexts_of_repeated_lines_are_those_of_the_last(spark):
    from annoweave.plans import pipeline

    lines = spark.createDataFrame([(1, i, "t", i % 30, "*A:", f"u{i}", None) for i in range(60)], "half int, ord int, transcript_id string, line long, speaker string, utterance string, transcript_line string")
    tokens = spark.createDataFrame([(1, "t", 4), (1, "t", 4), (1, "t", 29), (1, "t", 77), (2, "t", 4), (1, None, None)], "half int, transcript_id string, line long")
    found = {r.line: r for r in pipeline.token_contexts(tokens, lines, 3).collect()}
    assert set(found) == {4, 29}
    assert [x.utterance for x in found[4].context_before] == ["u31", "u32", "u33"] and [x.utterance for x in found[29].context_after] == []


def test_json_safe_values(spark):
    from annoweave.functions.text import json_safe

    df = spark.sql("SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, DATE'2024-01-02' AS day, CAST(NULL AS DATE) AS none, 1.50 AS e, array(1) AS a")
    row = df.select(*[json_safe(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == (1, 1.5, True, "x", "2024-01-02", None, "1.50", "[1]")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as S

    from annoweave import session

    named = []

    def fake(master, folder=None):
        context = S(master=master, getCheckpointDir=lambda: None, setCheckpointDir=named.append)
        return S(sparkContext=context, conf=S(get=lambda k, d: folder or d))

    for master in ("local", "local[*]", "local[4]"):
        session.ensure_checkpoint_dir(fake(master))
    session.ensure_checkpoint_dir(fake("spark://x:7077", "hdfs:///shared"))
    assert len(named) == 4 and named[-1] == "hdfs:///shared"
    for master in ("spark://x:7077", "local-cluster[3,2,3000]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(fake(master))


def test_sorts_and_deals_grow_with_the_rows(spark, monkeypatch):
    """What a task sorts or takes is bounded: more rows mean more tasks, in the same order."""
    from annoweave import run_queries
    from annoweave.sources import sinks

    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("o"))
    numbered = ordering.dense_number(df, "o", "n", width=16)
    assert numbered.rdd.getNumPartitions() == 20
    assert {r.o: r.n for r in numbered.collect()} == {i: i + 1 for i in range(2000)}
    out = sinks.ordered(df, ["o"])
    assert out.rdd.getNumPartitions() > 8
    assert [r.o for r in out.collect()] == list(range(2000))
    monkeypatch.setattr(run_queries, "_PART", 1000)
    assert run_queries._parts(df) == 5 + sum(len(str(i)) for i in range(2000)) // 1000


def test_rows_of_files_do_not_move(spark, tmp_path, capsys):
    from annoweave.sources import tables

    spark.range(100).write.json(str(tmp_path / "x"))
    capsys.readouterr()
    tables.read_json_lines(spark, str(tmp_path / "x"), "id long", strict=False, ordinal="n").explain()
    assert "SortMergeJoin [__path" not in (shown := capsys.readouterr().out) and "SortMergeJoin [__file" not in shown
