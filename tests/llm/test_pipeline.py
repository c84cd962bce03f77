from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from annoweave.llm import mixing, packing, queries, simhash, toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_add_up(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        docs = docs.checkpoint()
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = packed.filter("piece = 0").groupBy("doc_id").count()
    want = docs.groupBy("doc_id").count()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))


def test_run_gives_what_the_stages_give(spark):
    a = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    b = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) != []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_over_whole_tables(spark, name):
    out = queries.queries()[name](spark, SF)
    if name not in ("op2_ann", "op5_mixing", "op10_packing"):
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert out.count() > 0
    assert name in entry.queries()


DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, toxic int, h long, replica int, kept boolean, fp double, `group` int, t string"


def odd_rows():
    rng = random.Random(17)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for i in range(240):
        words = text(rng.randrange(1, 80)).split()
        if i % 6 == 0:
            words += ["grumph", "skazz", "blorf"]
        rows.append((i if i % 7 else 2**62 + i, " ".join(words), f"s{i % 3}"))
    rows += [(1000 + i, rows[5][1].replace(" ", "  ") + " " * (i % 2), "s1") for i in range(5)]  # equal texts, the longest stays
    rows += [(rows[8][0], rows[8][1], "s0"), (rows[9][0], "another text under an id that is there", "s2")]
    long = text(5000)
    rows += [(2000, long, "s0"), (2001, long + " more", "s0"), (2002, long + " or less", None)]  # near copies, and longer than a sequence
    rows += [(None, None, "s1"), (None, "a text without any id", None), (3000, "", "s0"), (3001, " \n", "s0"), (3002, None, "s0")]
    return rows


def brute(rows, toxic):
    """Rows of the packed result without their places, from the definition of each stage."""
    kept = [r for r in rows if (r[0], r[1]) not in toxic]
    best = {}
    for i, t, s in kept:
        key = re.sub("[ \t-\r]", "", t or "")
        rank = (-len(t or ""), i is None, i or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (i, t, s))
    kept = [r for _, r in best.values()]
    fps = [simhash.fingerprint(t or "", 4) for _, t, _ in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    firsts = {}
    for r, g in zip(kept, group, strict=True):
        if g not in firsts or (r[0] is None, r[0] or 0) < (firsts[g][0] is None, firsts[g][0] or 0):
            firsts[g] = r
    kept, size = list(firsts.values()), Counter()
    for _, t, s in kept:
        size[s] += len(t or "")
    want = {s: n**0.5 for s, n in size.items() if n}
    tok, out = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for i, t, s in kept:
        rate = want[s] / sum(want.values()) * sum(size.values()) / size[s] if size[s] else 1.0
        key = str(i) if i is not None else "null:" + hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{mixing.SEED}:{key}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        cdf = p
        while cdf < u:
            n += 1
            p *= rate / n
            cdf += p
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            out[i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += n
    return +out


def stored(spark, folder, rows, labels):
    full = [(i, t, "l", s, len(t or ""), "x", 5, 6, 7, True, 0.5, 8, "y") for i, t, s in rows]
    spark.createDataFrame(full, DDL).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_whole_pipeline_by_brute_force(spark, tmp_path):
    rows = odd_rows()
    labels = [(i, int("grumph" in (t or "")), 1) for i, t, _ in rows if i is not None and i < 2000] + [(None, 1, 0), (4, None, 0)]
    sf = stored(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = toxicity.drop_toxic(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns
    toxic = {(i, t) for i, t, _ in rows} - {(r.doc_id, r.text) for r in kept.collect()}
    assert sum("grumph" in (t or "") for _, t in toxic) >= max(20, 0.8 * len(toxic))
    found = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute(rows, toxic)
    ends = {}
    for r in found:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_odd_tables(spark, tmp_path):
    rows = odd_rows()
    cases = {"empty": ([], []), "no labels": (rows[:30], []), "one class": (rows[:30], [(1, 0, 1)]), "one row": ([(None, None, None)], [(5, 1, 1)])}
    n = {name: corpus_pipeline.run(spark, stored(spark, tmp_path / name, *case)).count() for name, case in cases.items()}
    assert n["empty"] == 0 and n["no labels"] > 10 and n["one class"] > 10


def test_nothing_is_left_in_the_shared_folder(spark):
    corpus_pipeline.run(spark, SF).count()
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d in os.listdir(shared) if d.startswith("corpus_pipeline") and os.listdir(f"{shared}/{d}")]


def test_stages_take_any_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.lit(1) for c in ("id", "toxic", "h", "t", "mark", "size", "part", "fp", "group", "node", "replica", "kept", "keep_id", "digest", "norm", "owner", "mix_source", "rate", "cdf", "length")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
