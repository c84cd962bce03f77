from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from annoweave.llm import toxicity as X

BAD = ["grumph", "skazz", "blorf"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), toxic))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, data):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data[0]], "doc_id long, text string, score double")
    labels = spark.createDataFrame(data[1], "doc_id long, toxic int")
    found = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    truth = {i: t for i, _, t in data[0]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (i in set(held)) for i in truth)
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}


def test_held_out_labels_are_not_learned_from(spark, data):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data[0]], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in data[1]]
    a, b = (sorted(map(tuple, X.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (data[1], flip))
    assert a == b


def test_nulls_empty_and_one_class(spark):
    docs = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "w " * 50_000), (3, "w")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in X.toxicity(docs, none).collect()} == {0.0}
    assert X.toxicity(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (1, 0)], "doc_id long, toxic int")
    assert X.toxicity(docs, some).count() == 5


def brute_models(rows):
    """P(word | context), P(word) of both classes by the definition, on plain dicts, from {text: toxic}. None is the start, "" ends a text."""
    names = lambda t: [f"={w!r}" for w in X.words_of(t)] + ["<end>"]
    pairs = [Counter(), Counter()]
    for t, k in rows.items():
        w = names(t)
        pairs[k].update(zip([None, *w], w, strict=False))
    before = [Counter(w for _, w in p) for p in pairs]
    classes = Counter(w for b in before for w in b)
    shared = lambda w: (classes[w] + 1) / (sum(classes.values()) + len(classes) + 1)

    def of(k):
        n = sum(before[k].values())
        d = X.discount(*(sum(c == i for c in before[k].values()) for i in (1, 2)))
        d2 = X.discount(*(sum(c == i for c in pairs[k].values()) for i in (1, 2)))
        after = {}
        for (h, w), c in pairs[k].items():
            after.setdefault(h, {})[w] = c
        word = lambda w: max(before[k][w] - d, 0) / max(1, n) + (sum(min(c, d) for c in before[k].values()) / n if n else 1) * shared(w)

        def p(h, w):
            own = after.get(h)
            return word(w) if not own else (max(own.get(w, 0) - d2, 0) + d2 * len(own) * word(w)) / sum(own.values())

        return p, word

    return [of(0), of(1)], [*classes, "<unknown>"], names


def brute_figures(rows, text):
    (ordinary, toxic), _, names = brute_models(rows)
    w = names(text)
    tells = [math.log10(toxic[0](h, x) / ordinary[0](h, x)) for h, x in zip([None, *w], w, strict=False)]
    lesser = [min(a, math.log10(toxic[1](x) / ordinary[1](x))) for a, x in zip(tells, w, strict=True)]
    out = [sum(tells) / len(w)]
    for size in (1, 2, 4):
        size = min(size, len(w))
        means = sorted((sum(lesser[i : i + size]) / size for i in range(0, len(w) - size + 1, max(1, size // 2))), reverse=True)
        out += [sum(means[:k]) / len(means[:k]) for k in (1, 3, 8)]
    return out


def small(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["you", "so", "a", "b", "c", "grumph" if i % 3 == 0 else "d", "e", f"u{i}"], k=rng.randrange(25))) for i in range(60)]
    return texts + texts[:4], [i % 3 == 0 for i in range(60)] + [i % 3 == 0 for i in range(4)]


def counted(spark, texts, toxic):
    rows = dict(zip(texts, toxic, strict=True))  # equal texts have one vote
    return X.pair_counts(spark.createDataFrame([(t, k, i % X.PARTS) for i, (t, k) in enumerate(rows.items())], "t string, toxic boolean, part int")), rows


def test_figures_by_brute_force(spark):
    counts, rows = counted(spark, *small())
    for without in (None, 0, 2):
        kept = {t: k for i, (t, k) in enumerate(rows.items()) if without is None or i % X.PARTS != without}
        models = counts.fit(without)
        for t in ["", "you grumph grumph", "never seen words d so", *list(rows)[:20]]:
            assert np.allclose(X.figures(models, t), brute_figures(kept, t), atol=1e-5)


def test_scores_by_brute_force(spark):
    """The whole result from its definition: sample, parts, models, curve."""
    texts, toxic = small(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(toxic)], "doc_id long, toxic int")
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows: dict = {}
    for i in learned:
        rows[texts[i]] = rows.get(texts[i], False) or toxic[i]
    part = {r.text: r.part for r in docs.select("text", ((X.row_hash() % X.PARTS + X.PARTS) % X.PARTS).alias("part")).collect()}
    seen = sorted((tuple(brute_figures({t: k for t, k in rows.items() if part[t] != part[text]}, text)), bool(k)) for text, k in rows.items())
    mean, scale, w = X.fit_logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], float), share=sum(toxic[i] for i in learned) / len(learned))
    for r in X.toxicity(docs, labels).collect():
        z = (np.array(brute_figures(rows, texts[r.doc_id])) - mean) / scale @ w[1:] + w[0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-3)


def test_probabilities_sum_to_one(spark):
    counts, rows = counted(spark, *small())
    for without in (None, 1):
        _, found = counts.probabilities(without)
        size = len(counts.words)
        h, w = counts.keys >> 32, counts.keys & 0xFFFFFFFF
        for own, freed, word in found:
            known = word[:-1][np.isin(np.arange(size), w)].sum() + word[-1]
            if without is None:
                assert abs(known - 1) < 1e-9
                for c in set(h.tolist()):
                    assert abs(own[h == c].sum() + freed[c] - 1) < 1e-9


def test_figures_are_per_word(spark):
    counts, _ = counted(spark, *small())
    models = counts.fit()
    once, often = (X.figures(models, t) for t in ("grumph", "grumph " * 200_000))
    assert once[0] > 0 and abs(often[0] - once[0]) < 2 and len(once) == 1 + len(X.WINDOWS) * len(X.BEST)
    assert all(np.isfinite(X.figures(models, "")))


def test_logistic_finds_a_boundary():
    x = np.linspace(-1, 1, 200)[:, None]
    mean, scale, w = X.fit_logistic(x, (x[:, 0] > 0).astype(float))
    assert w[1] > 0 and abs(w[0]) < 0.5


def test_a_bound_sample_keeps_the_base_rate(spark):
    # words tell nothing here, so a score is the share of toxic rows
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(1500)], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1500)], "doc_id long, toxic int").cache()
    texts = [r.text for r in docs.collect()]
    whole, bound = (float(np.mean(X.train(docs, labels, max_docs=n).scores(texts))) for n in (4000, 60))
    assert abs(whole - 0.1) < 0.05 and abs(bound - whole) < 0.08


def test_votes_move_the_boundary():
    x = np.array([[0.0], [1.0]] * 50)
    y = np.array([0.0, 1.0, 1.0, 0.0] * 25)
    mean, scale, w = X.fit_logistic(x, y, share=0.1)
    p = 1 / (1 + np.exp(-((x - mean) / scale @ w[1:] + w[0])))
    assert abs(p.mean() - 0.1) < 1e-6
    assert np.allclose(X.fit_logistic(x, y, share=0.5)[2], X.fit_logistic(x, y)[2])


def test_context_tells(spark):
    """The same word after different ones: in toxic texts it follows one, in ordinary texts the other."""
    texts = [f"you grumph {c}" for c in "abcdefgh"] + [f"a grumph {c}" for c in "ijklmnop"] + ["you a b so", "then you c", "a you d"]
    counts, _ = counted(spark, texts, [True] * 8 + [False] * 11)
    models = counts.fit()
    after, other = (models.differences(f"{w} grumph")[0][1] for w in ("you", "a"))
    assert after > 0 > other
    assert X.figures(models, "you grumph")[0] > X.figures(models, "a grumph")[0]


def test_clashing_columns_repeats_and_long_texts(spark, data):
    rows = [(i, t) for i, t, _ in data[0]] + [(3, "quite another text"), (3, "quite another text"), (None, "x"), (5000, "word " * 200_000)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2, 3, True) for i, t in rows], "doc_id long, text string, id string, toxic int, h long, t int, part boolean")
    labels = spark.createDataFrame([(*x, "y") for x in data[1]], "doc_id long, toxic int, text string")
    a, b = (sorted(map(repr, X.toxicity(d, labels).collect())) for d in (docs, docs.orderBy("text").repartition(5)))
    assert a == b and len(a) == len(rows)  # which text of a repeated id is learned from doesn't hang on the rows' order
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_one_oversized_row_does_not_end_the_sample(spark):
    rows = [(i, f"w{i} x") for i in range(40)]
    h = {r.doc_id: r.h for r in spark.range(40).selectExpr("id AS doc_id", "xxhash64(id, 8) AS h").collect()}
    first = min((i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1), key=h.get)
    rows[first] = (first, "y" * 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = X.learned_rows(docs, labels, max_bytes=1000)[0].collect()
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.t for r in got) == sorted(rows[i][1] for i in learned if i != first)
    with pytest.raises(ValueError, match="max_bytes"):
        X.learned_rows(docs, labels, max_bytes=1)
