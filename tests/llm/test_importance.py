import random

import numpy as np
from pyspark.sql import functions as F

from logtide.llm import importance

from .conftest import make


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("etaoinshr") for _ in range(k))
    rows, quality = [], []
    for i in range(n):
        good = rng.random() < 0.8
        own = [word(rng.randint(2, 7)) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own)))
        quality.append((i, int(good), 0))
    return rows, quality


def test_held_out_accuracy(spark, odd_rows):
    rows, quality = corpus()
    labels = spark.createDataFrame([q for q in quality if q[0] % 2], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (None, "some words here"), (3, rows[3][1])]
    got = importance.select(make(spark, rows + extra).withColumn("key", F.lit("x")), labels).collect()
    assert len(got) == len(rows) + len(extra)
    kept = {r["doc_id"]: r["kept"] for r in got}
    unseen = [q for q in quality if not q[0] % 2]
    assert all(kept[i] for i, good, _ in unseen if good)
    assert sum(kept[i] for i, good, _ in unseen if not good) <= 1
    assert kept[1000] and kept[1001]
    stay = importance.keep_selected(make(spark, rows), labels)
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in stay.collect()} == {i for i, _ in rows if kept[i]}


def test_noise_draws_in_proportion():
    weights = np.array([1.0, 2.0, 5.0])
    wins = np.zeros(3)
    for seed in range(20_000):
        wins[np.argmax(np.log(weights) + importance.gumbel(np.arange(3), seed))] += 1
    assert np.allclose(wins / wins.sum(), weights / weights.sum(), atol=0.015)


def test_the_draw_follows_seed_and_weights(spark):
    rng = random.Random(3)
    one = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(20)]
    other = [w.upper() for w in one]
    rows = [(i, " ".join(rng.choice(one if rng.random() < 0.3 + 0.4 * (i % 10) / 9 else other) for _ in range(6))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 > 4), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows).cache()
    drawn, weight = [], {}
    for seed in (1, 2, 3):
        got = importance.select(docs, labels, buckets=512, seed=seed, k=150).collect()
        drawn.append({r["doc_id"] for r in got if r["kept"]})
        weight = {r["doc_id"]: r["relative_log_weight"] for r in got}
    assert drawn[0] != drawn[1] != drawn[2] and all(len(d) >= 150 for d in drawn)
    order = sorted(weight, key=weight.get)
    rate = [sum(i in d for d in drawn for i in order[part * 100 : part * 100 + 100]) for part in range(4)]
    assert rate == sorted(rate) and rate[0] < rate[3] // 2
    plain = {r["doc_id"] for r in importance.select(docs, labels, buckets=512, temperature=0.0, k=150).collect() if r["kept"]}
    assert plain >= set(order[-150:]) - {i for i in order if weight[i] == weight[order[-150]]}


def test_without_labels_and_empty(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert importance.select(odd, labels).count() == len(odd_rows)
    assert importance.select(empty, labels).collect() == []


def test_kth_largest(spark):
    rng = random.Random(4)
    keys = [rng.choice([rng.randint(-(10**12), 10**12), 7, 8]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 250, 499, 500):
        assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_split_point():
    assert 0.2 < importance.split_point(np.array([0.1, 0.9, 0.3, -0.5, 0.2]), np.array([False, True, True, False, False])) < 0.3
