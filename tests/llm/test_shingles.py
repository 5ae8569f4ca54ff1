import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from logtide.llm import shingles

from .conftest import make
from .test_simhash import roots


def varied():
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(3000)
    line = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 45))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [f"{line} " + " ".join(word() for _ in range(30)) for _ in range(30)]
    star = [word() for _ in range(150)]
    for i in range(40):
        rows.append(" ".join([*star[: i % 7], word(), *star[i % 7 + 1 :]]))
    long = [word() for _ in range(2500)]
    rows += [" ".join([*long[:n], *(word() for _ in range(m))]) for n, m in ((2500, 0), (2400, 50), (2000, 100), (1200, 1300), (1250, 0))]
    rows += ["", " ", "One two THREE four five six", "one two three four five six"]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(5000, None)]


def expected(rows):
    sets = []
    for _, text in rows:
        own = (text or "").lower().split()
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    found = roots(range(len(rows)), links)
    return {rows[i][0]: rows[found[i]][0] for i in range(len(rows))}


def test_stage_against_brute_force(spark, monkeypatch):
    rows = varied()
    want = expected(rows)
    assert len(set(want.values())) < len(rows) - 30
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, make(spark, rows), "").collect()}
    assert kept == set(want.values())
    monkeypatch.setattr(shingles, "BLOCK", 4)
    monkeypatch.setattr(shingles, "COMMON", 0)
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_groups(make(spark, rows)).collect()} == want


def test_long_sketches_never_refuse_a_near_pair():
    rng = np.random.default_rng(4)
    for n in (500, 1025, 2000, 2049, 9000, 70_000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for other in (n, n * 9 // 10, n * 6 // 10, n // 10):
            for more in (0, n // 10, n):
                a, b = np.unique(base), np.unique(np.r_[base[:other], rng.integers(0, 1 << 63, more, np.uint64)])
                both = len(np.intersect1d(a, b))
                may = shingles.long_may_be_near(shingles.long_sketch(a), shingles.long_sketch(b), len(a) + len(b), shingles.SIMILARITY)
                assert may or both * 5 < 4 * (len(a) + len(b) - both)
                if min(len(a), len(b)) > shingles.SKETCH and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                    assert not may or both * 2 >= len(a) + len(b) - both


def test_odd_rows(odd, empty):
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns
    assert shingles.near_groups(odd).count() == odd.count()
    assert shingles.keep_one(empty).collect() == []
