from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from logtide.llm import simhash
from logtide.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_groups_against_brute_force(odd, odd_rows, empty):
    fps = [slow_fingerprint(t or "") for _, t in odd_rows]
    found = roots(range(len(fps)), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = defaultdict(list)
    for i, (doc, _) in enumerate(odd_rows):
        least[found[i]].append(doc)
    want = [(str(doc), f"{fps[i]:016x}", min((d for d in least[found[i]] if d is not None), default=None)) for i, (doc, _) in enumerate(odd_rows)]
    got = [(str(r[0]), r[1], r[2]) for r in simhash.near_groups(odd.withColumn("fp", F.lit("x"))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_groups(empty).collect() == []


def test_links_of_random_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**63, 60).astype(np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for c in own for _ in range(4)]
    dense = [own[0] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in combinations(range(20), 2)]
    fps = np.unique(np.array([*own, *near, *dense], np.uint64))
    want = roots(fps.tolist(), [(int(a), int(b)) for a, b in combinations(fps, 2) if (int(a) ^ int(b)).bit_count() <= 3])
    monkeypatch.setattr(simhash, "BLOCK", 16)
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = [(r[0] & (2**64 - 1), r[1] & (2**64 - 1)) for r in simhash.near_links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert roots(fps.tolist(), links) == want
    assert len(links) < 40 * len(fps)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 130), (130, 129)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 3 in ids and 103 not in ids and 104 not in ids
