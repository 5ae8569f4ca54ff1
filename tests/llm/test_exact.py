import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from logtide.llm import exact


def expected(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not done, hashlib.sha256(text.encode()).hexdigest()))
            done |= i == keep
    return out


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


def test_against_brute_force(odd, odd_rows):
    for snapshot in (exact.older_half(odd), F.lit(False), F.lit(True), F.col("doc_id") % 3 == 0):
        got = [tuple(r) for r in exact.exact_dedup(odd, snapshot).collect()]
        assert sorted(got, key=key) == sorted(expected(odd_rows), key=key)


def test_empty_and_clashing_columns(empty, odd):
    assert exact.exact_dedup(empty, exact.older_half(empty)).collect() == []
    clash = odd.withColumn("keep_id", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("bucket", F.lit(None))
    assert exact.exact_dedup(clash, exact.older_half(clash)).count() == odd.count()


def test_keep_exact_keeps_one_row_of_each_text(odd, odd_rows):
    kept = exact.keep_exact(odd, exact.older_half(odd))
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in odd_rows})


def test_keep_exact_with_any_columns(odd):
    clash = odd.withColumn("id", F.create_map(F.lit("a"), F.lit(1))).withColumn("sha", F.lit("x")).withColumn("_keep_doc", F.lit(0))
    kept = exact.keep_exact(clash, F.lit(False))
    assert kept.columns == clash.columns and kept.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_stored_snapshot(spark, odd, odd_rows, tmp_path):
    folder = str(tmp_path / "snapshot")
    exact.store_snapshot(odd.filter("doc_id < 40"), folder)
    old = {t or "" for i, t in odd_rows if i is not None and i < 40}
    got = exact.known_texts(odd, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, t in odd_rows if (t or "") in old)


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 40_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        built = exact.FuseFilter.from_bytes(exact.FuseFilter.build(keys).to_bytes())
        assert built.contains(keys).all()
        others = rng.integers(0, 2**63, 20_000).astype(np.uint64)
        assert built.contains(others).mean() < 0.02
    assert len(exact.FuseFilter.build(keys).slots) < 1.6 * len(keys)
