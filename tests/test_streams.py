"""Batches by span and the stream guard against brute force."""

import random

import pytest

from logtide import catalogue
from logtide.streaming import pipeline

from .test_queries import SF_DIR


def test_all_commits_are_batched_by_span(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select("event_id").collect()
    commits = sorted({(e // 8 + 1) * 4096 for (e,) in events if (e // 8) % 17})
    want, base, batch = {}, None, -1
    for at in commits:
        if base is None or at - base >= 65_536:
            base, batch = at, batch + 1
        want[at] = batch
    assert commits[-1] > 400_000
    assert {r["commit_lsn"]: r["batch"] for r in catalogue.QUERIES["batch_by_span"](spark, SF_DIR).collect()} == want


def test_open_streams_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows, open_, want = [], set(), []
    for seq in range(400):
        kind, xid = rng.choice(["start", "start", "commit", "abort", "row"]), rng.randrange(12)
        subxid = rng.choice([None, xid, xid + 100]) if kind == "abort" else None
        rows.append((seq, kind, xid if kind != "row" else None, subxid))
        if kind == "start":
            open_.add(xid)
        elif kind == "commit" or kind == "abort" and subxid in (None, xid):
            open_.discard(xid)
        want.append((seq, len(open_), len(open_) > 5))
    frames = spark.createDataFrame(rows, "seq long, kind string, xid long, subxid long")
    monkeypatch.setattr(pipeline, "POSITIONS", 7)
    assert sorted(map(tuple, pipeline.open_streams(frames, 5).collect())) == want
    most = max(n for _, n, _ in want)
    pipeline.guard_streams(frames, most)
    with pytest.raises(RuntimeError, match="^too_many_streams$"):
        pipeline.guard_streams(frames, most - 1)


def test_all_events_go_through_the_guard(spark):
    n = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert n > 300 and catalogue.QUERIES["too_many_streams"](spark, SF_DIR).count() == n
