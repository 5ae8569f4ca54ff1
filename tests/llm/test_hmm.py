import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from logtide.llm import hmm

from .conftest import make


def model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: (x / x.sum(axis, keepdims=True)).astype(np.float32)
    return hmm.Model({bytes([97 + i]): i for i in range(symbols - 2)}, norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def test_forward_is_exact():
    m = model()
    texts = [np.array(t) for t in ([0, 1, 2, 4], [3, 4], [4], [1, 1, 0, 3, 2, 4])]
    got = hmm.forward_log10(m, texts)
    for text, log in zip(texts, got, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = m.start[path[0]] * m.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= m.move[path[t - 1], path[t]] * m.emit[text[t], path[t]]
            total += p
        assert math.isclose(log, math.log10(total), rel_tol=1e-5)


def test_expected_counts_are_those_of_all_paths():
    m = model(2)
    texts = [np.array([0, 1, 2, 4]), np.array([3, 4]), np.array([4])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for text in texts:
        paths = {}
        for path in itertools.product(range(2), repeat=len(text)):
            p = m.start[path[0]] * m.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= m.move[path[t - 1], path[t]] * m.emit[text[t], path[t]]
            paths[path] = p
        for path, p in paths.items():
            p /= sum(paths.values())
            start[path[0]] += p
            for t in range(len(text)):
                emit[text[t], path[t]] += p
                if t:
                    move[path[t - 1], path[t]] += p
    lanes, ends = np.zeros((4, 3), np.int32), np.array([4, 2, 1])
    for i, text in enumerate(texts):
        lanes[: len(text), i] = text
    got = hmm.expected_counts(m, lanes, ends)
    assert np.allclose(got[0], start, atol=1e-4) and np.allclose(got[1], move, atol=1e-4) and np.allclose(got[2], emit, atol=1e-4)


def test_rounds_raise_the_likelihood(spark, odd):
    texts = odd.select("doc_id", "text").na.fill("")
    counts = {bytes(r["word"]): r["n"] for r in hmm.word_counts(texts).collect()}
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]
    logs = []
    rare = sum(counts.values()) - sum(n for _, n in head)
    for rounds in range(4):
        m = hmm.train(texts, head, [rare // 2, rare - rare // 2], texts.count(), 3, rounds)
        logs.append(hmm.train_round(texts, m)[3])
        assert np.allclose(m.emit.sum(0), 1, atol=1e-3)
    assert logs[0] < logs[1] < logs[2] < logs[3]


def test_windows_count_everything_once(monkeypatch):
    rng = np.random.default_rng(2)
    m = model(3, 6, 3)
    text = np.append(rng.integers(0, 5, 400), 5).astype(np.int32)
    m.emit = m.emit / m.emit.sum(0)
    whole = hmm.expected_counts(m, text[:, None], np.array([len(text)]))
    batch = pa.RecordBatch.from_arrays([pa.array([text.tobytes()], pa.binary())], names=["symbols"])
    monkeypatch.setattr(hmm, "STRETCH", 50)
    monkeypatch.setattr(hmm, "MARGIN", 20)
    parts = [hmm.expected_counts(m, *w) for w in hmm._stretches(iter([batch]))]
    for i in range(3):
        got = sum(p[i] for p in parts)
        assert np.isclose(got.sum(), whole[i].sum(), rtol=1e-3) and np.allclose(got, whole[i], atol=0.05)
    assert math.isclose(sum(p[3] for p in parts), whole[3], rel_tol=1e-3)


def brute_log10(fitted, train, own):
    """The forward recursion word by word, with each word's own probability."""
    m = fitted.model
    size = m.classes
    rest = Counter()
    kinds = Counter()
    for w, n in train.items():
        if w is not None and w not in m.index:
            rest[zlib.crc32(w) % size] += n
            kinds[zlib.crc32(w) % size] += 1
    state, log = None, 0.0
    for w in [*own, None]:
        if w is None:
            p = m.emit[m.end]
        elif w in m.index:
            p = m.emit[m.index[w]]
        else:
            at = zlib.crc32(w) % size
            p = m.emit[m.head + at].astype(float) * (train[w] + 0.1) / (rest[at] + 0.1 * (kinds[at] + 1))
        state = p.astype(float) * (m.start if state is None else state @ m.move.astype(float))
        log += math.log10(state.sum())
        state = state / state.sum()
    return log


def test_score_against_brute_force(spark, odd, odd_rows, empty, monkeypatch):
    lower = lambda t: (t or "").encode().translate(hmm.words.__globals__["LOWER"]).split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = Counter()
    for i, t in odd_rows:
        if not held(i):
            train.update([*lower(t), None])
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in odd_rows:
        own = [*lower(t), None]
        want.append((str(i), held(i), len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    fitted = hmm.fit(hmm.id_and_text(odd), growth=2)
    assert fitted.model.head == fitted.model.classes < v and fitted.class_norm.shape == (fitted.model.classes,)
    got = sorted(((str(r[0]), *r[1:]) for r in hmm.score_with(fitted, hmm.id_and_text(odd)).collect()), key=lambda r: (*r[:4], r[5]))
    want = [(*w, brute_log10(fitted, train, lower(t))) for w, (_, t) in zip(want, odd_rows, strict=True)]
    for a, b in zip(got, sorted(want, key=lambda r: (*r[:4], r[5])), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=1e-6)
    assert hmm.score(empty).collect() == []
    assert sum(r[6] for r in got) > sum(r[5] for r in got)
    lone = hmm.score(make(spark, [(None, "never trained")])).collect()
    assert lone[0]["train_tokens"] == 0 and lone[0]["n_known"] == 0 and lone[0]["n_tokens"] == 3
