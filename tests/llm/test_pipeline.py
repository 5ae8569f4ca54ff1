"""Every stage of the pipeline on odd rows, and the whole on a small corpus with planted copies and secrets."""

import random

import corpus_pipeline
import pytest
from logtide.llm import secrets

from .conftest import make
from .test_shingles import expected

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(rows, folder): good prose and shouting, exact and near copies, a secret, null and empty texts, a repeated row."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    rows, quality = [], []
    for i in range(0, 120):
        own = [word() for _ in range(rng.randint(40, 80))]
        good = i % 6 > 0
        rows.append((i, " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own)))
        quality.append((i, int(good), 0))
    near = rows[1][1].split()
    near[7] = "changed"
    rows += [(200, rows[2][1]), (201, rows[2][1]), (202, " ".join(near)), (203, rows[3][1] + " api_key = 'abcdefghijkl1234567'"), (204, None), (205, ""), (1, rows[1][1])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    make(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([q for q in quality if q[0] % 2 or q[0] % 12 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, folder


def test_the_whole(spark, corpus):
    rows, folder = corpus
    text = dict(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    good = [i for i, t in rows if t is None or not t or "!!" not in t]
    assert len(set(good) - set(kept[NAMES[0]])) <= 1 and len(set(kept[NAMES[0]]) - set(good)) <= 1
    last = {}
    for i in kept[NAMES[0]]:
        last[text[i] or ""] = max(i, last.get(text[i] or "", -1))
    assert kept[NAMES[1]] == sorted(last.values())
    assert kept[NAMES[2]] == sorted(set(expected([(i, text[i]) for i in kept[NAMES[1]]]).values()))
    assert 202 not in kept[NAMES[2]] or 1 not in kept[NAMES[2]]
    assert kept[NAMES[3]] == kept[NAMES[2]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all("abcdefghijkl1234567" not in (t or "") for t in texts.values())
    encode = secrets._encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN).encode_ordinary
    spans = lambda t: secrets.joined(secrets.base_spans(t) + secrets.random_spans(t, encode, secrets.base_spans(t), secrets.MAX_CHARS_PER_TOKEN))
    assert texts == {i: None if text[i] is None else secrets.redact(text[i], spans(text[i])) for i in texts}
    pieces = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(texts)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p["length"] for p in pieces)
    assert len(by) <= total // 2048 + 2


def test_stages_on_odd_rows(spark, corpus, odd, empty):
    _, folder = corpus
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.count() > 0, name
        if name != NAMES[-1]:
            assert out.columns == odd.columns
        assert stage(spark, empty, folder).collect() == [], name
