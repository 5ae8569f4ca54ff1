import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Codec(PATH, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehinorst THE''stéß漢🎉 \n\t0123.,-_= \x00"), max_size=80) | st.text(max_size=40))
def test_same_ids_as_the_library(text):
    assert OWN.encode(text) == WHOLE.encode_ordinary(text)
    assert "".join(OWN.decode(OWN.encode(text), every=1)) == text


def test_long_pieces_and_forgetting(monkeypatch):
    rng = random.Random(1)
    texts = ["a" * 20_000, " " * 5000 + "x", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "=-" * 3000, "漢" * 3000]
    for text in texts:
        assert OWN.encode(text) == WHOLE.encode_ordinary(text)
    monkeypatch.setattr(bpe, "REMEMBERED_ARCS", 200)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 10)
    small = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for text in texts:
        assert small.encode(text) == WHOLE.encode_ordinary(text)
    words = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(80_000))
    assert small.encode(words) == WHOLE.encode_ordinary(words)


def test_stream_holds_back_unfinished_characters():
    data = "aé漢🎉".encode()
    for n in range(1, 5):
        stream = bpe.Utf8Stream()
        parts = [stream.feed(data[i : i + n]) for i in range(0, len(data), n)]
        assert "".join(parts) + stream.close() == "aé漢🎉"
        assert "�" not in "".join(parts)
    stream = bpe.Utf8Stream()
    assert stream.feed(b"x\xff\xe6\xbc") + stream.close() == "x��"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"\xe0\xa0", b"\xe0\x9f", b"\xed\xa0\x80", b"\xf0\x90", b"\xf4\x90", b"\xc0\xaf", "漢é🎉".encode()]), max_size=12))
def test_machine_replaces_as_the_standard_does(parts):
    stream = bpe.Utf8Stream()
    assert "".join(map(stream.feed, parts)) + stream.close() == b"".join(parts).decode("utf-8", "replace")


def test_round_trip(odd, odd_rows, empty):
    want = []
    for doc, text in odd_rows:
        ids = WHOLE.encode_ordinary(text or "")
        want.append((str(doc), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in bpe.round_trip(odd, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).collect() == []
