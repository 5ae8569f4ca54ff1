import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from logtide.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pack(odd, odd_rows):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc if doc is not None else -1, piece, at, len(part), zlib.crc32(array("I", part).tobytes())))
    rows = packing.pack(odd, PATH).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit([r["length"] for r in rows], 2048)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            rooms.append(capacity - length)
        else:
            rooms.remove(fit)
            rooms.append(fit - length)
    return len(rooms)


def test_plan_equals_best_fit_over_single_pieces():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([7, 30, 100])
        lengths = [min(capacity, int(rng.expovariate(3 / capacity)) + 1) for _ in range(rng.randint(0, 400))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        placed, bins = packing.plan_best_fit(counts, capacity)
        assert bins == best_fit(lengths, capacity)
        ranks = defaultdict(list)
        for length, rank, *_ in placed:
            ranks[length].append(rank)
        assert all(sorted(r)[0] == 0 and len(set(r)) == len(r) for r in ranks.values())


def test_empty(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_chunks_keep_odd_blanks():
    own, whole = packing.ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in ("a b", "a\x1cb  c\r\nd", " é́ ´ ́x", "ΣΑΣ  İ", "it's 'S\t12.5%%%", "<|endoftext|> x<|endoftext|>y", " z", "\x85q"):
        got = array("I")
        got.frombytes(own.encode([text])[0])
        assert list(got) == whole.encode(text, add_special_tokens=False).ids, text
