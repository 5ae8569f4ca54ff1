"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the merge result of its bytes exactly when each pair of
neighbours is: merging the bytes of the two gives the two back. So the merges
are a non-deterministic transducer that reads bytes along the vocabulary's trie
and, at the end of a token that may follow the last one, may start the next. A
deterministic state is the set of such readings with the tokens on which they
still differ; what all agree on is emitted. No reading is longer than the
longest token, which bounds the lookahead. States and arcs are made on demand
and remembered.

Decoding is streamed: ids go through a UTF-8 state machine that hands out whole
characters and holds back an unfinished one.

Defined results: a null text is the empty text, with no ids; a null id stays
null; a long text is split where no piece crosses; repeated rows give repeated
results; other columns, whatever their names, don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, only

#: Arcs, pairs and pieces that a worker remembers at most.
REMEMBERED_ARCS, REMEMBERED_PAIRS, REMEMBERED_PIECES = 500_000, 500_000, 300_000
ROOT = 0


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of least rank, leftmost first, until none joins."""
    parts = [data[i : i + 1] for i in range(len(data))]
    never = 1 << 60
    joins = [ranks.get(data[i : i + 2], never) for i in range(len(data) - 1)]
    while joins and (best := min(joins)) != never:
        at = joins.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del joins[at]
        if at:
            joins[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        if at < len(joins):
            joins[at] = ranks.get(parts[at] + parts[at + 1], never)
    return [ranks[p] for p in parts]


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._child: dict[int, int] = {}  # node * 256 + byte -> node
        self._token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                node = self._child.setdefault(node << 8 | byte, len(self._child) + 1)
            self._token_at[node] = rank
        self._pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = (((), -1, ROOT),)
        self._states: list[tuple] = [start]  # readings: (tokens not yet agreed on, last token, trie node)
        self._number: dict[tuple, int] = {start: 0}
        self._arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _may_follow(self, last: int, token: int) -> bool:
        pair = last, token
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            if last < 0:
                known = merge(self.tokens[token], self.ranks) == [token]
            elif self.ranks.get(self.tokens[last] + self.tokens[token]) is not None and self._may_follow(-1, self.ranks[self.tokens[last] + self.tokens[token]]):
                known = False  # the two merge into one
            else:
                known = self._may_follow(-1, token) and merge(self.tokens[last] + self.tokens[token], self.ranks) == [last, token]
            self._pairs[pair] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        readings = []
        for held, last, node in self._states[state]:
            node = self._child.get(node << 8 | byte)
            if node is None:
                continue
            token = self._token_at.get(node)
            readings.append((held, last, node))
            if token is not None and self._may_follow(last, token):
                readings.append(((*held, token), token, ROOT))
        agreed = 0
        least = min(len(held) for held, _, _ in readings)
        while agreed < least and len({held[agreed] for held, _, _ in readings}) == 1:
            agreed += 1
        emitted = readings[0][0][:agreed]
        to = tuple((held[agreed:], last, node) for held, last, node in readings)
        if to not in self._number:
            self._number[to] = len(self._states)
            self._states.append(to)
        return self._number[to], emitted

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern. A piece that is itself a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self._arcs) > REMEMBERED_ARCS:
            self._forget()
        out: list[int] = []
        state, arcs = 0, self._arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = arcs[state << 8 | byte] = self._step(state, byte)
                if len(arcs) > 2 * REMEMBERED_ARCS:  # within one very long piece
                    here = self._states[arc[0]]
                    self._forget()
                    arcs = self._arcs
                    self._number[here] = len(self._states)
                    self._states.append(here)
                    arc = self._number[here], arc[1]
            state = arc[0]
            if arc[1]:
                out += arc[1]
        for held, _, node in self._states[state]:
            if node == ROOT:
                return [*out, *held]
        raise ValueError("a byte is no token of the vocabulary")


#: The UTF-8 machine: for each state the bytes (first, last) that lead on and the state they lead to. Fixed values, as in the Unicode standard's table of well-formed sequences.
STEPS = {
    "start": [(0x00, 0x7F, "start"), (0xC2, 0xDF, "one more"), (0xE0, 0xE0, "after E0"), (0xE1, 0xEC, "two more"), (0xED, 0xED, "after ED"), (0xEE, 0xEF, "two more"), (0xF0, 0xF0, "after F0"), (0xF1, 0xF3, "three more"), (0xF4, 0xF4, "after F4")],
    "one more": [(0x80, 0xBF, "start")],
    "two more": [(0x80, 0xBF, "one more")],
    "three more": [(0x80, 0xBF, "two more")],
    "after E0": [(0xA0, 0xBF, "one more")],
    "after ED": [(0x80, 0x9F, "one more")],
    "after F0": [(0x90, 0xBF, "two more")],
    "after F4": [(0x80, 0x8F, "two more")],
}
START, REFUSED = 0, -1


def _machine() -> list[list[int]]:
    """For each state, by number, the next one for each byte."""
    number = {name: i for i, name in enumerate(STEPS)}
    table = []
    for ranges in STEPS.values():
        own = [REFUSED] * 256
        for first, last, name in ranges:
            own[first : last + 1] = [number[name]] * (last + 1 - first)
        table.append(own)
    return table


class Utf8Stream:
    """Incremental UTF-8 state machine over token bytes.

    feed() returns the characters completed so far; of an unfinished one the
    state and the bits read are held. A byte that can't go on a character ends
    it as U+FFFD and is read again from the start; one that can't begin a
    character is U+FFFD. ASCII leads from the start to the start, so that its
    stretches pass at once.
    """

    NEXT = _machine()
    OTHERS = re.compile(rb"[\x80-\xff]+")

    def __init__(self) -> None:
        self._state = START
        self._bits = 0

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        for stretch in self.OTHERS.finditer(data):
            if stretch.start() > at:
                out += self._broken(), data[at : stretch.start()].decode("ascii")
            self._walk(stretch[0], out)
            at = stretch.end()
        if at < len(data):
            out += self._broken(), data[at:].decode("ascii")
        return "".join(out)

    def close(self) -> str:
        return self._broken()

    def _broken(self) -> str:
        """What is left of an unfinished character, which ends here."""
        held, self._state = self._state != START, START
        return "\ufffd" if held else ""

    def _walk(self, data: bytes, out: list[str]) -> None:
        state, bits, table = self._state, self._bits, self.NEXT
        for byte in data:
            after = table[state][byte]
            if after == REFUSED and state != START:
                out.append("\ufffd")
                state = START
                after = table[state][byte]
            if after == REFUSED:
                out.append("\ufffd")
            elif state == START:  # a lead byte: its bits below the zero that ends its length
                bits = byte & (0x1F if byte < 0xE0 else 0x0F if byte < 0xF0 else 0x07)
                state = after
            else:
                bits = bits << 6 | byte & 0x3F
                state = after
                if state == START:
                    out.append(chr(bits))
        self._state, self._bits = state, bits


class Codec:
    """Encoding and decoding of whole texts, with the ids of frequent pieces remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        self._split = regex.compile(pattern).findall
        self.machine = MergeTransducer(load_ranks(path))
        most = max(self.machine.tokens) + 1
        self._bytes = [self.machine.tokens.get(i, b"") for i in range(most)]
        self.names = [str(i) for i in range(most)]
        # Two generations: when the young one is full it becomes the old one, and what is used again moves back.
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for at, end in self._stretches(text):
            pieces = self._split(text, at, end)
            known, old = self._young, self._old
            for piece in set(pieces).difference(known):
                found = old.get(piece)
                known[piece] = tuple(self.machine.encode_piece(piece.encode())) if found is None else found
            out += chain.from_iterable(map(known.__getitem__, pieces))
            if len(known) > REMEMBERED_PIECES:
                self._young, self._old = {}, known
        return out

    @staticmethod
    def _stretches(text: str, size: int = 200_000) -> Iterator[tuple[int, int]]:
        """Ranges of a long text that end right before a blank that follows a non-blank: no piece crosses one."""
        at = 0
        while len(text) - at > size:
            end = at + size
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            yield at, end
            at = end
        yield at, len(text)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode(self, ids: list[int], every: int = 4096) -> Iterator[str]:
        """Characters of the ids, a few thousand ids at a time."""
        stream = Utf8Stream()
        for at in range(0, len(ids), every):
            yield stream.feed(self.decode_bytes(ids[at : at + every]))
        yield stream.close()


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only(Codec, vocabulary, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                encoded.append(sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                back = sha256()
                for part in own.decode(ids):
                    back.update(part.encode())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
