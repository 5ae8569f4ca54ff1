"""Secret scan with a token-efficiency test.

Three fixed patterns give the base spans. The method adds spans of kind
`random`: a run of key characters whose characters-per-token ratio under a
byte-level vocabulary is low, which words, names and paths never have. Digests
of known lengths, UUIDs and identifiers are excluded; that the letters of an
identifier are words is decided by the same ratio.

A span is the whole match, in code points, end exclusive. Defined results: a
null text is the empty text and has no spans; a null id stays null; texts of any
length are scanned whole; repeated rows give repeated results; other columns,
whatever their names, don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as the matches of [0-9a-f]+ are
#: A run of key characters long enough to judge by its tokens.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"[0-9A-Fa-f]+")
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
WORDLIKE = re.compile(r"([A-Za-z]*)|[0-9]*|([A-Za-z]{2,})[0-9]{1,4}")
#: Characters a token: English prose has over 4, base64 of random bytes about 1.4.
MAX_CHARS_PER_TOKEN = 2.0
FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_word(letters: str, encode, max_ratio: float) -> bool:
    """Whether letters are one token, or few enough for their number."""
    n = len(encode(letters))
    return n <= 1 or len(letters) / n >= max_ratio


def is_known(run: str, encode, max_ratio: float) -> bool:
    """Whether a run is a digest of a usual length, a UUID, or an identifier, path or number made of word-like parts."""
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True
    parts = [WORDLIKE.fullmatch(part) for part in re.split(r"[+/_=-]", run)]
    return all(parts) and all(is_word(m[1] or m[2] or "", encode, max_ratio) for m in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encode, base: list[tuple[int, int, int]], max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs that fail the token-efficiency test and that no base span holds already."""
    found = []
    for m in RUN.finditer(text):
        run = m.group()
        if run.isdigit():
            continue
        if any(start <= m.start() and m.end() <= end for start, _, end in base):
            continue
        if len(run) / max(1, len(encode(run))) < max_ratio and not is_known(run, encode, max_ratio):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float = MAX_CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans; one row for each row of docs. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                kinds = [kind for _, kind, _ in base]
                spans = base + random_spans(text, encode, base, max_ratio)
                out.append((*map(kinds.count, (0, 1, 2)), sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, FIELDS)


def redact(text: str | None, spans: str | None, mark: str = "[SECRET]") -> str | None:
    """text with each maximal stretch of its spans replaced by mark."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, end in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, vocabulary: str, pattern: str, max_ratio: float = MAX_CHARS_PER_TOKEN, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in its texts replaced; other columns and rows stay as they are, null texts null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                out.append(redact(text, joined(base + random_spans(text or "", encode, base, max_ratio)), mark))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
