"""Hidden Markov language model over words.

Baum-Welch: every task runs scaled forward and backward recursions over its
texts and hands on expected counts, which are summed across tasks by symbol.
The most frequent words have emissions of their own in each state; a rarer word
is one of its class, by hash, times its share of the class from exact counts
over all training texts, so that the model is a distribution over all words,
unseen ones included. The numbers of head words and of classes both grow with
the square root of the vocabulary. The scaled forward recursion then gives the
exact likelihood of each whole text.

Training takes texts in windows of `STRETCH` words with `MARGIN` words of context
on either side: each symbol and each transition is counted once, in one window,
and starts are counted at starts of texts alone. Only what lies beyond the margin
is forgotten; a window inside a text begins from the steady state. Scoring cuts
nothing.

Defined results: a null text is the empty text, its one token the end; a null
id counts as the empty string when rows are split, and is held out; repeated
rows have equal results; other columns don't matter; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, runs
from .simhash import words

STATES, ROUNDS, STRETCH, MARGIN, LANES = 8, 4, 128, 8, 1024
#: Head words, and classes of the others, for each square root of the number of distinct words.
GROWTH = 16
SMOOTH = 0.1
#: Steps of the forward recursion between two scalings: no probability of a symbol is so low that so many of them underflow.
RESCALE = 8
#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 200_000
#: Characters of the texts that a task scores at once, but for single longer texts.
SCORED = 1_000_000


@dataclass
class Model:
    index: dict[bytes, int]  # head word -> symbol; classes and the end follow
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)
    classes: int = 1

    @property
    def head(self) -> int:
        return len(self.index)

    @property
    def end(self) -> int:
        return len(self.index) + self.classes

    def symbols(self, own: list[bytes]) -> np.ndarray:
        get, head, classes = self.index.get, self.head, self.classes
        out = np.fromiter((get(w, -1) for w in own), np.int32, len(own))
        for at in np.flatnonzero(out < 0).tolist():
            out[at] = head + crc32(own[at]) % classes
        return np.append(out, np.int32(self.end))

    def steady(self) -> np.ndarray:
        """The distribution over states far from a start."""
        out = self.start.astype(np.float64)
        for _ in range(64):
            out = out @ self.move
        return (out / out.sum()).astype(np.float32)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all words of texts, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def expected_counts(model: Model, lanes: np.ndarray, ends: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of windows: lanes (time, window) of symbols, ends: their lengths, longest first. What is in [low, high) is counted; low 0 is a start of a text."""
    steps, n = lanes.shape
    low, high = np.zeros(n, np.int64) if low is None else low, ends if high is None else high
    states = len(model.start)
    first = np.where((low == 0)[:, None], model.start, model.steady())
    counted = (np.arange(steps)[:, None] >= low) & (np.arange(steps)[:, None] < high)
    alpha = np.zeros((steps, n, states), np.float32)
    seen = model.emit[lanes]
    live = [int(np.searchsorted(-ends, -t)) for t in range(steps)]  # windows longer than t
    log10 = 0.0
    scale = np.ones((steps, n), np.float32)
    for t in range(steps):
        k = live[t]
        now = (first if t == 0 else alpha[t - 1, :k] @ model.move) * seen[t, :k]
        scale[t, :k] = now.sum(1)
        alpha[t, :k] = now / scale[t, :k, None]
        log10 += float(np.log10(scale[t, :k]) @ counted[t, :k])
    beta = np.ones((n, states), np.float32)
    gamma = np.zeros_like(alpha)
    move = np.zeros((states, states))
    k = live[-1]
    gamma[-1, :k] = alpha[-1, :k]
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        back = seen[t + 1, :k] * beta[:k] / scale[t + 1, :k, None]
        move += alpha[t, :k].T @ (back * counted[t + 1, :k, None])
        beta[:k] = back @ model.move.T
        own = live[t]
        gamma[t, :own] = alpha[t, :own] * beta[:own]
    flat, weight = lanes[counted], gamma[counted]
    emit = np.stack([np.bincount(flat, weights=weight[:, s], minlength=len(model.emit)) for s in range(states)], 1)
    return gamma[0, low == 0].sum(0, dtype=np.float64), move * model.move, emit, log10


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, ends, low, high) of many windows at once."""
    held: list[tuple[np.ndarray, int, int]] = []

    def lanes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = sorted(held, key=lambda w: -len(w[0]))
        ends = np.array([len(s) for s, _, _ in own])
        out = np.zeros((ends[0], len(own)), np.int32)
        for i, (s, _, _) in enumerate(own):
            out[: len(s), i] = s
        return out, ends, np.array([a for _, a, _ in own]), np.array([b for _, _, b in own])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            symbols = np.frombuffer(data, np.int32)
            for at in range(0, len(symbols), STRETCH):
                begin, until = max(0, at - MARGIN), min(len(symbols), at + STRETCH)
                held.append((symbols[begin : until + MARGIN], at - begin, until - begin))
                if len(held) == LANES:
                    yield lanes()
                    held = []
    if held:
        yield lanes()


def symbol_table(texts: DataFrame, model: Model) -> DataFrame:
    """(symbols): each text's symbols as 32-bit numbers; rounds differ in no index, so that one table serves all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.symbols(words(text)).tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["symbols"])

    return texts.select("text").mapInArrow(run, "symbols binary")


def train_round(texts: DataFrame, model: Model, symbols: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all texts. Each task sends at most a row for each symbol, and the driver gets as many. symbols: symbol_table() of texts, if it is at hand."""
    symbols = symbol_table(texts, model) if symbols is None else symbols
    states = len(model.start)
    fields = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, log10 = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), 0.0
        for window in _stretches(batches):
            a, b, c, d = expected_counts(model, *window)
            start, move, emit, log10 = start + a, move + b, emit + c, log10 + d
        all_rows = np.concatenate([emit, move, start[None], np.r_[log10, np.zeros(states - 1)][None]])
        at = np.flatnonzero(all_rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(all_rows[at, i]) for i in range(states))], names=["at", *fields])

    schema = "at long, " + ", ".join(f"{f} double" for f in fields)
    total = np.zeros((len(model.emit) + states + 2, states))
    for at, *values in symbols.mapInArrow(run, schema).groupBy("at").agg(*(F.sum(f) for f in fields)).collect():
        total[at] = values
    n = len(model.emit)
    return total[n + states], total[n : n + states], total[:n], float(total[n + states + 1, 0])


def first_model(head: list[tuple[bytes, int]], class_n: list[int], end_n: int, states: int) -> tuple[Model, np.ndarray]:
    """Word frequencies, disturbed by a hash in each state, and states that tend to stay."""
    from xxhash import xxh64_intdigest

    share = np.array([n for _, n in head] + [*class_n, end_n], np.float64) + SMOOTH
    share /= share.sum()
    names = [w for w, _ in head] + [b" %d" % i for i in range(len(class_n))]  # no word holds a blank
    noise = np.array([[xxh64_intdigest(w, s) / 2**64 for s in range(states)] for w in names] + [[0.5] * states])
    emit = share[:, None] * np.exp(2 * noise)
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1) if states > 1 else 1.0)
    index = {w: i for i, (w, _) in enumerate(head)}
    return Model(index, np.full(states, 1 / states, np.float32), (move / move.sum(1, keepdims=True)).astype(np.float32), (emit / emit.sum(0)).astype(np.float32), len(class_n)), share


def train(texts: DataFrame, head: list[tuple[bytes, int]], class_n: list[int], end_n: int, states: int = STATES, rounds: int = ROUNDS) -> Model:
    model, share = first_model(head, class_n, end_n, states)
    symbols = cut(symbol_table(texts, model), as_table=True)
    for _ in range(rounds):
        start, move, emit, _ = train_round(texts, model, symbols)
        emit = emit + share[:, None]
        model = Model(model.index, ((start + 1) / (start + 1).sum()).astype(np.float32), ((move + 1) / (move + 1).sum(1, keepdims=True)).astype(np.float32), (emit / emit.sum(0)).astype(np.float32), model.classes)
    return model


def forward_log10(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each whole symbol sequence, by the scaled forward recursion."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out = np.zeros(len(texts))
    move, start, emit = model.move.astype(np.float64), model.start.astype(np.float64), model.emit.astype(np.float64)
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        ends = np.array([len(texts[i]) for i in own])
        flat = np.concatenate([texts[i] for i in own])
        at = np.r_[0, np.cumsum(ends)[:-1]]
        total = np.zeros(len(own))
        alpha = emit[flat[at]] * start
        for t in range(1, ends[0]):
            if ends[len(alpha) - 1] <= t or t % RESCALE == 0:
                scale = alpha.sum(1)
                total[: len(alpha)] += np.log10(scale)
                alpha = (alpha / scale[:, None])[: int(np.searchsorted(-ends, -t))]
            alpha = alpha @ move
            alpha *= emit[flat[at[: len(alpha)] + t]]
        total[: len(alpha)] += np.log10(alpha.sum(1))
        out[own] = total
    return out


def _least_count(counts: DataFrame, n_words: int) -> int:
    """A count that at least n_words words reach, or all do: what sorts the head then gets little more than it."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # under 512 rows
    least, found = 0, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        least, found = row["least"], found + row["words"]
        if found >= n_words:
            break
    return least


@dataclass
class Fitted:
    """A trained model and what scores need beside it. counts: (word, n) of all training words."""

    model: Model
    counts: DataFrame
    head_n: np.ndarray  # counts of head words
    class_norm: np.ndarray  # log10 of a class' words, one place for all unseen ones among them, each smoothed
    train_tokens: int
    types: int
    end_n: int


def fit(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS, growth: float = GROWTH) -> Fitted:
    """The model of the training texts among texts (doc_id, text)."""
    training = texts.filter(~held_out())
    counts = cut(word_counts(training))
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end_n = training.count()
    size = max(1, int(np.ceil(growth * np.sqrt(n_types))))
    often = counts.filter(F.col("n") >= _least_count(counts, size))
    head = [(bytes(r["word"]), r["n"]) for r in often.orderBy(F.desc("n"), "word").limit(size).collect()]
    class_n, class_types = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at, n, types in counts.groupBy((F.crc32("word") % size).alias("class")).agg(F.sum("n"), F.count("*")).collect():  # a row for each class
        class_n[at], class_types[at] = n, types
    for word, n in head:
        class_n[crc32(word) % size] -= n
        class_types[crc32(word) % size] -= 1
    model = train(training, head, class_n.tolist(), end_n, states, rounds)
    return Fitted(model, counts, np.array([n for _, n in head], np.float64), np.log10(class_n + SMOOTH * (class_types + 1)), n_words + end_n, n_types + (end_n > 0), end_n)


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, growth: float = GROWTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    texts = id_and_text(docs, id_col, text_col)
    return score_with(fit(texts, states, rounds, growth), texts)


def score_with(fitted: Fitted, texts: DataFrame) -> DataFrame:
    model, end_n, class_norm, train_tokens = fitted.model, fitted.end_n, fitted.class_norm, fitted.train_tokens
    norm = np.log10(train_tokens + SMOOTH * (fitted.types + 1))
    # By symbol; a class has no count of its own, its words' follow by join.
    head_log = np.log10(np.concatenate([fitted.head_n, np.full(model.classes, 1 - SMOOTH), [end_n]]) + SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text, and one for each of its rare words. A text's row has a word that no text can hold: a blank and its id, or its text's key."""
        names = ["doc_id", "text_key", "word", "m", "n_tokens", "n_known", "base_score", "score"]
        types_ = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            symbols: list[np.ndarray] = []
            for group in runs(batch.column(1).to_pylist(), SCORED):
                cols: list[list] = [[], [], [], []]
                for text in group:
                    own, at = words(text), len(symbols)
                    symbols.append(sym := model.symbols(own))
                    rare = np.flatnonzero(sym[:-1] >= model.head).tolist()
                    if rare:
                        found = Counter([own[i] for i in rare])
                        n = len(found)
                        for col, x in zip(cols, ([ids[at]] * n, [keys[at]] * n, found.keys(), found.values()), strict=True):
                            col.extend(x)
                n = len(cols[0])
                if n:
                    none = [pa.array(np.zeros(n, kind)) for kind in (np.int64, np.int64, np.float64, np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types_, strict=False)] + none, names=names)
            classes = [sym[:-1][sym[:-1] >= model.head] - model.head for sym in symbols]
            marks = [b" %d" % doc if doc is not None else b" n%d" % key for doc, key in zip(ids, keys, strict=True)]
            base = [head_log[sym].sum() - norm * len(sym) for sym in symbols]
            whole = [f - class_norm[c].sum() for f, c in zip(forward_log10(model, symbols).tolist(), classes, strict=True)]
            cols = [ids, keys, marks, [1] * len(ids), [len(sym) for sym in symbols], [len(sym) - len(c) - (end_n == 0) for sym, c in zip(symbols, classes, strict=True)], base, whole]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types_, strict=True)], names=names)

    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    parts = keyed.mapInArrow(run, "doc_id long, text_key long, word binary, m long, n_tokens long, n_known long, base_score double, score double")
    # A word is one row of counts, so that a partition of them is small: no side need be sorted.
    joined = parts.join(fitted.counts.hint("shuffle_hash"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    is_text = F.col("n_tokens") > 0
    rare_log = F.when(is_text, 0.0).otherwise(F.col("m") * F.log10(c + SMOOTH))
    summed = joined.groupBy("doc_id", "text_key").agg(
        F.sum(is_text.cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_text, F.col("n_known")).otherwise(F.when(c > 0, F.col("m")).otherwise(0))).alias("n_known"),
        F.sum(F.col("base_score") + rare_log).alias("base_score"),
        F.sum(F.col("score") + rare_log).alias("score"),
    )
    # Rows that repeat id and text were summed together.
    each = summed.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
    whole = lambda name: F.expr(f"{name} div copies").alias(name)
    return each.select("doc_id", held_out().alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
