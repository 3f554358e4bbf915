"""Quality classifier from weak labellers.

Eight overlapping heuristics look at a document's style and vote good, bad or
nothing. Expectation-maximisation over the counts of vote patterns, of all
documents, estimates how each heuristic votes on good and on bad documents
(no labels are used); a pattern then has a posterior probability of good. A
linear scorer over hashed word shapes is trained on the posteriors of a sample
of at most ``SAMPLE`` different rows (smallest hashes of id and text) and scores
every document whole; ``keep`` is a score of one half or more, and so is a tie.
Every statistic is taken over the whole text; short texts are drawn to a value
without a vote by ``SHRINK`` words, with no limit at which they are treated apart.

Sameness compares logarithms of the number of different words and of all words,
a ratio that falls slowly with the length of prose and fast where words repeat.

A shape is a word with runs of capitals, of other letters and of digits reduced
to A, a and 0; a word equal to the one before has a mark of its own.

Null and empty texts have no words: they get the scorer's value of an empty
text and no votes. Rows with equal ids are scored separately; only the named
columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .samples import sampled_texts
from .session import lean

SAMPLE = 12_000
DIMENSION_BITS = 16
#: Words added to every count's base, so that a text of a few words is not judged by one of them.
SHRINK = 10
#: Labeller: (statistic, bad at least or most, good at most or least); a statistic between votes nothing.
LABELLERS = [
    ("symbol_words", 0.20, 0.03),
    ("capitals", 0.35, 0.10),
    ("lone_symbols", 0.15, 0.02),
    ("repeats", 0.20, 0.05),
    ("sameness", 0.35, 0.25),
    ("symbols", 0.12, 0.06),
    ("shouts", 0.15, 0.03),
    ("no_short_words", 0.92, 0.80),
]
NAMES = [n for n, _, _ in LABELLERS]
#: Share that short texts are drawn to, by SHRINK words: between the two votes.
MIDDLE = {name: (bad + good) / 2 for name, bad, good in LABELLERS}

CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = CLASS[128:] = ord("a")
CLASS[65:91] = ord("A")
CLASS[48:58] = ord("0")
ASCII_SYMBOL = K.SYMBOL & ~K.SPACE & (np.arange(256) > 32) & (np.arange(256) < 127)
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
SMALL = np.zeros(256, dtype=bool)
SMALL[97:123] = True


class Style:
    """Word shapes and style statistics of packed texts."""

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(hashed shape of each word, first word of each document, {statistic: by document})."""
        starts, ends, first = K.word_spans(data, offsets)
        rows, n = len(offsets) - 1, np.maximum(1, np.diff(first))
        if not len(starts):
            return np.zeros(0, np.int64), first, {name: np.zeros(rows) for name in NAMES}
        hashes = K.span_names(K.LOWER[data], starts, ends)
        again = np.zeros(len(starts), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        inner = first[1:-1][first[1:-1] < len(again)]
        again[inner] = False
        classes = CLASS[data]
        turn = np.ones(len(data), bool)
        turn[1:] = classes[1:] != classes[:-1]
        turn[starts] = True
        rank = np.concatenate(([0], np.cumsum(turn)))
        shape = K.span_names(classes[turn], rank[starts], rank[ends])
        shape = np.where(again, np.uint64(12345), shape)
        symbol, capital = ASCII_SYMBOL[data], CAPITAL[data]
        count = lambda x: np.concatenate(([0], np.cumsum(x)))
        by_byte = lambda x: np.diff(count(x)[offsets])
        by_word = lambda x: K.sums(x, first) / (n + SHRINK)
        pairs = np.zeros(len(data), bool)
        pairs[1:] = symbol[1:] & symbol[:-1]
        tail, total = data[ends - 1], count(pairs)
        letters = by_byte(capital) + by_byte(SMALL[data])
        row = np.repeat(np.arange(rows), np.diff(first))
        kinds = np.bincount(_distinct_rows(row, hashes), minlength=rows)
        length = ends - starts
        stats = {
            "symbol_words": by_word(total[ends] - total[starts] > 0),
            "capitals": by_byte(capital) / (letters + 2 * SHRINK),
            "lone_symbols": by_word((length == 1) & symbol[starts]),
            "repeats": by_word(again),
            "sameness": 1 - np.log(kinds + SHRINK) / np.log(np.diff(first) + SHRINK),
            "symbols": by_byte(symbol) / (np.diff(offsets) + 4 * SHRINK),
            "shouts": by_word(tail == ord("!")),
            "no_short_words": (np.diff(first) - K.sums((length <= 3) & ~symbol[starts], first) + SHRINK * MIDDLE["no_short_words"]) / (n + SHRINK),
        }
        return (shape >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64), first, stats


def _distinct_rows(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The row of every distinct (row, hash)."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new]


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """0 bad, 1 good, 2 no vote, by document and labeller."""
    return np.stack([np.where(stats[name] >= bad, 0, np.where(stats[name] <= good, 1, 2)) for name, bad, good in LABELLERS], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good by pattern, share of good, how labellers vote by class) by expectation-maximisation."""
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == 0).any(axis=1), 0.2, 0.9)
    share, table = 0.8, None
    for _ in range(rounds):
        weight = np.stack((counts * (1 - good), counts * good))
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.stack([[[(weight[c] * (v[:, j] == k)).sum() + 0.5 for k in range(3)] for j in range(v.shape[1])] for c in range(2)])
        table /= table.sum(axis=2, keepdims=True)
        log = np.stack([np.log(table[c][np.arange(v.shape[1])[None, :], v]).sum(axis=1) for c in range(2)])
        log += np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good, share, table


def _patterns(batches):
    style, size = Style(), 3 ** len(LABELLERS)
    counts = np.zeros(size, np.int64)
    for batch in batches:
        data, offsets = K.packed(batch.column(0))
        for a, b in K.chunks(offsets):
            _, first, stats = style(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            has = np.diff(first) > 0
            counts += np.bincount(pattern(votes(stats))[has], minlength=size)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pattern", "n"])


def _sampled(batches):
    style = Style()
    for batch in batches:
        data, offsets = K.packed(batch.column(0))
        for a, b in K.chunks(offsets):
            shapes, first, stats = style(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = [np.unique(shapes[first[i] : first[i + 1]], return_counts=True) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pattern(votes(stats))), pa.array([x.astype(np.int32).tobytes() for x, _ in rows], pa.binary()), pa.array([(n / (n.sum() + SHRINK)).astype(np.float32).tobytes() for _, n in rows], pa.binary())],
                names=["pattern", "shapes", "shares"],
            )


def train_scorer(target: np.ndarray, shapes: list[np.ndarray], shares: list[np.ndarray], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights over hashed shapes, fitted to posteriors by Adam."""
    size = 1 << DIMENSION_BITS
    rows = np.repeat(np.arange(len(shapes)), [len(x) for x in shapes])
    flat, value = np.concatenate([*shapes, np.zeros(0, np.int32)]), np.concatenate([*shares, np.zeros(0, np.float32)]).astype(float)
    used, column = np.unique(flat, return_inverse=True)
    w, bias = np.zeros(len(used) + 1), np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)) if len(target) else 0.0
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1 if len(target) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, value * w[column], minlength=len(shapes)) + w[-1], -500, 500)))
        slope = np.append(np.bincount(column, value * (target - p)[rows], minlength=len(used)) - 0.002 * w[:-1], (target - p).sum()) / len(target)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(size)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def _scored(weights: np.ndarray, bias: float, posterior: np.ndarray):
    at, known = np.flatnonzero(weights), np.flatnonzero(~np.isnan(posterior))
    value, told = weights[at], posterior[known]

    def scan(batches):
        style, w, by_pattern = Style(), np.zeros(1 << DIMENSION_BITS), np.full(3 ** len(LABELLERS), np.nan)
        w[at], by_pattern[known] = value, told
        for batch in batches:
            data, offsets = K.packed(batch.column(1))
            score, label = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b in K.chunks(offsets):
                shapes, first, stats = style(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.maximum(1, np.diff(first))
                score[a:b] = 1 / (1 + np.exp(-np.clip(K.sums(w[shapes], first) / (n + SHRINK) + bias, -500, 500)))
                label[a:b] = np.where(np.diff(first) > 0, by_pattern[pattern(votes(stats))], np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(label, from_pandas=True), pa.array(score >= 0.5)], names=["id", "score", "label_posterior", "keep"])

    return scan


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(id, score, label_posterior, keep)`` for every row; label_posterior is null for texts without words."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    seen = texts.mapInArrow(lean(_patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()  # at most 3^8 rows
    patterns, counts = seen.column("pattern").to_numpy(), seen.column("n").to_numpy().astype(float)
    good, _, _ = label_model(patterns, counts)
    posterior = np.full(3 ** len(LABELLERS), np.nan)
    posterior[patterns] = good
    got = sampled_texts(docs, id, text, sample).where("trim(text) <> ''").select("text").mapInArrow(lean(_sampled), "pattern long, shapes binary, shares binary").toArrow()
    target = posterior[got.column("pattern").to_numpy()] if got.num_rows else np.zeros(0)
    fine = ~np.isnan(target)
    read = lambda name, kind: [np.frombuffer(x, kind) for x, ok in zip(got.column(name).to_pylist(), fine, strict=True) if ok]
    weights, bias = train_scorer(target[fine], read("shapes", np.int32), read("shares", np.float32))
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(lean(_scored(weights, bias, posterior)), f"id {kind}, score double, label_posterior double, keep boolean").withColumnRenamed("id", id)
