"""Language-model scores by a weighted backoff automaton.

Tokens are words (runs of bytes outside space and \\x09-\\x0D, A-Z lower-cased)
and one end for each document. The model is an n-gram model of ``ORDER`` (three)
over every training document, smoothed order by order with a Dirichlet prior of
strength m: ``p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m)``, h' being h without its
first word, down to ``p(w) = (c(w) + 1/2) / (N + (V + 1)/2)`` with one share for all
unseen words.

Automaton. A state for the empty history, for each word seen in training, for
the start of a document, and for each longer n-gram seen, up to ORDER - 1 words. A
state has an arc for each word that was seen after it, weighted log10 p(w|h), to
the state of the longest seen end of hw, and a failure arc, weighted
log10(m / (c(h) + m)), to the state of h'. The empty history has arcs for all
words, unseen ones leading back to it. A text is read from left to right: a word
takes its arc or follows failure arcs until a state has one; the weights add up
to log10 of the text's probability. The state after a word depends on the last
words only (the longest end that is a state), so all tokens of a block are read
at once, failure arc by failure arc; tests hold this against a reader that
carries one state along a text.

The model grows with the corpus and is never gathered in one place. Documents
are packed into blocks; each block asks, shard by shard of the n-gram names,
for the n-grams that it holds, adding its own training counts; a shard sums the
counts of all blocks and answers each with just what it asked; a block gets its
part of the automaton and is read. There are as many shards as keep about
``SHARD_KEYS`` n-grams in each, by the number of tokens. N and V are two numbers
for each shard.

Words are told apart by 64-bit names, longer n-grams by as many bits as keep the
chance that one shares its counts with another below 2^-``SPARE``, by the number
of tokens (``LEAST_BITS`` at least; 64 bits are reached at 2^44 tokens).

A null text is empty and has the end only. A document with a null id trains and
is not held out. Rows with equal ids are separate documents with one common
side. Without training documents all words are unseen. Only the named columns
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import cut, lean

U = np.uint64
#: Words of the longest n-grams, and prior strength m of each order from two on, in observations.
ORDER, STRENGTH = 3, (500.0, 10.0)
FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a block, and n-grams asked of a shard.
BLOCK_BYTES, SHARD_KEYS = 8 << 20, 4 << 20
#: Bits of a name beyond those that number the tokens, and the fewest.
SPARE, LEAST_BITS = 20, 48
END, START = U(0x0123456789ABCDEF), U(0x0FEDCBA987654321)


def squeeze(x: np.ndarray, level: int = 1) -> bytes:
    """64-bit integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True)


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T).view(U).ravel()


def held_out(id) -> bool:
    return id is not None and zlib.crc32(str(id).encode()) % FOLDS == HELD_OUT


def token_stream(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents with an end after each; where each document begins, one more at the end."""
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def longer(shorter: np.ndarray, tokens: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """Names of the n-grams of ``order`` that end in each token, from the names of those one word shorter.

    A document's first token follows the start; n-grams that would begin before it are 0.
    """
    before = np.empty_like(shorter)
    before[1:] = shorter[:-1]
    if order == 2:
        before[begin[:-1]] = START
    out = K.mix(K.mix(before + U(order)) ^ tokens)
    for i in range(order - 2):  # a document of one token has no place for them
        at = begin[:-1] + i
        out[at[at < begin[1:]]] = 0
    return out


def _pack(batches):
    words, at, seq = K.Words(), TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        data, offsets = K.packed(batch.column(1))
        ids = batch.column(0)
        for a, b in K.chunks(offsets, BLOCK_BYTES):
            streams, lengths = [], []
            for c, d in K.chunks(offsets[a : b + 1] - offsets[a]):
                lo = offsets[a + c]
                hashes, first = words(data[lo : offsets[a + d]], offsets[a + c : a + d + 1] - lo)
                tokens, begin = token_stream(hashes, first)
                streams.append(tokens)
                lengths.append(np.diff(begin))
            distinct, stream = np.unique(np.concatenate(streams), return_inverse=True)
            # words by falling frequency, those of one frequency by name: that makes both the stream and the names small
            order = np.argsort(-np.bincount(stream), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            distinct, stream = distinct[order], place[stream]
            held = [held_out(i) for i in ids.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at + seq], pa.int64()), pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([squeeze(np.diff(distinct, prepend=U(0)))], pa.binary()), pa.array([len(distinct)], pa.int64()), pa.array([squeeze(stream, 6)], pa.binary()), pa.array([len(stream)], pa.int64()),
                ],
                names=BLOCK_NAMES,
            )
            seq += 1


BLOCK = "block long, ids array<long>, lengths array<long>, held array<boolean>, words binary, n_words long, stream binary, n_tokens long"
BLOCK_NAMES = ["block", "ids", "lengths", "held", "words", "n_words", "stream", "n_tokens"]


class Block:
    """Tokens of one packed block, and its n-grams: for each order the distinct names and each token's place among them."""

    def __init__(self, row: dict, order: int, bits: int) -> None:
        self.ids, self.held = row["ids"], np.array(row["held"], dtype=bool)
        lengths = np.array(row["lengths"], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        words = np.cumsum(unsqueeze(row["words"], row["n_words"]), dtype=U)  # differences wrap where a lower frequency begins
        by_name = np.argsort(words)
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        words, stream = words[by_name], place[unsqueeze(row["stream"], int(self.begin[-1])).astype(np.int64)]
        self.document = np.repeat(np.arange(len(lengths)), lengths)
        self.names, self.grams = [words], [stream]
        tokens = name = words[stream]
        for n in range(2, order + 1):
            name = longer(name, tokens, self.begin, n)
            distinct, place = np.unique(name >> U(64 - bits), return_inverse=True)
            self.names.append(distinct)
            self.grams.append(place)

    def asked(self, orders):
        """(order from 0, names in ascending order, training counts)."""
        trained = ~self.held[self.document]
        for n in orders:
            yield n, self.names[n], np.bincount(self.grams[n], trained, len(self.names[n])).astype(U)


def shard_bounds(shards: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // shards for i in range(1, shards)], dtype=U)


def _ask(shards: int, orders, bits: int):
    bounds = shard_bounds(shards, 64 if 0 in orders else bits)  # words are told apart by all 64 bits

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, max(orders) + 1, bits)
                for kind, keys, counts in block.asked(orders):
                    edge = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
                    some = [s for s in range(shards) if edge[s + 1] > edge[s]]
                    part = [slice(edge[s], edge[s + 1]) for s in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([p.stop - p.start for p in part], pa.int64()),
                         pa.array([squeeze(np.diff(keys[p], prepend=U(0))) for p in part], pa.binary()), pa.array([squeeze(counts[p]) for p in part], pa.binary())],
                        names=["shard", "kind", "block", "n", "keys", "counts"],
                    )

    return scan


ANSWER = "shard int, kind int, block long, n long, counts binary, total long, distinct long"


def _answer(table: pa.Table) -> pa.Table:
    """Sums the counts of a shard over all blocks; each block gets those that it asked for, in its order."""
    n = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(unsqueeze(k, m), dtype=U) for k, m in zip(table.column("keys").to_pylist(), n, strict=True)])
    counts = np.concatenate([unsqueeze(c, m) for c, m in zip(table.column("counts").to_pylist(), n, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    answer = np.empty(len(keys), U)
    answer[order] = sums[group]
    edge = np.concatenate(([0], np.cumsum(n)))
    total, distinct = [0] * len(n), [0] * len(n)
    total[0], distinct[0] = int(sums.sum()), int((sums > 0).sum())
    out = pa.array([squeeze(answer[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.table({"shard": table.column("shard"), "kind": table.column("kind"), "block": table.column("block"), "n": table.column("n"), "counts": out, "total": pa.array(total, pa.int64()), "distinct": pa.array(distinct, pa.int64())})


class Automaton:
    """The part of the automaton that a block needs.

    States are numbered: 0 is the empty history, then the words of the block, then
    the start, then its longer n-grams, order by order. ``fails_to`` and ``failing``
    are the failure arcs; an arc is named by the n-gram that it completes, with
    ``weight`` by order. Only what was seen in training is a state or has an arc.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, distinct: int, strength) -> None:
        self.block, self.order = block, len(counts)
        self.count = [c.astype(float) for c in counts]
        word = (self.count[0] + 0.5) / (total + 0.5 * (distinct + 1))
        self.weight, self.arc = [np.log10(word)], [np.ones(len(word), bool)]
        sizes = [len(word) + 1, *[len(c) for c in counts[1:-1]]]  # words and the start, n-grams that are histories
        self.first = np.concatenate(([1], 1 + np.cumsum(sizes)))
        self.start = len(word) + 1
        self.fails_to = np.zeros(self.first[-1], np.int64)
        self.failing = np.zeros(self.first[-1])
        self.seen = np.zeros(self.first[-1], bool)
        self.seen[0] = True
        started = self.count[0][np.searchsorted(block.names[0], END)]  # as many starts as ends
        history = [np.append(self.count[0], started), *self.count[1:-1]]
        for n, c in enumerate(history):
            at = slice(self.first[n], self.first[n + 1])
            self.seen[at] = c > 0
            if self.order > 1:
                self.failing[at] = np.log10(strength[n] / (c + strength[n]))
        # by n-gram: its history and the n-gram without its first word, from any token that it ends in
        probability = word
        for n in range(1, self.order):
            sample = np.zeros(len(counts[n]), np.int64)
            sample[block.grams[n]] = np.arange(len(block.grams[n]))
            real = block.names[n] != 0
            before = np.maximum(sample - 1, 0)
            head = block.grams[n - 1][before]
            if n == 1:
                head = np.where(sample == block.begin[block.document[sample]], len(word), head)
            shorter = block.grams[n - 1][sample]
            m = strength[n - 1]
            probability = np.where(real, (self.count[n] + m * probability[shorter]) / (history[n - 1][head] + m), 1.0)
            self.weight.append(np.log10(probability))
            self.arc.append(real & (self.count[n] > 0))
            if n < self.order - 1:
                self.fails_to[self.first[n] : self.first[n + 1]] = np.where(real, self.first[n - 1] + shorter, 0)

    def states(self) -> np.ndarray:
        """The state that each token is read in: that of the longest seen end of what stands before it."""
        b, after = self.block, np.zeros(len(self.block.document), np.int64)
        for n in range(self.order - 1):
            state = self.first[n] + b.grams[n]
            longer_seen = self.seen[state] & (b.names[n][b.grams[n]] != 0)
            after = np.where(longer_seen, state, after)
        before = np.zeros_like(after)
        before[1:] = after[:-1]
        before[b.begin[:-1]] = self.start if self.order > 1 and self.seen[self.start] else 0
        return before

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 probability by unigrams, known tokens) of each document."""
        b = self.block
        weight, state = np.zeros(len(b.document)), self.states()
        length = np.searchsorted(self.first, state, side="right")  # words of the history: 0 for the empty one
        pending = np.arange(len(state))
        while len(pending):
            found = np.zeros(len(pending), bool)
            for n in range(self.order):
                here = np.flatnonzero(length[pending] == n)
                gram = b.grams[n][pending[here]]
                arc = self.arc[n][gram]
                weight[pending[here[arc]]] += self.weight[n][gram[arc]]
                found[here[arc]] = True
            pending = pending[~found]
            weight[pending] += self.failing[state[pending]]
            state[pending] = self.fails_to[state[pending]]
            length[pending] -= 1
        count = len(b.begin) - 1
        by = lambda x: np.bincount(b.document, x, minlength=count)
        return by(weight), by(self.weight[0][b.grams[0]]), by(self.count[0][b.grams[0]] > 0).astype(np.int64)


OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _read(total: int, distinct: int, strength, bits: int):
    order = len(strength) + 1

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        answers = sorted(zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("n").to_pylist(), right.column("counts").to_pylist(), strict=True), key=lambda x: x[:2])
        for row in left.to_pylist():
            block = Block(row, order, bits)
            counts = [np.concatenate([unsqueeze(c, n) for k, _, n, c in answers if k == kind]) for kind in range(order)]
            score, base, known = Automaton(block, counts, total, distinct, strength).read()
            m = len(block.ids)
            parts.append(pa.table([pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(np.diff(block.begin)), pa.array(known), pa.array([total] * m, pa.int64()), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(parts)

    return read


ASKED = "shard int, kind int, block long, n long, keys binary, counts binary"


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", strength=STRENGTH) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row; a strength for each order from two on."""
    order = len(strength) + 1
    blocks = cut(docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(_pack), BLOCK))
    tokens, words = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bits = min(64, max(LEAST_BITS, int(tokens).bit_length() + SPARE))
    answered = lambda shards, orders: blocks.mapInArrow(lean(_ask(shards, orders, bits)), ASKED).groupBy("kind", "shard").applyInArrow(_answer, ANSWER)
    ones = cut(answered(1 + words // SHARD_KEYS, [0]))
    total, distinct = ones.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    answers = ones.unionAll(answered(1 + tokens // SHARD_KEYS, range(1, order))) if order > 1 else ones
    read = blocks.groupBy("block").cogroup(answers.select("block", "kind", "shard", "n", "counts").groupBy("block")).applyInArrow(_read(total, distinct, strength, bits), OUT)
    return read.withColumnRenamed("id", id)
