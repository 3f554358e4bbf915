"""BPE encoding and decoding with a public vocabulary; nothing is trained.

Each word keeps a segment tree over the ranks of its adjacent pairs. A leaf is
``rank * width + position``, so the root is the leftmost pair of lowest rank;
a merge updates three leaves and their ancestors, until the root is infinite.
The trees of many words of one width are rows of one array and advance together.

Texts go through the vocabulary file's own steps: special tokens cut the raw
text, then NFC, lower case, the word pattern, bytes, merges with the word-end
mark. (The file also turns white space to one space; its pattern takes no white
space, so that step changes nothing and is left out.) A worker keeps up to about
``KEPT_BYTES`` of encoded words, each word's ids as packed 32-bit numbers, and is
handed its texts in batches of bounded bytes.

A null or empty text has no tokens and decodes to the empty string. Texts of
any length are encoded whole. Of equal ranks the leftmost pair merges first. Rows
with equal ids are separate rows; the kept columns are handed on whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import lean, numbered, small_batches

INF = np.iinfo(np.int64).max
#: Bytes of words that a worker keeps encoded before it starts anew, and the cost of a word beside its text and ids: its place in the table.
KEPT_BYTES, WORD_COST = 48 << 20, 100
#: Leaves of the trees that advance together; a longer word advances alone.
LEAVES = 1 << 17
#: Encoded documents handed on at once, in bytes of text.
HAND_ON = 1 << 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shown, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in shown:
            shown[b], spare = chr(spare), spare + 1
    return [shown[b] for b in range(256)]


class Codec:
    """Encoder and decoder of a vocabulary file's contents."""

    def __init__(self, source: str) -> None:
        file = json.loads(source)
        model = file["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        shown = byte_symbols()
        self.inner = np.array([vocab[s] for s in shown], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in shown], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(code)
        self.code, self.rank, self.into = code[order], order, into
        # special tokens stand among the words as their ids
        self.seeds = {i: np.int32(i).tobytes() for i in self.special.values()}
        self.words: dict[str | int, bytes] = dict(self.seeds)
        self.old: dict[str | int, bytes] = {}
        self.kept = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that don't merge."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, packed."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        width = 1
        while width < (lengths.max() if len(words) else 0) * 2:
            rows = np.flatnonzero((lengths > width // 2) & (lengths <= width))
            step = max(1, LEAVES // width)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                for i, ids in zip(some, self._trees([words[i] for i in some], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _trees(self, words: list[bytes], width: int):
        n = len(words)
        length = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        at = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
        symbol = np.zeros((n, width + 1), np.int64)
        symbol[row, at] = self.inner[data]
        rows = np.arange(n)
        symbol[rows, length - 1] = self.last[data[np.cumsum(length) - 1]]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        live = np.arange(width)[None, :] < length[:, None]
        tree = np.full((n, 2 * width), INF)
        if width > 1:
            rank = self.ranks(symbol[:, :-2], symbol[:, 1:-1])
            ok = (rank >= 0) & live[:, 1:]
            tree[:, width : 2 * width - 1] = np.where(ok, rank * width + np.arange(width - 1), INF)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        bits = width.bit_length() - 1
        active = rows[tree[:, 1] != INF]
        while len(active):
            root = tree[active, 1]
            pos, merged = root & (width - 1), self.into[root >> bits]
            nxt = after[active, pos]
            far = after[active, nxt]
            symbol[active, pos] = merged
            live[active, nxt] = False
            after[active, pos] = far
            inside = far < length[active]
            before[active[inside], far[inside]] = pos[inside]
            self._set(tree, active, nxt, np.full(len(active), INF), width)
            right = np.where(inside, symbol[active, np.minimum(far, width)], 0)
            rank = np.where(inside, self.ranks(merged, right), -1)
            self._set(tree, active, pos, np.where(rank >= 0, rank * width + pos, INF), width)
            prev = before[active, pos]
            has = prev >= 0
            r, p = active[has], prev[has]
            rank = self.ranks(symbol[r, p], merged[has])
            self._set(tree, r, p, np.where(rank >= 0, rank * width + p, INF), width)
            active = active[tree[active, 1] != INF]
        ids = symbol[:, :width][live].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        begin = 0
        for end in ends:
            yield ids[begin:end]
            begin = end

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point update: the leaf, then each ancestor up to the root."""
        at = leaf + width
        tree[rows, at] = value
        while width > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            width //= 2

    def pieces(self, text: str):
        """The words of a text in order; a special token's id where one stands."""
        at = 0
        for found in self.cut.finditer(text):
            yield from self._split(text[at : found.start()])
            yield self.special[found.group()]
            at = found.end()
        yield from self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        # one lower case for each character: no final-sigma rule
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def words_of(self, texts: list[str]) -> list[list]:
        """The words of each text; all of them are in the store afterwards."""
        cut = [list(self.pieces(t)) if self.cut and self.cut.search(t) else self._split(t) for t in texts]
        asked = set().union(*cut)
        if self.kept > KEPT_BYTES // 2:
            # the store has two halves: what is asked for again moves to the new one, the rest goes with the old one
            self.old, self.words, self.kept = self.words, dict(self.seeds), 0
        new = asked.difference(self.words)
        again = {w: self.old[w] for w in new if w in self.old} if self.old else {}
        new = list(new.difference(again))
        self.words |= again
        self.words |= zip(new, self.merge([w.encode() for w in new]), strict=True)
        self.kept += sum(WORD_COST + getsizeof(w) + getsizeof(self.words[w]) for w in chain(new, again))
        return cut

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        known = self.words_of(texts)
        stored = self.words.__getitem__
        return [np.frombuffer(b"".join(map(stored, words)), np.int32) for words in known]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """Tokens joined by a space: the vocabulary names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


OUT = "token_ids array<int>, n_tokens long, decoded string"


def _encode(source: str):
    def scan(batches):
        codec = Codec(source)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = K.packed(column)
            for a, b in K.chunks(offsets, HAND_ON):
                ids = codec.encode_batch([t or "" for t in column.slice(a, b - a).to_pylist()])
                n = [len(x) for x in ids]
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat))
                decoded = pa.array([codec.decode(x.tolist()) for x in ids], pa.string())
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(n, pa.int64()), decoded], names=[*batch.schema.names[:-1], "token_ids", "n_tokens", "decoded"])

    return scan


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep=("doc_id",), into=("token_ids", "n_tokens", "decoded")) -> DataFrame:
    """The kept columns with the ids, their number and the decoded text of every row, named by ``into``.

    ``vocabulary`` is the path of a tokenizer file that the driver can read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    small_batches(docs.sparkSession)
    picked = numbered(docs.select(*[F.col(c) for c in keep], F.col(text).cast("string")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(lean(_encode(source)), f"{kinds}, {OUT}").toDF(*keep, *into)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Hex SHA-256 of the ids as decimals joined by one space, and of the decoded text."""
    joined = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return encoded.select(*keep, "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
