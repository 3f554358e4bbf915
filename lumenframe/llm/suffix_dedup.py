"""Removal of byte strings that repeat across documents, by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Strings are judged on the input and never cross
documents; null texts are empty.

* Equal texts are one text with the smallest of their ids; the others lose
  everything, if they are long enough for one string.
* Every string of LENGTH bytes has an anchor: the GRAM bytes in it with the
  smallest hash, the leftmost of equals. Equal strings have equal anchors, so
  a string can only repeat where its anchor's hash does. Which hashes do is
  settled shard by shard; a bit table of the shared ones, whose size follows
  their number up to ``MOST_BITS``, spares the others the next step (a wrong bit
  costs a row and changes nothing).
* Around each shared anchor lies the region of the strings it anchors. Regions
  meet by anchor. Of the regions of an anchor, equal ones are one content with
  the smallest of their ids. A content whose bytes agree too little with all
  others, before and after the anchor, shares no string and is settled by that.
  All others go whole into suffix arrays (linear grouping, suffix_array.py), as
  many anchors to an array as ``ARRAY_BYTES`` hold: neighbours in an array that
  have a common prefix of LENGTH bytes begin one string, and the smallest id of
  such a run decides for every region that holds the string.

Null ids come after all others and remove nothing from each other. Rows with
equal ids never remove from one another; they are told apart by 64-bit hashes
of their texts, so among n rows of one id about n^2 / 2^65 pairs are expected
to share their spans (spans that a text has no room for are left out). Equal
texts are known by MD5. Texts of any length are taken whole, in pieces. Only
the two named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .language_model import squeeze, unsqueeze
from .session import cut, lean
from .suffix_array import suffix_array

LENGTH, GRAM = 50, 24
#: Bytes on both sides of an anchor that a string's other bytes fill.
SIDES = LENGTH - GRAM
KEY_BITS, MOST_BITS = 48, 28
#: Piece of a text handled at once, and bytes of contents in one suffix array.
PIECE, ARRAY_BYTES = 256 << 10, 1 << 16
#: Rows of one anchor taken at once, more come in slabs in order of id (at least twice as many as there are contents so far); rows read at once.
SLAB, STEP = 1 << 16, 1 << 14
#: Rows that a task remembers as seen, by the last bits of their hashes.
REMEMBERED = 1 << 16
LAST_ID = (1 << 63) - 1
#: Anchors asked of a shard.
SHARD_KEYS = 2 << 20
#: Duplicate texts are joined by broadcast up to so many, counted first.
BROADCAST_TEXTS = 200_000

U = np.uint64


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For each run of strings with one anchor: (document, first and last start, anchor, hash)."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),)
    word = eights(data)
    hashes = K.mix(K.mix(K.mix(word[:-16]) ^ word[8:-8]) ^ word[16:])
    at = np.arange(len(hashes))
    least = least_in_windows((hashes >> U(24) << U(24)) | at.astype(U), SIDES + 1)
    anchor = (least & U(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    document = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= offsets[document + 1]
    start, anchor, document = start[inside], anchor[inside], document[inside]
    if not len(start):
        return document, start, start, anchor, hashes[:0]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return document[first], start[first], start[last], anchor[first], hashes[anchor[first]]


class Remembered:
    """Rows that a task has seen: a row that stands many times is read about once a task."""

    def __init__(self) -> None:
        self.rows: dict[int, tuple[int, int]] = {}

    def new(self, id: int, th: int) -> bool:
        place = (th ^ id) & REMEMBERED - 1
        if self.rows.get(place) == (id, th):
            return False
        self.rows[place] = id, th
        return True

    def column(self, batch) -> pa.Array:
        """The texts (third column) of a batch's new rows, null for the others."""
        fresh = [self.new(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return batch.column(2) if all(fresh) else pa.compute.if_else(pa.array(fresh), batch.column(2), pa.scalar(None, batch.column(2).type))


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, row offsets, bytes, place of the bytes in the first row): texts longer than a piece come in overlapping pieces."""
    for a, b in K.chunks(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b == a + 1 and hi - lo > 2 * PIECE:
            for at in range(lo, max(lo + 1, hi - LENGTH + 1), PIECE):
                to = min(hi, at + PIECE + LENGTH - 1)
                yield a, np.array([0, to - at]), data[at:to], at - lo
        else:
            yield a, offsets[a : b + 1] - lo, data[lo:hi], 0


SHARED = "shard int, n long, keys binary"


def _ask(shards: int):
    bounds = (np.arange(1, shards) * ((1 << KEY_BITS) / shards)).astype(U)

    def scan(batches):
        seen = Remembered()
        for batch in batches:
            data, offsets = K.packed(seen.column(batch))
            for _, rows, part, _ in pieces(data, offsets):
                document, _, _, _, hashes = anchors(part, rows)
                keys = hashes >> U(64 - KEY_BITS)
                order = np.lexsort((document, keys))
                keys, document = keys[order], document[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                other = np.zeros(len(keys), bool)
                other[1:] = ~new[1:] & (document[1:] != document[:-1])
                many = np.logical_or.reduceat(other, first)
                keys = keys[first]
                edge = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
                some = [s for s in range(shards) if edge[s + 1] > edge[s]]
                cuts = [slice(edge[s], edge[s + 1]) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([c.stop - c.start for c in cuts], pa.int64()), pa.array([squeeze(np.diff(keys[c], prepend=U(0))) for c in cuts], pa.binary()), pa.array([np.packbits(many[c]).tobytes() for c in cuts], pa.binary())],
                    names=["shard", "n", "keys", "many"],
                )

    return scan


def _settle(table: pa.Table) -> pa.Table:
    """Keys of a shard that two pieces or two documents of one piece hold."""
    n = table.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(unsqueeze(k, m), dtype=U) for k, m in zip(table.column("keys").to_pylist(), n, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m).astype(bool) for x, m in zip(table.column("many").to_pylist(), n, strict=True)])
    keys = keys << U(1) | many.astype(U)
    keys.sort()
    value = keys >> U(1)
    again = np.zeros(len(keys), bool)
    again[1:] = value[1:] == value[:-1]
    shared = np.unique(value[again | (keys & U(1) == 1)])
    return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(shared)], pa.int64()), "keys": pa.array([squeeze(np.diff(shared, prepend=U(0)))], pa.binary())})


def _bits(bits: int):
    """Each shard's part of the bit table, as the bytes that hold it."""

    def scan(batches):
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n:
                    at = np.unique(np.cumsum(unsqueeze(blob, n), dtype=U) >> U(KEY_BITS - bits)).astype(np.int64)
                    low = int(at[0]) >> 3
                    part = np.zeros((int(at[-1]) >> 3) - low + 1, np.uint8)
                    np.bitwise_or.at(part, (at >> 3) - low, (1 << (at & 7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["low", "size", "part"])

    return scan


#: place is where the region begins in its text, and in its last bits how far the anchor lies from there.
REGION = "key long, id long, th long, place long, region binary"
LEAD_BITS = 5


def _regions(table, bits: int):
    def scan(batches):
        seen, bit = Remembered(), table.value
        for batch in batches:
            data, offsets = K.packed(seen.column(batch))
            for row, rows, part, place in pieces(data, offsets):
                document, first, last, anchor, hashes = anchors(part, rows)
                at = (hashes >> U(64 - bits)).astype(np.int64)
                take = np.flatnonzero((bit[at >> 3] >> (at & 7)) & 1)
                if not len(take):
                    continue
                document, first, last, anchor, hashes = (x[take] for x in (document, first, last, anchor, hashes))
                who = pa.array(document + row)
                text = part.tobytes()
                blobs = [text[s : e + LENGTH] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array((first - rows[document] + place) << LEAD_BITS | (anchor - first)), pa.array(blobs, pa.binary())], names=["key", "id", "th", "place", "region"])

    return scan


def agreement(key: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes of a side a row has in common with the row of its key that agrees most; -1 for a row alone."""
    wide = np.zeros((len(key), 32), np.uint8)
    wide[:, : side.shape[1]] = side
    word = wide.view(">u8").astype(U)
    order = np.lexsort((word[:, 3], word[:, 2], word[:, 1], word[:, 0], key))
    a, b = order[:-1], order[1:]
    differ = side[a] != side[b]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    same = np.where(key[a] == key[b], np.minimum(same, np.minimum(size[a], size[b])), -1)
    out = np.full(len(key), -1)
    np.maximum.at(out, a, same)
    np.maximum.at(out, b, same)
    return out


class Regions:
    """Rows of whole anchors, sorted by anchor."""

    def __init__(self, key, id, th, place, lead, blobs) -> None:
        self.key, self.id, self.th, self.place, self.lead, self.blobs = key, id, th, place, lead, blobs

    def some(self, rows: np.ndarray) -> Regions:
        return Regions(self.key[rows], self.id[rows], self.th[rows], self.place[rows], self.lead[rows], [self.blobs[i] for i in rows])

    def contents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content of each row, of each content its row with the smallest id, is it of several ids): equal regions of an anchor are one content."""
        number: dict = {}
        content = np.array([number.setdefault(x, len(number)) for x in zip(self.key.tolist(), self.blobs, strict=True)], np.int64)
        order = np.lexsort((self.id, content))
        first = np.searchsorted(content[order], np.arange(len(number) + 1))
        return content, order[first[:-1]], self.id[order[first[:-1]]] < self.id[order[first[1:] - 1]]

    def may_share(self) -> np.ndarray:
        """Contents (rows that differ) that may share a string with another content of their anchor.

        A string holds the anchor and SIDES bytes more: those before it agree with
        some content and those after it with some content, or it is in no other.
        """
        size = np.array([len(x) for x in self.blobs])
        flat = np.frombuffer(b"".join(self.blobs), np.uint8)
        middle = np.cumsum(size) - size + self.lead
        step, agree = np.arange(SIDES)[None, :], 0
        for left in (True, False):
            far = np.minimum(self.lead if left else size - self.lead - GRAM, SIDES)
            at = middle[:, None] + (-1 - step if left else GRAM + step)
            side = np.where(step < far[:, None], flat[np.clip(at, 0, len(flat) - 1)], 0).astype(np.uint8)
            agree = agree + np.maximum(agreement(self.key, side, far), -SIDES)
        return agree >= SIDES

    def spans(self, new: np.ndarray):
        """(id, th, start, end) of what the rows marked as new lose."""
        empty = tuple(np.zeros(0, np.int64) for _ in range(4))
        if len(self.key) < 2:
            return empty
        first = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1])))
        many = np.minimum.reduceat(self.id, first) < np.maximum.reduceat(self.id, first)
        rows = np.flatnonzero(np.repeat(many, np.diff(np.append(first, len(self.key)))))
        if not len(rows):
            return empty
        some = self.some(rows)
        content, sample, several = some.contents()
        kinds = some.some(sample)
        sharing = kinds.may_share()
        size = np.array([len(x) for x in kinds.blobs])
        windows = size - LENGTH + 1
        edge = np.concatenate(([0], np.cumsum(windows)))
        # a content that shares no string owns all of its own
        owner = np.repeat(kinds.id, windows)
        met = np.flatnonzero(sharing)
        for a, b in _batches(kinds.key[met], size[met]) if len(met) else ():
            here = met[a:b]
            at = np.repeat(edge[here] - np.cumsum(windows[here]) + windows[here], windows[here]) + np.arange(windows[here].sum())
            owner[at] = owners([kinds.blobs[i] for i in here], kinds.id[here])
        mine = np.flatnonzero(new[rows] & (sharing | several)[content])
        count = windows[content[mine]]
        row = np.repeat(mine, count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        gone = owner[edge[content[row]] + step] < some.id[row]
        row, step = row[gone], step[gone]
        if not len(row):
            return empty
        begins = np.ones(len(row), bool)
        begins[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
        a = np.flatnonzero(begins)
        b = np.append(a[1:], len(row)) - 1
        source = row[a]
        return some.id[source], some.th[source], some.place[source] + step[a], some.place[source] + step[b] + LENGTH


def _batches(key: np.ndarray, size: np.ndarray):
    """Ranges of contents, whole anchors each, so many that one suffix array holds them."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    at, held = 0, 0
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
        more = int(size[a:b].sum()) + b - a
        if a > at and held + more > ARRAY_BYTES:
            yield at, a
            at, held = a, 0
        held += more
    yield at, len(key)


def owners(contents: list[bytes], least: np.ndarray) -> np.ndarray:
    """Smallest id of each string of the contents, content by content, read from their suffix array."""
    size = np.array([len(x) for x in contents])
    begin = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    codes = raw.astype(np.int64) + 2
    codes[begin + size] = 1  # between contents
    order = suffix_array([*codes.tolist(), 0])
    content = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[content] <= size[content] - LENGTH
    order, content = order[whole], content[whole]
    # neighbours with a common prefix of LENGTH bytes; no such string holds a mark between contents
    word, new = eights(raw), np.zeros(len(order), bool)
    new[0] = True
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        piece = word[order + at]
        new[1:] |= piece[1:] != piece[:-1]
    smallest = np.minimum.reduceat(least[content], np.flatnonzero(new))[np.cumsum(new) - 1]
    return smallest[np.argsort(order, kind="stable")]


def _judge(batches):
    """Spans to remove, from rows sorted by anchor and id."""
    held, carried = None, 0

    def read(batch):
        key, id, th, place = (batch.column(i).to_numpy() for i in range(4))
        return [key, id, th, place >> LEAD_BITS, place & (1 << LEAD_BITS) - 1, batch.column(4).to_pylist()]

    def join(a, b):
        return [np.concatenate((x, y)) for x, y in zip(a[:5], b[:5], strict=True)] + [a[5] + b[5]]

    def judged(rows, carried):
        new = np.ones(len(rows[0]), bool)
        new[:carried] = False
        out = Regions(*rows).spans(new)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["id", "th", "a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            now = read(batch.slice(at, STEP))
            held = now if held is None else join(held, now)
            if len(held[0]) < STEP:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield judged([x[:last] for x in held], carried)
                held, carried = [x[last:] for x in held], 0
            if len(held[0]) - carried > max(SLAB, 2 * carried):
                yield judged(held, carried)
                _, keep, _ = Regions(*held).contents()
                held = [x[keep] for x in held[:5]] + [[held[5][i] for i in keep]]
                carried = len(keep)
    if held is not None and len(held[0]):
        yield judged(held, carried)


def _squeezed(batches):
    """The last column, texts, as compressed bytes and their number."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        data, offsets = K.packed(batch.column(batch.num_columns - 1))
        text = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(text, pa.binary())], names=[*batch.schema.names[:-1], "n", "body"])


def _cut_out(batches):
    """Kept bytes and removed spans of each text."""
    for batch in batches:
        size, starts, ends, bodies = (batch.column(i).to_pylist() for i in range(1, 5))
        kept, spans = [], []
        for i in range(batch.num_rows):
            text = np.frombuffer(pa.decompress(bodies[i], size[i], codec="zstd"), np.uint8)
            if not starts[i]:
                kept.append(text.tobytes())
                spans.append([])
                continue
            turn = np.zeros(len(text) + 1, np.int64)
            a, b = np.array(starts[i]), np.array(ends[i])
            room = b <= len(text)
            np.add.at(turn, a[room], 1)
            np.add.at(turn, b[room], -1)
            gone = np.cumsum(turn[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )


def dedup_strings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, spans, kept)`` for every row: removed byte spans and the remaining bytes."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.col(id).cast("long").alias("given"), F.coalesce(F.col(id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(body).alias("th"), F.md5(body).alias("md5"), body.alias("text"))
    # the text's hash tells rows of one id apart; where an id stands once it is not carried along
    again = cut(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.count() <= BROADCAST_TEXTS:
        shared_id = F.broadcast(again.withColumn("shared_id", F.lit(True)))
        named = named.join(shared_id, "id", "left").withColumn("th", F.when(F.col("shared_id"), F.col("th")).otherwise(F.lit(0).cast("long")))
    copies = cut(named.groupBy("md5").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("md5", "least"))
    few = copies.count() <= BROADCAST_TEXTS
    told = named.join(F.broadcast(copies) if few else copies, "md5", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    first = told.where(f"not copy and octet_length(text) >= {LENGTH}")
    # about two anchors for every SIDES bytes
    size = first.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 + 2 * size // SIDES // SHARD_KEYS
    asked = first.select("id", "th", "text").mapInArrow(lean(_ask(shards)), "shard int, n long, keys binary, many binary")
    shared = cut(asked.groupBy("shard").applyInArrow(_settle, SHARED))
    found = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(16, int(found * 32).bit_length()))
    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in shared.mapInArrow(lean(_bits(bits)), "low long, size long, part binary").toLocalIterator():
        table[r.low : r.low + r.size] |= np.frombuffer(pa.decompress(r.part, r.size, codec="zstd"), np.uint8)
    regions = first.select("id", "th", "text").mapInArrow(lean(_regions(spark.sparkContext.broadcast(table), bits)), REGION)
    spans = regions.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lean(_judge), "id long, th long, a long, b long")
    gone = spans.groupBy("id", "th").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    # what is known without spans is not moved: copies, which lose everything, and texts too short for a string
    size = F.octet_length("text")
    plain = F.col("copy") | (size < LENGTH)
    whole = F.col("copy") & (size >= LENGTH)
    bytes_ = F.col("text").cast("binary")
    none = F.array().cast("array<struct<start: long, end: long>>")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("end")))
    known = told.where(plain).select(F.col("given").alias("id"), size.cast("long").alias("n_bytes"), F.when(whole, all_).otherwise(none).alias("spans"), F.when(whole, F.lit(b"")).otherwise(bytes_).alias("kept"))
    bodies = told.where(~plain).select("given", "id", "th", "text").mapInArrow(lean(_squeezed), "given long, id long, th long, n long, body binary")
    out = bodies.join(gone, ["id", "th"], "left").select(F.col("given").alias("id"), "n", "starts", "ends", "body")
    done = out.mapInArrow(lean(_cut_out), "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return known.unionByName(done).withColumnRenamed("id", id)
