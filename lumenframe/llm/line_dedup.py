"""Line dedup by a segment-partition edit join.

Lines (between ``\\n``) are compared by their bytes without white space at either
end. Two lines match when they are equal or, if both have at least ``shortest``
bytes, when their edit distance (insertions, deletions, substitutions of bytes
of UTF-8) is at most ``edits``. Matches join into classes; of a class the first
occurrence by (document id, position) stays, the others are removed. Blank
lines are never compared or removed.

Join. A line of length L holds edits + 1 disjoint segments of L // (edits + 1)
bytes, the first half of them counted from its start, the others from its end; a
partner within the distance keeps one of them intact. A line is indexed by (size,
segment number, segment) and probes, for every length from L - edits to L, the
substrings where that length's segments could lie: one segment i (from 0) is
intact with i edits to its left and at most edits - i to its right, which bounds
its shift. Lengths of one size put their segments at the same places, so a
line probes them once. Lines that share a key pass a parity sketch of their byte pairs (one edit flips at most
four bits) and are verified by a banded bit-parallel edit distance. Equal lines
are one line throughout. Lines of a key that more than ``RUN`` share meet again
under finer keys, the key with any two of 4 edits + 2 parts of the sketch (of
which at most 4 edits differ), each pair under the first of them; lines that
still are a crowd are cut into tiles that are compared two by two.

Lines are told apart by two independent 64-bit names: 10^12 different lines
hold two that agree in both with a chance below 10^-14. Positions are (id, text
hash, line number): rows with equal ids and texts are treated alike, null ids
come last. A null text has no lines and stays null. The other columns are
handed on as they are, whatever their names; the two counts come last, named as
``counts`` says. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .jaccard_join import _filter_at, _filter_bits
from .session import cut, lean, numbered

#: Edits that a match may have, and bytes of the shortest line that is compared by edits: parameters of the operator.
EDITS, SHORTEST = 2, 16
#: The band of 2 edits + 1 rows lies in one word of 64 bits.
MOST_EDITS = 30
RUN, TILE = 256, 2048
#: Parts of a sketch that crowds are refined by, at most.
THINNEST = 16

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)
LAST_ID = (1 << 63) - 1


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(document, number, start, end) of every line of packed texts; ends are trimmed of white space."""
    breaks = np.flatnonzero(data == 10)
    document = np.searchsorted(offsets, breaks, side="right") - 1
    rows = np.arange(len(offsets) - 1)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    ends = np.concatenate((offsets[1:], breaks))
    document = np.concatenate((rows, document))
    order = np.lexsort((starts, document))
    starts, document = starts[order], document[order]
    ends = np.sort(ends[: len(rows)]) if not len(breaks) else _line_ends(starts, document, offsets)
    first = np.searchsorted(document, rows)
    number = np.arange(len(starts)) - first[document]
    starts, ends = trimmed(data, starts, ends)
    return document, number, starts, ends


#: White space at a line's end is stepped over byte by byte so far, then looked up for all bytes at once.
STEPS = 32


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at either end."""
    starts, ends = starts.copy(), ends.copy()
    for left in (True, False):
        open_ = np.flatnonzero(starts < ends)
        for _ in range(STEPS):
            open_ = open_[K.SPACE[data[starts[open_] if left else ends[open_] - 1]]]
            if left:
                starts[open_] += 1
            else:
                ends[open_] -= 1
            open_ = open_[starts[open_] < ends[open_]]
            if not len(open_):
                break
        else:
            solid = np.flatnonzero(~K.SPACE[data])
            if left:
                after = np.append(solid, len(data))[np.searchsorted(solid, starts[open_])]
                starts[open_] = np.minimum(after, ends[open_])
            else:
                before = np.concatenate(([0], solid + 1))[np.searchsorted(solid, ends[open_])]
                ends[open_] = np.maximum(before, starts[open_])
    return starts, ends


def _line_ends(starts: np.ndarray, document: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line ends before the break that the next line of its document follows."""
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[-1] = offsets[-1]
    last = np.append(document[1:] != document[:-1], True)
    ends[last] = offsets[document[last] + 1]
    return ends


#: The sketch's bit of each byte pair.
FLIP = U(1) << (K.mix(np.arange(1 << 16, dtype=U)) >> U(58))


class Lines:
    """Names, sketches and join keys of the lines of packed texts."""

    def __init__(self, edits: int) -> None:
        self.rolling, self.edits = K.Rolling(), edits

    def __call__(self, data: np.ndarray, offsets: np.ndarray, checked: bool = False):
        self.data = data
        document, number, self.starts, self.ends = line_spans(data, offsets)
        if checked:
            self.names, self.checks = (x.view(np.int64) for x in K.span_names(data, self.starts, self.ends, 0, 1))
        else:
            self.names = K.span_names(data, self.starts, self.ends).view(np.int64)
        return document, number, self.ends > self.starts

    def checks_of(self, at: np.ndarray) -> np.ndarray:
        """The second names of some lines only."""
        size = (self.ends - self.starts)[at]
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - size), size)
        return K.span_names(self.data[inside], ends - size, ends, 1).view(np.int64)

    def sketches(self, at: np.ndarray) -> np.ndarray:
        """Parity of each line's byte pairs in 64 bits."""
        pair = self.data[:-1].astype(np.uint16) << 8 | self.data[1:]
        flips = np.zeros(len(self.data) + 1, U)
        np.bitwise_xor.accumulate(FLIP[pair], out=flips[1 : len(pair) + 1])
        return flips[np.maximum(self.ends[at] - 1, self.starts[at])] ^ flips[self.starts[at]]

    def keys(self, at: np.ndarray):
        """(has the line this key, key, is it an index entry) arrays, one after another, for the given lines."""
        starts, length, parts = self.starts[at], (self.ends - self.starts)[at], self.edits + 1
        prefix = self.rolling.prefix(self.data)
        given: dict[tuple[int, int], np.ndarray] = {}
        for shorter in range(parts):
            target = length - shorter
            size = target // parts
            for i in range(parts):
                low = max(-i, shorter - (self.edits - i))
                high = min(i, shorter + (self.edits - i))
                left = 2 * i <= self.edits
                for shift in range(low, high + 1):
                    # from the line's start, or from its end: there a target of any length has it at the same place
                    place = shift if left else shift - shorter
                    where = i * size + place if left else length - (parts - i) * size + place
                    before = given.get((i, place), np.full(len(at), -1))
                    fits = (target >= 0) & (where >= 0) & (where + size <= length) & (before != size)
                    given[i, place] = np.where(fits, size, before)
                    begin = np.where(fits, starts + where, starts)
                    key = self.rolling.spans(prefix, begin, begin + np.where(fits, size, 0)) ^ K.mix((size * parts + i).astype(U))
                    yield fits, K.mix(key).view(np.int64), shorter == 0 and shift == 0


def _occurrences(edits: int):
    def scan(batches):
        lines = Lines(edits)
        for batch in batches:
            data, offsets = K.packed(batch.column(2))
            for a, b in K.chunks(offsets):
                document, number, solid = lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
                take = pa.array(document[solid] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number[solid]), pa.array(lines.names[solid]), pa.array(lines.checks[solid])], names=["id", "th", "line", "name", "check"])

    return scan


#: Names that a task remembers as handed on, by their last bits.
REMEMBERED = 1 << 17


def _keyed(edits: int, shortest: int):
    def scan(batches):
        lines, told = Lines(edits), np.zeros(REMEMBERED, np.int64)
        for batch in batches:
            data, offsets = K.packed(batch.column(0))
            for a, b in K.chunks(offsets):
                _, _, solid = lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names, at = np.unique(lines.names, return_index=True)
                fine = solid[at] & (lines.ends[at] - lines.starts[at] >= shortest) & (told[names & REMEMBERED - 1] != names)
                names, at = names[fine], at[fine]
                if not len(at):
                    continue
                told[names & REMEMBERED - 1] = names
                sketch = lines.sketches(at).view(np.int64)
                fits, keys, index = zip(*lines.keys(at), strict=True)
                # one batch a chunk: each costs the JVM more than its rows do
                which, at = np.divmod(np.flatnonzero(np.concatenate(fits)), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys)[which, at]), pa.array(names[at]), pa.array(sketch[at]), pa.array(np.array(index)[which])], names=["key", "name", "sketch", "indexed"])

    return scan


#: A pair of lines, or a line of a crowd (b is null) and the key that it is crowded under.
PAIRED = "a long, b long, key long, sketch long, indexed boolean"
PAIRED_NAMES = ["a", "b", "key", "sketch", "indexed"]


def _paired(a, b):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=PAIRED_NAMES)


def _crowd(key, names, sketch, indexed):
    return pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(key), pa.array(sketch), pa.array(indexed)], names=PAIRED_NAMES)


def sketch_edges(edits: int) -> list[int]:
    """Where 4 edits + 2 parts of a sketch begin and end."""
    count = 4 * edits + 2
    return [64 * i // count for i in range(count + 1)]


def first_two(differ: np.ndarray, edges: list[int]) -> np.ndarray:
    """Number (later * parts + earlier) of the first two parts without a difference."""
    count = len(edges) - 1
    one, two = np.full(len(differ), -1), np.full(len(differ), -1)
    for i in range(count):
        same = (differ >> U(edges[i])) & U((1 << (edges[i + 1] - edges[i])) - 1) == 0
        two = np.where((one >= 0) & (two < 0) & same, i, two)
        one = np.where((one < 0) & same, i, one)
    return two * count + one


def _runs(edits: int, refined: bool = False):
    """Of rows sorted by key (alone, which Spark sorts by radix): pairs that pass the sketch, of short runs; the lines of long runs.

    Rows are (key, name, sketch, indexed) and, if refined, the number of the two
    parts that the key holds and the key that it refines: of the finer keys that
    two lines share only the first gives the pair.
    """
    most, edges = 4 * edits, sketch_edges(edits)

    def distinct(rows):
        """One row for each key and line, however many batches the line stood in; keys that one row has are left out."""
        key, names = rows[0], rows[1]
        same = key[1:] == key[:-1]
        met = np.flatnonzero(np.append(same, False) | np.append(False, same))
        met = met[np.lexsort((names[met], key[met]))]
        rows = [x[met] for x in rows]
        if not len(met):
            return rows
        key, names = rows[0], rows[1]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (names[1:] != names[:-1]))))
        indexed = np.logical_or.reduceat(rows[3], first)
        return [x[first] if i != 3 else indexed for i, x in enumerate(rows)]

    def crowded(rows):
        return _crowd(rows[5] if refined else rows[0], *rows[1:4])

    def pairs(rows):
        rows = distinct(rows)
        key, names, sketch, indexed = rows[:4]
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        short = np.repeat((size > 1) & (size <= RUN), size)
        for step in range(1, RUN):
            if len(key) <= step:
                break
            i = np.flatnonzero(short[:-step] & (key[step:] == key[:-step]))
            if not len(i):
                break
            differ = sketch[i].view(U) ^ sketch[i + step].view(U)
            ok = (np.bitwise_count(differ) <= most) & (names[i] != names[i + step]) & (indexed[i] | indexed[i + step])
            if refined and ok.any():
                ok[ok] = first_two(differ[ok], edges) == rows[4][i[ok]]
            if ok.any():
                yield _paired(names[i[ok]], names[i[ok] + step])
        long = np.flatnonzero(np.repeat(size > RUN, size))
        if len(long):
            yield crowded([x[long] for x in rows])

    def scan(batches):
        held, long_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if long_key is not None:
                same = int(np.searchsorted(now[0], long_key, side="right"))
                if same:
                    yield crowded([x[:same] for x in now])
                now = [x[same:] for x in now]
                if not len(now[0]):
                    continue
                long_key = None
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from pairs([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) > 1 << 16:  # one key is left
                held = distinct(held)
            if len(held[0]) > 1 << 16:
                long_key = held[0][0]
                yield crowded(held)
                held = None
        if held is not None and len(held[0]):
            yield from pairs(held)

    return scan


KEYED = "key long, name long, sketch long, indexed boolean"
REFINED = KEYED + ", parts long, origin long"


def _refined(edits: int):
    """Lines of crowds under finer keys: any two parts of the sketch, which lines within the edits have in common."""
    edges = sketch_edges(edits)
    count = len(edges) - 1

    def scan(batches):
        for batch in batches:
            key, sketch = (batch.column(i).to_numpy().view(U) for i in (2, 3))
            part = [(sketch >> U(a)) & U((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for i in range(count):
                for j in range(i):
                    number = i * count + j
                    finer = K.mix(K.mix(key ^ (part[i] << U(32) | part[j])) + U(number))
                    yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), batch.column(0), batch.column(3), batch.column(4), pa.array(np.full(len(key), number)), batch.column(2)], names=["key", "name", "sketch", "indexed", "parts", "origin"])

    return scan


def _tiles(edits: int):
    def compare(table: pa.Table) -> pa.Table:
        names, sketch = table.column("a").to_numpy(), table.column("sketch").to_numpy().view(U)
        indexed, side = table.column("indexed").to_numpy(), table.column("side").to_numpy()
        across = bool(side.any())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if across else (np.arange(len(names)),) * 2
        for i in left:
            near = right[(np.bitwise_count(sketch[right] ^ sketch[i]) <= 4 * edits) & (indexed[right] | indexed[i]) & (names[right] != names[i])]
            if not across:
                near = near[near > i]
            a.append(np.full(len(near), names[i]))
            b.append(names[near])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return compare


def within(patterns: list[bytes], texts: list[bytes], edits: int) -> np.ndarray:
    """Is the edit distance of each pair at most ``edits``?

    One 64-bit word holds the band of 2 edits + 1 rows around the diagonal, its
    top bit the lowest row. The band slides down one row a column (Hyyrö 2003);
    all pairs advance together. The score follows the band's lowest diagonal
    until the pattern's last row, then that row.
    """
    n = len(patterns)
    m, t = np.array([len(x) for x in patterns], np.int64), np.array([len(x) for x in texts], np.int64)
    out = np.abs(m - t) <= edits
    # a short pattern is not cut by the band at all: pad both with the same bytes
    pad = b"\x00" * (edits + 1)
    m, t = m + edits + 1, t + edits + 1
    wide = int(max(m.max(), t.max())) + 2 * edits + 2 if n else 0
    p = np.zeros((n, wide + edits), np.uint8)
    s = np.zeros((n, wide), np.uint8)
    for i in range(n):
        p[i, edits : edits + m[i]] = np.frombuffer(pad + patterns[i], np.uint8)
        s[i, : t[i]] = np.frombuffer(pad + texts[i], np.uint8)
    up, down = np.full(n, (ALL << U(63 - edits)) & ALL, U), np.zeros(n, U)
    score, row_bit = np.full(n, edits, np.int64), np.full(n, 62, np.int64)
    top = U(1) << U(63)
    for j in range(int(t.max()) if n else 0):
        match = np.zeros(n, U)
        for k in range(2 * edits + 1):
            row = j + edits - k  # of the pattern
            match |= ((p[:, row + edits] == s[:, j]) & (row >= 0) & (row < m)).astype(U) << U(63 - k)
        flat = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(flat | up), flat & up
        diagonal = j < m - edits
        bit = U(1) << row_bit.astype(U)
        step = np.where(diagonal, (flat & top) == 0, ((rise & bit) != 0).astype(np.int64) - ((fall & bit) != 0))
        score += np.where(j < t, step, 0)
        row_bit -= ~diagonal & (row_bit > 0)
        up, down = fall | ~((flat >> U(1)) | rise), (flat >> U(1)) & rise
    return out & (score <= edits)


def _verify(edits: int):
    def scan(batches):
        for batch in batches:
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            order = sorted(range(len(a)), key=lambda i: len(a[i]))
            keep = np.zeros(len(a), bool)
            at = 0
            while at < len(order):
                # pairs of like length together; the arrays stay within a few MB
                to, width = at, len(a[order[at]])
                while to < len(order) and to - at < 1024 and len(a[order[to]]) <= 2 * width + 64 and (to == at or (to - at) * len(a[order[to]]) < 1 << 22):
                    to += 1
                some = order[at:to]
                keep[some] = within([a[i] for i in some], [b[i] for i in some], edits)
                at = to
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return scan


def _texts(edits: int, bits: np.ndarray):
    def scan(batches):
        lines, bit = Lines(edits), np.unpackbits(bits).astype(bool)
        for batch in batches:
            data, offsets = K.packed(batch.column(0))
            for a, b in K.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                _, _, solid = lines(part, offsets[a : b + 1] - offsets[a])
                at = np.flatnonzero(solid & bit[_filter_at(lines.names)])
                if len(at):
                    checks = lines.checks_of(at)
                    order = np.lexsort((checks, lines.names[at]))
                    at, checks = at[order], checks[order]
                    names = lines.names[at]
                    fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])))
                    at = at[fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(names[fresh]), pa.array(checks[fresh]), pa.array([part[lines.starts[i] : lines.ends[i]].tobytes() for i in at], pa.binary())], names=["name", "check", "bytes"])

    return scan


def links(texts: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``(a, b)``: verified matches between different lines of a one-column frame of texts, each a pair of names."""
    met = lambda keyed, refined=False: cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_runs(edits, refined)), PAIRED).distinct())
    split = lambda found: (found.where("b is not null").select("a", "b"), found.where("b is null").select("a", "b", "key", "sketch", "indexed"))
    pairs, crowd = split(met(texts.mapInArrow(lean(_keyed(edits, shortest)), KEYED)))
    if 4 * edits + 2 <= THINNEST and not crowd.isEmpty():
        more, crowd = split(met(crowd.mapInArrow(lean(_refined(edits)), REFINED), True))
        pairs = pairs.unionAll(more).distinct()
    if not crowd.isEmpty():
        # what is crowded under a finer key still is compared under the key that it came from, once
        counted = crowd.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.max("key").alias("k")).select(F.col("k").alias("key"), "tiles")
        dealt = crowd.join(counted, "key").withColumn("tile", F.pmod(F.xxhash64("a"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("key", "a", "sketch", "indexed", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).alias("side"))
        pairs = cut(pairs.unionAll(dealt.groupBy("key", "i", "j").applyInArrow(_tiles(edits), "a long, b long")).distinct())
    bytes_of = cut(texts.mapInArrow(lean(_texts(edits, _filter_bits(pairs.select(F.explode(F.array("a", "b")))))), "name long, check long, bytes binary").dropDuplicates(["name", "check"]))
    side = lambda s: bytes_of.select(F.col("name").alias(s), F.col("check").alias(f"check_{s}"), F.col("bytes").alias(f"bytes_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "check_a", "b", "check_b", "bytes_a", "bytes_b")
    fine = met.mapInArrow(lean(_verify(edits)), "a long, check_a long, b long, check_b long")
    return fine.select(F.struct(F.col("a").alias("name"), F.col("check_a").alias("check")).alias("a"), F.struct(F.col("b").alias("name"), F.col("check_b").alias("check")).alias("b"))


def _apply(at: int):
    """Texts without their removed lines; at: the text's column, the removed numbers come last."""

    def scan(batches):
        for batch in batches:
            gone = batch.column(batch.num_columns - 1).to_pylist()
            text = batch.column(at).to_pylist()
            lines, removed = [0] * len(text), [0] * len(text)
            for i, t in enumerate(text):
                if t is None:
                    continue
                parts = t.split("\n")
                lines[i] = sum(1 for x in parts if x.strip(" \t\n\x0b\x0c\r"))
                if gone[i]:
                    drop = set(gone[i])
                    removed[i] = len(drop)
                    text[i] = "\n".join(x for k, x in enumerate(parts) if k not in drop)
            columns = [*batch.columns[:-1], pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lines", "removed"])

    return scan


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST, counts=("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns of docs, the text without its removed lines, and two counts of lines with content."""
    if not 0 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must lie between 0 and {MOST_EDITS}")
    plain = numbered(docs)
    place, body = docs.columns.index(id), docs.columns.index(text)
    order, words = F.coalesce(F.col(f"c{place}").cast("long"), F.lit(LAST_ID)), F.col(f"c{body}").cast("string")
    keyed = plain.select(order.alias("id"), F.xxhash64(words).alias("th"), words.alias("text")).where("text is not null")
    seen = cut(keyed.mapInArrow(lean(_occurrences(edits)), "id long, th long, line long, name long, check long"))
    linked = components(links(keyed.select("text"), edits, shortest), "a", "b")
    classes = cut(linked.select(F.col("node.name").alias("name"), F.col("node.check").alias("check"), F.col("component.name").alias("first_name"), F.col("component.check").alias("first_check")))
    # only lines that stand more than once, or that match others, go further
    often = seen.groupBy("name", "check").agg(F.count("*").alias("n"), F.max("name").alias("k"), F.max("check").alias("l")).select(F.col("k").alias("name"), F.col("l").alias("check"), "n")
    often = often.join(classes, ["name", "check"], "left").where("n > 1 or first_name is not null")
    cls = [F.coalesce("first_name", "name").alias("cls"), F.coalesce("first_check", "check").alias("cls_check")]
    met = seen.join(often.select("name", "check", *cls), ["name", "check"]).select("id", "th", "line", "cls", "cls_check")
    firsts = met.groupBy("cls", "cls_check").agg(F.min(F.struct("id", "th", "line")).alias("first"), F.count("*").alias("n"), F.max("cls").alias("k"), F.max("cls_check").alias("l")).where("n > 1")
    # the class is an aggregate of its own, so that the join deals out both sides itself and may split a frequent line's occurrences
    firsts = firsts.select(F.col("k").alias("cls"), F.col("l").alias("cls_check"), "first")
    gone = met.join(firsts, ["cls", "cls_check"]).where("struct(id, th, line) <> first").groupBy("id", "th").agg(F.collect_set("line").alias("gone"))
    joined = plain.withColumns({"own_id": order, "own_th": F.xxhash64(words)}).join(gone, (F.col("own_id") == F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    kinds = ", ".join(f"{f.name} {'string' if i == body else f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields))
    picked = [words.alias(f"c{body}") if i == body else F.col(c) for i, c in enumerate(plain.columns)]
    out = joined.select(*picked, "gone").mapInArrow(lean(_apply(body)), f"{kinds}, lines long, removed long")
    return out.toDF(*docs.columns, *counts)
