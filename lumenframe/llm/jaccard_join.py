"""N-gram Jaccard join by parity sketches.

Every text becomes the set of its distinct k-word shingles. Two texts link when
their sets' Jaccard similarity reaches the threshold; the result groups texts
by reachability over all links.

Method. A parity sketch XORs each shingle into one place, so places of two
sketches that differ are at most as many as the sets' symmetric difference.

* Sizes are dealt into bands; partners lie in the same or the next band, and
  each pair of bands bounds the symmetric difference by some D.
* In a band pair a sketch has B > D blocks. A shingle falls into one block, so
  at most D blocks of linked sets differ and the others are equal. Of its
  non-empty blocks, taken in one global order, a set publishes the first D + 1:
  linked sets then publish a common block (prefix filter over pigeonholes).
  Blocks made of very frequent shingles only come last in that order; which
  shingles those are changes costs, never links. A set with D blocks or fewer
  publishes its single shingles too, which two such sets must share.
* Sets that share a block are compared by bit sketches, whose Hamming distance
  is a lower bound of the symmetric difference, then by the sets themselves.
* The sets that share a block are a run, one row of names; runs of the same sets
  are one. A run's sets are first compared with its first set (of a run of more than
  ``RUN`` sets with a second one too): of each set the pivot that it shares most
  runs with, then those of its other pivots that it is not connected with yet.
* Near copies that miss the threshold share most of their blocks, each block with a
  few sets more or fewer. So runs of one first set are one group where they are much
  the same (``_groups``): a set then stands in it once, not once for each block.
  Groups and runs whose sets are all connected are done with.
* Within each other group or run, and within it only, all sets that are not connected
  yet are compared by their sketches, in tiles of two times ``TILE`` sets at most:
  in those of more than ``RUN`` sets first for the nearest of each set, then, with
  what that connects, in all of them for every pair (a pair that meets again counts
  once as a rule, under the first run of both). Only the pairs that the sketches
  leave are fetched again as sets, so sets travel for pairs that link or nearly do,
  not for all that share a frequent block.

Texts of equal sets are one class throughout, so copies cost nothing.

Nulls and empty texts have no shingles and link with nothing. A text of fewer
than k words is one shingle. Rows with equal ids are separate rows; a null id
never names a component unless nothing else can. Only the two named columns
are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .session import cut, lean, plain, sweep

#: Counters of the shingle-frequency sketch, and by how many standard deviations of a Poisson count a frequent one exceeds the mean.
CELLS, FREQUENT = 1 << 21, 6
#: Runs of more than RUN sets get a second pivot; a tile has up to TILE sets of a run on each side.
RUN, TILE = 48, 2048
#: Of each set so many of its first runs are known in every tile, where pairs that met in one of them before are left out.
FIRSTS = 8
#: Bits of the membership filter of the texts whose sets are fetched.
FILTER_BITS = 1 << 23

U = np.uint64


def class_of(shingles: np.ndarray) -> int:
    """64-bit name of a set of shingle hashes."""
    return int(K.mix(np.add.reduce(K.mix(shingles ^ U(0x5BD1E995)), keepdims=True) + U(len(shingles)))[0].view(np.int64))


class Bands:
    """Sizes of the bands, differences D and blocks B for a threshold in percent."""

    def __init__(self, percent: int) -> None:
        self.percent, self.ratio = percent, 100 / percent
        self.plan: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        g = int(np.log(n) / np.log(self.ratio))
        while self.ratio ** (g + 1) <= n:
            g += 1
        while self.ratio**g > n:
            g -= 1
        return g

    def limits(self, g: int) -> tuple[int, int]:
        """D and B of the pairs whose smaller set lies in band g."""
        if g not in self.plan:
            largest = int(np.ceil(self.ratio ** (g + 1)))
            most = int(largest * (1 + self.ratio)) + 1
            d = differ(most, self.percent)
            self.plan[g] = d, (largest + 1) // 2 if largest >= 64 else 2 * largest + 1
        return self.plan[g]


def differ(sizes: int, percent: int) -> int:
    """Most symmetric difference of linked sets whose sizes add up to ``sizes``."""
    return sizes * (100 - percent) // (100 + percent)


def hot_shingles(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[(shingles >> U(40)).astype(np.int64) % CELLS]


def published(shingles: np.ndarray, bands: Bands, hot: np.ndarray) -> np.ndarray:
    """Keys of the blocks (and shingles) that a set publishes."""
    n = len(shingles)
    if not n:
        return shingles
    often, own, out = hot_shingles(shingles, hot), bands.band(n), []
    for g in (own, own - 1):
        if g < 0:
            continue
        d, b = bands.limits(g)
        block = (((shingles >> U(32)) * U(b)) >> U(32)).astype(np.int64)
        # shingles are sorted, and the block grows with the upper half of the hash
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        keys = K.mix(np.bitwise_xor.reduceat(shingles, first) ^ K.mix((block[first] + (g << 40)).astype(U)))
        if len(keys) > d + 1:
            late = np.logical_and.reduceat(often, first)
            order = np.lexsort((keys, late)) if late.any() else np.argsort(keys)
            out.append(keys[order[: d + 1]])
        else:
            out.append(keys)
            if len(keys) <= d:
                out.append(K.mix(shingles ^ U(0xA5A5 + g)))
    return np.concatenate(out)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parity bits, a power of two of them, at least as many as shingles."""
    bits = 64
    while bits < len(shingles) and bits < 1 << 20:
        bits *= 2
    at = (shingles & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A shorter parity sketch of the same set (rows are sketches)."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b)))) if len(a) and len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


#: Rows of documents, and of parts of the frequency sketch.
SCANNED = "id long, th long, n long, cls long, sketch binary, cell int, counts binary"
SCANNED_NAMES = ["id", "th", "n", "cls", "sketch", "cell", "counts"]


def _documents(k: int):
    def scan(batches):
        words, cells = K.Words(), np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            n, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            gathered, held, sketches = [], 0, []
            for row, s in K.shingle_sets(batch.column(2), words, k):
                n[row], names[row] = len(s), class_of(s)
                sketches.append(sketch_of(s))
                gathered.append(s)
                held += len(s)
                if held > 1 << 20:
                    cells += np.bincount((np.concatenate(gathered) >> U(40)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint32)
                    gathered, held = [], 0
            if gathered:
                cells += np.bincount((np.concatenate(gathered) >> U(40)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint32)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n), pa.array(names), pa.array(sketches, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=SCANNED_NAMES)
        if cells.any():
            parts = cells.reshape(8, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(8, pa.int64()), pa.nulls(8, pa.int64()), pa.nulls(8, pa.int64()), pa.nulls(8, pa.int64()), pa.nulls(8, pa.binary()), pa.array(range(8), pa.int32()), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in parts], pa.binary())], names=SCANNED_NAMES)

    return scan


def _cells(batches):
    """Sums the counters of a partition, cell by cell."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(pa.decompress(blob, CELLS // 8 * 4, codec="zstd"), np.uint32)
            sums[cell] = sums.get(cell, 0) + x.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cell", "counts"])


def frequent_cells(counts: DataFrame) -> np.ndarray:
    """Which counters are frequent: CELLS bits, whatever the input."""
    rows = counts.repartition(8, "cell").mapInArrow(lean(_cells), "cell int, counts binary").collect()
    total = np.zeros(CELLS, dtype=np.uint64)
    for r in rows:
        total.reshape(8, -1)[r.cell] += np.frombuffer(r.counts, np.uint64)
    return total > total.mean() + FREQUENT * np.sqrt(total.mean()) + 16


def _keys(percent: int, k: int, hot: np.ndarray):
    packed_hot = np.packbits(hot)

    def scan(batches):
        words, bands, hot = K.Words(), Bands(percent), np.unpackbits(packed_hot).astype(bool)
        for batch in batches:
            seen, keys, names, held = set(), [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names))], names=["key", "cls"])

            for _, s in K.shingle_sets(batch.column(0), words, k):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                keys.append(published(s, bands, hot))
                names.append(np.full(len(keys[-1]), c, np.int64))
                held += len(keys[-1])
                if held > 1 << 20:
                    yield out()
                    keys, names, held = [], [], 0
            if keys:
                yield out()

    return scan


def _runs(batches):
    """Of rows sorted by key (alone, which Spark sorts by radix): each run's pivots and classes in one row, runs of the same classes once (and again after many).

    A run that is too long to hold comes in several rows.
    """
    key, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_key = long_row = None
    seen: set[int] = set()

    def rows(run, first, second, members):
        return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(members, pa.binary())], names=["run", "first", "second", "members"])

    def whole(key, names):
        same = key[1:] == key[:-1]
        met = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(met):
            return
        met = met[np.lexsort((names[met], key[met]))]
        key, names = key[met], names[met]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (names[1:] != names[:-1])
        key, names = key[keep], names[keep]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        mixed = K.mix(names.view(U))
        run = K.mix(np.add.reduceat(mixed, first) + size.astype(U)).view(np.int64)
        fresh = size > 1
        for i in np.flatnonzero(fresh):
            fresh[i] = (r := int(run[i])) not in seen
            seen.add(r)
        if len(seen) > 1 << 18:
            seen.clear()
        if not fresh.any():
            return
        second = names[first].copy()
        for i in np.flatnonzero(fresh & (size > RUN)):
            second[i] = names[first[i] + int(np.argmin(mixed[first[i] : first[i] + size[i]]))]
        taken = np.flatnonzero(fresh)
        yield rows(run[taken], names[first[taken]], second[taken], [names[first[i] : first[i] + size[i]].tobytes() for i in taken])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if long_key is not None:  # the run that was too long to hold goes on
            same = int(np.searchsorted(k, long_key, side="right"))
            if same:
                more = np.unique(c[:same])
                yield rows(*([x] for x in long_row), [more.tobytes()])
            k, c = k[same:], c[same:]
            if not len(k):
                continue
            long_key = None
        key, names = np.concatenate((key, k)), np.concatenate((names, c))
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from whole(key[:last], names[:last])
            key, names = key[last:], names[last:]
        if len(key) > 1 << 16:
            # one key is left: copies of a class are one
            names = np.unique(names)
            key = np.full(len(names), key[0])
            if len(names) > RUN:
                # named by its key, as its classes are not known yet
                long_key = key[0]
                long_row = int(K.mix(key[:1].view(U)).view(np.int64)[0]), names[0], names[int(np.argmin(K.mix(names.view(U))))]
                yield rows(*([x] for x in long_row), [names.tobytes()])
                key, names = key[:0], names[:0]
    if len(key):
        yield from whole(key, names)


def _members(batches):
    """A row for each class of each run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        members = batch.column(3).to_pylist()
        size = [len(x) // 8 for x in members]
        spread = lambda x: pa.array(np.repeat(x.to_numpy(), size))
        cls = np.frombuffer(b"".join(members), np.int64)
        yield pa.RecordBatch.from_arrays([spread(batch.column(0)), pa.array(cls), spread(batch.column(1)), spread(batch.column(2))], names=["run", "cls", "first", "second"])


def _filter_bits(names: DataFrame) -> np.ndarray:
    """A membership filter of fixed size over a column of longs, built on the executors."""

    def build(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_at(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(np.packbits(bits).tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["bits"])

    def merge(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                bits |= np.frombuffer(pa.decompress(x, FILTER_BITS // 8, codec="zstd"), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["bits"])

    parts = names.mapInArrow(lean(build), "bits binary").repartition(8).mapInArrow(lean(merge), "bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(pa.decompress(r.bits, FILTER_BITS // 8, codec="zstd"), np.uint8)
    return bits


def _filter_at(names: np.ndarray) -> np.ndarray:
    return (K.mix(names.view(U) ^ U(77)) >> U(41)).astype(np.int64) % FILTER_BITS


def _sets(k: int, bits: np.ndarray):
    """Sets of the texts (text hash, text) that pass the filter."""

    def scan(batches):
        words, bit = K.Words(), np.unpackbits(bits).astype(bool)
        for batch in batches:
            seen, rows = set(), []
            wanted = batch.column(1).filter(pa.array(bit[_filter_at(batch.column(0).to_numpy())]))
            for _, s in K.shingle_sets(wanted, words, k):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                rows.append((c, s.tobytes()))
                if len(rows) == 512:
                    yield _set_rows(rows)
                    rows = []
            if rows:
                yield _set_rows(rows)

    return scan


def _set_rows(rows):
    c, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.binary())], names=["cls", "shingles"])


def _near_sketches(percent: int):
    """Drops pairs whose sketches already differ too much."""

    def scan(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            least = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
            keep = np.zeros(batch.num_rows, bool)
            a, b = batch.column(4), batch.column(5)
            for i in np.flatnonzero(least):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint8), np.frombuffer(b[i].as_buffer(), np.uint8)
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= differ(int(na[i] + nb[i]), percent)
            yield batch.select([0, 1, 6]).filter(pa.array(keep))

    return scan


def _verify(percent: int):
    def scan(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [linked(np.frombuffer(a[i].as_buffer(), U), np.frombuffer(b[i].as_buffer(), U), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scan


def near_pairs(percent: int, names, component, n, side, sketches, nearest: bool = False, run: int = 0, firsts=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile, of different components (and sides, if there are two), whose sketches may be of linked sets; or of each set the nearest ones only.

    Pairs whose ``firsts`` share a run before this one are left out: they meet there.
    """
    order = np.argsort(n, kind="stable")
    firsts = None if firsts is None else firsts[order]
    names, component, n, side = names[order], component[order], n[order], side[order]
    bits = [np.frombuffer(sketches[i].as_buffer(), np.uint8) for i in order.tolist()]
    alone, out_a, out_b = bool((side == side[0]).all()), [], []
    folded: dict[int, np.ndarray] = {}
    best, whose = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
    upto = np.searchsorted(n, n * 100 // percent, side="right")
    for i, to in enumerate(upto.tolist()):
        if to <= i + 1:
            continue
        size = len(bits[i])
        if size not in folded:
            # sizes ascend: of what comes before i nothing is asked any more
            folded, start = {size: np.stack([fold(x, size) for x in bits[i:]])}, i
        far = np.bitwise_count(folded[size][i + 1 - start : to - start].view(U) ^ bits[i].view(U)).sum(axis=1, dtype=np.int64)
        near = (far <= (n[i] + n[i + 1 : to]) * (100 - percent) // (100 + percent)) & (component[i + 1 : to] != component[i])
        if not alone:
            near &= side[i + 1 : to] != side[i]
        j = np.flatnonzero(near)
        if firsts is not None and len(j) and len(before := firsts[i][firsts[i] < run]):
            j = j[~np.isin(firsts[j + i + 1], before).any(axis=1)]
        if not len(j):
            continue
        far, j = far[j], j + i + 1
        if nearest:
            closer = far < best[j]
            best[j[closer]], whose[j[closer]] = far[closer], i
            j = j[np.argsort(far, kind="stable")[:2]]
        out_a.append(np.full(len(j), names[i]))
        out_b.append(names[j])
    if nearest:
        j = np.flatnonzero(whose >= 0)
        out_a.append(names[whose[j]])
        out_b.append(names[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _tiles(percent: int, nearest: bool):
    """Rows (tile, run, side, cls, component, n, sketch, firsts) sorted by tile: the pairs that are left of each tile, each once a batch."""

    def compare(table):
        tile = table.column("tile").to_numpy()
        names, component, n, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "component", "n", "side"))
        sketches, run, firsts = table.column("sketch"), table.column("run").to_numpy(), table.column("firsts").flatten().to_numpy().reshape(-1, FIRSTS)
        first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        a, b = [], []
        for s, e in zip(first.tolist(), np.append(first[1:], len(tile)).tolist(), strict=True):
            x, y = near_pairs(percent, names[s:e], component[s:e], n[s:e], side[s:e], sketches.slice(s, e - s), nearest, run[s], firsts[s:e])
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def whole(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def scan(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))
            if not last and held and held[-1].column(0)[-1].as_py() == tile[0]:
                held.append(batch)
                continue
            if last or held:
                yield compare(whole([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield compare(whole(held))

    return scan


def _fetched(texts: DataFrame, scanned: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """Of pairs of classes those whose sets link; the sets are made again, from one text each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    one = scanned.where("n > 0").groupBy("cls").agg(F.min("th").alias("th"), F.max("cls").alias("c"))
    bits = _filter_bits(wanted.join(one, F.col("w") == F.col("c")).select("th"))
    sets = texts.mapInArrow(lean(_sets(k, bits)), "cls long, shingles binary").dropDuplicates(["cls"])
    sets = plain(cut(sets))
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("shingles").alias(f"shingles_{s}"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", "shingles_a", "shingles_b")
        .mapInArrow(lean(_verify(percent)), "a long, b long")
    )


def links(docs: DataFrame, scanned: DataFrame, text: str = "text", percent: int = 80, k: int = K.SHINGLE) -> DataFrame:
    """Links ``(a, b)`` between classes of equal sets that connect whatever all links connect."""
    body = F.col(text).cast("string")
    hot = frequent_cells(scanned.where("cell is not null").select("cell", "counts"))
    keys = docs.select(body).mapInArrow(lean(_keys(percent, k, hot)), "key long, cls long")
    runs = plain(cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_runs), "run long, first long, second long, members binary").distinct()))
    sweep(docs.sparkSession)  # of the keys, the largest shuffle by far
    members = runs.mapInArrow(lean(_members), "run long, cls long, first long, second long")
    stars = plain(cut(members.groupBy("first", "cls").agg(F.count("*").alias("shared"))))
    texts = docs.select(F.xxhash64(body).alias("th"), body.alias("text"))
    sketched = scanned.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.max("cls").alias("c")).select(F.col("c").alias("cls"), "n", "sketch")
    side = lambda s: sketched.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    star = stars.select("cls", F.col("first").alias("pivot"), "shared").unionAll(members.where("first <> second").select("cls", F.col("second").alias("pivot"), F.lit(1).cast("long").alias("shared")))
    star = star.where("cls <> pivot").groupBy(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).agg(F.sum("shared").alias("shared"))
    near = plain(cut(
        star.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "shared")
        .mapInArrow(lean(_near_sketches(percent)), "a long, b long, shared long")
    ))
    # first of each set the pivot that it shares most with, then the others of other components
    best = near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    seen = plain(cut(best))
    near = near.select("a", "b")
    checked = plain(cut(_fetched(texts, scanned, seen, percent, k)))
    sweep(docs.sparkSession)
    runs = plain(cut(_groups(stars, members)))
    for nearest in (True, False):
        joined = components(checked, "a", "b")
        left = _left(runs, joined, sketched, percent, nearest)
        left = plain(cut((left.unionAll(_apart(near, joined)).distinct() if nearest else left).join(seen, ["a", "b"], "left_anti")))
        if not left.isEmpty():
            checked, seen = checked.unionAll(plain(cut(_fetched(texts, scanned, left, percent, k)))), seen.unionAll(left)
            sweep(docs.sparkSession)
    return checked


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose ends lie in different components."""
    of = lambda s: joined.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not coalesce(of_a = of_b, false)").select("a", "b")


def _groups(stars: DataFrame, members: DataFrame) -> DataFrame:
    """``(run, cls)``: the sets that are to meet without their first pivot, which all of them have met.

    The runs of one first pivot are one group where they are much the same: if
    they have t rows, are r runs and hold u sets, from t^2 >= r u^2 on. The squares
    of their sizes then add up to u^2 at least, so the group compares no more
    pairs than its runs would. Other runs stay by themselves.
    """
    own = F.max(F.when(F.col("cls") == F.col("first"), F.col("shared")))
    size = stars.groupBy("first").agg(F.sum("shared").cast("double").alias("t"), F.count("*").cast("double").alias("u"), own.cast("double").alias("r"), F.max("first").alias("f"))
    loose = size.where("u > 2 and t * t < r * u * u").select("f")
    met = lambda rows, how: rows.where("cls <> first").join(loose, F.col("first") == F.col("f"), how)
    return met(stars, "left_anti").select(F.col("first").alias("run"), "cls").unionAll(met(members, "left_semi").select("run", "cls").distinct())


def _left(runs: DataFrame, joined: DataFrame, sketched: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` that share a run, lie in different components and may link by their sketches; or the nearest of each set in the long runs."""
    labelled = plain(cut(runs.select("run", "cls").join(joined, F.col("cls") == F.col("node"), "left").select("run", "cls", F.coalesce("component", "cls").alias("component"))))
    mixed = labelled.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.max("run").alias("r"))
    mixed = mixed.where(f"lo <> hi and size > {RUN if nearest else 1}").select("r", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    met = labelled.join(mixed, F.col("run") == F.col("r"))
    firsts = F.slice(F.sort_array(F.collect_list("run")), 1, FIRSTS)
    firsts = F.slice(F.concat(firsts, F.array_repeat(F.lit((1 << 63) - 1), FIRSTS)), 1, FIRSTS).alias("firsts")
    known = met.groupBy("cls").agg(firsts, F.max("cls").alias("c")).select(F.col("c").alias("cls"), "firsts").join(sketched, "cls")
    dealt = met.select("run", "cls", "component", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tile = F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")).alias("tile")
    dealt = dealt.select(tile, "run", (F.col("own") > F.col("other")).alias("side"), "cls", "component").join(known, "cls")
    dealt = dealt.select("tile", "run", "side", "cls", "component", "n", "sketch", "firsts").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(lean(_tiles(percent, nearest)), "a long, b long").distinct()


def _scanned(docs: DataFrame, id: str, text: str, k: int) -> DataFrame:
    body = F.col(text).cast("string")
    return cut(docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("text")).mapInArrow(lean(_documents(k)), SCANNED))


def _named(full: DataFrame, joined: DataFrame, least) -> DataFrame:
    """``(cls, least)``: of each class the least over its component."""
    classes = full.groupBy("cls").agg(least.alias("least")).join(joined, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    classes = cut(classes)
    named = classes.groupBy("component").agg(F.min("least").alias("component_least"), F.max("component").alias("k")).select(F.col("k").alias("component"), "component_least")
    return classes.join(named, "component").select("cls", F.col("component_least").alias("least"))


def jaccard_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, k: int = K.SHINGLE) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of docs."""
    rows = _scanned(docs, id, text, k)
    found = rows.where("n is not null").select("id", "n", "cls")
    joined = components(links(docs, rows, text, percent, k), "a", "b")
    full = found.where("n > 0")
    named = _named(full, joined, F.min("id")).withColumnRenamed("least", "component_id")
    some = full.join(named, "cls").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")
    none = found.where("n = 0").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return some.unionAll(none)


def repeated_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, k: int = K.SHINGLE) -> DataFrame:
    """``(id, th, stays)`` of the rows that are not all to be kept, told apart by id and text hash.

    Of a component the row with the smallest (id, text hash) stays, null ids
    last. Rows with equal ids and texts are one entry: none of them is to be
    kept, or, with ``stays``, one.
    """
    rows = _scanned(docs, id, text, k)
    joined = components(links(docs, rows, text, percent, k), "a", "b")
    full = rows.where("n > 0").groupBy("cls", "id", "th").agg(F.count("*").alias("rows"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    named = _named(full, joined, F.min(place))
    judged = full.join(named, "cls").select("id", "th", "rows", place.eqNullSafe(F.col("least")).alias("stays"))
    return judged.where("not stays or rows > 1").select("id", "th", "stays")
