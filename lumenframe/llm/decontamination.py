"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Words are runs of letters and digits, in lower case. An item of n words is
matched by windows of n words of a document (by the whole document if that has
fewer); both are multisets of 5-word shingles (of the whole sequence, if an item
has fewer words). Their similarity is the weighted Jaccard, the sum of the
smaller counts over the sum of the larger, and a match has ``SIMILAR`` or more.

* A window that shares no shingle with an item of its size has similarity 0, so
  only windows around shared shingles are looked at; nothing else is skipped.
* Each window and item gets a 64-bit SimHash, bit by bit the weighted majority
  of its shingles' hashes. Fingerprints are cut into ``RADIUS`` + 1 blocks of eight
  bits: two within the radius agree in a block (multi-index hashing), so an
  equi-join on (size, block, value) finds all of them, and the Hamming distance is
  checked. Unrelated fingerprints share one of eight blocks with a chance of 3 %.
* At similarity 0.8 fingerprints differ in 9.7 bits of 64 on average, and blocks
  for a radius that holds all of those would be three bits wide and filter
  nothing. So windows with enough places whose shingles are of items of their
  size also meet the items that share one of their rarest shingles; with these
  pairs no match is lost, whatever its fingerprints say.
* All pairs are compared by their shingles.

Whether the benchmark side and the list of documents with shared shingles are
broadcast is settled by counting them; larger ones are joined by shuffle.

Null and empty texts and items without words match nothing. Repeated rows of a
document or an item give one row. Null ids are kept as ids; of texts that share
an id each is judged by itself, and the id gets its best window. Only ids and texts
are read. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

SIMILAR, RADIUS, SHINGLE = 0.8, 7, 5
#: Rows (a few dozen bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; an empty array for fewer words."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))


def placed_shingles(words: Column, k: int) -> Column:
    """Shingles of k words with their places."""
    return F.transform(shingles_of(words, k), lambda h, i: F.struct(h.alias("shingle"), i.alias("pos"), F.lit(k).alias("of")))


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


class Lanes:
    """64 counters packed into longs, as many lanes to a long as the largest count allows."""

    def __init__(self, most: int) -> None:
        self.width = 8 if most < 128 else 16 if most < 1 << 15 else 32
        self.lanes = 64 // self.width
        self.one = sum(1 << (self.width * i) for i in range(self.lanes))
        self.pick = sum(1 << (self.width * i + i) for i in range(self.lanes))
        self.below = self.one * ((1 << (self.width - 1)) - 1)

    def spread(self, hash: Column, part: int) -> Column:
        """A one in the lane of each set bit among the hash's bits of this part."""
        bits = F.shiftrightunsigned(hash, self.lanes * part).bitwiseAND(_long((1 << self.lanes) - 1))
        step = self.width
        while step < 64:
            bits, step = bits.bitwiseOR(F.shiftleft(bits, step)), step * 2
        # each lane keeps its own bit of the copies and carries it to the lane's top
        kept = bits.bitwiseAND(_long(self.pick)) + _long(self.below)
        return F.shiftrightunsigned(kept, self.width - 1).bitwiseAND(_long(self.one))

    def counts(self, hash: Column) -> list[Column]:
        """Sums over shingle hashes, equal ones counted as often as they stand."""
        return [F.count("*").alias("shingles"), *[F.sum(self.spread(hash, i)).alias(f"c{i}") for i in range(self.width)]]

    def fingerprint(self) -> Column:
        """SimHash, from the columns of ``counts``."""
        out = F.lit(0).cast("long")
        for i in range(self.width):
            for lane in range(self.lanes):
                often = F.shiftrightunsigned(F.col(f"c{i}"), self.width * lane).bitwiseAND(_long((1 << self.width) - 1))
                out = out.bitwiseOR(F.when(often * 2 > F.col("shingles"), _long(1 << (self.lanes * i + lane))).otherwise(F.lit(0).cast("long")))
        return out


def blocks_of(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(number, value) of each of radius + 1 blocks."""
    count, at, out = radius + 1, 0, []
    for i in range(count):
        width = 64 // count + (i < 64 % count)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append((value * count + i).alias("block"))
        at += width
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets, given as arrays."""
    often = lambda x, xs: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(often(x, a), often(x, b)))
    return both / (F.size(a) + F.size(b) - both)


def _sharing(near: DataFrame, items: DataFrame, of_window: Column, similar: float, small: bool) -> DataFrame:
    """``(row, start, number)``: windows with enough shared shingles, and the items that share a telling one."""
    # a match shares similar / (1 + similar) of both multisets; places whose shingle is of any item of that size are no fewer
    around = F.sequence(F.greatest(F.lit(0), F.col("p") - (F.col("n") - F.col("k"))), F.least("p", "last"))
    at = near.select("row", F.explode("pos").alias("p"), "n", "k", "last").where("p - (n - k) <= last")
    held = at.select("row", F.explode(around).alias("start")).groupBy("row", "start").agg(F.count("*").alias("held"))
    size = F.size(of_window)
    full = F.col("held") * (1 + similar) >= similar * (size + F.col("n") - F.col("k") + 1) - 1e-6
    windows = held.join(near, "row").where(full).select("row", "n", "start", F.explode(F.array_distinct(of_window)).alias("shingle"))
    # of an item's m shingles a match lacks at most m - similar * m: one more of them, the rarest, cannot all be missing
    each = items.select("number", "n", F.size("of_item").alias("m"), F.explode(F.array_distinct("of_item")).alias("shingle"))
    often = each.groupBy("n", "shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["n", "shingle"]).groupBy("number", "n", "m").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    most = (F.col("m") - F.ceil(similar * F.col("m") - 1e-6) + 1).cast("int")
    telling = ranked.select("number", "n", F.explode(F.slice("s", F.lit(1), most)).alias("x")).select("number", "n", "x.shingle")
    return windows.join(F.broadcast(telling) if small else telling, ["n", "shingle"]).select("row", "start", "number")


def _matching(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str = "item_id", item_text: str = "text", similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """``(id, th, item, n, start, similarity)`` of all windows that match; th is the text's hash."""
    words = words_of(F.col(item_text).cast("string"))
    items = benchmark.select(F.col(item).alias("item"), words.alias("words")).where("size(words) > 0").distinct()
    k = F.least(F.lit(SHINGLE), F.size("words"))
    items = items.select("item", F.size("words").alias("n"), k.alias("k"), *[shingles_of(F.col("words"), j).alias(f"s{j}") for j in range(1, SHINGLE + 1)])
    chosen = F.coalesce(*[F.when(F.col("k") == j, F.col(f"s{j}")) for j in range(1, SHINGLE + 1)])
    # an id may name several texts, or be null: items go by a number of their own
    items = cut(items.select(F.monotonically_increasing_id().alias("number"), "item", "n", "k", chosen.alias("of_item")))
    shape = items.agg(F.collect_set("k").alias("k"), F.max(F.size("of_item")).alias("most"), F.sum(F.size("of_item")).alias("rows")).first()
    lanes = Lanes(shape.most or 0)
    small = (shape.rows or 0) <= BROADCAST_ROWS
    prints = items.select("number", "n", F.explode("of_item").alias("shingle")).groupBy("number", "n").agg(*lanes.counts(F.col("shingle"))).select("number", "n", lanes.fingerprint().alias("item_print"))
    offered = prints.select("number", "n", "item_print", F.explode(blocks_of(F.col("item_print"), radius)).alias("block"))
    known = items.select(F.explode("of_item").alias("shingle"), "n", "k").distinct().groupBy("shingle").agg(F.collect_set(F.struct("n", "k")).alias("sizes"), F.max("shingle").alias("held")).select(F.col("held").alias("shingle"), "sizes")

    named = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text")).where("text is not null")
    # words are a column of their own: inside a lambda their expression would be evaluated again and again
    worded = named.select("id", "th", words_of(F.col("text")).alias("words"))
    if shape.k == [SHINGLE]:
        placed = worded.select("id", "th", F.posexplode(shingles_of(F.col("words"), SHINGLE)).alias("pos", "shingle")).withColumn("of", F.lit(SHINGLE))
    elif shape.k:
        every = F.flatten(F.array(*[placed_shingles(F.col("words"), j) for j in sorted(shape.k)]))
        placed = worded.select("id", "th", F.explode(every).alias("x")).select("id", "th", "x.pos", "x.shingle", "x.of")
    else:
        placed = named.select("id", "th", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("of")).where("false")
    hits = placed.join(F.broadcast(known) if small else known, "shingle").select("id", "th", "pos", F.explode("sizes").alias("x")).where("x.k = of").select("id", "th", "pos", "x.n", "x.k")
    ranges = cut(hits.groupBy("id", "th", "n", "k").agg(F.collect_set("pos").alias("pos")))

    hit = ranges.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th")).distinct()
    same = (F.col("th") == F.col("hit_th")) & F.col("id").eqNullSafe(F.col("hit_id"))
    # texts without a hit are left behind before any is moved; the places, lists as long as they may be, are joined to what is left
    few = hit.count() <= BROADCAST_ROWS
    met = named.join(F.broadcast(hit), same, "left_semi") if few else named
    held = ranges.withColumnsRenamed({"id": "hit_id", "th": "hit_th"})
    near = met.join(held, same).select("id", "th", "n", "k", "pos", words_of(F.col("text")).alias("words"))
    of_doc = F.coalesce(*[F.when(F.col("k") == j, shingles_of(F.col("words"), j)) for j in sorted(shape.k) or [SHINGLE]])
    last = F.greatest(F.lit(0), F.size("words") - F.col("n"))
    around = F.transform("pos", lambda p: F.sequence(F.greatest(F.lit(0), p - (F.col("n") - F.col("k"))), F.greatest(F.lit(0), F.least(p, last))))
    starts = F.array_distinct(F.flatten(F.filter(around, lambda x: F.size(x) > 0)))
    near = cut(near.select(F.monotonically_increasing_id().alias("row"), "id", "th", "n", "k", of_doc.alias("of_doc"), F.filter(starts, lambda x: x <= last).alias("starts"), "pos", last.alias("last")))
    of_window = F.slice("of_doc", F.col("start") + 1, F.col("n") - F.col("k") + 1)
    windows = near.select("row", "n", "k", "of_doc", F.explode("starts").alias("start")).select("row", "n", "start", F.explode(of_window).alias("shingle"))
    prints = windows.groupBy("row", "n", "start").agg(*lanes.counts(F.col("shingle"))).select("row", "n", "start", lanes.fingerprint().alias("print"))
    asked = prints.withColumn("block", F.explode(blocks_of(F.col("print"), radius)))
    close = asked.join(F.broadcast(offered) if small else offered, ["n", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = close.select("row", "start", "number")
    sharing = _sharing(near, items, of_window, similar, small)
    pairs = pairs.unionAll(sharing).distinct()
    whole = items.select("number", "item", "of_item")
    judged = (
        pairs.join(near, "row").join(F.broadcast(whole) if small else whole, "number")
        .select("id", "th", "item", "n", "start", similarity(of_window, F.col("of_item")).alias("similarity"))
    )
    return judged.where(F.col("similarity") >= similar)


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", **how) -> DataFrame:
    """``(id, item, similarity, start, size)``: for each document and item that match, the best window (then the first)."""
    best = _matching(docs, benchmark, id, text, item, **how).groupBy("id", "item").agg(F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"), "n")).alias("best"))
    return best.select(F.col("id").alias(id), F.col("item").alias(item), "best.similarity", "best.start", F.col("best.n").alias("size"))


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows whose text matches no item, whatever other rows share their id; all columns as they are."""
    found = cut(_matching(docs, benchmark, id, text, **how).select(F.col("id").alias("__hit"), F.col("th").alias("__hit_th")).distinct())
    few = found.count() <= BROADCAST_ROWS
    same = docs[id].eqNullSafe(F.col("__hit")) & (F.xxhash64(docs[text].cast("string")) == F.col("__hit_th"))
    return docs.join(F.broadcast(found) if few else found, same, "left_anti")
