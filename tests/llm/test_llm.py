"""Operators of the subpackage against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, jaccard_join, language_model, line_dedup, nearest, quality, suffix_array, suffix_dedup, toxicity, url_filter
from lumenframe.llm import kernels as K

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"
EDGE = [(900, None), (901, ""), (902, " \n\t"), (None, "one two three four five six seven"), (903, "x" * 3000), (904, "ä" * 200), (905, "w " * 400)]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def documents(seed=1, n=60):
    """Random texts with exact and near copies, shared lines and passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 25)))
    shared = [line() for _ in range(4)]
    out = []
    for i in range(n):
        if i > 5 and r.random() < 0.35:
            text = r.choice(out)[1]
            w = text.split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = "\n".join(r.choice(shared) if r.random() < 0.2 else line() for _ in range(r.randint(1, 8)))
        out.append((i, text))
    return out


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def extra(df):
    """Columns that clash with the operators' own."""
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "n", "cls", "key", "component_id", "words", "th", "tag", "rank", "score", "host")])


@pytest.mark.parametrize("edits, most", [(0, 1), (1, 3), (2, 7.5), (3, 13)])
def test_lines_within_the_edits_share_a_key_of_few(edits, most):
    r, rows, lines = random.Random(edits), 0, line_dedup.Lines(edits)
    for _ in range(1000):
        one = bytes(r.choice(b"abcdefgh") for _ in range(r.randrange(edits + 1, 40)))
        two = bytearray(one)
        for _ in range(edits):
            at, kind = r.randrange(len(two) + 1), r.randrange(3)
            two[at : at + (kind > 0)] = bytes([r.choice(b"abcdefgh")]) if kind < 2 else b""
        lines.data = np.frombuffer(one + bytes(two), np.uint8)
        lines.starts, lines.ends = np.array([0, len(one)]), np.array([len(one), len(one) + len(two)])
        keys = [{}, {}]
        for fits, key, index in lines.keys(np.arange(2)):
            for i in np.flatnonzero(fits):
                keys[i][key[i]] = index or keys[i].get(key[i], False)
                rows += 1
        assert not two or any(k in keys[1] and (own or keys[1][k]) for k, own in keys[0].items())
    assert rows <= most * 2000  # of two edits 12 each, when every length had keys of its own


# -- jaccard ----------------------------------------------------------------


def check_jaccard(spark, docs):
    got = {r.doc_id: r for r in jaccard_join.jaccard_groups(extra(spark.createDataFrame(docs, SCHEMA))).collect()}
    sets = {i: shingles(t) for i, t in docs if i is not None}
    u = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            u.join(a, b)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id) == (len(s), u.root(i))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    check_jaccard(spark, documents(seed) + EDGE)


def test_jaccard_with_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 3)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    check_jaccard(spark, documents(3, 90))


def test_jaccard_crowds_at_default_settings(spark):
    """Three families of near copies, each far larger than a run, one of them a chain; and texts in between."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(4000)}"
    docs, base = [], [[word() for _ in range(120)] for _ in range(2)]
    for k in range(2):
        for _ in range(80):
            w = list(base[k])
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    chain = [word() for _ in range(120)]
    for _ in range(80):  # each differs from the one before in a word, so its ends have nothing in common
        chain[r.randrange(120)] = word()
        docs.append((len(docs), " ".join(chain)))
    r.shuffle(docs)
    check_jaccard(spark, docs)


def shuffled(spark, done):
    """Bytes that an action writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    done()
    return total() - before


def test_jaccard_shuffle_grows_with_the_texts(spark):
    """Texts of frequent lines are chained by what they share: sets must not travel to every tile of all that is chained."""
    r = random.Random(5)
    lines = [" ".join(f"w{r.randrange(4000)}" for _ in range(12)) for _ in range(60)]
    texts = [(i, " ".join(r.sample(lines, 6))) for i in range(6000)]
    took = [shuffled(spark, lambda m=m: jaccard_join.jaccard_groups(spark.createDataFrame(texts[:m], SCHEMA)).collect()) for m in (1500, 6000)]
    print("bytes shuffled", took)
    assert took[1] < 10 * took[0]  # of four times the texts; 16 were the square


def test_jaccard_shuffles_a_near_copy_once_and_not_for_each_block(spark):
    """Copies on either side of the threshold share most of their blocks, each with other copies."""
    r = random.Random(8)
    word, docs = lambda: f"w{r.randrange(4000)}", []
    for _ in range(2):
        base = [word() for _ in range(400)]
        for _ in range(120):
            w = list(base)
            for _ in range(r.randrange(14)):
                w[r.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    took = shuffled(spark, lambda: check_jaccard(spark, docs))
    print("bytes shuffled a text", took / len(docs))
    assert took < 18_000 * len(docs)  # the published keys and one set are 5 000


def test_runs_of_one_pivot_meet_together_where_they_are_much_the_same(spark):
    crowd, lines = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 3, 4, 5])], [(4, [7, 8, 9]), (5, [7, 10, 11]), (6, [7, 12, 13])]
    members = spark.createDataFrame([(run, c, who[0], who[0]) for run, who in crowd + lines for c in who], "run long, cls long, first long, second long")
    stars = members.groupBy("first", "cls").agg(F.count("*").alias("shared"))
    groups = {}
    for x in jaccard_join._groups(stars, members).collect():
        groups.setdefault(x.run, []).append(x.cls)
    assert {run: sorted(who) for run, who in groups.items()} == {1: [2, 3, 4, 5], 4: [8, 9], 5: [10, 11], 6: [12, 13]}


def test_pairs_of_runs_that_are_almost_the_same_meet_once():
    r = np.random.default_rng(4)
    base = K.mix(np.arange(60, dtype=np.uint64))
    sets = [np.sort(np.concatenate((base[r.random(60) < 0.93], K.mix(r.integers(100, 1 << 40, 5).astype(np.uint64))))) for _ in range(40)]
    names, n, side = np.arange(40), np.array([len(x) for x in sets]), np.zeros(40, bool)
    sketches = [pa.scalar(jaccard_join.sketch_of(x), pa.binary()) for x in sets]
    runs = {run: np.flatnonzero(r.random(40) < 0.9) for run in range(1, 16)}
    firsts = np.array([([run for run, who in runs.items() if i in who] + [1 << 62] * 8)[:8] for i in range(40)])
    tell = lambda run, who, f: zip(*jaccard_join.near_pairs(80, names[who], names[who], n[who], side[who], [sketches[i] for i in who], run=run, firsts=f), strict=True)
    plain = [frozenset((int(a), int(b))) for run, who in runs.items() for a, b in tell(run, who, None)]
    once = [frozenset((int(a), int(b))) for run, who in runs.items() for a, b in tell(run, who, firsts[who])]
    linked = {frozenset((a, b)) for a, b in itertools.combinations(range(40), 2) if jaccard_join.linked(sets[a], sets[b], 80)}
    assert set(once) == set(plain) and len(once) < len(plain) / 5
    assert linked and linked <= set(plain)


def test_lines_crowds_at_default_settings(spark):
    """Lines of one length with one beginning and one end, more than a run holds; copies with up to three edits among them."""
    r = random.Random(22)
    lines = ["the common beginning " + "".join(r.choice("abcdefgh") for _ in range(24)) + " the common end" for _ in range(330)]
    docs = [(i, x) for i, x in enumerate(lines)]
    for x in lines[:60]:
        y = list(x)
        for _ in range(r.randint(1, 3)):
            y[r.randrange(22, 44)] = r.choice("abcdefgh")
        docs.append((len(docs), "".join(y)))
    check_lines(spark, docs)


def test_published_keys_meet():
    r = np.random.default_rng(0)
    bands, cold = jaccard_join.Bands(80), np.zeros(jaccard_join.CELLS, bool)
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a
        while True:
            c = np.unique(np.concatenate((np.delete(b, r.integers(0, len(b))), r.integers(0, 2**63, 1).astype(np.uint64)))) if len(b) > 1 else b
            if not jaccard_join.linked(a, c, 80) or r.random() < 0.02 or len(b) <= 1:
                break
            b = c
        assert np.intersect1d(jaccard_join.published(a, bands, cold), jaccard_join.published(b, bands, cold)).size


# -- lines ------------------------------------------------------------------


def check_lines(spark, docs):
    df = extra(spark.createDataFrame(docs, SCHEMA))
    done = line_dedup.dedup_lines(df)
    assert done.columns == [*df.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in done.collect()}
    solid = sorted({x.strip(" \t\n\x0b\x0c\r") for _, t in docs for x in (t or "").split("\n")} - {""})
    u = Union(solid)
    for a, b in itertools.combinations(solid, 2):
        x, y = a.encode(), b.encode()
        # an edit changes one byte of the multiset at most
        if min(len(x), len(y)) >= 16 and abs(len(x) - len(y)) <= 2 and sum((collections.Counter(x) - collections.Counter(y)).values()) <= 2 and distance(x, y) <= 2:
            u.join(a, b)
    seen = set()
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if t is None:
            assert got[i].text is None
            continue
        kept = []
        for x in t.split("\n"):
            s = x.strip(" \t\n\x0b\x0c\r")
            if s and u.root(s) in seen:
                continue
            seen |= {u.root(s)} if s else set()
            kept.append(x)
        assert got[i].text == "\n".join(kept)


def test_lines(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(10, 40))) for _ in range(40)]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                j = r.randrange(len(x))
                x[j : j + r.randint(0, 1)] = r.choice(["", "a", "b"])
            lines += ["".join(x) + r.choice(["", " "])] + [""] * (r.random() < 0.1)
        docs.append((i, "\n".join(lines)))
    check_lines(spark, docs + EDGE[:-1])


def test_lines_with_crowded_segments(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN", 2)
    monkeypatch.setattr(line_dedup, "TILE", 3)
    check_lines(spark, [(i, "common start of the line " + "abcdefghij"[i % 10] * (1 + i % 3) + " common end") for i in range(30)])


def test_banded_distance():
    r = random.Random(7)
    for edits in range(4):
        a = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(400)]
        b = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) if r.random() < 0.5 else x[: r.randint(0, 12)] for x in a]
        assert line_dedup.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b)]


# -- suffix arrays ----------------------------------------------------------


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def check_strings(spark, docs):
    got = {(r.doc_id, r.n_bytes, r.kept): r for r in suffix_dedup.dedup_strings(extra(spark.createDataFrame(docs, SCHEMA))).collect()}
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            key = b[s : s + 50]
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 50, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (math.inf if i is None else i):
                gone[s : s + 50] = True
        gone = gone[: len(b)]
        row = got[i, len(b), np.frombuffer(b, np.uint8)[~gone].tobytes()]
        assert sum(s.end - s.start for s in row.spans) == gone.sum()
        assert len(row.spans) == (np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_strings(spark, seed):
    check_strings(spark, documents(seed) + EDGE + [(903, "x" * 200), (5, "x" * 120)])


def test_strings_in_slabs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 8)
    docs = [(i, chr(97 + i % 26) * 30 + " a passage that very many of the documents hold, word by word " + chr(97 + i // 26) * 30) for i in range(60)]
    check_strings(spark, docs)


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 2000).astype(np.uint8)
    anchors = suffix_dedup.anchors
    whole = {int(s): (int(a), int(h)) for _, x, y, a, h in zip(*anchors(data, np.array([0, 2000]))) for s in range(x, y + 1)}
    cut = {}
    for _, rows, part, place in suffix_dedup.pieces(data, np.array([0, 2000])):
        for _, x, y, a, h in zip(*anchors(part, rows)):
            cut |= {int(s + place): (int(a + place), int(h)) for s in range(x, y + 1)}
    assert cut == whole and len(whole) == 1951


# -- language model ---------------------------------------------------------


class Reader:
    """The backoff automaton as dictionaries, read word by word with one carried state (a tuple of words)."""

    def __init__(self, docs, strength):
        self.strength, self.order = strength, len(strength) + 1
        self.count, self.total = collections.Counter(), 0
        for i, t in docs:
            if not held(i):
                w = ["<s>", *words(t), None]
                self.total += len(w) - 1
                for n in range(1, self.order + 1):
                    self.count.update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
        self.known = {g[0] for g in self.count if len(g) == 1} - {"<s>"}

    def p(self, history, w):
        if not history:
            return (self.count[w,] + 0.5) / (self.total + 0.5 * (len(self.known) + 1))
        m = self.strength[len(history) - 1]
        return (self.count[(*history, w)] + m * self.p(history[1:], w)) / (self.count[history] + m)

    def is_state(self, history):
        return not history or (len(history) < self.order and self.count[history] > 0)

    def read(self, text):
        state, out = (("<s>",) if self.is_state(("<s>",)) else ()), 0.0
        for w in [*words(text), None]:
            while state and not self.count[(*state, w)]:
                m = self.strength[len(state) - 1]
                out += math.log10(m / (self.count[state] + m))
                state = state[1:]
            out += math.log10(self.p(state, w))
            state = (*state, w)
            while not self.is_state(state):
                state = state[1:]
        return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("strength", [(20.0, 3.0), (), (7.0,), (20.0, 3.0, 2.0)])
def test_language_model(spark, monkeypatch, strength):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(language_model, "SHARD_KEYS", 500)
    docs = documents(4) + EDGE
    rows = language_model.score(extra(spark.createDataFrame(docs, SCHEMA)), strength=strength).collect()
    assert len(rows) == len(docs)
    got = {(r.doc_id, r.n_tokens): r for r in rows}
    reader = Reader(docs, strength)
    p = lambda x: reader.p((), x)
    for i, t in docs:
        w = [*words(t), None]
        r = got[i, len(w)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(x in reader.known for x in w), reader.total)
        assert r.base_score == pytest.approx(sum(math.log10(p(x)) for x in w))
        assert r.score == pytest.approx(reader.read(t))


def test_probabilities_of_a_history_sum_to_one():
    docs = documents(4)
    reader = Reader(docs, (20.0, 3.0))
    for history in [(), ("<s>",), *[g for g in reader.count if len(g) == 2 and None not in g][:40]]:
        unseen = reader.p(history, "never seen")
        assert sum(reader.p(history, w) for w in reader.known) + unseen == pytest.approx(1)


def test_language_model_without_training_documents(spark):
    kept = [(i, "a b a") for i in range(100) if held(i)]
    for r in language_model.score(spark.createDataFrame(kept, SCHEMA)).collect():
        assert (r.train_tokens, r.n_known, r.score) == (0, 0, pytest.approx(0.0))


# -- urls -------------------------------------------------------------------


def test_urls(spark):
    hosts = ["com", "a.com", "example.com", "x.example.com", "notexample.com", "EXAMPLE.Net", "b.org", "net", "a..com", "com.", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/en", "/de/8", "/de/1", "/es/?q=/en/7", "/es/#x", "?/en/7"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme.com/en/", "a://b://c.com/en/", "x\n://com/en/7"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            m = re.match(r"([^/?#]*)([^?#]*)", rest)
            host, path = m[1].translate(FOLD), m[2]
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    none = url_filter.judge(spark.createDataFrame([], "page_id long, url string"))
    assert none.count() == 0
    many = url_filter.rules_frame(spark, [])
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), many).collect()} == {"allow"}


def test_rules_of_the_contract(spark):
    """Each rule's word, by a url that it alone decides."""
    want = {"a.com/en/1": "block", "x.example.com/en/71": "allow", "b.net/de/1": "allow", "x.example.net/de/80": "block", "example.net/de/1": "allow", "b.org/es/": "block", "b.org/en/": "allow"}
    pages = spark.createDataFrame([(u, f"http://{u}") for u in want], "page_id string, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == want


# -- nearest ----------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 300)
    r = np.random.default_rng(2)
    v = r.normal(size=(900, 12)).astype(np.float32)
    v[100:400] = v[7]
    rows = [(i, v[i].tolist()) for i in range(900)]
    bad = [(901, None), (902, []), (903, [0.0] * 12), (904, [float("nan")] + [1.0] * 11), (905, [None] + [1.0] * 11), (906, [float("inf")] + [1.0] * 11), (None, [1.0] * 12), (920, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = nearest.search(df, df.where("vec_id % 20 = 0")).toPandas()
    assert got[got.query_id == 920].empty
    hit = total = 0
    for q in range(0, 900, 20):
        s = v.astype(float) @ v[q].astype(float)
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], s[mine["vec_id"]])
        assert (np.diff(mine["score"]) <= 1e-12).all()
        hit, total = hit + len(set(want) & set(mine["vec_id"])), total + 20
    assert hit / total >= 0.9
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert nearest.search(few, few.where("vec_id % 20 = 0")).count() == 4
    assert nearest.search(few.where("false"), few.where("false")).count() == 0


def test_repeated_query_rows_are_one_query(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [rows[19], (40, r.normal(size=8).tolist())]  # 20 twice with one vector, 40 with two
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id = 20 or vec_id = 40")).toPandas()
    mine = got[got.query_id == 20].sort_values("rank")
    v = np.array(rows[19][1])
    want = sorted(((-float(np.dot(v, x)), i) for i, x in rows if i != 20))[:20]
    assert mine.vec_id.tolist() == [i for _, i in want] and mine["rank"].tolist() == list(range(1, 21))
    assert sorted(got[got.query_id == 40]["rank"]) == sorted(list(range(1, 21)) * 2)


def test_recall_and_share_looked_at_of_a_whole_shard():
    """A full shard of vectors as the tables hold them: directions with groups of near copies."""
    r = np.random.default_rng(3)
    v = r.normal(size=(nearest.SHARD // 2, 64))
    v[: len(v) // 4] = v[r.integers(0, 400, len(v) // 4)] + 0.05 * r.normal(size=(len(v) // 4, 64))
    v = np.vstack((v, v + 0.6 * r.normal(size=v.shape)))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph, count = nearest.Graph(v), 256
    queries = graph.vectors[r.integers(0, len(v), count)]
    got = np.concatenate([graph.search(queries[a : a + nearest.BLOCK], 21)[0] for a in range(0, count, nearest.BLOCK)])
    want = np.argsort(-(queries @ graph.vectors.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(got, want)]) >= 0.9
    assert graph.looked / count < 0.05 * len(v)


# -- decontamination --------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 9, 20, 30, 60])))) for i in range(20)] + [(99, None), (98, "")]
    docs = []
    for d in range(50):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 3 == 0:
            x = items[r.randrange(20)][1].split()
            for _ in range(r.choice([0, 0, 1])):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            w[len(w) // 2 : len(w) // 2] = [y.upper() + "," for y in x] if d % 2 else x
        docs.append((d, " ".join(w)))
    cut = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    want = {}
    for (d, t), (i, x) in itertools.product(docs, items[:20]):
        w, v = cut(t), cut(x)
        k = min(5, len(v))
        bag = lambda z: collections.Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1))
        best = 0
        for s in range(max(1, len(w) - len(v) + 1)):
            a, b = bag(w[s : s + len(v)]), bag(v)
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
        if best >= 0.8:
            want[d, i] = best
    df, bench = extra(spark.createDataFrame(docs + EDGE[:6], SCHEMA)), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontamination.matches(df, bench).collect()}
    assert got == pytest.approx(want)
    left = {x.doc_id for x in decontamination.clean(df, bench).collect()}
    assert left == {d for d, _ in docs + EDGE[:6]} - {d for d, _ in want}
    assert decontamination.matches(df, bench.where("false")).count() == 0
    plan = decontamination.matches(df, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_items_that_share_an_id_or_have_none(spark):
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    texts = [text(n) for n in [12, 20, 40] * 20]
    bench = [(1 if i < 30 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in decontamination.matches(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(i, item): (1.0, 0) for i, (item, _) in enumerate(bench)}


def test_matches_beyond_the_radius(spark):
    r = random.Random(10)
    items = [[f"w{r.randrange(60)}" for _ in range(r.choice([1, 4, 7, 45, 60, 90]))] for _ in range(30)]
    docs = []
    for x in items:
        w = list(x)
        if len(w) >= 45:
            w[r.randrange(5, len(w) - 5)] = "other"
        docs.append((len(docs), " ".join(["before", "it", *w, "after"] if len(docs) % 2 else w)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = lambda **how: {(x.doc_id, x.item_id): x.similarity for x in decontamination.matches(spark.createDataFrame(docs, SCHEMA), bench, **how).collect()}
    wide, narrow = found(), found(radius=1)
    assert any(0.75 < s < 0.95 for s in wide.values()) and narrow == wide


# -- bpe --------------------------------------------------------------------


def test_bpe(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library, codec = tokenizers.Tokenizer.from_file(path), bpe.Codec(open(path).read())
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE 0123456789'’.,!?$%#\n\t\x0b\x1c\x1f\x85\xa0\u200b\u3000\ufeffÀéñßΣσςİıŁ漢字한👍🏽\u0301<|>Ⅷ²½\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>x", "<|startoftext|>"]) for _ in range(500)] + ["a" * 3000, "the" * 999, None, ""]
    got = {x.doc_id: x for x in bpe.encode_documents(extra(spark.createDataFrame(list(enumerate(texts)), SCHEMA)), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids == codec.encode(t or "") and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    one = bpe.digests(bpe.encode_documents(spark.createDataFrame([(1, "the cat")], SCHEMA), path), "doc_id").first()
    ids = library.encode("the cat", add_special_tokens=False).ids
    assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_memory(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "KEPT_BYTES", 1 << 20)
    codec, r = bpe.Codec(open(path).read()), random.Random(2)
    size = lambda x: sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if isinstance(x, list) else 0)
    most = 0
    for letters in ("abcdefghijklmnopqrstuvwxyz", "漢字한글かなжщю"):
        for _ in range(200):
            codec.encode(" ".join("".join(r.choice(letters) for _ in range(20)) for _ in range(50)))
            kept = [codec.words, codec.old]
            most = max(most, sum(sys.getsizeof(x) + sum(map(size, x)) + sum(map(size, x.values())) for x in kept))
    assert bpe.KEPT_BYTES / 2 < most <= bpe.KEPT_BYTES
    # texts of 12 MB reach a worker in small batches, unless the session was told a size of its own
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    before = spark._jsparkSession.conf().contains("spark.sql.execution.arrow.maxBytesPerBatch")
    for session, least, limit in ((spark, 3, 4 << 20), (own, 1, 32 << 20)):
        docs = session.range(600).selectExpr("id doc_id", "repeat('word ', 4000) text").coalesce(1)
        bpe.encode_documents(docs, path)
        sizes = [x.n for x in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert len(sizes) >= least and max(sizes) <= limit and sum(sizes) >= 12e6
    if not before:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


# -- classifiers ------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(9)
    vocabulary, foul = [f"v{i}" for i in range(300)], ["vile", "foul", "nasty"]
    docs, labels = [], []
    for i in range(1200):
        w = [r.choice(vocabulary) for _ in range(r.randint(10, 200))]
        bad = i % 5 == 0
        for _ in range(r.choice([1, 3, 8]) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(foul).upper())
        docs.append((2000 + i, " ".join(w)))
        if i % 2 == 0:
            labels.append((2000 + i, int(bad)))
    df = extra(spark.createDataFrame(docs + EDGE, SCHEMA))
    table = spark.createDataFrame(labels + [(2001, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, table)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(df, model).toPandas()
    assert len(got) == len(docs) + len(EDGE)
    odd = got[(got.doc_id % 2 == 1) & (got.doc_id >= 2000)]
    assert ((odd.doc_id % 5 == 0) == odd.rejected).mean() > 0.98
    assert not got[got.doc_id.isin([900, 901, 902])].rejected.any()
    none = toxicity.score(df, toxicity.train(df, table.where("false"))).toPandas()
    assert not none.rejected.any() and (none.severity == 0).all()


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "of", "and", "report", "evening", "river", "carefully"]) + r.choice(["", "", ",", "."]) for _ in range(r.randint(20, 120)))
    junk = [lambda: " ".join(f"w{r.randint(0, 9)}$$$" for _ in range(60)), lambda: "SHOUT!! " * 40, lambda: " | ".join("cell" + str(i) for i in range(50)), lambda: "same " * 80]
    docs = [(i, r.choice(junk)() if i % 6 == 0 else good()) for i in range(600)]
    got = quality.classify(extra(spark.createDataFrame(docs + EDGE, SCHEMA))).toPandas()
    assert len(got) == len(docs) + len(EDGE)
    made = got[got.doc_id < 600]
    assert ((made.doc_id % 6 != 0) == made.keep).mean() > 0.95
    assert quality.classify(spark.createDataFrame([], SCHEMA)).count() == 0


# -- different texts that polynomial hashes take for one -----------------------


def thue_morse():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_thue_morse_words(spark):
    one, two = thue_morse()
    assert jaccard_join.jaccard_groups(spark.createDataFrame([(1, one), (2, two)], SCHEMA)).where("doc_id <> component_id").count() == 0
    lines = spark.createDataFrame([(1, one + "\n" + two), (2, two)], SCHEMA)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(lines).collect()} == {1: one + "\n" + two, 2: ""}
    docs = [(i, (one + " ") * 9 if i % 2 else two) for i in range(40)]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(docs, SCHEMA)).collect()}
    reader = Reader(docs, language_model.STRENGTH)
    assert all(r.score == pytest.approx(reader.read(dict(docs)[i])) for i, r in got.items())


# -- rows of one id -------------------------------------------------------------


def test_strings_of_many_rows_of_one_id(spark):
    r = random.Random(12)
    passage = "a passage that stands in very many of the texts, with more than fifty bytes"
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(40)) + passage * (r.random() < 0.3) + "".join(r.choice("abcdefgh ") for _ in range(30))
    rows = [(None, text()) for _ in range(150)] + [(7, text()) for _ in range(150)] + [(3, text())] + [(5, passage)] * 30
    check_strings(spark, rows)


def test_lines_bounds(spark):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA), edits=31)
    docs = spark.createDataFrame([(1, "short line"), (2, "shirt line")], SCHEMA)
    assert line_dedup.dedup_lines(docs).where("n_removed > 0").count() == 0
    assert line_dedup.dedup_lines(docs, shortest=5).where("n_removed > 0").count() == 1


def test_names_of_our_own_columns(spark):
    """Columns named as the operators' own are handed on."""
    clash = [f"c{i}" for i in range(4)] + ["__gone", "__id", "__th", "__lines", "gone", "own_id", "lines", "token_ids", "n_tokens", "decoded", "th", "cls"]
    docs = spark.createDataFrame([(1, "a line that is long enough\nx"), (2, "a line that is long enough")], SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_removed"] and {r.n_removed for r in done.collect()} == {0, 1}
    public = pytest.importorskip("public_tokenizers")
    coded = bpe.encode_documents(docs, public.path("word_bpe_49k.json"), keep=docs.columns, into=("x", "y", "z"))
    assert coded.columns == [*docs.columns, "x", "y", "z"] and coded.count() == 2
    assert bpe.encode_documents(docs.where("false"), public.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_documents(docs.unionAll(docs), public.path("word_bpe_49k.json")).count() == 4


# -- empty tables and the pipeline ------------------------------------------


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_groups(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert suffix_dedup.dedup_strings(none).count() == 0
    assert language_model.score(none).count() == 0
    assert decontamination.matches(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_stages_judge_rows_not_ids(spark):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, b, c, d, e, f, leak = (text() for _ in range(7))
    rows = [
        (1, a), (None, near(a)),  # a near copy without an id
        (None, b), (None, near(b)), (None, text()),  # null ids only
        (2, c), (2, c), (2, c),  # one row three times
        (None, d), (None, d),
        (3, e), (4, near(e)), (4, f),  # an id with two texts, one a near copy
        (5, None), (5, None), (None, ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collections.Counter((x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    of_b = [x for x in got if x[1] in (b, near(b))]
    assert len(of_b) == 1
    want = [(1, a), of_b[0], rows[4], (2, c), (None, d), (3, e), (4, f), (5, None), (5, None), (None, "")]
    assert got == collections.Counter(want)

    rows = [(None, a + " " + leak), (None, b), (6, leak), (6, c), (7, d), (7, d), (8, leak), (8, leak), (None, None)]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = decontamination.clean(spark.createDataFrame(rows, SCHEMA), bench)
    assert collections.Counter((x.doc_id, x.text) for x in left.collect()) == collections.Counter([(None, b), (6, c), (7, d), (7, d), (None, None)])


def lines_left(rows):
    """Texts without repeated lines, by brute force; rows are (id, text) in order."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    solid = sorted({strip(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    u, by_length = Union(solid), collections.defaultdict(list)
    for x in solid:
        if len(x.encode()) >= line_dedup.SHORTEST:
            by_length[len(x.encode())].append(x)
    for n, some in by_length.items():
        for m in range(n, n + line_dedup.EDITS + 1):
            for a in some:
                for b in by_length.get(m, ()):
                    # pairs further apart than the edits differ in more places of their sorted bytes as well
                    if a != b and sum((collections.Counter(a.encode()) - collections.Counter(b.encode())).values()) <= line_dedup.EDITS and line_dedup.EDITS >= distance(a.encode(), b.encode()):
                        u.join(a, b)
    seen, out = set(), []
    for i, t in rows:
        kept, solid = [], 0
        for x in (t or "").split("\n"):
            solid += bool(strip(x))
            if strip(x) and u.root(strip(x)) in seen:
                continue
            seen |= {u.root(strip(x))} if strip(x) else set()
            kept.append(x)
        if t is None or not solid or any(strip(x) for x in kept):
            out.append((i, None if t is None else "\n".join(kept)))
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    """Every stage against brute force on its own input; toxicity, which is fitted, against its labels."""
    import corpus_pipeline

    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in now.collect())
        now = stage(spark, now, sf).cache()
        after = {r.doc_id: r.text for r in now.collect()}
        kept[name] = set(after)
        if name != "bpe":
            assert now.columns == docs.columns
            assert now.where("n_chars <> length(text)").count() == 0 or name == "toxicity"
        if name == "toxicity":
            told = [(i in after, toxic[i]) for i, _ in before if i in toxic]
            assert sum(stays != bool(t) for stays, t in told) / len(told) > 0.95
            assert all(after[i] == t for i, t in before if i in after)
        if name == "line_dedup":
            assert sorted(after.items()) == lines_left(before)
        if name == "ngram_jaccard_join":
            u, sets = Union(dict(before)), {i: shingles(t) for i, t in before}
            for a, b in itertools.combinations(sets, 2):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    u.join(a, b)
            assert kept[name] == {i for i, _ in before if u.root(i) == i}
        if name == "decontamination":
            assert kept[name] == {i for i, t in before if not any(holds(t, x) for _, x in items)}
        if name == "bpe":
            for r in now.collect():
                ids = library.encode(r.text, add_special_tokens=False).ids
                assert (r.token_ids, r.n_tokens) == (ids, len(ids))
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    run = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in run.select("doc_id").collect()} == kept["bpe"]
    assert run.where("size(token_ids) <> n_tokens").count() == 0


def holds(text, item):
    """Has a window of the text a weighted shingle similarity of 0.8 or more with the item?"""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, v = cut(text), cut(item)
    k = min(5, len(v))
    bag = lambda z: collections.Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1))
    want = bag(v)
    where = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in want]
    starts = {s for j in where for s in range(max(0, j - (len(v) - k)), min(j, max(0, len(w) - len(v))) + 1)}
    return any(10 * sum((a & want).values()) >= 8 * sum((a | want).values()) for a in (bag(w[s : s + len(v)]) for s in starts)) if v else False


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, shared ids, repeated rows, empty tables, a column more."""
    import corpus_pipeline

    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(40))
    a, b, item = text(), text(), text()
    schema = "doc_id long, text string, lang string, source string, n_chars long, token_ids int, __lines int"
    rows = [(1, a, "en", "s", len(a), 1, 1), (None, a, None, None, None, None, None), (2, b, "en", "s", len(b), 1, 1), (2, b, "en", "s", len(b), 1, 1), (2, item, None, None, None, None, None), (3, None, None, None, None, None, None), (None, "", None, None, 0, None, None), (4, " \n ", None, None, 3, None, None)]
    for name, docs, items in (("some", rows, [(1, item), (None, None), (2, "")]), ("none", [], [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([(None, 1, 1), (1, None, None)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        kept = collections.Counter((x.doc_id, x.text) for x in got.select("doc_id", "text").collect())
        assert kept == (collections.Counter([(1, a), (2, b), (3, None), (None, ""), (4, " \n ")]) if docs else {})
