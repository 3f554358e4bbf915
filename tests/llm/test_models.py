"""The fitted operators against direct recomputation: vote statistics, EM, the linear scorer, ordinal regression."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import quality, samples, toxicity

SCHEMA = "doc_id long, text string"
WORD = "[^\x20\x09-\x0d]+"


def texts(n=250, seed=11):
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["the", "of", "And", "Report", "evening", "river", "carefully", "42", "ä"]) + r.choice(["", "", ",", "."]) for _ in range(r.randint(1, 150)))
    junk = [lambda: " ".join(f"w{r.randint(0, 9)}$$$" for _ in range(60)), lambda: "SHOUT!! " * r.randint(2, 40), lambda: " | ".join("cell" + str(i) for i in range(50)), lambda: "same " * r.randint(5, 80)]
    return [(i, r.choice(junk)() if i % 5 == 0 else good()) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, " \n")]


def statistics(text):
    """The labellers' statistics of one text, word by word."""
    b = text.encode()
    w = [m[0].encode() for m in re.finditer(WORD, text)]
    symbol = lambda c: 32 < c < 127 and not chr(c).isalnum()
    n, s = len(w), quality.SHRINK
    capitals, small, symbols = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b), sum(symbol(c) for c in b)
    low = [x.lower() for x in w]  # bytes: A-Z only
    again = sum(low[i] == low[i - 1] for i in range(1, n))
    runs = sum(any(symbol(x[i]) and symbol(x[i + 1]) for i in range(len(x) - 1)) for x in w)
    short = sum(len(x) <= 3 and not symbol(x[0]) for x in w)
    return {
        "symbol_words": runs / (n + s), "capitals": capitals / (capitals + small + 2 * s), "lone_symbols": sum(len(x) == 1 and symbol(x[0]) for x in w) / (n + s),
        "repeats": again / (n + s), "sameness": 1 - math.log(len(set(low)) + s) / math.log(n + s), "symbols": symbols / (len(b) + 4 * s),
        "shouts": sum(x.endswith(b"!") for x in w) / (n + s), "no_short_words": (n - short + s * quality.MIDDLE["no_short_words"]) / (n + s),
    }


def votes_of(text):
    x = statistics(text)
    return tuple(0 if x[name] >= bad else 1 if x[name] <= good else 2 for name, bad, good in quality.LABELLERS)


def posteriors(votes, rounds=100):
    """Expectation-maximisation document by document."""
    p = [0.2 if 0 in v else 0.9 for v in votes]
    for _ in range(rounds):
        share = (sum(p) + 1) / (len(votes) + 2)
        table = {}
        for c, weight in ((0, [1 - x for x in p]), (1, p)):
            for j in range(len(quality.LABELLERS)):
                seen = [0.5, 0.5, 0.5]
                for v, x in zip(votes, weight):
                    seen[v[j]] += x
                table[c, j] = [x / sum(seen) for x in seen]
        new = []
        for v in votes:
            bad, good = (math.prod(table[c, j][k] for j, k in enumerate(v)) * (share if c else 1 - share) for c in (0, 1))
            new.append(good / (bad + good))
        p = new
    return p


def test_votes_and_posteriors(spark):
    docs = texts()
    worded = [(i, t) for i, t in docs if t and t.strip()]
    want = dict(zip((i for i, _ in worded), posteriors([votes_of(t) for _, t in worded])))
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(docs)
    for i, _ in docs:
        assert (got[i].label_posterior is None) == (i not in want)
        if i in want:
            assert abs(got[i].label_posterior - want[i]) < 1e-6
        assert got[i].keep == (got[i].score >= 0.5)


def test_sameness_looks_at_whole_texts():
    """A long text of few words is never prose, however long."""
    words = [f"word{i}" for i in range(120)]
    assert votes_of(" ".join(words * 1000))[4] == votes_of(" ".join(words * 160))[4] == 0
    varied = " ".join(f"word{i}" for i in range(5000))
    assert votes_of(varied)[4] == 1


def test_scorer_is_near_the_optimum():
    r = np.random.default_rng(1)
    shapes = [np.unique(r.integers(0, 40, 12)).astype(np.int32) for _ in range(120)]
    shares = [np.full(len(x), 1 / (len(x) + 3), np.float32) for x in shapes]
    target = np.array([0.95 if 3 in x or 5 in x else 0.1 for x in shapes])
    x = np.zeros((120, 41))
    for i, (s, v) in enumerate(zip(shapes, shares)):
        x[i, s] = v
    x[:, 40] = 1

    def loss(w):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - target * z) + 0.001 * (w[:40] ** 2).sum() / 120

    best = np.zeros(41)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-x @ best))
        ridge = np.append(np.full(40, 0.002 / 120), 1e-9)
        slope = x.T @ (p - target) / 120 + ridge * best
        best -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / 120 + np.diag(ridge), slope)
    weights, bias = quality.train_scorer(target, shapes, shares)
    mine = np.append(weights[:40], bias)
    start = loss(np.append(np.zeros(40), math.log(target.mean() / (1 - target.mean()))))
    assert loss(mine) - loss(best) < 0.15 * (start - loss(best))


def test_ordinal_slopes_and_optimum():
    r = np.random.default_rng(2)
    grade, score, cuts = r.integers(0, 4, 50), r.normal(size=50), np.array([-0.5, 0.4, 1.3])
    value, by_score, by_cut = toxicity.likelihood(grade, score, cuts)
    edge = np.concatenate(([-np.inf], cuts, [np.inf]))
    cdf = lambda x: 1 / (1 + np.exp(-x))
    direct = lambda s, c: sum(math.log(cdf(np.append(c, np.inf)[g] - x) - cdf(np.append(-np.inf, c)[g] - x)) for g, x in zip(grade, s))
    assert np.isclose(value, direct(score, cuts)) and len(edge) == 5
    for i in range(50):
        step = np.eye(50)[i] * 1e-5
        assert np.isclose(by_score[i], (direct(score + step, cuts) - direct(score - step, cuts)) / 2e-5, atol=1e-4)
    for j in range(3):
        step = np.eye(3)[j] * 1e-5
        assert np.isclose(by_cut[j], (direct(score, cuts + step) - direct(score, cuts - step)) / 2e-5, atol=1e-4)
    # the fit reaches the penalised optimum: no direction has a slope left
    found = [np.unique(r.integers(0, 12, 4)).astype(np.int32) for _ in range(300)]
    grade = np.array([min(3, int((x < 3).sum())) for x in found]) * (r.random(300) < 0.9)
    rows, kept = toxicity.Rows(found), np.zeros(1 << toxicity.DIMENSION_BITS, bool)
    kept[:12] = True
    model = toxicity.ordinal(grade, rows, np.ones(300, bool), kept, 3, rounds=3000)
    _, by_score, by_cut = toxicity.likelihood(grade, rows.scores(model.weights), model.thresholds)
    slope = np.bincount(rows.word, by_score[rows.row], minlength=12)[:12] - toxicity.RIDGE * model.weights[:12]
    assert abs(slope).max() / 300 < 2e-3 and abs(by_cut).max() / 300 < 2e-3
    assert (np.diff(model.thresholds) > 0).all()


def test_severity_word_by_word(spark):
    """Scores of texts are sums over their distinct words, probabilities and verdicts follow from the cuts."""
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 60))] + (["vile"] * r.randint(1, 3) + ["Foul"] * r.randint(0, 1) if i % 4 == 0 else [])
        docs.append((i, r.choice([" ", "-", "\n"]).join(w)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(docs + [(None, "vile"), (700, None), (701, "")], SCHEMA)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    from lumenframe.llm import kernels as K

    def place(word):
        data = np.frombuffer(word.lower().encode(), np.uint8)
        return int(K.span_names(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - toxicity.DIMENSION_BITS))

    for row in toxicity.score(df, model, keep=("doc_id", "text")).collect():
        score = sum(model.weights[p] for p in {place(w) for w in re.findall("[A-Za-z0-9]+", row.text or "")})
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert math.isclose(row.severity, sum(above), rel_tol=1e-9) and math.isclose(row.p_toxic, above[0], rel_tol=1e-9)
        assert row.rejected == (above[0] >= 0.5)
    grades = sorted(model.calibration)
    assert [model.calibration[g] for g in grades] == sorted(model.calibration[g] for g in grades)


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 0 and quality.classify(docs).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("severity", "p_toxic", "rejected", "c0", "toxic", "th", "found")])
    done = toxicity.score(some, model, keep=some.columns, into=("x", "y", "z"))
    assert done.columns == [*some.columns, "x", "y", "z"] and not any(r.z for r in done.collect())
    assert not any(r.rejected for r in toxicity.score(some, toxicity.train(some, labels)).collect())


def test_samples_bound_rows_not_ids(spark):
    rows = [(7, f"text {i}") for i in range(50)] + [(8, "same")] * 40 + [(None, "x"), (9, None)]
    got = samples.sampled_texts(spark.createDataFrame(rows, SCHEMA).repartition(4), "doc_id", "text", 5).collect()
    assert len(got) == 5 and all(r.id in (7, 8) for r in got)
    whole = samples.sampled_texts(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 1000).collect()
    assert collections.Counter(r.id for r in whole) == {7: 50, 8: 1}
