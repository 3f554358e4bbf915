"""Toxicity as ordered severity grades, by cumulative-link regression.

Grades 0 to 3 share one weight vector w over hashed words; thresholds
t1 < t2 < t3 order them: ``P(grade >= k) = 1 / (1 + exp(t_k - w.x))``. The output
is the expected severity, the sum of the three. A document is rejected when
grade 1 or more is likelier than grade 0.

The labels are binary, so grades are made from them: a row that is not labelled
toxic has grade 0; a toxic row has grade 1, 2 or 3 by how sure a model is that
did not see it. For that the sample is dealt into ``FOLDS`` parts by a hash, a
binary model is fitted without each part, and the toxic rows are dealt by their
held-out scores into thirds. ``calibration`` reports expected against held-out
grades. Words are runs of ASCII letters and digits and of bytes beyond ASCII,
lower-cased A-Z, present or absent in a document; only words whose shares in
toxic and other rows of the fit differ by ``SCREEN`` standard errors get a
weight, so a long text does not add up noise.

The model is fitted on at most ``SAMPLE`` labelled rows (smallest hashes of id
and text), on the driver; every document is scored whole.

Null and empty texts, and words never seen, score as an empty text. Labels that
are null or of documents that don't exist are not used, nor are rows with a null
id or text in the fit; several labels of one document count as its highest.
Without any toxic label nothing is rejected and severity is 0. A tie of the
probabilities rejects. Rows with equal ids are scored separately; the kept
columns are handed on whatever their names. An empty table gives an empty
result, and no labels a model that rejects nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import lean, numbered

SAMPLE = 12_000
DIMENSION_BITS = 18
SCREEN = 3.5
GRADES, FOLDS = 3, 3


def features_of(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashed words of one document."""
    return np.unique((hashes >> np.uint64(64 - DIMENSION_BITS)).astype(np.int32))


def _features(batches):
    words = K.Words(between=K.SYMBOL)
    for batch in batches:
        data, offsets = K.packed(batch.column(3))
        found = []
        for a, b in K.chunks(offsets):
            hashes, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found += [features_of(hashes[first[row] : first[row + 1]]).tobytes() for row in range(b - a)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["id", "th", "toxic", "found"])


class Model:
    """Weights over the hashed words and the ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        #: Mean expected severity of the sample's rows by grade.
        self.calibration: dict[int, float] = {}

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, probability of grade 1 or more)."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500))) * np.isfinite(self.thresholds)
        return above.sum(axis=1), above[:, 0]


class Rows:
    """Sparse rows of hashed words."""

    def __init__(self, found: list[np.ndarray]) -> None:
        self.count = len(found)
        self.row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        self.word = np.concatenate([*found, np.zeros(0, np.int32)])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.word], minlength=self.count)


def screened(toxic: np.ndarray, rows: Rows, used: np.ndarray) -> np.ndarray:
    """Words whose shares in toxic and other used rows differ by SCREEN standard errors."""
    size, n = 1 << DIMENSION_BITS, np.maximum(1, np.bincount(toxic[used], minlength=2))
    by = lambda c: np.bincount(rows.word[(used & (toxic == c))[rows.row]], minlength=size)
    in_other, in_toxic = by(0), by(1)
    p, q, both = in_toxic / n[1], in_other / n[0], (in_toxic + in_other) / n.sum()
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (np.abs(z) >= SCREEN) & (in_toxic + in_other >= 3)


def likelihood(grade: np.ndarray, score: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of the grades, its slopes by score and by cut) of a cumulative-link model."""
    n, grades = len(grade), len(cuts)
    at_least = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30))), np.zeros((n, 1))])
    row = np.arange(n)
    likely = np.maximum(at_least[row, grade] - at_least[row, grade + 1], 1e-12)
    # a grade's likelihood is a difference of neighbours; each moves by p(1-p)
    slope = at_least * (1 - at_least)
    by_cut = np.zeros((n, grades + 2))
    by_cut[row, grade] += slope[row, grade] / likely
    by_cut[row, grade + 1] -= slope[row, grade + 1] / likely
    by_cut = by_cut[:, 1:-1]
    return float(np.log(likely).sum()), by_cut.sum(axis=1), -by_cut.sum(axis=0)


RIDGE = 0.05


def ordinal(grade: np.ndarray, rows: Rows, used: np.ndarray, kept: np.ndarray, grades: int, rounds: int = 400) -> Model:
    """Maximum penalised likelihood over the kept words and ordered cuts, by Adam; the mean is over the used rows."""
    column = np.full(len(kept), -1)
    column[kept] = np.arange(kept.sum())
    number = np.cumsum(used) - 1
    inside = (column[rows.word] >= 0) & used[rows.row]
    r, c, g, n = number[rows.row[inside]], column[rows.word[inside]], grade[used], int(used.sum())
    w, t, gaps = np.zeros(kept.sum()), 2.0, np.zeros(grades - 1)
    state = [np.zeros(len(w) + grades), np.zeros(len(w) + grades)]
    for step in range(1, rounds + 1):
        score = np.bincount(r, w[c], minlength=n)
        _, by_score, d_cut = likelihood(g, score, t + np.concatenate(([0], np.cumsum(np.exp(gaps)))))
        d_gap = np.array([d_cut[j + 1 :].sum() for j in range(grades - 1)]) * np.exp(gaps)
        slopes = np.concatenate((np.bincount(c, by_score[r], minlength=len(w)) - RIDGE * w, [d_cut.sum()], d_gap)) / n
        state[0] = 0.9 * state[0] + 0.1 * slopes
        state[1] = 0.99 * state[1] + 0.01 * slopes**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, t, gaps = w + move[: len(w)], t + move[len(w)], np.clip(gaps + move[len(w) + 1 :], -4, 4)
    weights = np.zeros(len(kept))
    weights[kept] = w
    return Model(weights, t + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def grades_of(toxic: np.ndarray, rows: Rows, fold: np.ndarray) -> np.ndarray:
    """Grades of toxic rows by the thirds of what models without them say; 0 for the others."""
    held = np.zeros(len(toxic))
    for f in range(FOLDS):
        used = fold != f
        kept = screened(toxic, rows, used) if toxic[used].any() and not toxic[used].all() else np.zeros(1 << DIMENSION_BITS, bool)
        if kept.any():
            model = ordinal(toxic, rows, used, kept, 1, rounds=150)
            held[fold == f] = (rows.scores(model.weights) - model.thresholds[0])[fold == f]
    if not toxic.any():
        return toxic.copy()
    low, high = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (held > low) + (held > high), 0)


def fit(toxic: np.ndarray, found: list[np.ndarray], fold: np.ndarray) -> Model:
    """The model of a sample: grades by held-out folds, then one cumulative-link fit over all rows."""
    rows, every = Rows(found), np.ones(len(found), bool)
    kept = screened(toxic, rows, every)
    if not toxic.any() or not kept.any():
        return Model(np.zeros(1 << DIMENSION_BITS), np.full(GRADES, np.inf))
    grade = grades_of(toxic, rows, fold)
    model = ordinal(grade, rows, every, kept, GRADES)
    severity, _ = model.severity(rows.scores(model.weights))
    model.calibration = {int(g): float(severity[grade == g].mean()) for g in np.unique(grade)}
    return model


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model fitted on a bounded sample of the labelled rows."""
    told = labels.where(F.col(label).isNotNull()).select(F.col(id).alias("id"), (F.col(label) > 0).cast("int").alias("toxic"))
    told = told.groupBy("id").agg(F.max("toxic").alias("toxic")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    body = F.col(text).cast("string")
    named = docs.select(F.col(id).alias("id"), F.xxhash64(body).alias("th"), body.alias("text")).where("text is not null")
    kind = named.schema["id"].dataType.simpleString()
    # as many labels as the bound; a label's id may have any number of rows, so those are bounded after their words are taken
    rows = named.join(F.broadcast(told), "id").select("id", "th", "toxic", "text").mapInArrow(lean(_features), f"id {kind}, th long, toxic int, found binary")
    rows = rows.dropDuplicates(["id", "th"]).withColumn("place", F.xxhash64("id", "th")).orderBy("place", "id", "th").limit(sample)
    got = rows.select("toxic", "place", "found").toArrow()
    toxic, fold = got.column("toxic").to_numpy().astype(np.int64), got.column("place").to_numpy() % FOLDS
    return fit(toxic, [np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()], fold)


def _score(weights: np.ndarray, thresholds: np.ndarray):
    at = np.flatnonzero(weights)
    value = weights[at]

    def scan(batches):
        words, model = K.Words(between=K.SYMBOL), Model(np.zeros(1 << DIMENSION_BITS), thresholds)
        model.weights[at] = value
        for batch in batches:
            data, offsets = K.packed(batch.column(batch.num_columns - 1))
            score = np.zeros(batch.num_rows)
            for a, b in K.chunks(offsets):
                hashes, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                places = (hashes >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)
                # few words weigh anything: only those are made distinct within their documents
                hit = np.flatnonzero(model.weights[places])
                row = np.searchsorted(first, hit, side="right") - 1
                once = np.unique(row << DIMENSION_BITS | places[hit])
                score[a:b] = np.bincount(once >> DIMENSION_BITS, model.weights[once & ((1 << DIMENSION_BITS) - 1)], minlength=b - a)
            severity, likely = model.severity(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(severity), pa.array(likely), pa.array(likely >= 0.5)], names=[*batch.schema.names[:-1], "severity", "p_toxic", "rejected"])

    return scan


def score(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text", into=("severity", "p_toxic", "rejected")) -> DataFrame:
    """The kept columns with the expected grade, the probability of grade 1 or more and the verdict of every row, named by ``into``."""
    picked = numbered(docs.select(*[F.col(c) for c in keep], F.col(text).cast("string")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(lean(_score(model.weights, model.thresholds)), f"{kinds}, severity double, p_toxic double, rejected boolean").toDF(*keep, *into)
