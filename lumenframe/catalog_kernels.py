"""Queries over the numeric kernels: smoothing, percentiles, joint solves, background factors, rings, registration; their oracles write the sums out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .catalog import DISC, MK, MKW, MV, SIDE, TR, frames, masks, movie, pixels, query, r6, table, trace_table
from .functions import kernels, registration
from .model import Imaging, Rois
from .operators import background, extraction, motion, neuropil, reduce, scoring, segmentation, traces

#: Weights of a Gaussian along an axis of 8 places whose borders are repeated: place i takes w from place j.
CLAMPED = """{name} AS (SELECT i, least(7, greatest(0, i + k)) AS j, sum(exp(-0.5::DOUBLE * power(k / {s}::DOUBLE, 2))) / (SELECT sum(exp(-0.5::DOUBLE * power(k / {s}::DOUBLE, 2))) FROM range(-{r}, {r} + 1) t(k)) AS w
  FROM range(8) a(i), range(-{r}, {r} + 1) t(k) GROUP BY ALL)"""


def each_frame(spark, d, run, kinds: str, planes: bool = False):
    """Rows that ``run(frame, image)`` gives for every frame of the movie."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def scan(batches):
        for batch in batches:
            rows = [r for f, p in zip(batch["frame"], batch["pixels"]) for r in run(int(f), np.asarray(p, float).reshape(SIDE, SIDE))]
            yield pd.DataFrame(rows, columns=names)

    return frames(spark, d).select("frame", "pixels").mapInPandas(scan, kinds)


def image_rows(f: int, x: np.ndarray) -> list[tuple]:
    return [(f, i, float(v)) for i, v in enumerate(x.ravel())]


# -- reductions -----------------------------------------------------------------


@query(f"""WITH {MV}, n AS (SELECT max(frame) + 1 AS t FROM mv), s AS (SELECT DISTINCT round(i * (t - 30) / 6.0)::BIGINT AS s FROM n, range(7) a(i)), k AS (SELECT DISTINCT s + j AS frame FROM s, range(30) b(j))
SELECT p AS pix, round(avg(v), 6) AS v FROM mv JOIN k USING (frame) GROUP BY p""")
def average_image_of_chunks(spark, d):
    f = frames(spark, d)
    total = f.agg(F.max("frame") + 1).first()[0]
    return reduce.average_image(f, total, 7, 30).select(F.col("pix").cast("long").alias("pix"), r6("v"))


@query("SELECT DISTINCT round(i * (t - 1) / 37.0)::BIGINT AS frame FROM (SELECT max(vec_id) + 1 AS t FROM embeddings), range(38) a(i)")
def even_subsample(spark, d):
    v = table(spark, d, "embeddings")
    total = v.agg(F.max("vec_id") + 1).first()[0]
    listed = spark.createDataFrame([(k,) for k in reduce.sampled_frames(total, 38)], "vec_id long")
    return v.join(F.broadcast(listed), "vec_id", "left_semi").select(F.col("vec_id").alias("frame"))


@query("WITH k AS (SELECT nbins, greatest(1, least(nbins // 10, 13)) AS n FROM (VALUES (5), (40), (75), (500)) t(nbins)) SELECT nbins, unnest(list_transform(range(n), lambda i: i * 12 // greatest(1, n - 1))) AS kept FROM k")
def kept_batches(spark, d):
    rows = [(n, reduce.kept_batches(1250, 10, n, 100)) for n in (5, 40, 75, 500)]
    return spark.createDataFrame(rows, "nbins int, kept array<long>").select("nbins", F.explode("kept").alias("kept"))


BINNED = """f AS (SELECT vec_id AS g, vec_id // 60 AS batch, label < 4 AS bad, embedding FROM embeddings), k AS (SELECT *, avg((NOT bad)::INT) OVER (PARTITION BY batch) AS good FROM f WHERE {kept}),
u AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY g) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS len FROM k WHERE NOT bad OR good <= 0.5),
w AS (SELECT batch, pos // 7 AS bin, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM u WHERE len <= 7 OR (pos // 7 + 1) * 7 <= len)
SELECT batch, bin, (p // 8 - 1) * 6 + p % 8 - 2 AS pix, round(avg(v), 4) AS v FROM w WHERE p // 8 BETWEEN 1 AND 6 AND p % 8 BETWEEN 2 AND 7 GROUP BY ALL"""


def _binned(spark, d, nbins):
    bad = table(spark, d, "embeddings").select((F.col("vec_id") / 100).cast("int").alias("epoch_index"), (F.col("vec_id") % 100).alias("frame"), (F.col("label") < 4).alias("bad"))
    done = segmentation.binned_frames(movie(spark, d), 7, nbins, 60, bad, ((1, 7), (2, 8)))
    return done.select("batch", "bin", F.posexplode("pixels").alias("pix", "v")).select("batch", "bin", F.col("pix").cast("long").alias("pix"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@query("WITH " + BINNED.format(kept="TRUE"))
def stream_binned_movie(spark, d):
    return _binned(spark, d, None)


@query("WITH n AS (SELECT (max(vec_id) + 60) // 60 AS batches FROM embeddings), " + BINNED.format(kept="batch IN (SELECT i * (batches - 1) // 2 FROM n, range(3) a(i))"))
def stream_binned_sample(spark, d):
    return _binned(spark, d, 24)


CHUNKED = "t AS (SELECT max(frame) + 1 AS t FROM mv), c AS (SELECT frame * 6 // t AS chunk, p, avg(CASE WHEN (frame + p) % 3 > 0 AND p <> 5 THEN v END) AS v FROM mv, t GROUP BY ALL), s AS (SELECT chunk, p, coalesce(v, min(v) OVER (PARTITION BY chunk)) AS v FROM c)"


def _holed(spark, d):
    """The movie with NaN in a third of its places, and in one pixel throughout."""
    nan = F.lit(float("nan"))
    return pixels(spark, d).withColumn("v", F.when(((F.col("frame") + F.col("pix")) % 3 > 0) & (F.col("pix") != 5), F.col("v")).otherwise(nan)), pixels(spark, d).agg(F.max("frame") + 1).first()[0]


@query(f"WITH {MV}, {CHUNKED} SELECT chunk, p AS pix, round(v, 6) AS v FROM s")
def split_templates(spark, d):
    p, total = _holed(spark, d)
    return reduce.split_templates(p, 6, total).select("chunk", F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"WITH {MV}, {CHUNKED} SELECT p AS pix, round(median(v), 6) AS v FROM s GROUP BY p")
def template_update(spark, d):
    p, total = _holed(spark, d)
    return reduce.template(p, 6, total).select(F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"WITH {MV} SELECT k AS component, p AS pix, round(sum(v * CASE k WHEN 0 THEN 1 ELSE frame % 5 END), 6) AS v FROM mv, range(2) a(k) GROUP BY ALL")
def temporal_projection(spark, d):
    p = pixels(spark, d)
    f = p.select("frame").distinct().select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("component"), F.lit(1.0).alias("f")), F.struct(F.lit(1).cast("long").alias("component"), (F.col("frame") % 5).cast("double").alias("f")))).alias("x"), "frame").select("x.component", "frame", "x.f")
    return reduce.temporal_projection(p, f).select("component", F.col("pix").cast("long").alias("pix"), r6("v"))


@query("WITH t AS (SELECT vec_id // 100 AS e, count(*) AS n FROM embeddings GROUP BY 1) SELECT e::INT AS epoch_index, sum(n)::BIGINT AS frames, sum(n)::BIGINT * 64 AS pixels, sum(n)::BIGINT * 256 AS bytes, round(sum(n) / 10.0, 6)::DOUBLE AS seconds FROM t GROUP BY ROLLUP (e)")
def movie_totals(spark, d):
    return movie(spark, d).totals().select("epoch_index", "frames", "pixels", "bytes", r6("seconds"))


@query(f"WITH {TR}, m AS (SELECT roi, min(value) AS a, max(value) AS b FROM tr GROUP BY roi HAVING max(value) > min(value)) SELECT roi, floor((value - (a - (b - a) / 10)) / ((b - a) * 1.2::DOUBLE / 16))::BIGINT AS bin, count(*) AS n FROM tr JOIN m USING (roi) GROUP BY ALL")
def padded_histogram(spark, d):
    return reduce.padded_histogram(trace_table(spark, d), 16).select("roi", F.col("bin").cast("long").alias("bin"), "n")


@query(f"WITH {TR}, s AS (SELECT roi, event_type, avg(value) AS s FROM tr GROUP BY ALL) SELECT event_type, round(median(s), 6) AS score, count(*) AS n FROM s GROUP BY event_type")
def median_over_regions(spark, d):
    s = trace_table(spark, d).groupBy("roi", "event_type").agg(F.avg("value").alias("score"))
    return traces.median_over_regions(s, "score", "event_type").select("event_type", r6("score"), "n")


@query(f"WITH {TR}, s AS (SELECT roi, roi % 5 AS grp, round(avg(value), 6) AS score FROM tr GROUP BY ALL) SELECT roi, row_number() OVER (PARTITION BY grp ORDER BY score DESC, roi) AS rank FROM s")
def roi_ranking(spark, d):
    # as DuckDB rounds: the nearest whole number of millionths of the double, not of its shortest decimal form
    s = traces.ordered_means(trace_table(spark, d)).select("roi", (F.col("roi") % 5).alias("grp"), (F.round(F.col("mean") * 1e6, 0) / 1e6).alias("score"))
    return scoring.ranked(s, "score", "roi", "grp").select("roi", F.col("rank").cast("long").alias("rank"))


# -- traces ---------------------------------------------------------------------

#: The traces with mirrored rows beyond both ends (the border itself is repeated), {0} on the left and {1} on the right.
MIRRORED = """ln AS (SELECT roi, count(*) AS n FROM tr GROUP BY roi), sp AS (SELECT roi, unnest(range(-{0}, n + {1})) AS at, n FROM ln), mi AS (SELECT sp.roi, sp.at, sp.n, tr.value FROM sp JOIN tr ON tr.roi = sp.roi
  AND tr.frame = CASE WHEN ((sp.at % (2 * n)) + 2 * n) % (2 * n) < n THEN ((sp.at % (2 * n)) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((sp.at % (2 * n)) + 2 * n) % (2 * n) END)"""
SOFT = f"""{MIRRORED.format(8, 8)}, so AS (SELECT a.roi, a.at AS frame, sum(b.value * exp(-0.5::DOUBLE * power((b.at - a.at) / 2.0::DOUBLE, 2))) / sum(exp(-0.5::DOUBLE * power((b.at - a.at) / 2.0::DOUBLE, 2))) AS soft
  FROM mi a JOIN mi b ON a.roi = b.roi AND b.at BETWEEN a.at - 8 AND a.at + 8 WHERE a.at >= 0 AND a.at < a.n GROUP BY ALL)"""


@query(f"WITH {TR}, {SOFT} SELECT roi, frame, round(soft, 6) AS soft FROM so")
def gaussian_smoothing(spark, d):
    return traces.smoothed(trace_table(spark, d).select("roi", "frame", "value"), 2.0).select("roi", "frame", r6("soft"))


@query(f"""WITH {TR}, {SOFT}, l AS (SELECT *, min(soft) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low FROM so),
b AS (SELECT roi, frame, max(low) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS f0 FROM l)
SELECT roi, frame, round((value - f0) / (f0 + 1.1920929e-07::DOUBLE), 5) AS dff, round(f0, 5) AS f0 FROM b JOIN tr USING (roi, frame)""")
def dff_maximin(spark, d):
    done = traces.baseline_dff(trace_table(spark, d), 1.0, "maximin", window=6.0, sigma=2.0, kind="double")
    return done.select("roi", "frame", (F.round("dff", 5) + 0.0).alias("dff"), (F.round("f0", 5) + 0.0).alias("f0"))


@query(f"""WITH {TR}, {MIRRORED.format(5, 4)}, b AS (SELECT a.roi, a.at AS frame, list_sort(list(b.value))[1 + 10 * 30 // 100] AS f0 FROM mi a JOIN mi b ON a.roi = b.roi AND b.at BETWEEN a.at - 5 AND a.at + 4 WHERE a.at >= 0 AND a.at < a.n GROUP BY ALL)
SELECT roi, frame, round((value - f0) / (f0 + 1.1920929e-07::DOUBLE), 5) AS dff, round(f0, 5) AS f0 FROM b JOIN tr USING (roi, frame)""")
def dff_percentile(spark, d):
    done = traces.baseline_dff(trace_table(spark, d), 1.0, "percentile", percentile=30.0, window=10.0, kind="double")
    return done.select("roi", "frame", (F.round("dff", 5) + 0.0).alias("dff"), (F.round("f0", 5) + 0.0).alias("f0"))


@query()
def kde_percentile(spark, d):
    return traces.mode_levels(trace_table(spark, d)).select("roi", r6("level"))


@query()
def dff_percentile_auto(spark, d):
    return traces.baseline_dff(trace_table(spark, d), 1.0, window=20.0).select("roi", "frame", "dff", "f0")


@query(f"WITH {TR}, m AS (SELECT *, value - median(value) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS flat FROM tr), l AS (SELECT roi, 2 * median(abs(flat)) AS l FROM m GROUP BY roi) SELECT roi, frame, round(greatest(-l, least(l, flat)), 6) AS flat FROM m JOIN l USING (roi)")
def outlier_detrend(spark, d):
    return traces.outliers_removed(trace_table(spark, d), 4, 2.0).select("roi", "frame", r6("flat"))


@query(f"WITH {TR} SELECT roi, frame, CASE WHEN frame = 0 THEN 0 ELSE (event_type = 'purchase')::INT END::DOUBLE AS spikes FROM tr")
def deconvolution_of_clean_traces(spark, d):
    """Spikes of a noiseless AR(1) course come back (those of the first frame are part of its start)."""
    s = trace_table(spark, d).select("roi", "frame", (F.col("event_type") == "purchase").cast("double").alias("value"))
    clean = traces.ar1_filter(s, float(np.exp(-0.1))).select("roi", "frame", F.col("c").alias("value"))
    done = traces.deconvolve(clean, 1.0, decay=10.0, penalty=None, baseline=0.0)
    return done.select("roi", "frame", (F.round(F.col("spikes").cast("double"), 5) + 0.0).alias("spikes"))


@query()
def deconvolution_second_order(spark, d):
    t = traces.baseline_dff(trace_table(spark, d), 1.0, percentile=20.0, window=20.0)
    return traces.deconvolve(t.select("roi", "frame", F.col("dff").cast("double").alias("value")), 1.0).select("roi", "frame", "denoised", "spikes")


# -- joint solves -----------------------------------------------------------------

DOTS = f"{MV}, {MKW}, y AS (SELECT frame, roi, sum(v * w) AS y FROM mv JOIN mk USING (p) GROUP BY ALL), gr AS (SELECT a.roi AS i, b.roi AS j, sum(a.w * b.w) AS g FROM mk a JOIN mk b USING (p) GROUP BY ALL)"


def _entry(i: str, j: str) -> str:
    return f"max(CASE WHEN i = '{i}' AND j = '{j}' THEN g END)"


#: The overlaps of four discs are a chain r1 - r0 - r5 - r3: a tridiagonal system, eliminated from one end; two discs stand alone.
CHAIN = f"""m AS (SELECT {_entry("r1", "r1")} AS d1, {_entry("r0", "r0")} AS d2, {_entry("r5", "r5")} AS d3, {_entry("r3", "r3")} AS d4, {_entry("r1", "r0")} AS e1, {_entry("r0", "r5")} AS e2, {_entry("r5", "r3")} AS e3 FROM gr),
z AS (SELECT frame, max(CASE WHEN roi = 'r1' THEN y END) AS y1, max(CASE WHEN roi = 'r0' THEN y END) AS y2, max(CASE WHEN roi = 'r5' THEN y END) AS y3, max(CASE WHEN roi = 'r3' THEN y END) AS y4 FROM y GROUP BY frame),
s2 AS (SELECT *, d2 - e1 * e1 / d1 AS q2, y2 - e1 / d1 * y1 AS z2 FROM z, m), s3 AS (SELECT *, d3 - e2 * e2 / q2 AS q3, y3 - e2 / q2 * z2 AS z3 FROM s2), s4 AS (SELECT *, (y4 - e3 / q3 * z3) / (d4 - e3 * e3 / q3) AS c4 FROM s3),
s5 AS (SELECT *, (z3 - e3 * c4) / q3 AS c3 FROM s4), s6 AS (SELECT *, (z2 - e2 * c3) / q2 AS c2 FROM s5), s7 AS (SELECT *, (y1 - e1 * c2) / d1 AS c1 FROM s6)"""


@query(f"""WITH {DOTS}, {CHAIN} SELECT frame, roi, round(y / g, 6) AS value FROM y JOIN gr ON i = roi AND j = roi WHERE roi IN ('r2', 'r4')
UNION ALL SELECT frame, 'r1', round(c1, 6) FROM s7 UNION ALL SELECT frame, 'r0', round(c2, 6) FROM s7 UNION ALL SELECT frame, 'r5', round(c3, 6) FROM s7 UNION ALL SELECT frame, 'r3', round(c4, 6) FROM s7""")
def trace_regression_all(spark, d):
    solver = extraction.JointSolver(masks(spark, True), ridge=0.0)
    return solver.on_frames(frames(spark, d), ["frame"]).select("frame", "roi", r6("value"))


#: Two coupled unknowns that may not be negative: both free, or one of them, or none.
CASES = """CASE WHEN c0 >= 0 AND c1 >= 0 THEN c0 WHEN y0 > 0 AND y1 - g01 * y0 / g00 <= 0 THEN y0 / g00 ELSE 0 END AS n0,
 CASE WHEN c0 >= 0 AND c1 >= 0 THEN c1 WHEN y1 > 0 AND y0 - g01 * y1 / g11 <= 0 THEN y1 / g11 ELSE 0 END AS n1"""


@query(f"""WITH {DOTS}, z AS (SELECT frame, max(CASE WHEN roi = 'r0' THEN y END) AS y0, max(CASE WHEN roi = 'r1' THEN y END) AS y1 FROM y GROUP BY frame), m AS (SELECT {_entry("r0", "r0")} AS g00, {_entry("r1", "r1")} AS g11, {_entry("r0", "r1")} AS g01 FROM gr),
s AS (SELECT *, (g11 * y0 - g01 * y1) / (g00 * g11 - g01 * g01) AS c0, (g00 * y1 - g01 * y0) / (g00 * g11 - g01 * g01) AS c1 FROM z, m), k AS (SELECT *, {CASES} FROM s)
SELECT frame, roi, round(greatest(0, y / g), 6) AS value FROM y JOIN gr ON i = roi AND j = roi WHERE roi IN ('r2', 'r3', 'r4') UNION ALL SELECT frame, 'r0', round(n0, 6) FROM k UNION ALL SELECT frame, 'r1', round(n1, 6) FROM k""")
def trace_nnls_coupled(spark, d):
    solver = extraction.JointSolver(masks(spark, True).where("roi <> 'r5'"), ridge=0.0, nonnegative=True)
    return solver.on_frames(frames(spark, d), ["frame"]).select("frame", "roi", r6("value"))


@query()
def trace_nnls_all(spark, d):
    solver = extraction.JointSolver(masks(spark, True), ridge=0.0, nonnegative=True)
    return solver.on_frames(frames(spark, d), ["frame"]).select("frame", "roi", r6("value"))


@query(f"WITH {MV}, {MKW} SELECT frame, roi, round(sum(v * w) / sum(w * w), 6) AS value FROM mv JOIN mk USING (p) GROUP BY ALL")
def trace_projection_of_frames(spark, d):
    done = extraction.projection_of_frames(frames(spark, d), masks(spark, True), ["frame"], [f"r{i}" for i in range(6)])
    return done.select("frame", "roi", r6("value"))


#: One region (r2) with a background, the movie's mean image: two coupled unknowns a frame.
WITH_BACK = f"""{MV}, {MKW}, im AS (SELECT p, avg(v) AS b FROM mv GROUP BY p), r2 AS (SELECT p, w FROM mk WHERE roi = 'r2'),
q AS (SELECT (SELECT sum(w * w) FROM r2) AS gaa, (SELECT sum(b * b) FROM im) AS gbb, (SELECT sum(w * b) FROM r2 JOIN im USING (p)) AS gab),
u AS (SELECT frame, sum(v * coalesce(w, 0)) AS ya, sum(v * b) AS yb FROM mv JOIN im USING (p) LEFT JOIN r2 USING (p) GROUP BY frame)"""


def _with_background(spark, d, nonnegative):
    b = reduce.image(pixels(spark, d)).select(F.lit(0).alias("component"), "pix", F.col("v").alias("b"))
    solver = extraction.JointSolver(masks(spark, True).where("roi = 'r2'"), b, 0.0, nonnegative)
    return solver.on_frames(frames(spark, d), ["frame"])


@query(f"""WITH {WITH_BACK}, c AS (SELECT *, (ya * gbb - yb * gab) / (gaa * gbb - gab * gab) AS c FROM u, q), f AS (SELECT *, (yb - c * gab) / gbb * gab / gaa AS back FROM c)
SELECT frame, 'r2' AS roi, round(c + (1 - 0.7::DOUBLE) * back, 5) AS value, round(back, 5) AS background FROM f""")
def regression_with_background(spark, d):
    done = _with_background(spark, d, False)
    value = extraction.weighted(F.col("value"), F.col("background"), 0.7)
    return done.select("frame", "roi", (F.round(value, 5) + 0.0).alias("value"), (F.round("background", 5) + 0.0).alias("background"))


@query(f"""WITH {WITH_BACK}, c AS (SELECT *, greatest(0, (ya * gbb - yb * gab) / (gaa * gbb - gab * gab)) AS c FROM u, q) SELECT frame, 'r2' AS roi, round(c, 5) AS value, round((yb - c * gab) / gbb * gab / gaa, 5) AS background FROM c""")
def nnls_with_background(spark, d):
    done = _with_background(spark, d, True)
    return done.select("frame", "roi", (F.round("value", 5) + 0.0).alias("value"), (F.round("background", 5) + 0.0).alias("background"))


@query(f"""WITH {MKW}, g AS (SELECT a.roi AS i, b.roi AS j, sum(a.w * b.w) AS g FROM mk a JOIN mk b USING (p) GROUP BY ALL), n AS (SELECT * FROM (VALUES ('none')) t(i)),
e AS (SELECT a.i, b.i AS j FROM (SELECT DISTINCT i FROM g UNION ALL SELECT i FROM n) a, (SELECT DISTINCT i FROM g UNION ALL SELECT i FROM n) b), m AS (SELECT avg(g) AS m FROM g WHERE i = j)
SELECT e.i AS roi_i, e.j AS roi_j, round(coalesce(g.g, 0) + CASE WHEN e.i <> e.j THEN 0 WHEN e.i = 'none' THEN m ELSE 0.1::DOUBLE * g.g END, 6) AS g FROM e LEFT JOIN g USING (i, j), m""")
def ridge_gram(spark, d):
    """The Gram matrix with a region without weight, regularised."""
    order = [*sorted(f"r{i}" for i in range(6)), "none"]
    at = {r: i for i, r in enumerate(order)}
    g = np.zeros((7, 7))
    for r in extraction.gram(masks(spark, True)).collect():
        g[at[r.roi_i], at[r.roi_j]] = r.g
    g = kernels.regularise(g, 0.1)
    return spark.createDataFrame([(a, b, float(g[at[a], at[b]])) for a in order for b in order], "roi_i string, roi_j string, g double").select("roi_i", "roi_j", r6("g"))


@query(f"""WITH {MKW}, g AS (SELECT sum(CASE WHEN a.roi = 'r0' AND b.roi = 'r0' THEN a.w * b.w END) AS a, sum(CASE WHEN a.roi = 'r0' AND b.roi = 'r1' THEN a.w * b.w END) AS b, sum(CASE WHEN a.roi = 'r1' AND b.roi = 'r1' THEN a.w * b.w END) AS c FROM mk a JOIN mk b USING (p)),
l AS (SELECT (a + c) / 2 AS m, sqrt(power((a - c) / 2, 2) + b * b) AS r FROM g) SELECT round((m + r) / (m - r), 6) AS condition FROM l""")
def gram_condition(spark, d):
    g = {(r.roi_i, r.roi_j): r.g for r in extraction.gram(masks(spark, True).where("roi in ('r0', 'r1')")).collect()}
    m = np.array([[g["r0", "r0"], g["r0", "r1"]], [g["r1", "r0"], g["r1", "r1"]]])
    return spark.createDataFrame([(extraction.condition(m),)], "condition double").select(r6("condition"))


@query("SELECT k, y, round(greatest(0, y / g * (1 - power(1 - g / 4, 50))), 6) AS c FROM (SELECT k, (k + 1)::DOUBLE AS g, (f - 10)::DOUBLE * (k + 1) AS y FROM range(4) a(k), range(30) b(f)) t")
def projected_gradient(spark, d):
    """50 projected gradient steps from 0 on a diagonal problem."""
    f, k = np.mgrid[:30, :4]
    y = (f - 10.0) * (k + 1)
    c = kernels.nnls_descent(np.diag([1.0, 2.0, 3.0, 4.0]), y, np.zeros(y.shape))
    return spark.createDataFrame([(int(b), float(y[a, b]), float(c[a, b])) for a in range(30) for b in range(4)], "k long, y double, c double").select("k", "y", r6("c"))


# -- background -------------------------------------------------------------------


@query(f"""WITH {MV}, {CLAMPED.format(name="a", s=1, r=4)}, {CLAMPED.format(name="b", s=2, r=8)},
s AS (SELECT frame, y.i AS y, x.i AS x, sum(v * y.w * x.w) AS v FROM mv JOIN a y ON y.j = p // 8 JOIN a x ON x.j = p % 8 WHERE frame < 100 GROUP BY ALL),
h AS (SELECT frame, y.i AS y, x.i AS x, sum(v * y.w * x.w) AS v FROM s JOIN b y ON y.j = s.y JOIN b x ON x.j = s.x GROUP BY ALL) SELECT frame, s.y * 8 + s.x AS pix, round(s.v - h.v, 5) AS v FROM s JOIN h USING (frame, y, x)""")
def spatial_band_pass(spark, d):
    done = each_frame(spark, d, lambda f, x: image_rows(f, kernels.band_pass(x, 1.0, 2.0)) if f < 100 else [], "frame long, pix long, v double")
    return done.select("frame", "pix", (F.round("v", 5) + 0.0).alias("v"))


@query("SELECT k, y * 8 + x AS pix, round(greatest(0, 1 - abs(x - k * 3.5::DOUBLE) / 3.5::DOUBLE), 6) AS v FROM range(3) a(k), range(5) b(y), range(8) c(x)")
def partition_of_unity(spark, d):
    bumps = background.unit_partition(5, 8, 3)
    return spark.createDataFrame([(k, i, float(v)) for k in range(3) for i, v in enumerate(bumps[k])], "k long, pix long, v double").select("k", "pix", r6("v"))


#: Two regions that don't overlap (r2, r4), their first traces by projection, and the residual image filled over them from around.
SEEDED = f"""{MV}, {MKW}, two AS (SELECT * FROM mk WHERE roi IN ('r2', 'r4')), nn AS (SELECT roi, sum(w * w) AS g FROM two GROUP BY roi),
c0 AS (SELECT frame, roi, greatest(0, sum(v * w) / max(g)) AS c FROM mv JOIN two USING (p) JOIN nn USING (roi) GROUP BY ALL), cm AS (SELECT roi, avg(c) AS c FROM c0 GROUP BY roi),
ca AS (SELECT p, sum(c * w) AS s FROM cm JOIN two USING (roi) GROUP BY p), im AS (SELECT p, avg(v) AS v FROM mv GROUP BY p), re AS (SELECT p, v - coalesce(s, 0) AS v, s IS NOT NULL AND p IN (SELECT p FROM two WHERE w <> 0) AS hole FROM im LEFT JOIN ca USING (p)),
{CLAMPED.format(name="k", s=1.5, r=6)}, ti AS (SELECT y.i * 8 + x.i AS p, sum(CASE WHEN hole THEN 0 ELSE v END * y.w * x.w) / sum(CASE WHEN hole THEN 0 ELSE 1 END * y.w * x.w) AS f FROM re JOIN k y ON y.j = p // 8 JOIN k x ON x.j = p % 8 GROUP BY ALL),
fi AS (SELECT p, CASE WHEN hole THEN f ELSE v END AS v FROM re JOIN ti USING (p))"""


def _fit(spark, d, components: int = 1) -> background.Fit:
    """The movie, two regions that don't overlap, first traces from the frames as they are."""
    rows = frames(spark, d).select("frame", "pixels").orderBy("frame").toPandas()
    flat = extraction.FlatMasks(masks(spark, True), ["r2", "r4"])
    a = np.zeros((2, SIDE * SIDE))
    a[np.repeat([0, 1], np.diff(flat.edge)), flat.pix] = flat.w
    model = background.Fit(np.stack(rows["pixels"].to_list()), a, (SIDE, SIDE), ridge=0.0)
    model.seed(0, 0)
    return model


def _pix(spark, image):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.ravel(image))], "pix long, v double").select("pix", r6("v"))


@query(f"WITH {SEEDED} SELECT p AS pix, round(v, 6) AS v FROM fi")
def inpainted_residual(spark, d):
    model = _fit(spark, d)
    image = (model.y.mean(axis=0) - model.c.mean(axis=0) @ model.a).reshape(SIDE, SIDE)
    return _pix(spark, background.inpaint(image, model.support.reshape(SIDE, SIDE), 1.5))


@query(f"WITH {SEEDED} SELECT k AS component, p AS pix, round(greatest(0, v) * greatest(0, 1 - abs(p % 8 - k * 7)::DOUBLE / 7), 6) AS v FROM fi, range(2) a(k)")
def background_start(spark, d):
    model = _fit(spark, d)
    model.start(2, "ramp", 1.5)
    # a width of 1.5 caps the one that the masks suggest; the query's oracle takes it as given
    return spark.createDataFrame([(k, i, float(v)) for k in range(2) for i, v in enumerate(model.b[k])], "component long, pix long, v double").select("component", "pix", r6("v"))


STARTED = f"""{SEEDED}, b0 AS (SELECT p, greatest(0, v) AS b FROM fi), w0 AS (SELECT frame, sum(v * b) - (SELECT 0) AS yb FROM mv JOIN b0 USING (p) GROUP BY frame), ab AS (SELECT roi, sum(w * b) AS ab FROM two JOIN b0 USING (p) GROUP BY roi), bb AS (SELECT sum(b * b) AS bb FROM b0),
f0 AS (SELECT frame, greatest(0, (yb - (SELECT sum(c * ab) FROM c0 JOIN ab USING (roi) WHERE c0.frame = w0.frame)) / bb) AS f FROM w0, bb),
c1 AS (SELECT frame, roi, greatest(0, (sum(v * w) - max(f * ab)) / max(g)) AS c FROM mv JOIN two USING (p) JOIN nn USING (roi) JOIN f0 USING (frame) JOIN ab USING (roi) GROUP BY ALL),
ff AS (SELECT sum(f * f) AS ff FROM f0), fc AS (SELECT roi, sum(f * c) AS fc FROM f0 JOIN c1 USING (frame) GROUP BY roi), fa AS (SELECT p, sum(fc * w) AS fa FROM fc JOIN two USING (roi) GROUP BY p),
b1 AS (SELECT p, greatest(0, (sum(f * v) - coalesce(max(fa), 0)) / max(ff)) AS b FROM mv JOIN f0 USING (frame) LEFT JOIN fa USING (p), ff GROUP BY p), ab1 AS (SELECT roi, sum(w * b) AS ab FROM two JOIN b1 USING (p) GROUP BY roi), bb1 AS (SELECT sum(b * b) AS bb FROM b1),
cab AS (SELECT frame, sum(c * ab) AS cab FROM c1 JOIN ab1 USING (roi) GROUP BY frame), f1 AS (SELECT frame, greatest(0, (sum(v * b) - max(cab)) / max(bb)) AS f FROM mv JOIN b1 USING (p) JOIN cab USING (frame), bb1 GROUP BY frame)"""


def _updated(spark, d) -> tuple[background.Fit, float]:
    model = _fit(spark, d)
    model.start(1, "ramp", 1.5)
    return model, model.update()


@query(f"WITH {STARTED} SELECT p AS pix, round(b, 6) AS v FROM b1")
def background_update(spark, d):
    return _pix(spark, _updated(spark, d)[0].b[0])


@query(f"WITH {STARTED} SELECT frame, round(f, 6) AS f FROM f1")
def background_course(spark, d):
    f = _updated(spark, d)[0].f[:, 0]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(f)], "frame long, f double").select("frame", r6("f"))


@query(f"""WITH {STARTED}, ca1 AS (SELECT frame, p, sum(c * w) AS s FROM c1 JOIN two USING (roi) GROUP BY ALL)
SELECT round(sum(power(v - coalesce(s, 0) - f * b, 2)), 4) AS objective FROM mv JOIN f1 USING (frame) JOIN b1 USING (p) LEFT JOIN ca1 USING (frame, p)""")
def background_objective(spark, d):
    return spark.createDataFrame([(_updated(spark, d)[1],)], "objective double").select((F.round("objective", 4) + 0.0).alias("objective"))


@query("""WITH x AS (SELECT k, i, (1 + (k + i) % 3)::DOUBLE AS b FROM range(3) a(k), range(6) c(i)), f AS (SELECT k, t, ((k * 7 + t) % 5 - 1)::DOUBLE AS f FROM range(3) a(k), range(8) c(t)), n AS (SELECT k, sqrt(sum(b * b)) AS n FROM x GROUP BY k),
e AS (SELECT k, sum(f * f) * max(n) * max(n) AS e FROM f JOIN n USING (k) GROUP BY k), o AS (SELECT k, row_number() OVER (ORDER BY round(e, 9) DESC, k) - 1 AS place FROM e)
SELECT place AS component, i AS pix, round(b / n, 6) AS v FROM x JOIN n USING (k) JOIN o USING (k)""")
def components_by_energy(spark, d):
    k, i = np.mgrid[:3, :6]
    model = background.Fit(np.zeros((8, 6)), np.zeros((0, 6)), (2, 3))
    model.b = (1 + (k + i) % 3).astype(float)
    model.f = np.array([[(kk * 7 + t) % 5 - 1 for kk in range(3)] for t in range(8)], float)
    b, _ = model.ordered()
    return spark.createDataFrame([(int(a), int(c), float(b[a, c])) for a in range(3) for c in range(6)], "component long, pix long, v double").select("component", "pix", r6("v"))


@query()
def cnmf_background(spark, d):
    m = masks(spark, True).select(F.col("roi").alias("roi_id"), F.lit(0).alias("plane_index"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "w")
    rois = Rois(m, SIDE, SIDE, tuple(f"r{i}" for i in range(6)))
    return background.cnmf_background(movie(spark, d), rois, 1, 200).select("component", "plane_index", "pix", r6("b"))


# -- rings --------------------------------------------------------------------------


@query(f"""WITH {MK}, own AS (SELECT DISTINCT roi, y, x FROM mk), box AS (SELECT roi, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM own GROUP BY roi),
free AS (SELECT roi, gy.y, gx.x, greatest(y0 - gy.y, gy.y - y1, x0 - gx.x, gx.x - x1, 0) AS far FROM box, range(8) gy(y), range(8) gx(x)
  WHERE NOT EXISTS (SELECT 1 FROM own t WHERE t.y = gy.y AND t.x = gx.x) AND NOT EXISTS (SELECT 1 FROM own t WHERE t.roi = box.roi AND abs(t.y - gy.y) <= 1 AND abs(t.x - gx.x) <= 1)),
s AS (SELECT roi, g, count(*) FILTER (far <= g) AS n FROM free, range(2, 16) a(g) GROUP BY ALL), p AS (SELECT roi, coalesce(min(g) FILTER (n >= 12), 15) AS g FROM s GROUP BY roi)
SELECT roi, y * 8 + x AS pix, round(1.0::DOUBLE / count(*) OVER (PARTITION BY roi), 6) AS w FROM free JOIN p USING (roi) WHERE far <= g""")
def grown_rings(spark, d):
    m = masks(spark).select(F.col("roi").alias("roi_id"), F.lit(0).alias("plane_index"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "w")
    rois = Rois(m, SIDE, SIDE, tuple(f"r{i}" for i in range(6)))
    return neuropil.surround_masks(rois, 1, 12).select("roi", F.col("pix").cast("long").alias("pix"), r6("w"))


@query(f"""WITH {DISC}, m AS (SELECT roi, p, CASE WHEN d2 <= 2 THEN 1 - sqrt(d2) / 2 ELSE 0 END AS w FROM disc WHERE roi IN ('r0', 'r2', 'r4')), o AS (SELECT roi, p, CASE WHEN d2 <= 2 THEN 1 - sqrt(d2) / 2 ELSE 0 END AS w FROM disc WHERE roi IN ('r1', 'r2', 'r5')),
c AS (SELECT m.roi AS i, o.roi AS j, corr(m.w, o.w) AS c FROM m JOIN o USING (p) GROUP BY ALL), t AS (SELECT a.j AS j0, b.j AS j2, e.j AS j4, greatest(a.c - 0.2, 0) + greatest(b.c - 0.2, 0) + greatest(e.c - 0.2, 0) AS s FROM c a, c b, c e WHERE a.i = 'r0' AND b.i = 'r2' AND e.i = 'r4' AND a.j <> b.j AND b.j <> e.j AND a.j <> e.j),
best AS (SELECT * FROM t ORDER BY s DESC LIMIT 1), pick AS (SELECT 'r0' AS i, j0 AS j FROM best UNION ALL SELECT 'r2', j2 FROM best UNION ALL SELECT 'r4', j4 FROM best)
SELECT i AS roi_i, j AS roi_j, round(c, 6) AS corr FROM pick JOIN c USING (i, j) WHERE c > 0.2""")
def footprint_assignment(spark, d):
    m = masks(spark, True)
    c = scoring.footprint_correlation(m.where("roi in ('r0', 'r2', 'r4')"), m.where("roi in ('r1', 'r2', 'r5')"), SIDE * SIDE, every=False)
    return scoring.assign_footprints(c, 0.2).select("roi_i", "roi_j", r6("corr"))


# -- registration ---------------------------------------------------------------------

GRID = "g AS (SELECT a.k AS dy, b.k AS dx FROM range(-2, 3) a(k), range(-2, 3) b(k))"


@query(f"""WITH {MV}, ref AS (SELECT p, avg(v) AS r FROM mv GROUP BY p), {GRID}, c AS (SELECT frame, dy, dx, abs(sum(v * r)) AS score FROM mv, g, ref WHERE ref.p = ((mv.p // 8 + dy + 8) % 8) * 8 + (mv.p % 8 + dx + 8) % 8 GROUP BY ALL)
SELECT frame, dy::DOUBLE AS dy, dx::DOUBLE AS dx FROM c QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC) = 1""")
def dft_shift(spark, d):
    image = np.array([r.v for r in reduce.image(pixels(spark, d)).orderBy("pix").collect()]).reshape(SIDE, SIDE)
    return each_frame(spark, d, lambda f, x: [(f, *registration.shift_of(x, image, (2, 2), 1))], "frame long, dy double, dx double")


@query(f"""WITH {MV}, t AS (SELECT p // 8 - 1 AS y, p % 8 - 1 AS x, avg(v) + 3 AS t FROM mv WHERE p // 8 BETWEEN 1 AND 6 AND p % 8 BETWEEN 1 AND 6 GROUP BY p), o AS (SELECT a.k AS oy, b.k AS ox FROM range(3) a(k), range(3) b(k)),
s AS (SELECT frame, oy, ox, sum((v + 3) * t) / sqrt(sum((v + 3) * (v + 3)) * sum(t * t)) AS score FROM mv, o, t WHERE mv.p // 8 = t.y + oy AND mv.p % 8 = t.x + ox GROUP BY ALL)
SELECT frame, (1 - oy)::DOUBLE AS dy, (1 - ox)::DOUBLE AS dx FROM s QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC) = 1""")
def matched_shift(spark, d):
    image = np.array([r.v for r in reduce.image(pixels(spark, d)).orderBy("pix").collect()]).reshape(SIDE, SIDE) + 3
    return each_frame(spark, d, lambda f, x: [(f, *registration.match_shift(x + 3, image, (1, 1), refine=False))], "frame long, dy double, dx double")


@query("""WITH l AS (SELECT n, s, o, least(n, s + o) AS size FROM (VALUES (100, 48, 24), (64, 16, 8), (30, 48, 24), (97, 32, 1)) t(n, s, o)), k AS (SELECT n, s, o, size, unnest(range(0, n - size + 1, s)) AS start FROM l UNION SELECT n, s, o, size, n - size FROM l)
SELECT n, s, o, size, start, start + (size - 1) / 2.0::DOUBLE AS centre FROM k""")
def patch_layout(spark, d):
    rows = []
    for n, s, o in ((100, 48, 24), (64, 16, 8), (30, 48, 24), (97, 32, 1)):
        starts, size = registration.patch_starts(n, s, o)
        rows += [(n, s, o, size, a, a + (size - 1) / 2) for a in starts]
    return spark.createDataFrame(rows, "n int, s int, o int, size int, start long, centre double")


KEYS = "CASE WHEN abs({t}) <= 1 THEN 1.25::DOUBLE * power(abs({t}), 3) - 2.25::DOUBLE * power(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -0.75::DOUBLE * power(abs({t}), 3) + 3.75::DOUBLE * power(abs({t}), 2) - 6 * abs({t}) + 3 ELSE 0 END"


@query(f"""WITH {MV}, ky AS (SELECT i, least(7, greatest(0, j)) AS j, sum({KEYS.format(t="(i - 0.3::DOUBLE - j)")}) AS w FROM range(8) a(i), range(-4, 12) b(j) GROUP BY ALL), kx AS (SELECT i, least(7, greatest(0, j)) AS j, sum({KEYS.format(t="(i + 0.6::DOUBLE - j)")}) AS w FROM range(8) a(i), range(-4, 12) b(j) GROUP BY ALL),
s AS (SELECT frame, ky.i * 8 + kx.i AS pix, sum(v * ky.w * kx.w) AS v FROM mv JOIN ky ON ky.j = p // 8 JOIN kx ON kx.j = p % 8 WHERE frame < 100 GROUP BY ALL), m AS (SELECT frame, min(v) AS a, max(v) AS b FROM mv GROUP BY frame)
SELECT frame, pix, round(least(b, greatest(a, s.v)), 5) AS v FROM s JOIN m USING (frame)""")
def cubic_warp(spark, d):
    field = np.broadcast_to(np.array([0.3, -0.6]), (SIDE, SIDE, 2))
    done = each_frame(spark, d, lambda f, x: image_rows(f, registration.warp(x, field)) if f < 100 else [], "frame long, pix long, v double")
    return done.select("frame", "pix", (F.round("v", 5) + 0.0).alias("v"))


PHASE = "{n} AS (SELECT i, j, sum(cos(2 * pi() * k * (i - j - {s}::DOUBLE) / 8)) / 8 AS re, sum(sin(2 * pi() * k * (i - j - {s}::DOUBLE) / 8)) / 8 AS im FROM range(8) a(i), range(8) b(j), range(-4, 4) c(k) GROUP BY ALL)"


@query(f"""WITH {MV}, {PHASE.format(n="py", s="1.3")}, {PHASE.format(n="px", s="(-0.4)")} SELECT frame, py.i * 8 + px.i AS pix, round(sum(v * (py.re * px.re - py.im * px.im)), 5) AS v FROM mv JOIN py ON py.j = p // 8 JOIN px ON px.j = p % 8 WHERE frame < 100 GROUP BY ALL""")
def fourier_shift(spark, d):
    done = each_frame(spark, d, lambda f, x: image_rows(f, registration.move(x, 1.3, -0.4, False)) if f < 100 else [], "frame long, pix long, v double")
    return done.select("frame", "pix", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""WITH {MV}, m AS (SELECT *, p // 8 AS y, p % 8 AS x, min(v) OVER (PARTITION BY frame) AS least FROM mv WHERE frame < 50), k AS (SELECT * FROM (VALUES ('copy'), ('min'), ('nan'), ('none')) t(mode))
SELECT mode, m.frame, m.p AS pix, round(CASE mode WHEN 'none' THEN m.v WHEN 'copy' THEN c.v WHEN 'min' THEN CASE WHEN m.y < 2 OR m.x > 6 THEN m.least ELSE m.v END ELSE CASE WHEN m.y < 2 OR m.x > 6 THEN NULL ELSE m.v END END, 6) AS v
FROM k, m JOIN m c ON c.frame = m.frame AND c.y = greatest(2, m.y) AND c.x = least(6, m.x)""")
def border_modes(spark, d):
    modes = (("copy", "copy"), ("min", "min"), ("nan", True), ("none", False))

    def run(f, x):
        return [(n, *r) for n, m in modes for r in image_rows(f, registration.fill_border(x, 1.2, -0.4, m, x.min()))] if f < 50 else []

    names = "mode string, frame long, pix long, v double"

    def scan(batches):
        for batch in batches:
            rows = [r for f, p in zip(batch["frame"], batch["pixels"]) for r in run(int(f), np.asarray(p, float).reshape(SIDE, SIDE))]
            yield pd.DataFrame(rows, columns=[k.split()[0] for k in names.split(", ")])

    done = frames(spark, d).select("frame", "pixels").mapInPandas(scan, names)
    return done.select("mode", "frame", "pix", r6(F.nanvl("v", F.lit(None)), "v"))


@query(f"""WITH {MV}, k AS (SELECT a.i AS dy, b.i AS dx, exp(-0.5::DOUBLE * (a.i * a.i + b.i * b.i)) AS k FROM range(-1, 2) a(i), range(-1, 2) b(i)), z AS (SELECT dy, dx, CASE WHEN abs(dy) + abs(dx) <= 1 THEN k - (SELECT avg(k) FROM k WHERE abs(dy) + abs(dx) <= 1) ELSE 0 END AS k FROM k),
n AS (SELECT y.i * 8 + x.i AS pix, CASE WHEN y.i + dy < 0 THEN 1 WHEN y.i + dy > 7 THEN 6 ELSE y.i + dy END * 8 + CASE WHEN x.i + dx < 0 THEN 1 WHEN x.i + dx > 7 THEN 6 ELSE x.i + dx END AS p, k FROM z, range(8) y(i), range(8) x(i))
SELECT frame, pix, round(sum(v * k), 5) AS v FROM mv JOIN n USING (p) WHERE frame < 100 GROUP BY ALL""")
def one_photon_filter(spark, d):
    done = each_frame(spark, d, lambda f, x: image_rows(f, registration.high_pass(x, 1)) if f < 100 else [], "frame long, pix long, v double")
    return done.select("frame", "pix", (F.round("v", 5) + 0.0).alias("v"))


@query("""WITH g AS (SELECT y, x, (2 - 1 + 0.0) AS z, least(1, greatest(0, (y - 1.5::DOUBLE) / 4)) AS u, least(1, greatest(0, (x - 1.5::DOUBLE) / 4)) AS w FROM range(8) a(y), range(8) b(x))
SELECT y * 8 + x AS pix, round((1 - u) * (1 - w) * 1.0::DOUBLE + (1 - u) * w * 2 + u * (1 - w) * -1 + u * w * 0.5::DOUBLE, 6) AS dy, round((1 - u) * (1 - w) * 0.25::DOUBLE + (1 - u) * w * -2 + u * (1 - w) * 3 + u * w * 1, 6) AS dx FROM g""")
def patch_field(spark, d):
    grid = np.array([[[1.0, 0.25], [2.0, -2.0]], [[-1.0, 3.0], [0.5, 1.0]]])
    field = registration.field_of(grid, (np.array([1.5, 5.5]), np.array([1.5, 5.5])), (SIDE, SIDE)).reshape(-1, 2)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(field)], "pix long, dy double, dx double").select("pix", r6("dy"), r6("dx"))


def _rolled(spark, d):
    """The movie's frames rolled by known whole shifts, and those shifts as a motion."""
    f = movie(spark, d)
    g = F.col("frame") + F.col("epoch_index") * 100
    dy, dx = (g % 3 - 1).cast("double"), (g % 2).cast("double")
    rigid = f.frames.select("epoch_index", "frame", "plane_index", dy.alias("dy"), dx.alias("dx"), (g % 7 == 0).alias("bad"))
    return f, motion.Motion(rigid, "integer", {0: np.zeros((SIDE, SIDE))}, params={"max_shift": [2, 2]})


@query(f"WITH {MV} SELECT frame // 100 AS epoch_index, frame % 100 AS frame, ((p // 8 - (frame % 3 - 1) + 8) % 8) * 8 + (p % 8 - frame % 2 + 8) % 8 AS pix, round(v, 5) AS v FROM mv")
def registered_movie(spark, d):
    f, m = _rolled(spark, d)
    p = motion.register_motion(f, m).pixels()
    return p.select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", F.col("pix").cast("long").alias("pix"), (F.round("v", 5) + 0.0).alias("v"))


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, ((vec_id % 3) - 1)::DOUBLE AS dy, (vec_id % 2)::DOUBLE AS dx, vec_id % 7 = 0 AS bad FROM embeddings")
def motion_round_trip(spark, d):
    import json

    told = json.loads(json.dumps(_rolled(spark, d)[1].to_dict()))
    back = motion.Motion.from_dict(spark, told)
    assert isinstance(back.template[0], np.ndarray) and back.template[0].shape == (SIDE, SIDE)
    return back.rigid.select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", "dy", "dx", "bad")


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, ((vec_id % 3) - 1)::DOUBLE AS dy, (vec_id % 2)::DOUBLE AS dx FROM embeddings WHERE vec_id % 100 IN (3, 40, 41)")
def displacement_at_frames(spark, d):
    return _rolled(spark, d)[1].at([3, 40, 41], 0).select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", "dy", "dx")


@query("SELECT 0 AS plane_index, * FROM (VALUES ('y', 1, 7), ('x', 0, 7)) t(axis, lo, hi)")
def motion_ranges(spark, d):
    return _rolled(spark, d)[1].ranges(SIDE, SIDE)


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, vec_id % 7 = 0 AS bad FROM embeddings")
def motion_bad_frames(spark, d):
    return _rolled(spark, d)[1].bad_frames().select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", "bad")


@query("SELECT 20::BIGINT AS n, 80::BIGINT AS first, 99::BIGINT AS last, TRUE AS warned, TRUE AS refused")
def registered_read(spark, d):
    import warnings

    f, m = _rolled(spark, d)
    done = motion.register_motion(f, m)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rows = motion.registered_series(done, 80, 400, epoch_index=1)
    try:
        motion.registered_series(done, 101, None, epoch_index=1)
        refused = False
    except IndexError:
        refused = True
    return rows.agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.lit(any("past the last" in str(w.message) for w in seen)).alias("warned"), F.lit(refused).alias("refused"))


@query(f"""WITH {MV}, t AS (SELECT max(frame) + 1 AS t FROM mv), s AS (SELECT p, frame * greatest(t // 56, 1) // t AS chunk, avg(v) AS v FROM mv, t GROUP BY ALL) SELECT p AS pix, round(median(v), 5) AS v FROM s GROUP BY p""")
def corrected_template(spark, d):
    """The template of one pass over a movie that does not move."""
    f = frames(spark, d).withColumn("epoch_index", F.lit(0))
    still = f.select("epoch_index", "frame", "plane_index", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    total = f.agg(F.max("frame") + 1).first()[0]
    image = motion._corrected_mean(f, still, (SIDE, SIDE), 56, total)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(image.ravel())], "pix long, v double").select("pix", (F.round("v", 5) + 0.0).alias("v"))


def texture(side: int) -> np.ndarray:
    """A smooth image whose frequencies are known."""
    y, x = np.mgrid[:side, :side] * (2 * np.pi / side)
    return 100 + 20 * (np.sin(3 * y + 1) * np.cos(2 * x) + np.cos(5 * x + 2 * y) + np.sin(4 * y - 3 * x + 0.5) + np.cos(7 * x - 6 * y))


def drifting(spark, shifts: list[tuple[float, float]], side: int = 48) -> Imaging:
    from .sources.arrays import imaging_from_numpy

    return imaging_from_numpy(spark, np.stack([registration.move(texture(side), dy, dx, False) for dy, dx in shifts]).astype(np.float32), 10.0)


@query("SELECT f AS frame, ((f * 7) % 5 - 2)::DOUBLE AS dy, ((f * 3) % 4 - 1)::DOUBLE AS dx FROM range(40) t(f)")
def integer_motion(spark, d):
    """Whole shifts of a drifting texture, up to the constant by which the reference lies off."""
    shifts = [((f * 7) % 5 - 2, (f * 3) % 4 - 1) for f in range(40)]
    found = motion.compute_motion(drifting(spark, shifts), "integer", max_shift=(6, 6), spatial_taper=0.0).rigid
    first = found.where("frame = 0").select(F.col("dy").alias("y0"), F.col("dx").alias("x0"))
    return found.crossJoin(F.broadcast(first)).select("frame", (F.col("dy") - F.col("y0") - 2).alias("dy"), (F.col("dx") - F.col("x0") - 1).alias("dx"))  # one row


@query("SELECT f AS frame, TRUE AS close FROM range(30) t(f)")
def piecewise_motion(spark, d):
    """Fractional shifts are found to a quarter of a pixel, up to a constant; the oracle states that floor."""
    shifts = [(2.5 * np.sin(f * 0.7), 2.0 * np.cos(f * 0.4)) for f in range(30)]
    found = motion.compute_motion(drifting(spark, shifts), "piecewise", nonrigid=False).rigid.toPandas().sort_values("frame")
    error = found[["dy", "dx"]].to_numpy() - np.array(shifts)
    error -= np.median(error, axis=0)
    return spark.createDataFrame([(f, bool(np.abs(e).max() <= 0.25)) for f, e in enumerate(error)], "frame long, close boolean")


@query("SELECT f AS frame, TRUE AS close, TRUE AS steady FROM range(16) t(f)")
def patchwise_motion(spark, d):
    """Patch shifts of a rigid drift agree with it, and both warps bring the frames back inside the border."""
    shifts = [(1.5 * np.sin(f * 0.9), 1.2 * np.cos(f * 0.6)) for f in range(16)]
    film = drifting(spark, shifts, 64)
    found = motion.compute_motion(film, "piecewise", strides=(24, 24), overlaps=(8, 8))
    error = found.rigid.toPandas().sort_values("frame")[["dy", "dx"]].to_numpy() - np.array(shifts)
    error -= np.median(error, axis=0)
    steady = np.ones(16, bool)
    for patchwise in (False, True):
        rows = motion.register_motion(film, found, patchwise=patchwise).frames.orderBy("frame").toPandas()
        x = np.stack(rows["pixels"].to_list()).reshape(16, 64, 64)[:, 8:-8, 8:-8]
        steady &= np.abs(x - np.median(x, axis=0)).mean(axis=(1, 2)) < 0.3 * texture(64).std()
    return spark.createDataFrame([(f, bool(np.abs(e).max() <= 0.25), bool(s)) for f, (e, s) in enumerate(zip(error, steady))], "frame long, close boolean, steady boolean")


@query("SELECT f AS frame, TRUE AS close, TRUE AS steady FROM range(12) t(f)")
def block_motion(spark, d):
    """Whole shifts with block shifts on top: a drift is found to the pixel, and frames come back to one another inside the border."""
    shifts = [((f * 5) % 5 - 2, (f * 3) % 4 - 1) for f in range(12)]
    film = drifting(spark, shifts, 64)
    found = motion.compute_motion(film, "integer", max_shift=(6, 6), spatial_taper=0.0, nonrigid=True, block_size=(32, 32))
    error = found.rigid.toPandas().sort_values("frame")[["dy", "dx"]].to_numpy() - np.array(shifts)
    error -= np.median(error, axis=0)
    rows = motion.register_motion(film, found).frames.orderBy("frame").toPandas()
    x = np.stack(rows["pixels"].to_list()).reshape(12, 64, 64)[:, 8:-8, 8:-8]
    steady = np.abs(x - np.median(x, axis=0)).mean(axis=(1, 2)) < 0.3 * texture(64).std()
    return spark.createDataFrame([(f, bool(np.abs(e).max() < 0.5), bool(s)) for f, (e, s) in enumerate(zip(error, steady))], "frame long, close boolean, steady boolean")


@query("SELECT f AS frame, i, j, TRUE AS close FROM range(6) a(f), range(3) b(i), range(3) c(j)")
def patch_shifts(spark, d):
    """Shifts of patches that were each moved by a shift of their own."""
    base, out = kernels.smooth_image(np.random.default_rng(0).normal(size=(96, 96)), 1.5) * 100, []
    for f in range(6):
        rigid, found, centres = registration.patch_shifts(registration.move(base, 0.4 * f, -0.3 * f, False), base, (24, 24), (24, 24), (5, 5), 3)
        out += [(f, i, j, bool(np.abs(found[i, j] - np.array([-0.4 * f, 0.3 * f])).max() <= 0.25)) for i in range(found.shape[0]) for j in range(found.shape[1])]
    return spark.createDataFrame(out, "frame long, i long, j long, close boolean")


# -- scalar kernels -----------------------------------------------------------------------


@query("SELECT k, round(2 * sum(x * cos(pi() * k * (2 * i + 1) / 32)), 6) AS c FROM (SELECT i, ((i * 7) % 16 - 3)::DOUBLE AS x FROM range(16) a(i)), range(16) b(k) GROUP BY k")
def cosine_transform(spark, d):
    c = kernels._cosine(np.array([(i * 7) % 16 - 3.0 for i in range(16)]))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "k long, c double").select("k", r6("c"))


@query("SELECT i, j, round(v, 12) AS v FROM (VALUES (0, 0, 4 / 11.0::DOUBLE), (0, 1, -1 / 11.0::DOUBLE), (1, 0, -1 / 11.0::DOUBLE), (1, 1, 3 / 11.0::DOUBLE)) t(i, j, v)")
def pseudo_inverse(spark, d):
    m = kernels.ridge_inverse(np.array([[3.0, 1.0], [1.0, 4.0]]), 0.0)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double").select("i", "j", F.round("v", 12).alias("v"))
