"""Registered queries over the driver's tables, with the DuckDB SQL that must agree.

The tables stand in for a recording: ``embeddings`` is a movie of 8 x 8 frames,
``events`` holds traces (a user is a region) and spikes (purchases). Values are
rounded, for sums are taken in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Epoch, Imaging, Rois, explode_pixels
from .operators import algebra, extraction, reduce, scoring, traces

SIDE, FS, EPOCH = 8, 10.0, 100
#: Six discs: region, centre row, centre column; the first two overlap.
DISCS = [("r0", 2, 2), ("r1", 2, 3), ("r2", 5, 5), ("r3", 6, 1), ("r4", 1, 6), ("r5", 4, 0)]
ROIS = [r for r, _, _ in DISCS]
LITERAL = ", ".join(f"('{r}', {y}, {x})" for r, y, x in DISCS)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the oracle's side.
MV = """mv AS (SELECT vec_id AS frame, vec_id // 100 AS epoch, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
DISC = f"""disc AS (SELECT roi, y, x, y * 8 + x AS p, (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2
  FROM (VALUES {LITERAL}) c(roi, cy, cx), (SELECT range AS y FROM range(8)), (SELECT range AS x FROM range(8)))"""
MK = f"""{DISC}, mk AS (SELECT roi, y, x, p, 1.0::DOUBLE AS w FROM disc WHERE d2 <= 2)"""
MKW = f"""{DISC}, mk AS (SELECT roi, y, x, p, 1 - sqrt(d2) / 2 AS w FROM disc WHERE d2 <= 2)"""
RG = """free AS (SELECT roi, p FROM disc WHERE d2 BETWEEN 3 AND 9 AND p NOT IN (SELECT p FROM mk)),
  rg AS (SELECT roi, p, 1.0::DOUBLE / count(*) OVER (PARTITION BY roi) AS w FROM free)"""
TR = """tr AS (SELECT user_id AS roi, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type, ts, event_id FROM events)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movie's frames under their global number."""
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") / EPOCH).cast("int").alias("epoch_index"), F.col("vec_id").alias("frame"), F.lit(0).alias("plane_index"), F.col("embedding").alias("pixels"))


def movie(spark: SparkSession, sf_dir: str) -> Imaging:
    """The movie in epochs of EPOCH frames."""
    f = frames(spark, sf_dir).withColumn("frame", F.col("frame") % EPOCH)
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    epochs = tuple(Epoch(min(EPOCH, n - a), a / FS) for a in range(0, n, EPOCH))
    return Imaging(f, FS, SIDE, SIDE, epochs)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_pixels(frames(spark, sf_dir)).select("frame", F.col("epoch_index").alias("epoch"), "pix", "v")


def discs(spark: SparkSession) -> DataFrame:
    """(roi, y, x, pix, d2) over the whole field."""
    c = spark.createDataFrame(DISCS, "roi string, cy int, cx int")
    y, x = (spark.range(SIDE).select(F.col("id").cast("int").alias(n)) for n in "yx")
    grid = c.crossJoin(y).crossJoin(x)  # 6 x 8 x 8 literals
    return grid.select("roi", "y", "x", (F.col("y") * SIDE + F.col("x")).alias("pix"), (F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)).alias("d2"))


def masks(spark: SparkSession, weighted: bool = False) -> DataFrame:
    w = 1 - F.sqrt("d2") / 2 if weighted else F.lit(1.0)
    return discs(spark).where("d2 <= 2").select("roi", "y", "x", "pix", w.alias("w"))


def rings(spark: SparkSession) -> DataFrame:
    return extraction.ring_masks(masks(spark), discs(spark).where("d2 between 3 and 9").select("roi", "pix"))


def rois(spark: SparkSession) -> Rois:
    m = masks(spark, True).select(F.col("roi").alias("roi_id"), F.lit(0).alias("plane_index"), "y", "x", "w")
    return Rois(m, SIDE, SIDE, tuple(r for r, _, _ in DISCS), fs=FS)


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(roi, frame, value, event_type) of the events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("roi"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "value", "event_type")


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    # adding 0 turns -0.0 into 0.0
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


# -- movies -----------------------------------------------------------------

SERIES = "SELECT {0}::BIGINT AS epoch_index, {1} AS frame, count(*) AS n, round(sum(v), 6) AS total FROM mv {2} GROUP BY ALL"


def series(m: Imaging) -> DataFrame:
    """A movie's frames by number of pixels and their sum."""
    p = m.pixels()
    return p.groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame").agg(F.count("*").alias("n"), r6(F.sum("v"), "total"))


@query(f"WITH {MV} " + SERIES.format(2, "frame % 100", "WHERE frame >= 210 AND frame < 260"))
def get_series(spark, d):
    m = movie(spark, d)
    return series(m.with_frames(m.get_series(10, 60, epoch_index=2)))


@query(f"WITH {MV} " + SERIES.format(0, "frame - 120", "WHERE frame >= 120 AND frame < 170"))
def frame_slice(spark, d):
    return series(algebra.frame_slice(movie(spark, d), 20, 70, 1))


@query(f"WITH {MV}, pick(old, new) AS (VALUES (3, 0), (1, 1), (3, 2)) SELECT new::BIGINT AS epoch_index, frame % 100 AS frame, count(*) AS n, round(sum(v), 6) AS total FROM mv JOIN pick ON epoch = old GROUP BY ALL")
def split_epochs(spark, d):
    return series(algebra.split_epochs(movie(spark, d), [3, 1, 3]))


@query(f"WITH {MV} SELECT CASE WHEN frame >= 170 THEN 2 WHEN frame >= 130 THEN 1 ELSE 0 END::BIGINT AS epoch_index, frame - CASE WHEN frame >= 170 THEN 170 WHEN frame >= 130 THEN 130 ELSE 100 END AS frame, count(*) AS n, round(sum(v), 6) AS total FROM mv WHERE epoch = 1 GROUP BY ALL")
def split_epoch_at_frames(spark, d):
    return series(algebra.split_epoch_at_frames(movie(spark, d), [30, 70], 1))


@query(f"WITH {MV} " + SERIES.format(0, "frame", ""))
def concatenate_epochs(spark, d):
    return series(algebra.concatenate(movie(spark, d)))


@query(f"WITH {MV}, two AS (SELECT epoch AS epoch_index, * FROM mv UNION ALL SELECT epoch + (SELECT max(epoch) + 1 FROM mv), * FROM mv) SELECT epoch_index, frame % 100 AS frame, count(*) AS n, round(sum(v), 6) AS total FROM two GROUP BY ALL")
def append_imaging(spark, d):
    m = movie(spark, d)
    return series(algebra.append([m, m]))


@query(f"WITH {MV} SELECT epoch AS epoch_index, frame % 100 AS frame, k::BIGINT AS plane_index, round(sum(v * (k + 1)), 6) AS total FROM mv, (VALUES (0), (1)) t(k) GROUP BY ALL")
def stack_planes(spark, d):
    m = movie(spark, d)
    twice = m.with_frames(m.frames.withColumn("pixels", F.transform("pixels", lambda v: v * F.lit(2).cast("float"))))
    both = algebra.stack_planes(m, twice).pixels()
    return both.groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", F.col("plane_index").cast("long").alias("plane_index")).agg(r6(F.sum("v"), "total"))


@query(f"WITH {MV} SELECT epoch AS epoch_index, frame % 100 AS frame, k::BIGINT AS plane_index, round(sum(v * (2 - k)), 6) AS total FROM mv, (VALUES (0), (1)) t(k) GROUP BY ALL")
def select_planes(spark, d):
    m = movie(spark, d)
    twice = m.with_frames(m.frames.withColumn("pixels", F.transform("pixels", lambda v: v * F.lit(2).cast("float"))))
    both = algebra.select_planes(algebra.stack_planes(m, twice), [1, 0]).pixels()
    return both.groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", F.col("plane_index").cast("long").alias("plane_index")).agg(r6(F.sum("v"), "total"))


@query(f"WITH {MV} SELECT frame, count(*) AS n, round(sum(v), 6) AS total FROM mv WHERE p // 8 BETWEEN 2 AND 5 AND p % 8 BETWEEN 1 AND 6 GROUP BY frame")
def crop_bounds(spark, d):
    return algebra.crop(pixels(spark, d), SIDE, (2, 6), (1, 7)).groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("v"), "total"))


@query(f"WITH {MV}, e AS (SELECT epoch, count(DISTINCT frame) AS n_frames FROM mv GROUP BY epoch) SELECT epoch AS epoch_index, n_frames, (sum(n_frames) OVER (ORDER BY epoch) - n_frames)::BIGINT AS frame_offset, epoch * 10.0::DOUBLE AS t_start FROM e")
def frame_offsets(spark, d):
    return movie(spark, d).epoch_frame().select(F.col("epoch_index").cast("long").alias("epoch_index"), "n_frames", "frame_offset", "t_start")


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, round((vec_id // 100) * 10.0::DOUBLE + (vec_id % 100) / 10.0::DOUBLE + 2, 6) AS t FROM embeddings")
def frame_times(spark, d):
    return movie(spark, d).shift_times(2.0).with_times().select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", r6("t"))


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, bool_or(label = 3 OR label % 4 = 1) AS bad FROM embeddings GROUP BY ALL")
def badframe_union(spark, d):
    v = table(spark, d, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("epoch_index"), (F.col("vec_id") % 100).alias("frame"), "label")
    return algebra.bad_frame_union(v.select("epoch_index", "frame", (F.col("label") == 3).alias("bad")), v.select("epoch_index", "frame", (F.col("label") % 4 == 1).alias("bad")))


@query("""WITH f AS (SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, label < 5 AS bad FROM embeddings),
b AS (SELECT epoch_index, frame // 10 AS batch, avg((NOT bad)::INT) AS good FROM f GROUP BY ALL)
SELECT f.epoch_index, f.frame, f.frame // 10 AS batch FROM f JOIN b ON f.epoch_index = b.epoch_index AND f.frame // 10 = b.batch WHERE NOT bad OR good <= 0.5""")  # fmt: skip
def badframe_batch_filter(spark, d):
    v = table(spark, d, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("epoch_index"), (F.col("vec_id") % 100).alias("frame"), (F.col("label") < 5).alias("bad"))
    return algebra.drop_bad_frames(v.select("epoch_index", "frame"), v, 10)


@query("SELECT l_suppkey AS plane, max(l_linenumber)::BIGINT AS lo, min(l_quantity) AS hi FROM lineitem GROUP BY 1")
def range_intersection(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plane"), F.col("l_linenumber").cast("long").alias("lo"), F.col("l_quantity").alias("hi"))
    return algebra.range_intersection(r, "plane")


# -- regions ----------------------------------------------------------------


@query(f"WITH {MKW} SELECT roi AS roi_id, y, x, round(w, 6) AS w FROM mk WHERE roi IN ('r4', 'r1')")
def select_rois(spark, d):
    return rois(spark).select(["r4", "r1"]).masks.select("roi_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("w"))


@query(f"WITH {MKW} SELECT roi AS roi_id, count(*) AS n, round(sum(w), 6) AS w FROM mk WHERE roi NOT IN ('r0', 'r5') GROUP BY roi")
def remove_rois(spark, d):
    return rois(spark).remove(["r0", "r5"]).masks.groupBy("roi_id").agg(F.count("*").alias("n"), r6(F.sum("w"), "w"))


@query(f"WITH {MKW} SELECT roi AS roi_id, p AS pix, round(w, 6) AS w FROM mk WHERE w <> 0")
def pixel_masks(spark, d):
    return rois(spark).pixel_masks().select("roi_id", (F.col("y") * SIDE + F.col("x")).cast("long").alias("pix"), r6("w"))


@query(f"WITH {MKW} SELECT roi AS roi_id, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS npix FROM mk WHERE w <> 0 GROUP BY roi")
def roi_centroid_bbox(spark, d):
    g = rois(spark).geometry()
    return g.select("roi_id", r6("cy"), r6("cx"), *[F.col(c).cast("long").alias(c) for c in ("y0", "y1", "x0", "x1")], "npix")


# -- images and reductions --------------------------------------------------


def _image(how, sql):
    return lambda spark, d: reduce.image(pixels(spark, d), how).select(F.col("pix").cast("long").alias("pix"), r6("v")), f"WITH {MV} SELECT p AS pix, round({sql}, 6) AS v FROM mv GROUP BY p"


for _name, (_run, _sql) in {"average_image": _image(F.avg, "avg(v)"), "std_image": _image(F.stddev_pop, "stddev_pop(v)"), "max_projection": _image(F.max, "max(v)")}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _run, _sql


@query(f"""WITH {MV}, n AS (SELECT *, frame // 70 AS batch, frame % 70 AS pos FROM mv), l AS (SELECT batch, max(pos) + 1 AS len FROM n GROUP BY batch)
SELECT n.batch, pos // 20 AS bin, p AS pix, round(avg(v), 6) AS v FROM n JOIN l USING (batch) WHERE len <= 20 OR (pos // 20 + 1) * 20 <= len GROUP BY ALL""")
def temporal_bin(spark, d):
    return reduce.temporal_bins(pixels(spark, d), 20, 70).select("batch", "bin", F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"WITH {MV}, b AS (SELECT p, frame % 10 AS bin, avg(v) AS v FROM mv GROUP BY ALL) SELECT p AS pix, round(median(v), 6) AS v FROM b GROUP BY p")
def bin_median(spark, d):
    return reduce.bin_median(pixels(spark, d), 10).select(F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"WITH {MV} SELECT frame // 4 AS t, p // 8 // 2 AS by, p % 8 // 2 AS bx, round(avg(v), 6) AS v FROM mv GROUP BY ALL")
def spacetime_bin(spark, d):
    return reduce.binned(pixels(spark, d), SIDE, 4, 2).select("t", "by", "bx", r6("v"))


@query(f"WITH {MV} SELECT round(sum(v * v), 6) AS norm_sq FROM mv")
def movie_norm_sq(spark, d):
    return reduce.norm_squared(pixels(spark, d)).select(r6("norm_sq"))


@query(f"WITH {MV} SELECT epoch, round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.99), 6) AS high FROM mv GROUP BY epoch")
def contrast_limits(spark, d):
    p = pixels(spark, d).withColumn("epoch", F.col("epoch").cast("long"))
    return p.groupBy("epoch").agg(r6(reduce.percentile(F.col("v"), 0.01), "low"), r6(reduce.percentile(F.col("v"), 0.99), "high"))


# -- traces from masks ------------------------------------------------------


@query(f"WITH {MV}, {MK} SELECT frame, roi, round(sum(v * w) / sum(w * w), 6) AS value FROM mv JOIN mk USING (p) GROUP BY ALL")
def trace_projection(spark, d):
    return extraction.projection(pixels(spark, d), masks(spark), ["frame"]).select("frame", "roi", r6("value"))


@query(f"WITH {MV}, {MKW} SELECT frame, roi, round(sum(v * w) / sum(w * w), 6) AS value FROM mv JOIN mk USING (p) GROUP BY ALL")
def trace_projection_weighted(spark, d):
    return extraction.projection_of_frames(frames(spark, d), masks(spark, True), ["frame"], ROIS).select("frame", "roi", r6("value"))


@query(f"WITH {MV}, {MKW} SELECT frame, roi, round(sum(v * w) / sum(w), 6) AS value FROM mv JOIN mk USING (p) GROUP BY ALL")
def trace_mean_l1(spark, d):
    return extraction.mean_trace(pixels(spark, d), masks(spark, True), ["frame"]).select("frame", "roi", r6("value"))


@query(f"""WITH {MV}, {MK}, {RG}, n AS (SELECT roi, sum(w) AS l1, sum(w * w) AS l2 FROM mk GROUP BY roi),
f AS (SELECT frame, roi, sum(v * w) AS dot FROM mv JOIN mk USING (p) GROUP BY ALL), r AS (SELECT frame, roi, sum(v * w) AS ring FROM mv JOIN rg USING (p) GROUP BY ALL)
SELECT frame, roi, round((dot / l1 - 0.7::DOUBLE * coalesce(ring, 0)) * l1 / l2, 6) AS value, round(coalesce(ring, 0) * l1 / l2, 6) AS neuropil FROM f JOIN n USING (roi) LEFT JOIN r USING (frame, roi)""")
def trace_surround(spark, d):
    done = extraction.surround_of_frames(frames(spark, d), masks(spark), rings(spark), 0.7, ["frame"], ROIS)
    return done.select("frame", "roi", r6("value"), r6("background", "neuropil"))


@query(f"WITH {MK}, {RG} SELECT roi, p AS pix, round(w, 6) AS w FROM rg")
def neuropil_ring_weights(spark, d):
    return rings(spark).select("roi", F.col("pix").cast("long").alias("pix"), r6("w"))


@query(f"WITH {MV}, {MK}, g AS (SELECT frame, avg(v) AS g FROM mv WHERE p NOT IN (SELECT p FROM mk) GROUP BY frame), f AS (SELECT frame, roi, sum(v * w) / sum(w) AS f FROM mv JOIN mk USING (p) GROUP BY ALL) SELECT frame, roi, round(f - 0.7::DOUBLE * g, 6) AS value FROM f JOIN g USING (frame)")
def global_neuropil(spark, d):
    outside = extraction.global_neuropil(frames(spark, d), masks(spark), ["frame"])
    return extraction.mean_trace(pixels(spark, d), masks(spark), ["frame"]).join(outside, "frame").select("frame", "roi", r6(F.col("value") - 0.7 * F.col("g"), "value"))


@query(f"WITH {MKW} SELECT a.roi AS roi_i, b.roi AS roi_j, round(sum(a.w * b.w), 6) AS g FROM mk a JOIN mk b USING (p) GROUP BY ALL")
def mask_gram(spark, d):
    return extraction.gram(masks(spark, True)).select("roi_i", "roi_j", r6("g"))


@query(f"""WITH {MK}, s AS (SELECT a.roi, b.roi AS o, count(*) AS n FROM mk a JOIN mk b USING (p) WHERE a.roi <> b.roi GROUP BY ALL)
SELECT roi, round(coalesce((SELECT max(n) FROM s WHERE s.roi = m.roi), 0) / count(*), 6) AS overlap FROM mk m GROUP BY roi""")
def roi_overlap_fraction(spark, d):
    return extraction.overlap_fraction(masks(spark)).select("roi", r6("overlap"))


@query(f"WITH {MV}, {MKW}, b AS (SELECT p, avg(v) AS b FROM mv GROUP BY p) SELECT roi, round(sum(w * b), 6) AS g FROM mk JOIN b USING (p) GROUP BY roi")
def background_gram(spark, d):
    b = reduce.image(pixels(spark, d)).select("pix", F.lit("b").alias("component"), F.col("v").alias("w"))
    return extraction.dots(b.withColumnRenamed("w", "v"), masks(spark, True), ["component"]).select("roi", r6("dot", "g"))


@query(f"""WITH {MV}, {MKW}, y AS (SELECT frame, roi, sum(v * w) AS y FROM mv JOIN mk USING (p) WHERE roi IN ('r0', 'r1') GROUP BY ALL),
g AS (SELECT sum(CASE WHEN a.roi = 'r0' AND b.roi = 'r0' THEN a.w * b.w END) AS g00, sum(CASE WHEN a.roi = 'r0' AND b.roi = 'r1' THEN a.w * b.w END) AS g01, sum(CASE WHEN a.roi = 'r1' AND b.roi = 'r1' THEN a.w * b.w END) AS g11 FROM mk a JOIN mk b USING (p)),
t AS (SELECT frame, max(CASE WHEN roi = 'r0' THEN y END) AS y0, max(CASE WHEN roi = 'r1' THEN y END) AS y1 FROM y GROUP BY frame)
SELECT frame, 'r0' AS roi, round((g11 * y0 - g01 * y1) / (g00 * g11 - g01 * g01), 6) AS value FROM t, g UNION ALL
SELECT frame, 'r1', round((g00 * y1 - g01 * y0) / (g00 * g11 - g01 * g01), 6) FROM t, g""")
def trace_regression_pair(spark, d):
    solver = extraction.JointSolver(masks(spark, True).where("roi in ('r0', 'r1')"), ridge=0.0)
    return solver.on_frames(frames(spark, d), ["frame"]).select("frame", "roi", r6("value"))


@query(f"WITH {MV}, {MKW} SELECT frame, roi, round(greatest(0, sum(v * w) / sum(w * w)), 6) AS value FROM mv JOIN mk USING (p) WHERE roi IN ('r2', 'r3', 'r4') GROUP BY ALL")
def trace_nnls_disjoint(spark, d):
    solver = extraction.JointSolver(masks(spark, True).where("roi in ('r2', 'r3', 'r4')"), ridge=0.0, nonnegative=True)
    return solver.on_frames(frames(spark, d), ["frame"]).select("frame", "roi", r6("value"))


@query(f"WITH {MV}, {MKW}, t AS (SELECT frame, roi, sum(v * w) / sum(w * w) AS value FROM mv JOIN mk USING (p) GROUP BY ALL) SELECT frame, p AS pix, round(sum(value * w), 6) AS v FROM t JOIN mk USING (roi) GROUP BY ALL")
def reconstruct_movie(spark, d):
    t = extraction.projection(pixels(spark, d), masks(spark, True), ["frame"])
    return extraction.reconstruct(t, masks(spark, True), ["frame"]).select("frame", F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"""WITH {MV}, {MKW}, t AS (SELECT frame, roi, sum(v * w) / sum(w * w) AS value FROM mv JOIN mk USING (p) GROUP BY ALL),
r AS (SELECT frame, p, sum(value * w) AS r FROM t JOIN mk USING (roi) GROUP BY ALL) SELECT p AS pix, round(avg(v - coalesce(r, 0)), 6) AS v FROM mv LEFT JOIN r USING (frame, p) GROUP BY p""")
def residual_mean_image(spark, d):
    p = pixels(spark, d)
    r = extraction.reconstruct(extraction.projection(p, masks(spark, True), ["frame"]), masks(spark, True), ["frame"]).withColumnRenamed("v", "r")
    left = p.join(r, ["frame", "pix"], "left").withColumn("v", F.col("v") - F.coalesce("r", F.lit(0.0)))
    return reduce.image(left).select(F.col("pix").cast("long").alias("pix"), r6("v"))


# -- traces -----------------------------------------------------------------

ROWS3 = "OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"WITH {TR}, l AS (SELECT *, min(value) {ROWS3} AS low FROM tr) SELECT roi, frame, round(max(low) {ROWS3}, 6) AS f0 FROM l")
def roll_min_max(spark, d):
    return traces.rolling_min_max(trace_table(spark, d), 3).select("roi", "frame", r6("f0"))


@query(f"WITH {TR} SELECT roi, frame, round(quantile_cont(value, 0.2) {ROWS3}, 6) AS f0 FROM tr")
def roll_percentile_trunc(spark, d):
    return traces.rolling_percentile(trace_table(spark, d), 3, 0.2).select("roi", "frame", r6("f0"))


@query(f"WITH {TR} SELECT roi, frame, round(median(value) {ROWS3}, 6) AS f0 FROM tr")
def roll_median(spark, d):
    return traces.rolling_percentile(trace_table(spark, d), 3, 0.5).select("roi", "frame", r6("f0"))


@query(f"WITH {TR} SELECT roi, round(quantile_cont(value, 0.08), 6) AS f0 FROM tr GROUP BY roi")
def global_percentile_baseline(spark, d):
    return traces.global_percentile(trace_table(spark, d), 0.08).select("roi", r6("f0")).distinct()


@query(f"""WITH {MV}, {MKW}, t AS (SELECT frame, roi, sum(v * w) / sum(w * w) AS value FROM mv JOIN mk USING (p) GROUP BY ALL),
b AS (SELECT roi, quantile_cont(value, 0.9) AS f0 FROM t GROUP BY roi) SELECT frame, roi, round((value - f0) / (f0 + 1.1920929e-07::DOUBLE), 4) AS dff FROM t JOIN b USING (roi)""")
def dff_global(spark, d):
    t = extraction.projection(pixels(spark, d), masks(spark, True), ["frame"])
    done = traces.global_percentile(t, 0.9).withColumn("dff", traces.dff(F.col("value"), F.col("f0")))
    return done.select("frame", "roi", (F.round("dff", 4) + 0.0).alias("dff"))


@query(f"WITH {TR}, l AS (SELECT *, min(value) {ROWS3} AS low FROM tr), b AS (SELECT *, max(low) {ROWS3} AS f0 FROM l) SELECT roi, frame, round((value - f0) / (f0 + 1.1920929e-07::DOUBLE), 4) AS dff FROM b")
def dff_maximin_nosmooth(spark, d):
    done = traces.rolling_min_max(trace_table(spark, d), 3)
    return done.select("roi", "frame", (F.round(traces.dff(F.col("value"), F.col("f0")), 4) + 0.0).alias("dff"))


@query(f"WITH {TR}, b AS (SELECT roi, quantile_cont(value, 0.2) AS f0, avg(value) / 2 AS b0 FROM tr GROUP BY roi) SELECT roi, frame, round((value - f0) / (f0 + b0 + 1.1920929e-07::DOUBLE), 6) AS dff FROM tr JOIN b USING (roi)")
def dff_with_background(spark, d):
    t = trace_table(spark, d)
    b0 = t.groupBy("roi").agg((F.avg("value") / 2).alias("b0"))
    done = traces.global_percentile(t, 0.2).join(b0, "roi")
    return done.select("roi", "frame", r6(traces.dff(F.col("value"), F.col("f0"), F.col("b0")), "dff"))


@query(f"WITH {TR} SELECT roi, frame, round(value - avg(value) {ROWS3}, 6) AS high FROM tr")
def temporal_highpass(spark, d):
    return traces.high_pass(trace_table(spark, d), 3).select("roi", "frame", r6("high"))


@query(f"WITH {TR}, l AS (SELECT *, min(value) {ROWS3} AS low FROM tr), b AS (SELECT roi, frame, max(low) {ROWS3} AS f0 FROM l) SELECT roi, frame, round(f0, 6) AS f0 FROM b WHERE frame >= 20 AND frame < 30")
def halo_frame_range(spark, d):
    return traces.with_halo(trace_table(spark, d), 20, 30, 6, lambda t: traces.rolling_min_max(t, 3)).select("roi", "frame", r6("f0"))


@query(f"""WITH {TR}, x AS (SELECT roi, value - lag(value) OVER (PARTITION BY roi ORDER BY frame) AS d FROM tr), y AS (SELECT roi, d, median(d) OVER (PARTITION BY roi) AS m FROM x WHERE d IS NOT NULL)
SELECT roi, round(median(abs(d - m)) / 0.6745::DOUBLE / sqrt(2), 6) AS mad_noise, round(stddev_pop(d) / sqrt(2), 6) AS std_noise FROM y GROUP BY roi""")
def diff_noise_mad(spark, d):
    return traces.diff_noise(trace_table(spark, d)).select("roi", r6("mad_noise"), r6("std_noise"))


@query(f"WITH RECURSIVE {TR}, s AS (SELECT roi, frame, (event_type = 'purchase')::DOUBLE AS s FROM tr), c AS (SELECT roi, frame, s AS c FROM s WHERE frame = 0 UNION ALL SELECT s.roi, s.frame, s.s + 0.9::DOUBLE * c.c FROM s JOIN c ON s.roi = c.roi AND s.frame = c.frame + 1) SELECT roi, frame, round(c, 6) AS c FROM c")
def ar1_filter(spark, d):
    s = trace_table(spark, d).select("roi", "frame", (F.col("event_type") == "purchase").cast("double").alias("value"))
    return traces.ar1_filter(s, 0.9).select("roi", "frame", r6("c"))


@query(f"""WITH {TR}, b AS (SELECT *, avg(value) {ROWS3} AS soft FROM tr) SELECT roi, round(corr(soft, value), 6) AS corr, round(1 - sum((soft - value) * (soft - value)) / nullif(var_pop(value) * count(*), 0), 6) AS r2,
round(sum(soft * value) / nullif(sum(soft * soft), 0), 6) AS scale FROM b GROUP BY roi""")
def trace_agreement(spark, d):
    t = trace_table(spark, d)
    both = t.withColumn("soft", F.avg("value").over(traces.centred(3)))
    return traces.agreement(both, "soft", "value", "roi").select("roi", r6("corr"), r6("r2"), r6("scale"))


@query(f"WITH {TR}, f AS (SELECT roi, regr_slope(value, frame::DOUBLE) AS b, avg(value) AS my, avg(frame) AS mx FROM tr GROUP BY roi) SELECT roi, frame, round(value - my - b * (frame - mx), 6) AS residual FROM tr JOIN f USING (roi)")
def project_out_constant_and_time(spark, d):
    return traces.project_out(trace_table(spark, d), "frame").select("roi", "frame", r6("residual"))


@query(f"WITH {TR} SELECT a.roi, b.frame - a.frame AS lag, round(avg(b.value), 6) AS value, count(*) AS n FROM tr a JOIN tr b ON a.roi = b.roi AND b.frame BETWEEN a.frame - 2 AND a.frame + 4 WHERE a.event_type = 'purchase' GROUP BY ALL")
def event_triggered_average(spark, d):
    t = trace_table(spark, d)
    return traces.triggered_average(t, F.col("event_type") == "purchase", 2, 4).select("roi", F.col("lag").cast("long").alias("lag"), r6("value"), "n")


@query("""WITH e AS (SELECT user_id AS roi, epoch(ts) AS t, event_type FROM events), m AS (SELECT floor(min(t)) AS t0 FROM e),
last AS (SELECT max(floor((t - t0) / 86400))::BIGINT AS last FROM e, m), spine AS (SELECT roi, unnest(range(last + 1)) AS frame FROM (SELECT DISTINCT roi FROM e), last),
c AS (SELECT roi, floor((t - t0) / 86400)::BIGINT AS frame, count(*) AS n FROM e, m WHERE event_type = 'purchase' GROUP BY ALL)
SELECT roi, frame, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (roi, frame)""")
def spike_bin_counts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("roi"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("t"), "event_type")
    t0, last = e.agg(F.floor(F.min("t")), F.max("t")).first()
    days = int((last - t0) // 86400) + 1
    spine = e.select("roi").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("frame", F.col("frame").cast("long"))
    return traces.spike_bins(e.where("event_type = 'purchase'"), spine, t0, 1 / 86400)


# -- scoring ----------------------------------------------------------------


@query(f"WITH {DISC}, m AS (SELECT roi, p, CASE WHEN d2 <= 2 THEN 1 - sqrt(d2) / 2 ELSE 0 END AS w FROM disc) SELECT a.roi AS roi_i, b.roi AS roi_j, round(corr(a.w, b.w), 6) AS corr FROM m a JOIN m b USING (p) GROUP BY ALL")
def footprint_corr_matrix(spark, d):
    return scoring.footprint_correlation(masks(spark, True), masks(spark, True), SIDE * SIDE).select("roi_i", "roi_j", r6("corr"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_name, p_partkey) AS f FROM part)
SELECT p_brand AS indicator, p_type AS animal, p_name AS path FROM r WHERE f = 1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_name, p_partkey) <= 2""")
def topk_per_group(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("indicator"), F.col("p_type").alias("animal"), F.col("p_name").alias("path"), F.col("p_retailprice").alias("bytes"), "p_partkey")
    return scoring.smallest_files(p, 2, "bytes", "path", "p_partkey").select("indicator", "animal", "path")


@query("SELECT c_nationkey::BIGINT AS grp, min_by(c_custkey, c_custkey) AS first_id FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def first_qualifying(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), "c_custkey", "c_acctbal")
    return scoring.first_that(c, F.col("c_acctbal") > 5000, "grp", "c_custkey")


@query("""SELECT event_type AS indicator, value >= 50 AS visible, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (value >= 50), ())""")
def summary_grouping_sets(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("indicator"), (F.col("value") >= 50).alias("visible"), F.col("value").alias("score"))
    return scoring.summary(e, "indicator", "visible", "score").select("indicator", "visible", r6("score"), "n")


@query("SELECT vec_id // 100 AS epoch, sum(len(embedding) * 4)::BIGINT AS bytes, count(*) AS n FROM embeddings GROUP BY ROLLUP(1)".replace("ROLLUP(1)", "ROLLUP(vec_id // 100)"))
def rollup_bytes(spark, d):
    v = table(spark, d, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("epoch"), (F.size("embedding") * 4).cast("long").alias("b"))
    return v.rollup("epoch").agg(F.sum("b").alias("bytes"), F.count("*").alias("n"))


# -- motion at whole pixels -------------------------------------------------


@query(f"""WITH {MV}, s AS (SELECT frame, p // 8 + frame % 3 - 1 AS y, p % 8 + frame % 2 AS x, v FROM mv) SELECT frame, y * 8 + x AS pix, round(v, 6) AS v FROM s WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7""")
def integer_shift(spark, d):
    p = pixels(spark, d).withColumns({"dy": (F.col("frame") % 3 - 1), "dx": (F.col("frame") % 2)})
    return scoring.shift_pixels(p, SIDE, SIDE).select("frame", F.col("pix").cast("long").alias("pix"), r6("v"))


@query(f"""WITH {MV}, ref AS (SELECT p, avg(v) AS r FROM mv GROUP BY p), s AS (SELECT range - 2 AS k FROM range(5)), g AS (SELECT a.k AS dy, b.k AS dx FROM s a, s b),
c AS (SELECT frame, dy, dx, sum(v * r) AS score FROM mv, g, ref WHERE ref.p = ((mv.p // 8 + dy + 8) % 8) * 8 + (mv.p % 8 + dx + 8) % 8 GROUP BY ALL)
SELECT frame, dy, dx, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(score, 9) DESC, dy, dx) = 1""")
def integer_shift_search(spark, d):
    image = np.array([r.v for r in reduce.image(pixels(spark, d)).orderBy("pix").collect()]).reshape(SIDE, SIDE)  # one image
    best = scoring.best_integer_shift(frames(spark, d), image, 2)
    return best.select("frame", F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), r6("score"))


# -- scale ------------------------------------------------------------------


@query("SELECT l_partkey AS roi, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)) / nullif(sum((1 - l_discount) * (1 - l_discount)), 0), 4) AS value FROM lineitem GROUP BY 1")
def projection_at_scale(spark, d):
    w = 1 - F.col("l_discount")
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("roi"))
    return li.agg(F.count("*").alias("n"), (F.round(F.sum(F.col("l_extendedprice") * w) / F.nullif(F.sum(w * w), F.lit(0.0)), 4)).alias("value"))


from . import catalog_graph, catalog_kernels, catalog_sources  # noqa: E402, F401 - register their queries
