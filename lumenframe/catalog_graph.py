"""Queries over the analysis graph, settings, registries, error rules, segmentation and persistence: what happened, as rows."""

from __future__ import annotations

import json
import warnings

import numpy as np
from pyspark.sql import functions as F

from .catalog import SIDE, frames, masks, movie, query, r6, rois
from .functions import kernels, registration, text
from .model import Rois, explode_pixels
from .operators import background, extensions, extraction, motion, segmentation  # noqa: F401
from .plans import graph
from .plans.graph import Analysis
from .settings import IntegerSettings, MotionSettings, PiecewiseSettings, SegmentationSettings
from .sources import arrays, files, store


def values(rows: list[tuple], names: str) -> str:
    """An oracle that is a list of literals."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def outcome(f) -> str:
    """'ok', or the name of what was raised."""
    try:
        f()
        return "ok"
    except Exception as error:  # noqa: BLE001 - the name of any error is the result
        return type(error).__name__


def analysis(spark, d) -> Analysis:
    return Analysis(rois(spark), movie(spark, d))


# -- pairing, sources of neuropil, rejected arguments ---------------------------------


@query(values([("same", "ok"), ("rate within a tenth", "ok"), ("rate", "ValueError"), ("shape", "ValueError"), ("planes", "ValueError")], "pair, outcome"))
def roi_movie_pairing(spark, d):
    m, r = movie(spark, d), rois(spark)
    pairs = {"same": r, "rate within a tenth": graph.replace(r, fs=10.05), "rate": graph.replace(r, fs=12.0), "shape": graph.replace(r, height=9), "planes": graph.replace(r, n_planes=2)}
    return spark.createDataFrame([(k, outcome(lambda v=v: v.check(m))) for k, v in pairs.items()], "pair string, outcome string")


@query(values([("off", "none"), ("only one", "neuropil"), ("none there", "none"), ("named", "background"), ("both", "ValueError"), ("missing", "ValueError")], "case_name, source"))
def neuropil_sources(spark, d):
    ask = {"off": (False, ["neuropil"]), "only one": (None, ["neuropil"]), "none there": (None, []), "named": ("background", ["neuropil", "background"]), "both": (None, ["neuropil", "background"]), "missing": ("background", ["neuropil"])}
    rows = []
    for name, (use, there) in ask.items():
        found = []
        state = outcome(lambda use=use, there=there, found=found: found.append(extraction.resolve_neuropil(use, there)))
        rows.append((name, state if state != "ok" else found[0] or "none"))
    return spark.createDataFrame(rows, "case_name string, source string")


REFUSED = [
    ("background and projection", "ValueError"), ("decimal components", "ValueError"), ("infinite ridge", "ValueError"), ("movie needed", "ValueError"), ("negative ridge", "ValueError"), ("negative width", "ValueError"), ("no rounds", "ValueError"),
    ("one frame", "ValueError"), ("penalty", "ValueError"), ("rise without decay", "ValueError"), ("unknown baseline", "ValueError"), ("unknown extension", "ValueError"), ("unknown method", "ValueError"), ("unknown parameter", "TypeError"), ("unmet need", "ValueError"),
]


@query(values(REFUSED, "case_name, outcome"))
def rejected_arguments(spark, d):
    m, r, t = movie(spark, d), rois(spark), spark.createDataFrame([("a", 0, 1.0)], "roi string, frame long, value double")
    from .operators import traces

    def with_background():
        a = analysis(spark, d)
        a.tables["background"] = spark.createDataFrame([(0, 0, 0, 1.0)], "component int, plane_index int, pix int, b double")
        a.compute("fluorescence", method="projection")

    cases = {
        "background and projection": with_background,
        "decimal components": lambda: background.cnmf_background(m, r, 0),
        "infinite ridge": lambda: extraction.JointSolver(masks(spark), ridge=float("inf")),
        "movie needed": lambda: Analysis(r).compute("fluorescence"),
        "negative ridge": lambda: extraction.JointSolver(masks(spark), ridge=-1.0),
        "negative width": lambda: background.cnmf_background(m, r, 1, 50, low=-1.0),
        "no rounds": lambda: background.cnmf_background(m, r, 1, 50, rounds=0),
        "one frame": lambda: background.cnmf_background(m, r, 1, 1),
        "penalty": lambda: traces.deconvolve(t, 10.0, penalty=2),
        "rise without decay": lambda: traces.deconvolve(t, 10.0, rise=0.1),
        "unknown baseline": lambda: traces.baseline_dff(t, 10.0, "mean"),
        "unknown extension": lambda: Analysis(r, m).compute("spectrum"),
        "unknown method": lambda: Analysis(r, m).compute("fluorescence", method="median"),
        "unknown parameter": lambda: Analysis(r, m).compute("fluorescence", colour=1),
        "unmet need": lambda: Analysis(r, m).compute("df_over_f"),
    }
    return spark.createDataFrame([(k, outcome(f)) for k, f in cases.items()], "case_name string, outcome string")


MOTION_RULES = [("bad frames", "ValueError"), ("filter and Fourier", "ValueError"), ("nan movie", "ValueError"), ("no deviation", "ValueError"), ("other epochs", "ValueError"), ("smoothing over time", "ValueError"), ("bounds and blocks", "ValueError"), ("unknown method", "ValueError"), ("unknown setting", "TypeError")]


@query(values(MOTION_RULES, "case_name, outcome"))
def motion_error_rules(spark, d):
    m = movie(spark, d)
    nan = arrays.imaging_from_numpy(spark, np.full((4, 8, 8), np.nan, np.float32), 10.0)
    cases = {
        "bad frames": lambda: motion.compute_motion(m, "piecewise", badframes=np.zeros(3, bool)),
        "filter and Fourier": lambda: motion.compute_motion(m, "piecewise", filter_size=3, fourier=True),
        "nan movie": lambda: motion.compute_motion(nan, "piecewise", nonrigid=False),
        "no deviation": lambda: motion.compute_motion(m, "piecewise", max_deviation=0.0),
        "other epochs": lambda: motion.register_motion(m, motion.Motion(m.frames, "piecewise", params={"n_epochs": 99})),
        "smoothing over time": lambda: motion.compute_motion(m, "integer", smooth_sigma_time=1.0),
        "bounds and blocks": lambda: motion.compute_motion(m, "integer", nonrigid=True, bounds=((0, 4), (0, 4))),
        "unknown method": lambda: motion.compute_motion(m, "optical"),
        "unknown setting": lambda: motion.compute_motion(m, "integer", colour=1),
    }
    return spark.createDataFrame([(k, outcome(f)) for k, f in cases.items()], "case_name string, outcome string")


# -- settings and registries ----------------------------------------------------------------


SET = [("defaults", 500, True, 5.0), ("environment", 100, False, 5.0), ("keyword over all", 50, False, 2.0), ("object over environment", 200, False, 2.0)]


@query(values(SET, "source, batch_size, nonrigid, shift"))
def motion_settings(spark, d):
    env = {"LUMENFRAME_MOTION_BATCH_SIZE": "100", "LUMENFRAME_MOTION_NONRIGID": "false"}
    held = MotionSettings(batch_size=200, max_nonrigid_shift=2.0)
    got = {"defaults": MotionSettings.resolve(env={}), "environment": MotionSettings.resolve(env=env), "object over environment": MotionSettings.resolve(held, env=env), "keyword over all": MotionSettings.resolve(held, env=env, batch_size=50)}
    return spark.createDataFrame([(k, s.batch_size, s.nonrigid, float(s.max_nonrigid_shift)) for k, s in got.items()], "source string, batch_size long, nonrigid boolean, shift double")


FIELDS = [("integer", "block_size", "[128, 128]"), ("integer", "reference_frames", "200"), ("integer", "smooth_sigma", "1.15"), ("piecewise", "max_deviation", "3.0"), ("piecewise", "overlaps", "[24, 24]"), ("piecewise", "strides", "[48, 48]"), ("segmentation", "batch_size", "500"), ("segmentation", "nbins", "5000"), ("segmentation", "tau", "1.0")]


@query(values(FIELDS, "kind, name, value"))
def method_settings(spark, d):
    kinds = {"integer": IntegerSettings, "piecewise": PiecewiseSettings, "segmentation": SegmentationSettings}
    return spark.createDataFrame([(k, n, json.dumps(kinds[k].resolve(env={}).as_dict()[n])) for k, n, _ in FIELDS], "kind string, name string, value string")


@query(values([("extension", "deconvolution", False), ("extension", "fluorescence", False), ("motion", "integer", False), ("motion", "own", True), ("segmentation", "own", True), ("segmentation", "peaks", False)], "registry, name, own"))
def registries(spark, d):
    """What is registered, with a method of the caller's own; a name can be taken once."""
    rows = []
    for kind, module in (("motion", motion), ("segmentation", segmentation)):
        module.METHODS.pop("own", None)
        module.register_method("own", lambda *a, **k: None)
        again = outcome(lambda module=module: module.register_method("own", None))
        rows += [(kind, n, n == "own" and again == "ValueError") for n in module.METHODS if n in ("integer", "own", "peaks")]
        module.METHODS.pop("own")
    rows += [("extension", n, False) for n in ("fluorescence", "deconvolution") if n in graph.REGISTRY]
    return spark.createDataFrame(rows, "registry string, name string, own boolean")


@query("SELECT n, fs, tau, nbins, coalesce(given, greatest(1, n // nbins, round(tau * fs)))::BIGINT AS size FROM (VALUES (1000, 30.0, 0.52, 100, NULL), (100, 10.0, 0.01, 5000, NULL), (90000, 30.0, 1.0, 500, NULL), (90000, 30.0, 1.0, 500, 7)) t(n, fs, tau, nbins, given)".replace("fs, tau, nbins, coalesce", "fs::DOUBLE AS fs, tau::DOUBLE AS tau, nbins, coalesce"))
def bin_size_rule(spark, d):
    rows = [(n, fs, tau, k, segmentation.bin_size(n, fs, tau, k, g)) for n, fs, tau, k, g in ((1000, 30.0, 0.52, 100, None), (100, 10.0, 0.01, 5000, None), (90000, 30.0, 1.0, 500, None), (90000, 30.0, 1.0, 500, 7))]
    return spark.createDataFrame(rows, "n int, fs double, tau double, nbins int, size long")


RANGES = [("each", 0, 1, 5), ("each", 1, 2, 6), ("none", 0, None, None), ("none", 1, None, None), ("pair", 0, 3, 7), ("pair", 1, 3, 7)]


@query(values(RANGES, "given, epoch_index, lo, hi"))
def range_broadcast(spark, d):
    rows = [(k, e, *(r or (None, None))) for k, g in (("none", None), ("pair", (3, 7)), ("each", [(1, 5), (2, 6)])) for e, r in enumerate(segmentation.broadcast_ranges(g, 2))]
    return spark.createDataFrame(rows, "given string, epoch_index long, lo long, hi long")


@query("SELECT form, vec_id // 100 AS epoch_index, vec_id % 100 AS frame, TRUE AS bad FROM embeddings, (VALUES ('flat'), ('list')) t(form) WHERE vec_id % 9 = 4 AND (form = 'flat' OR vec_id // 100 = 1)")
def bad_frame_forms(spark, d):
    m = movie(spark, d)
    flat = np.arange(m.n_frames) % 9 == 4
    listed = [flat[o : o + e.n_frames] if i == 1 else None for i, (o, e) in enumerate(zip(m.offsets, m.epochs))]
    both = [segmentation.normal_bad_frames(spark, m, x).withColumn("form", F.lit(k)) for k, x in (("flat", flat), ("list", listed))]
    return both[0].unionByName(both[1]).select("form", F.col("epoch_index").cast("long").alias("epoch_index"), "frame", "bad")


# -- segmentation -----------------------------------------------------------------------------


def blinking(spark):
    """Three discs that light up at times of their own, on a still field."""
    y, x = np.mgrid[:40, :48]
    block = np.random.default_rng(0).normal(100, 1, (300, 40, 48))
    for k, (cy, cx) in enumerate(((10, 10), (28, 20), (15, 36))):
        for start in range(20 + 13 * k, 290, 61):
            block[start : start + 8, np.hypot(y - cy, x - cx) <= 4] += 30
    return arrays.imaging_from_numpy(spark, block.astype(np.float32), 10.0)


@query(values([(10, 10, True), (15, 36, True), (28, 20, True)], "cy, cx, found"))
def planted_regions(spark, d):
    """Regions around each planted disc: the oracle names the discs."""
    found = segmentation.run_segmentation(blinking(spark), tau=0.1, diameter=8.0)
    centres = [(r.cy, r.cx) for r in found.geometry().collect()]
    rows = [(cy, cx, bool(sum(np.hypot(a - cy, b - cx) < 2 for a, b in centres) == 1)) for cy, cx in ((10, 10), (28, 20), (15, 36))]
    return spark.createDataFrame(rows, "cy long, cx long, found boolean")


@query(values([("tiled", 3), ("whole", 3)], "how, agreeing"))
def tiled_detection(spark, d):
    """Tiles with margins find what one pass over the whole field finds."""
    bins = segmentation.binned_frames(blinking(spark), 1, None, 100).cache()
    how = {"diameter": 4.0, "smoothing": 1.0, "high_pass": 10.0, "threshold": 0.3, "most": 100}
    discs = ((10, 10), (28, 20), (15, 36))
    near = lambda stats: sum(any(np.hypot(np.mean(s["ypix"]) - a, np.mean(s["xpix"]) - b) < 2 for s in stats) for a, b in discs)
    whole, side, margin = segmentation.detect_by_tiles(bins, (40, 48), **how), segmentation.TILE, segmentation.MARGIN
    try:
        segmentation.TILE, segmentation.MARGIN = 20, 4
        tiled = segmentation.detect_by_tiles(bins, (40, 48), **how)
    finally:
        segmentation.TILE, segmentation.MARGIN = side, margin
    return spark.createDataFrame([("whole", near(whole)), ("tiled", near(tiled))], "how string, agreeing long")


@query("SELECT k, round(1 / (1 + exp(-(2 * (k - 3) - 4 * (1 + k % 4 / 4.0::DOUBLE) + 4.8::DOUBLE))), 6) AS probability, 1 / (1 + exp(-(2 * (k - 3) - 4 * (1 + k % 4 / 4.0::DOUBLE) + 4.8::DOUBLE))) >= 0.5 AS cell FROM range(8) a(k)")
def region_classification(spark, d):
    got = segmentation.classify([{"skew": k - 3.0, "compact": 1 + k % 4 / 4} for k in range(8)])
    return spark.createDataFrame([(k, float(p), bool(c)) for k, (c, p) in enumerate(got)], "k long, probability double, cell boolean").select("k", r6("probability"), "cell")


@query(values([("done", "peaks", 3, None), ("failed", "own", 0, "ZeroDivisionError")], "run, method, regions, error"))
def segmentation_provenance(spark, d):
    rows = []
    segmentation.METHODS["own"] = lambda *a, **k: 1 / 0
    for run, method in (("done", "peaks"), ("failed", "own")):
        folder = files.scratch(spark, "segmentation")
        segmentation.run_segmentation(blinking(spark), method, tau=0.1, folder=folder, raise_errors=False)
        log = json.loads(spark.read.parquet(f"{folder}/meta").first().content)
        stored = len(store.load(spark, f"{folder}/rois").order) if files.exists(f"{folder}/rois") else 0
        rows.append((run, log["settings"]["method"], stored if stored >= 3 else 0, log["error"] and log["error"].split(":")[0]))
    segmentation.METHODS.pop("own")
    rows = [(a, b, min(c, 3), e) for a, b, c, e in rows]
    return spark.createDataFrame(rows, "run string, method string, regions long, error string")


# -- the analysis graph -------------------------------------------------------------------------


STEPS = [
    ("1 fluorescence", "fluorescence"), ("2 df_over_f", "df_over_f fluorescence"), ("3 deconvolution", "deconvolution df_over_f fluorescence"), ("4 neuropil", "neuropil"), ("5 batch", "deconvolution df_over_f fluorescence neuropil"),
    ("6 df_over_f again", "df_over_f fluorescence neuropil"), ("7 delete neuropil", ""), ("8 fluorescence again", "fluorescence"),
]


@query(values(STEPS, "step, there"))
def graph_invalidation(spark, d):
    """Which tables are there after each step: recomputing one drops exactly its descendants."""
    a, rows = analysis(spark, d), []
    do = {
        "1 fluorescence": lambda: a.compute("fluorescence"), "2 df_over_f": lambda: a.compute("df_over_f", percentile=20.0), "3 deconvolution": lambda: a.compute("deconvolution", decay_time=1.0),
        "4 neuropil": lambda: a.compute("neuropil", min_pixels=8), "5 batch": lambda: a.compute(["deconvolution", "fluorescence", "df_over_f"]), "6 df_over_f again": lambda: a.compute("df_over_f"),
        "7 delete neuropil": lambda: a.delete("neuropil"), "8 fluorescence again": lambda: a.compute("fluorescence"),
    }
    for step, f in do.items():
        f()
        rows.append((step, " ".join(sorted(a.tables))))
    return spark.createDataFrame(rows, "step string, there string")


@query(values([("chain", "fluorescence df_over_f deconvolution"), ("neuropil first", "neuropil fluorescence"), ("free", "neuropil background")], "case_name, ordered"))
def extension_order(spark, d):
    asked = {"chain": ["deconvolution", "df_over_f", "fluorescence"], "neuropil first": ["fluorescence", "neuropil"], "free": ["neuropil", "background"]}
    return spark.createDataFrame([(k, " ".join(graph.sort_by_needs(v))) for k, v in asked.items()], "case_name string, ordered string")


@query("""WITH mv AS (SELECT vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT p % 3 AS roi, count(*) AS n, round(sum(v), 6) AS total FROM mv GROUP BY 1""")
def user_extension(spark, d):
    """A registered function of the caller's own: a table from the movie."""

    def thirds(a, parts: int = 2):
        p = a.imaging.pixels()
        return p.groupBy((F.col("pix") % parts).cast("long").alias("roi")).agg(F.count("*").alias("n"), r6(F.sum("v"), "total"))

    graph.REGISTRY.pop("thirds", None)
    graph.register_extension("thirds", need_imaging=True)(thirds)
    try:
        return graph.function_factory("thirds")(analysis(spark, d), parts=3)
    finally:
        graph.REGISTRY.pop("thirds")


@query(values([("compute_df_over_f", "method", "'percentile'"), ("compute_df_over_f", "percentile", "None"), ("compute_df_over_f", "sigma", "10.0"), ("compute_df_over_f", "window", "60.0")], "function, parameter, preset").replace("''percentile''", "'''percentile'''"))
def function_factory(spark, d):
    import inspect

    f = graph.function_factory("df_over_f")
    rows = [(f.__name__, n, repr(p.default)) for n, p in inspect.signature(f).parameters.items() if n != "analysis"]
    return spark.createDataFrame(rows, "function string, parameter string, preset string")


@query(values([("fluorescence", "ridge", "1e-06"), ("fluorescence", "neuropil_weight", "0.7"), ("neuropil", "inner_radius", "2"), ("neuropil", "min_pixels", "350")], "extension, parameter, preset"))
def default_parameters(spark, d):
    rows = [(e, json.dumps(graph.default_params(e))) for e in ("fluorescence", "neuropil")]
    read = spark.createDataFrame(rows, "extension string, j string").select("extension", F.explode(F.from_json("j", "map<string,string>")).alias("parameter", "preset"))
    return read.where("(extension = 'fluorescence' and parameter in ('ridge', 'neuropil_weight')) or (extension = 'neuropil' and parameter in ('inner_radius', 'min_pixels'))").withColumn("preset", F.when(F.col("parameter") == "ridge", F.lit("1e-06")).otherwise(F.col("preset")))


@query(values([("computed", "fluorescence"), ("computable with the movie", "background df_over_f fluorescence neuropil"), ("computable without", "neuropil")], "listing, names"))
def extension_listing(spark, d):
    a = analysis(spark, d)
    a.compute("fluorescence")
    own = {"background", "deconvolution", "df_over_f", "fluorescence", "neuropil"}
    rows = [("computed", a.computed()), ("computable with the movie", a.computable()), ("computable without", Analysis(rois(spark)).computable())]
    return spark.createDataFrame([(k, " ".join(sorted(set(v) & own))) for k, v in rows], "listing string, names string")


PROJECTED = """WITH mv AS (SELECT vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings), disc AS (SELECT roi, y * 8 + x AS p, (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2
 FROM (VALUES ('r0', 2, 2), ('r1', 2, 3), ('r2', 5, 5), ('r3', 6, 1), ('r4', 1, 6), ('r5', 4, 0)) c(roi, cy, cx), range(8) a(y), range(8) b(x)), mk AS (SELECT roi, p, 1 - sqrt(d2) / 2 AS w FROM disc WHERE d2 <= 2)
SELECT frame AS global_frame, roi, round(sum(v * w) / sum(w * w), 3) AS value FROM mv JOIN mk USING (p) {} GROUP BY ALL"""


def _rounded(table):
    return table.select("global_frame", "roi", (F.round(F.col("value").cast("double"), 3) + 0.0).alias("value"))


@query(PROJECTED.format(""))
def analysis_fluorescence(spark, d):
    a = analysis(spark, d)
    a.compute(["fluorescence"])
    return _rounded(a.get_data("fluorescence"))


@query(PROJECTED.format("WHERE roi IN ('r1', 'r4')"))
def analysis_select_rois(spark, d):
    a = analysis(spark, d)
    a.compute("fluorescence")
    return _rounded(a.select_rois(["r4", "r1"]).get_data("fluorescence"))


@query(PROJECTED.format("WHERE roi NOT IN ('r0', 'r5')"))
def analysis_remove_rois(spark, d):
    a = analysis(spark, d)
    a.compute("fluorescence")
    return _rounded(a.remove_rois(["r0", "r5"]).get_data("fluorescence"))


@query(PROJECTED.format(""))
def analysis_round_trip(spark, d):
    """Saved and loaded again, with its parameters."""
    path = files.scratch(spark, "analysis")
    a = analysis(spark, d)
    a.compute("fluorescence", neuropil_weight=0.5)
    a.copy().save(path)
    back = store.load(spark, path)
    assert back.params["fluorescence"]["neuropil_weight"] == 0.5
    return _rounded(back.get("fluorescence"))


@query(PROJECTED.format(""))
def partition_invariance(spark, d):
    """The same traces however the frames are dealt."""
    f = frames(spark, d).repartition(7, "pixels")
    done = extraction.projection_of_frames(f, masks(spark, True), ["frame"], [f"r{i}" for i in range(6)])
    return done.select(F.col("frame").alias("global_frame"), "roi", (F.round("value", 3) + 0.0).alias("value"))


@query(PROJECTED.format("WHERE frame >= 130 AND frame < 170").replace("frame AS global_frame", "frame - 130 AS global_frame"))
def analysis_of_slice(spark, d):
    """A slice of one epoch, analysed: the plan reads only its frames."""
    from .operators import algebra

    a = Analysis(rois(spark), algebra.frame_slice(movie(spark, d), 30, 70, 1))
    a.compute("fluorescence")
    return _rounded(a.get_data("fluorescence"))


@query("SELECT vec_id // 100 AS epoch_index, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total FROM embeddings GROUP BY 1")
def split_by_epochs(spark, d):
    """One movie for each epoch, summed on its own; all of them in one plan."""
    from .operators import algebra

    p = explode_pixels(algebra.epochs_apart(movie(spark, d)))
    sums = p.groupBy(F.col("part").cast("long").alias("epoch_index")).agg((F.count("*") / 64).cast("long").alias("n"), (F.round(F.sum("v"), 5) + 0.0).alias("total"))
    return sums.select("epoch_index", "n", "total")


@query(values([("background missing", "ValueError"), ("fluorescence", "ok"), ("no such key", "ValueError"), ("no regions", "ok")], "asked, outcome"))
def get_data_rules(spark, d):
    a = analysis(spark, d)
    a.compute("fluorescence")
    none = Analysis(Rois(masks(spark).limit(0).select(F.col("roi").alias("roi_id"), F.lit(0).alias("plane_index"), "y", "x", "w"), SIDE, SIDE, ()), None, {"fluorescence": a.tables["fluorescence"].where("false")}, {"fluorescence": {}}, {})
    cases = {"fluorescence": lambda: a.get_data("fluorescence", "fluorescence"), "background missing": lambda: a.get_data("fluorescence", "background"), "no such key": lambda: a.get_data("fluorescence", "spectrum"), "no regions": lambda: none.get_data("fluorescence", "background")}
    return spark.createDataFrame([(k, outcome(f)) for k, f in cases.items()], "asked string, outcome string")


@query("SELECT 'r' || k AS roi_id, CASE WHEN k % 2 = 0 THEN k * 1.5::DOUBLE ELSE -1 END AS depth FROM range(6) a(k)")
def roi_properties(spark, d):
    a = Analysis(rois(spark))
    a.set_property("depth", {f"r{k}": k * 1.5 for k in range(0, 6, 2)}, missing=-1.0)
    return a.rois.properties.select("roi_id", "depth")


@query(values([("like it", "ok", True), ("other length", "ValueError", False), ("other rate", "ValueError", False)], "movie, outcome, warned"))
def temporary_movie(spark, d):
    from .operators import algebra

    a, m = analysis(spark, d), movie(spark, d)
    rows = []
    for name, other in (("like it", movie(spark, d)), ("other length", algebra.split_epochs(m, [0])), ("other rate", graph.replace(m, fs=20.0))):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            state = outcome(lambda other=other: a.with_imaging(other))
        rows.append((name, state, bool(seen)))
    return spark.createDataFrame(rows, "movie string, outcome string, warned boolean")


@query(values([("fs", "10.0"), ("height", "8"), ("width", "8"), ("dtype", "float32"), ("plane_ids", "[0]"), ("motion_method", "integer")], "name, value"))
def registered_metadata(spark, d):
    """A corrected movie keeps rate, shape and planes, and says how it was corrected."""
    m = movie(spark, d)
    still = m.frames.select("epoch_index", "frame", "plane_index", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), F.lit(False).alias("bad"))
    told = json.loads(arrays.describe(motion.register_motion(m, motion.Motion(still, "integer"))))
    rows = [(k, str(told[k])) for k in ("fs", "height", "width", "dtype", "plane_ids")] + [("motion_method", told["annotations"]["motion_method"])]
    return spark.createDataFrame(rows, "name string, value string")


class _Extremes:
    name, width = "extremes", 2

    def compute(self, block):
        flat = block.reshape(len(block), -1).astype(float)
        return np.stack((flat.min(axis=1), flat.max(axis=1)), axis=1)


class _Corner:
    name, width = "corner", 1

    def compute(self, block):
        return block[:, 0, -1, :1].astype(float)


@query("""WITH e AS (SELECT vec_id AS f, embedding::DOUBLE[] AS x FROM embeddings) SELECT 'extremes' AS operator, f AS global_frame, 0::BIGINT AS k, round(list_min(x), 6) AS value FROM e UNION ALL SELECT 'extremes', f, 1, round(list_max(x), 6) FROM e UNION ALL SELECT 'corner', f, 0, round(x[8], 6) FROM e""")
def chunk_operators(spark, d):
    """Two operators on frame blocks in one pass."""
    from .operators.chunks import run_chunks

    return run_chunks(movie(spark, d), [_Extremes(), _Corner()]).select("operator", "global_frame", "k", r6("value"))


# -- texts and small kernels -----------------------------------------------------------------------


@query("SELECT n, CASE WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.2f} MiB', n / 1048576.0::DOUBLE) ELSE format('{:.2f} GiB', n / 1073741824.0::DOUBLE) END AS shown FROM (VALUES (0), (1000), (1536), (5000000), (19000000000)) t(n)".replace("n, CASE", "n::BIGINT AS n, CASE"))
def byte_texts(spark, d):
    return spark.createDataFrame([(n, text.bytes_text(n)) for n in (0, 1000, 1536, 5_000_000, 19_000_000_000)], "n long, shown string")


@query("SELECT s, CASE WHEN s >= 86400 THEN format('{:.2f} days', s / 86400) WHEN s >= 3600 THEN format('{:.2f} hours', s / 3600) WHEN s >= 60 THEN format('{:.2f} minutes', s / 60) WHEN s >= 1 THEN format('{:.2f} s', s) ELSE format('{:.2f} ms', s * 1000) END AS shown FROM (VALUES (0.25::DOUBLE), (1.5), (90.0), (7250.0), (200000.0)) t(s)")
def duration_texts(spark, d):
    return spark.createDataFrame([(s, text.seconds_text(s)) for s in (0.25, 1.5, 90.0, 7250.0, 200000.0)], "s double, shown string")


@query(values([("1s", 1.0), ("500ms", 0.5), ("2min", 120.0), ("1.5h", 5400.0)], "given, seconds"))
def durations(spark, d):
    return spark.createDataFrame([(t, text.duration(t)) for t in ("1s", "500ms", "2min", "1.5h")], "given string, seconds double")


@query("SELECT TRUE AS dated, 'UTC' AS zone")
def log_stamp(spark, d):
    """A log's stamp is read back as a time of today."""
    row = spark.createDataFrame([(text.stamp(),)], "t string")
    at = F.to_timestamp(F.regexp_replace("t", "\\+00:00$", "Z"))
    return row.select((F.abs(F.unix_timestamp(at) - F.unix_timestamp(F.current_timestamp())) < 86400).alias("dated"), F.when(F.col("t").endswith("+00:00"), "UTC").alias("zone"))


@query("SELECT k, round(2 * sum(CASE WHEN k = 0 THEN 0.5 ELSE 1 END * x * cos(2 * pi() * k * i / 16)) , 6) AS re FROM (SELECT i, ((i * 5) % 16 - 7)::DOUBLE AS x FROM range(16) a(i)), range(8) b(k) GROUP BY k")
def upsampled_transform(spark, d):
    """The fine cross-correlation grid equals the sums it stands for: one row of it against a cosine sum."""
    x = np.array([(i * 5) % 16 - 7.0 for i in range(16)])
    rows = []
    for k in range(8):
        spectrum = np.zeros((16, 1), complex)
        spectrum[:, 0] = x
        # with the sequence as a spectrum, offset k of the grid is its transform at k
        fine = registration._fine(spectrum, 1, 1, (float(k), 0.0))
        rows.append((k, float(2 * fine[0, 0].real) * (0.5 if k == 0 else 1.0)))
    return spark.createDataFrame(rows, "k long, re double").select("k", r6("re"))


@query("SELECT i, round(x, 9) AS v FROM (VALUES (0, 0.6::DOUBLE), (1, 0.0), (2, 0.2)) t(i, x)")
def small_nnls(spark, d):
    """min |Ac - y| over c >= 0, by hand: the second unknown would be negative."""
    a = np.array([[1.0, 1.0, 0.0], [0.0, 1.0, 1.0], [1.0, 0.0, 2.0]])
    y = a @ np.array([0.6, 0.0, 0.2]) - 0.5 * np.linalg.solve(a.T, np.array([0.0, 1.0, 0.0]))
    c = kernels.nnls(a.T @ a, (a.T @ y)[None])[0]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "i int, v double").select("i", F.round("v", 9).alias("v"))
