"""The analysis graph's own extensions: neuropil, background, fluorescence, df_over_f, deconvolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import register_extension
from . import extraction, traces
from .background import cnmf_background
from .neuropil import surround_masks

def _masks(analysis):
    area = analysis.rois.height * analysis.rois.width
    return analysis.rois.sparse.select(F.col("roi_id").alias("roi"), (F.col("plane_index") * area + F.col("pix")).alias("pix"), "w")


def _placed(analysis, table):
    area = analysis.rois.height * analysis.rois.width
    return table.withColumn("pix", F.col("plane_index") * area + F.col("pix")).drop("plane_index")


@register_extension("neuropil", need_imaging=False)
def neuropil(analysis, inner_radius: int = 2, min_pixels: int = 350, percentile: float = 50.0, circular: bool = False):
    return surround_masks(analysis.rois, inner_radius, min_pixels, percentile, circular)


@register_extension("background", need_imaging=True)
def background(analysis, components: int = 1, frames: int = 1000, init: str = "ramp", max_iter: int = 30):
    return cnmf_background(analysis.imaging, analysis.rois, components, frames, init=init, rounds=max_iter)


@register_extension("fluorescence", optional=("neuropil", "background"), need_imaging=True)
def fluorescence(analysis, method: str = "projection", use_neuropil: bool | str | None = None, neuropil_weight: float = 0.7, ridge: float = 1e-6):
    if method not in ("projection", "regression", "nnls"):
        raise ValueError(f"unknown method {method!r}")
    source = extraction.resolve_neuropil(use_neuropil, [n for n in ("neuropil", "background") if n in analysis.tables])
    if method == "projection" and source == "background":
        raise ValueError("a background needs regression or nnls")
    masks, keys, order = _masks(analysis), ["global_frame"], list(analysis.rois.order)
    b = _placed(analysis, analysis.tables["background"]) if source == "background" else None
    frames = whole_frames(analysis)
    if method == "projection":
        if source == "neuropil":
            done = extraction.surround_of_frames(frames, masks, _placed(analysis, analysis.tables["neuropil"]), neuropil_weight, keys, order)
        else:
            done = extraction.projection_of_frames(frames, masks, keys, order)
        value = F.col("value")
    else:
        done = extraction.JointSolver(masks, b, ridge, method == "nnls", order).on_frames(frames, keys)
        value = extraction.weighted(F.col("value"), F.col("background"), neuropil_weight) if b is not None else F.col("value")
    back = F.col("background") if source is not None else F.lit(None)
    # a region without pixels has a trace of zeros: its inner products are 0
    return done.select("global_frame", "roi", value.cast("float").alias("value"), back.cast("float").alias("background"))


def whole_frames(analysis) -> DataFrame:
    """(global_frame, pixels): all planes of a frame one after another in one row."""
    movie = analysis.imaging
    numbered = movie.frames.withColumn("global_frame", F.col("frame") + F.element_at(F.lit(movie.offsets), F.col("epoch_index") + 1))
    if movie.n_planes == 1:
        return numbered.select("global_frame", "pixels")
    rows = numbered.groupBy("global_frame").agg(F.sort_array(F.collect_list(F.struct("plane_index", "pixels"))).alias("x"))
    return rows.select("global_frame", F.flatten(F.transform("x", lambda v: v["pixels"])).alias("pixels"))


@register_extension("df_over_f", needs=("fluorescence",))
def df_over_f(analysis, method: str = "percentile", percentile: float | None = None, window: float = 60.0, sigma: float = 10.0):
    fs = analysis.imaging.fs if analysis.imaging is not None else analysis.rois.fs
    joint = analysis.params["fluorescence"]["method"] != "projection" and "background" in analysis.tables
    weight = analysis.params["fluorescence"]["neuropil_weight"]
    table = analysis.tables["fluorescence"].withColumn("background", F.col("background") * weight)
    return traces.baseline_dff(table, fs, method, percentile, window, sigma, "background" if joint else None, frame="global_frame")


@register_extension("deconvolution", needs=("df_over_f",))
def deconvolution(analysis, decay_time: float | None = None, rise_time: float | None = None, penalty: int | None = 1, baseline: float | None = None, baseline_nonneg: bool = True, noise_std: float | None = None, lam: float = 0.0, s_min: float = 0.0, refine_kinetics: int = 0):
    fs = analysis.imaging.fs if analysis.imaging is not None else analysis.rois.fs
    how = {"noise_std": noise_std, "baseline": baseline, "baseline_nonneg": baseline_nonneg, "lam": lam, "s_min": s_min, "refine": refine_kinetics}
    return traces.deconvolve(analysis.tables["df_over_f"], fs, decay_time, rise_time, penalty, value="dff", frame="global_frame", **how)
