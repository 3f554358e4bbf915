"""Baselines, dF/F and scores of traces (roi, frame, value); windows run over the global frame, across epochs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

EPS32 = 1.1920929e-07


def along(roi: str = "roi", frame: str = "frame") -> Window:
    return Window.partitionBy(roi).orderBy(frame)


def centred(half: int, roi: str = "roi", frame: str = "frame"):
    return along(roi, frame).rowsBetween(-half, half)


def rolling_min_max(traces: DataFrame, half: int, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Adds ``f0``: the centred minimum's centred maximum. Shortened windows at the ends equal mirrored ones."""
    w = centred(half, roi, frame)
    return traces.withColumn("__low", F.min(value).over(w)).withColumn("f0", F.max("__low").over(w)).drop("__low")


def rolling_percentile(traces: DataFrame, half: int, level: float, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Adds ``f0``: interpolated percentile over a centred window, shortened at the ends."""
    return traces.withColumn("f0", F.percentile(value, level).over(centred(half, roi, frame)))


def global_percentile(traces: DataFrame, level: float, value: str = "value", roi: str = "roi") -> DataFrame:
    """Adds ``f0``: the whole trace's exact percentile. Aggregated before it is joined back."""
    return traces.join(traces.groupBy(roi).agg(F.percentile(value, level).alias("f0")), roi)


def dff(value: Column, f0: Column, background: Column | None = None) -> Column:
    """(F - F0) / (F0 [+ B0] + eps)."""
    base = f0 if background is None else f0 + background
    return (value - f0) / (base + EPS32)


def smoothed(traces: DataFrame, sigma: float, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Adds ``soft``: a Gaussian mean along the trace (sigma in frames), borders mirrored."""

    def run(pdf):
        pdf = pdf.sort_values(frame)
        pdf["soft"] = kernels.smooth(pdf[value].to_numpy(float), sigma)
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields)
    return traces.groupBy(roi).applyInPandas(run, f"{kinds}, soft double")


#: Rows of whole traces that a kernel gets at once; a longer trace comes alone.
ROWS_AT_ONCE = 1 << 17


def by_traces(traces: DataFrame, columns: list[str], run, kinds: str, roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Rows that ``run`` gives for tables (roi, frame, columns...) of whole traces in the order of their frames, many traces at a time.

    ``run`` gets such a table and the place of each trace's first row, so that kernels can solve traces side by side;
    a call for each trace would cost more than most traces do. Sorted by a window, whose row numbers tell where a trace starts.
    """
    order = Window.partitionBy(roi).orderBy(F.asc_nulls_last(frame))
    numbered = traces.select(roi, frame, *columns).withColumn("__at", F.row_number().over(order))

    def scan(batches):
        held, rows = [], 0

        def done(parts):
            table = pd.concat(parts, ignore_index=True)
            return run(table.drop(columns="__at"), np.flatnonzero(table["__at"].to_numpy() == 1))

        for batch in batches:
            firsts = np.flatnonzero(batch["__at"].to_numpy() == 1)
            # all before the batch's last start is whole, what follows may go on
            if len(firsts) and rows + firsts[-1] >= ROWS_AT_ONCE:
                whole = [*held, batch.iloc[: firsts[-1]]]
                if rows + firsts[-1]:
                    yield done(whole)
                held, rows = [], 0
                batch = batch.iloc[firsts[-1] :]
            if len(batch):
                held.append(batch)
                rows += len(batch)
        if rows:
            yield done(held)

    return numbered.mapInPandas(scan, kinds)


def pieces(x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return np.split(x, starts[1:])


def mode_levels(traces: DataFrame, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """(roi, level): the percentile at which each trace's density peaks."""

    def run(pdf, starts):
        return pdf[[roi]].iloc[starts].assign(level=kernels.mode_percentiles(pieces(pdf[value].to_numpy(float), starts)))

    kind = traces.schema[roi].dataType.simpleString()
    return by_traces(traces, [value], run, f"`{roi}` {kind}, level double", roi, frame)


def high_pass(traces: DataFrame, half: int, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    return traces.withColumn("high", F.col(value) - F.avg(value).over(centred(half, roi, frame)))


def diff_noise(traces: DataFrame, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Noise from first differences: by median absolute deviation and by standard deviation."""
    d = traces.withColumn("d", F.col(value) - F.lag(value).over(along(roi, frame))).where("d is not null")
    d = d.join(d.groupBy(roi).agg(F.median("d").alias("m")), roi)
    root2 = float(np.sqrt(2.0))
    return d.groupBy(roi).agg((F.median(F.abs(F.col("d") - F.col("m"))) / 0.6745 / root2).alias("mad_noise"), (F.stddev_pop("d") / root2).alias("std_noise"))


def with_halo(traces: DataFrame, low: int, high: int, halo: int, operator, frame: str = "frame") -> DataFrame:
    """A frame range of a windowed result: rows are cut to the range and its halo below the window, to the range above."""
    inside = traces.where((F.col(frame) >= low - halo) & (F.col(frame) < high + halo))
    return operator(inside).where((F.col(frame) >= low) & (F.col(frame) < high))


def ar1_filter(traces: DataFrame, g: float, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Adds ``c``: c[t] = value[t] + g c[t-1], one scan of each trace."""

    def run(pdf):
        pdf = pdf.sort_values(frame)
        pdf["c"] = kernels.ar1(pdf[value].to_numpy(float), g)
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields)
    return traces.groupBy(roi).applyInPandas(run, f"{kinds}, c double")


def baseline_dff(
    traces: DataFrame, fs: float, method: str = "percentile", percentile: float | None = None, window: float = 60.0, sigma: float = 10.0, background: str | None = None, value: str = "value", roi: str = "roi", frame: str = "frame", kind: str = "float",
) -> DataFrame:
    """(roi, frame, dff, f0) with mirrored borders, as ``kind`` (float or double). Without a percentile, that of the density's mode over the first window is used, for the background as well."""
    if method not in ("percentile", "maximin"):
        raise ValueError(f"unknown method {method!r}")
    columns = [roi, frame, value, *([background] if background else [])]
    single = np.float32 if kind == "float" else np.float64

    size = int(window * fs)

    def run(pdf, starts):
        xs = pieces(pdf[value].to_numpy(float), starts)
        if method == "maximin":
            base = lambda v, level: kernels.maximin(v, sigma, kernels.odd_window(window, fs))
        else:
            base = lambda v, level: kernels.rolling_percentile(v, size, level)
        automatic = method == "percentile" and percentile is None
        levels = kernels.mode_percentiles([x[:size] for x in xs]) if automatic else [percentile] * len(xs)
        x, f0 = np.concatenate(xs), np.concatenate([base(x, level) for x, level in zip(xs, levels)])
        below = f0
        if background:
            below = f0 + np.concatenate([base(b, level) for b, level in zip(pieces(pdf[background].to_numpy(float), starts), levels)])
        pdf["dff"], pdf["f0"] = ((x - f0) / (below + EPS32)).astype(single), f0.astype(single)
        return pdf[[roi, frame, "dff", "f0"]]

    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}
    return by_traces(traces, columns[2:], run, f"`{roi}` {kinds[roi]}, `{frame}` {kinds[frame]}, dff {kind}, f0 {kind}", roi, frame)


def deconvolve(
    traces: DataFrame, fs: float, decay: float | None = None, rise: float | None = None, penalty: int | None = 1, value: str = "value", roi: str = "roi", frame: str = "frame", noise_std: float | None = None, baseline: float | None = None, baseline_nonneg: bool = True, lam: float = 0.0, s_min: float = 0.0, refine: int = 0,
) -> DataFrame:
    """(roi, frame, denoised, spikes) by non-negative AR deconvolution of each trace, AR(2) unless a decay without a rise is given."""
    if rise and not decay:
        raise ValueError("a rise time needs a decay time")
    if penalty not in (0, 1, None):
        raise ValueError("penalty is 0, 1 or None")
    if penalty is not None and (lam or s_min):
        raise ValueError("lam and s_min need penalty None")
    how = {"penalty": penalty, "noise_std": noise_std, "baseline": baseline, "baseline_nonneg": baseline_nonneg, "lam": lam, "s_min": s_min, "refine": refine}

    def run(pdf, starts):
        done = kernels.deconvolve_all(pieces(pdf[value].to_numpy(float), starts), fs, decay, rise, **how)
        pdf["denoised"], pdf["spikes"] = (np.concatenate(x).astype(np.float32) for x in zip(*done))
        return pdf[[roi, frame, "denoised", "spikes"]]

    kinds = {f.name: f.dataType.simpleString() for f in traces.schema.fields}
    return by_traces(traces, [value], run, f"`{roi}` {kinds[roi]}, `{frame}` {kinds[frame]}, denoised float, spikes float", roi, frame)


def project_out(traces: DataFrame, regressor: str, value: str = "value", roi: str = "roi") -> DataFrame:
    """Adds ``residual``: what a constant and one regressor leave."""
    fit = traces.groupBy(roi).agg(F.regr_slope(value, regressor).alias("b"), F.avg(value).alias("my"), F.avg(regressor).alias("mx"))
    return traces.join(fit, roi).withColumn("residual", F.col(value) - F.col("my") - F.coalesce("b", F.lit(0.0)) * (F.col(regressor) - F.col("mx"))).drop("b", "my", "mx")


def agreement(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Correlation, R^2 against identity and least-squares scale of two columns."""
    n = pairs.groupBy(*by).agg(
        F.corr(a, b).alias("corr"), F.sum(F.pow(F.col(a) - F.col(b), 2)).alias("e"), (F.var_pop(b) * F.count(b)).alias("v"), F.sum(F.col(a) * F.col(b)).alias("xy"), F.sum(F.col(a) * F.col(a)).alias("xx")
    )
    return n.select(*by, "corr", (1 - F.col("e") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"), (F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))).alias("scale"))


def triggered_average(traces: DataFrame, events: Column, before: int, after: int, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """(roi, lag, value, n): mean of the trace around its events."""
    at = traces.where(events).select(F.col(roi).alias("__roi"), F.col(frame).alias("__at"))
    lags = at.withColumn("lag", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("__f", F.col("__at") + F.col("lag"))
    met = lags.join(traces, (F.col("__roi") == F.col(roi)) & (F.col("__f") == F.col(frame)))
    return met.groupBy(roi, "lag").agg(F.avg(value).alias("value"), F.count("*").alias("n"))


def outliers_removed(traces: DataFrame, half: int, clip: float, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """Adds ``flat``: the trace less its rolling median, cut at so many times its median size of the differences."""
    flat = traces.withColumn("__m", F.percentile(value, 0.5).over(centred(half, roi, frame))).withColumn("flat", F.col(value) - F.col("__m")).drop("__m")
    limit = flat.groupBy(roi).agg((F.lit(clip) * F.median(F.abs("flat"))).alias("__l"))
    cut = F.greatest(-F.col("__l"), F.least(F.col("__l"), F.col("flat")))
    return flat.join(limit, roi).withColumn("flat", cut).drop("__l")


def ordered_means(traces: DataFrame, *by: str, value: str = "value", roi: str = "roi", frame: str = "frame") -> DataFrame:
    """(roi, by..., mean) of each trace, summed frame by frame: the same last digit however the rows are dealt. The columns ``by`` are constant along a trace."""
    before = along(roi, frame).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = traces.withColumns({"__s": F.sum(value).over(before), "__n": F.count(value).over(before)})
    # the last row of a trace has its whole sum
    last = running.groupBy(roi, *by).agg(F.max_by(F.struct("__s", "__n"), frame).alias("__t"))
    return last.select(roi, *by, (F.col("__t.__s") / F.nullif(F.col("__t.__n"), F.lit(0))).alias("mean"))


def median_over_regions(scores: DataFrame, score: str, *by: str) -> DataFrame:
    """The median of a score over regions."""
    return scores.groupBy(*by).agg(F.median(score).alias(score), F.count("*").alias("n"))


def spike_bins(spikes: DataFrame, spine: DataFrame, t0: float, fs: float, t: str = "t", roi: str = "roi") -> DataFrame:
    """Spikes counted into frames floor((t - t0) fs) of a spine (roi, frame); those outside are dropped, empty frames are 0."""
    counted = spikes.withColumn("frame", F.floor((F.col(t) - t0) * fs)).groupBy(roi, "frame").agg(F.count("*").alias("n"))
    return spine.join(counted, [roi, "frame"], "left").select(roi, "frame", F.coalesce("n", F.lit(0)).alias("n"))
