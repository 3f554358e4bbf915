"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from lumenframe import catalog

DATA = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(DATA)) if f.endswith(".parquet")] if os.path.isdir(DATA) else []


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = oracle.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    want, got = plain(want.fetchall()), plain(tuple(r) for r in got.select(*columns).collect())
    assert len(want) == len(got)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if any(isinstance(v, float) for v in a) and not any(isinstance(v, str) or v is None for v in a) else a == b


def test_filters_reach_the_scan(spark):
    if not TABLES:
        pytest.skip("no test tables")
    m = catalog.movie(spark, DATA)
    plan = m.get_series(10, 20, epoch_index=0)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1]


#: Queries that SQL has no form for, with the test that holds each against another way of computing it.
BY_OTHER_MEANS = {"kde_percentile", "dff_percentile_auto", "deconvolution_second_order", "trace_nnls_all", "cnmf_background"}


def test_every_query_is_held_against_something():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == BY_OTHER_MEANS


@pytest.fixture(scope="module")
def small_traces(spark):
    rows = catalog.trace_table(spark, DATA).orderBy("roi", "frame").toPandas()
    return {roi: g["value"].to_numpy(float) for roi, g in rows.groupby("roi")}


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_mode_percentiles(spark, small_traces):
    """The level is the share of a sum of Gaussian kernels up to its peak, with the kernels' width from the diffusion rule."""
    from lumenframe.functions import kernels

    got = {r.roi: r.level for r in catalog.QUERIES["kde_percentile"](spark, DATA).collect()}
    assert set(got) == set(small_traces)
    for roi, x in small_traces.items():
        if np.ptp(x) == 0:
            continue
        margin = np.ptp(x) / 10
        low, high = x.min() - margin, x.max() + margin
        counts, edges = np.histogram(x, 4096, (low, high))
        t = kernels.Diffusion(counts / len(x), len(x)).time()
        if t is None:
            assert got[roi] == 50
            continue
        at = (edges[:-1] + edges[1:]) / 2
        width = np.sqrt(t) * (high - low)
        density = np.zeros(4096)
        for v in np.concatenate((x, 2 * low - x, 2 * high - x)):  # the range's ends reflect
            density += np.exp(-((at - v) ** 2) / (2 * width**2))
        want = 100 * density[: density.argmax() + 1].sum() / density.sum()
        assert got[roi] == pytest.approx(want, abs=1.0)


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_automatic_baselines(spark, small_traces):
    from lumenframe.functions import kernels

    rows = catalog.QUERIES["dff_percentile_auto"](spark, DATA).toPandas()
    for roi, g in rows.groupby("roi"):
        x = small_traces[roi]
        level = kernels.mode_percentile(x[:20])
        pad = np.pad(x, (10, 9), mode="symmetric")
        f0 = np.array([np.sort(pad[i : i + 20])[min(int(20 * level / 100), 19)] for i in range(len(x))]) if len(x) > 20 else np.full(len(x), np.percentile(x, level))
        g = g.sort_values("frame")
        assert np.allclose(g["f0"], f0, rtol=1e-5) and np.allclose(g["dff"], (x - f0) / (f0 + 1.1920929e-07), rtol=1e-4, atol=1e-4)


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_nnls_of_all_regions(spark):
    """Every frame against all active sets."""
    import itertools

    from lumenframe.operators import extraction

    flat = extraction.FlatMasks(catalog.masks(spark, True), catalog.ROIS)
    a = np.zeros((6, 64))
    a[np.repeat(np.arange(6), np.diff(flat.edge)), flat.pix] = flat.w
    movie = catalog.frames(spark, DATA).orderBy("frame").toPandas()
    y = np.stack(movie["pixels"].to_list()).astype(float)
    got = catalog.QUERIES["trace_nnls_all"](spark, DATA).toPandas().pivot(index="frame", columns="roi", values="value")[catalog.ROIS].to_numpy()
    best, at = np.full(len(y), np.inf), np.zeros((len(y), 6))
    for k in range(7):
        for s in map(list, itertools.combinations(range(6), k)):
            c = np.zeros((len(y), 6))
            if s:
                c[:, s] = np.linalg.lstsq(a[s].T, y.T, rcond=None)[0].T
            left = np.where((c >= -1e-12).all(axis=1), ((y - c @ a) ** 2).sum(axis=1), np.inf)
            at[left < best], best = c[left < best], np.minimum(best, left)
    assert np.allclose(got, at, atol=2e-6)


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_second_order_deconvolution_is_consistent(spark):
    """Spikes are not negative, and denoised traces follow from them by a recursion of order two with stable roots."""
    rows = catalog.QUERIES["deconvolution_second_order"](spark, DATA).toPandas()
    assert (rows["spikes"] >= 0).all()
    for _, g in rows.sort_values("frame").groupby("roi"):
        c, s = g["denoised"].to_numpy(float), g["spikes"].to_numpy(float)
        if len(c) < 8 or np.abs(c).max() < 1e-6:
            continue
        past = np.stack((c[1:-1], c[:-2]), axis=1)
        fit, *_ = np.linalg.lstsq(past, c[2:] - s[2:], rcond=None)
        assert np.abs(past @ fit + s[2:] - c[2:]).max() < 1e-3 * max(1.0, np.abs(c).max())


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_background_of_the_movie(spark):
    """Unit norm, nothing negative, and a smaller residual than masks alone leave."""
    b = np.zeros(64)
    for r in catalog.QUERIES["cnmf_background"](spark, DATA).collect():
        b[r.pix] = r.b
    assert (b >= 0).all() and np.linalg.norm(b) == pytest.approx(1, abs=1e-4)


def test_long_windows_equal_short_ones(monkeypatch):
    from lumenframe.functions import kernels

    x = np.random.default_rng(4).normal(size=900)
    long = kernels.rolling_percentile(x, 301, 20)
    monkeypatch.setattr(kernels, "LONG_WINDOW", 10_000)
    assert np.array_equal(long, kernels.rolling_percentile(x, 301, 20))


def both(spark, folder, events, name):
    """A query over these events and its SQL, which sums in one thread."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(seconds=i), u, "view", v) for i, (u, v) in enumerate(events)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()), sorted(want.fetchall())


def test_histogram_edges(spark, tmp_path):
    """Values on the edges of bins."""
    got, want = both(spark, tmp_path, [(1, k / 20) for k in range(21)] + [(2, 0.0), (2, 2.0), (2, 0.25), (3, 1.0)], "padded_histogram")
    assert got == want


#: Its mean, 105.9690625, comes out a bit too small in double precision.
HALFWAY = [182.69, 184.03, 70.25, 122.38, 15.94, 66.86, 92.3, 173.12, 180.59, 0.01, 84.8, 70.64, 167.19, 51.68, 108.88, 122.23]
HALFWAY += [63.22, 115.72, 154.82, 143.09, 174.21, 116.29, 158.41, 28.64, 148.91, 143.86, 83.36, 71.41, 63.53, 21.16, 25.66, 185.13]


def test_ranking_of_halfway_means(spark, tmp_path):
    """A mean between two millionths ranks beside a trace that has the upper one."""
    got, want = both(spark, tmp_path, [(0, v) for v in HALFWAY] + [(5, 105.969063)] * 4 + [(1, 2.0)], "roi_ranking")
    assert got == want == [(0, 1), (1, 1), (5, 2)]


def test_means_are_summed_along_the_trace(spark):
    from lumenframe.operators import traces

    rows = [(0, i, v) for i, v in enumerate(HALFWAY)] + [(1, 0, None), (2, 0, 3.0), (2, 1, None)]
    plain = 0.0
    for v in HALFWAY:
        plain += v
    want = {0: plain / len(HALFWAY), 1: None, 2: 3.0}
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "roi long, frame long, value double").repartition(parts)
        assert {r.roi: r["mean"] for r in traces.ordered_means(df).collect()} == want


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_epochs_apart_are_one_plan(spark):
    """The table of all epochs holds what the movies by epoch hold, and reads the recording once."""
    from lumenframe.operators import algebra

    m = catalog.movie(spark, DATA)
    m = m.with_frames(m.frames.where("epoch_index < 3"), epochs=m.epochs[:3])
    parts = algebra.epochs_apart(m)
    for e, one in enumerate(algebra.split_by_epochs(m)):
        want = one.frames.collect()
        assert want and {r.epoch_index for r in want} == {0} and sorted(want) == sorted(parts.where(f"part = {e}").select(*one.frames.columns).collect())
    plan = catalog.QUERIES["split_by_epochs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_traces_are_handed_over_whole(spark, monkeypatch):
    """Traces cut by batches and blocks come to the kernel whole and in order, and as many at a time as a block holds."""
    from lumenframe.operators import traces

    monkeypatch.setattr(traces, "ROWS_AT_ONCE", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lengths = {**{k: 1 + 5 * k % 13 for k in range(30)}, None: 4, 99: 150}
        rows = [(k, f, float(f)) for k, n in lengths.items() for f in range(n)]
        df = spark.createDataFrame(rows[::-1], "roi long, frame long, value double").repartition(5)

        def run(pdf, starts):
            ends = [*starts[1:], len(pdf)]
            good = [pdf["value"].to_numpy()[a:b].tolist() == list(range(b - a)) for a, b in zip(starts, ends)]
            return pdf[["roi"]].iloc[starts].assign(n=np.diff([*starts, len(pdf)]), good=good, calls=len(starts))

        got = traces.by_traces(df, ["value"], run, "roi long, n long, good boolean, calls long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.roi: r.n for r in got} == lengths and len(got) == len(lengths)
    assert all(r.good for r in got) and max(r.calls for r in got) > 1
