import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.model import Rois
from lumenframe.operators import algebra, background, extensions, extraction, motion, neuropil, segmentation  # noqa: F401
from lumenframe.plans.graph import REGISTRY, Analysis, register_extension, sort_by_needs
from lumenframe.sources import arrays, generators, store


def dense(rois):
    a = np.zeros((len(rois.order), rois.height * rois.width))
    for r in rois.masks.collect():
        a[rois.order.index(r.roi_id), r.y * rois.width + r.x] = r.w
    return a


def wide(table, value="value", key="global_frame"):
    return table.toPandas().pivot(index=key, columns="roi", values=value).sort_index()


@pytest.fixture(scope="module")
def recording(spark):
    return generators.generate_recording(spark, 200, 32, 32, 4, radius=(3, 4), seed=3)


def test_algebra_against_arrays(spark):
    rng = np.random.default_rng(0)
    parts = [rng.random((n, 5, 7, 2)).astype(np.float32) for n in (4, 6, 8)]
    m = arrays.imaging_from_numpy(spark, parts, 20.0, plane_ids=("a", "b"))
    with pytest.raises(ValueError):
        m.get_series()
    assert np.array_equal(arrays.to_numpy(m, epoch_index=1, start=2, end=5), parts[1][2:5])
    assert np.array_equal(arrays.to_numpy(algebra.concatenate(m)), np.concatenate(parts))
    assert np.array_equal(arrays.to_numpy(algebra.select_planes(m, ["b"]), epoch_index=0), parts[0][..., [1]])
    cut = algebra.split_epoch_at_frames(m, [2, 5], 2)
    assert [e.n_frames for e in cut.epochs] == [2, 3, 3] and cut.epochs[1].t_start == pytest.approx(0.1)
    assert np.array_equal(arrays.to_numpy(cut, epoch_index=2), parts[2][5:])
    with pytest.raises(ValueError):
        algebra.split_epoch_at_frames(m, [5, 2], 2)
    with pytest.raises(ValueError):
        algebra.split_epochs(m, [True])


def test_binary_round_trip(spark, tmp_path):
    x = np.arange(11 * 3 * 4, dtype=np.uint16).reshape(11, 3, 4)
    (tmp_path / "m.raw").write_bytes(x.tobytes() + b"\x01")
    m = arrays.read_binary(spark, [str(tmp_path / "m.raw")], 10.0, (3, 4))
    assert m.n_frames == 11 and np.array_equal(arrays.to_numpy(m)[..., 0], x)


def test_store_round_trip(spark, tmp_path, recording):
    movie, rois, _ = recording
    store.save_imaging(movie, str(tmp_path / "m"))
    back = store.load(spark, str(tmp_path / "m"))
    assert back.epochs == movie.epochs and np.array_equal(arrays.to_numpy(back, start=3, end=6), arrays.to_numpy(movie, start=3, end=6))
    store.save_rois(rois, str(tmp_path / "r"))
    assert np.array_equal(dense(store.load(spark, str(tmp_path / "r"))), dense(rois))
    assert store.reader_name("TiffImagingExtractor") == "read_tiff"


def test_projection_regression_and_signs(spark, recording):
    movie, rois, _ = recording
    y, a = arrays.to_numpy(movie)[..., 0].reshape(200, -1).astype(float), dense(rois)
    run = Analysis(rois, movie)
    got = wide(run.compute("fluorescence"))[list(rois.order)].to_numpy()
    assert np.allclose(got, y @ a.T / (a**2).sum(axis=1), rtol=1e-4)
    got = wide(run.compute("fluorescence", method="regression", ridge=0.0))[list(rois.order)].to_numpy()
    assert np.allclose(got, y @ a.T @ np.linalg.inv(a @ a.T), rtol=1e-3, atol=1e-2)
    assert (wide(run.compute("fluorescence", method="nnls")).to_numpy() >= 0).all()
    with pytest.raises(ValueError):
        run.compute("fluorescence", method="other")


def test_joint_background_against_dense_least_squares(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((3, 20)), rng.random((1, 20))
    y = rng.random((6, 3)) @ a + rng.random((6, 1)) @ b
    table = lambda m, k: spark.createDataFrame([(int(i) if k == "component" else str(i), int(p), float(m[i, p])) for i in range(len(m)) for p in range(20)], f"{k} {'int' if k == 'component' else 'string'}, pix int, {'b' if k == 'component' else 'w'} double")
    pixels = spark.createDataFrame([(t, p, float(y[t, p])) for t in range(6) for p in range(20)], "frame int, pix int, v double")
    solver = extraction.JointSolver(table(a, "roi"), table(b, "component"), ridge=0.0)
    got = wide(solver(pixels, ["frame"]), key="frame").to_numpy()
    want = np.linalg.lstsq(np.vstack((a, b)).T, y.T, rcond=None)[0][:3].T
    assert np.allclose(got, want, atol=1e-6)


def test_rings(spark, recording):
    movie, rois, _ = recording
    rings = neuropil.surround_masks(rois, least=60).toPandas()
    inside = dense(rois).any(axis=0)
    assert np.allclose(rings.groupby("roi")["w"].sum(), 1.0) and not inside[rings["pix"]].any()


def test_graph_invalidates_and_sorts(spark, recording):
    movie, rois, truth = recording
    run = Analysis(rois, movie)
    run.compute(["deconvolution", "df_over_f", "fluorescence"])
    assert set(run.tables) == {"fluorescence", "df_over_f", "deconvolution"}
    run.compute("fluorescence")
    assert set(run.tables) == {"fluorescence"}
    with pytest.raises(ValueError):
        run.compute("deconvolution")
    with pytest.raises(TypeError):
        run.compute("fluorescence", nothing=1)
    with pytest.raises(ValueError):
        register_extension("fluorescence")(lambda a: None)
    assert sort_by_needs(["deconvolution", "fluorescence", "df_over_f"]) == ["fluorescence", "df_over_f", "deconvolution"]
    d = wide(run.compute("df_over_f", percentile=20.0), "dff")
    assert np.median([np.corrcoef(d[str(i)], truth.clean[:, i])[0, 1] for i in range(4)]) > 0.8
    fewer = run.remove_rois(["1"])
    assert sorted(r[0] for r in fewer.get("fluorescence").select("roi").distinct().collect()) == ["0", "2", "3"]


def test_analysis_round_trip(spark, recording, tmp_path):
    movie, rois, _ = recording
    run = Analysis(rois, movie)
    run.compute("fluorescence")
    run.save(str(tmp_path / "a"))
    back = store.load(spark, str(tmp_path / "a"))
    assert back.params["fluorescence"]["method"] == "projection" and back.get("fluorescence").count() == 800


def test_empty_mask_gives_zeros(spark):
    movie = generators.generate_random_imaging(spark, 6, 8, 8)
    masks = np.zeros((2, 8, 8))
    masks[0, 2:4, 2:4] = 1
    rois = arrays.rois_from_numpy(spark, masks)
    got = wide(Analysis(rois, movie).compute("fluorescence"))
    assert (got["1"] == 0).all() and (got["0"] > 0).all()


def test_background_fit_recovers_course():
    rng = np.random.default_rng(7)
    h = w = 24
    a = np.zeros((4, h, w))
    for i, (y, x) in enumerate([(3, 3), (3, 15), (15, 3), (15, 15)]):
        a[i, y : y + 4, x : x + 4] = 1
    a = a.reshape(4, -1)
    c = 20 * np.abs(rng.normal(size=(200, 4)))
    f = 100 + 30 * np.sin(np.arange(200) / 15)
    b = np.ones((1, h * w))
    y = c @ a + f[:, None] * b + rng.normal(0, 0.5, (200, h * w))
    got_b, got_f, seen = background.fit(y, a, (h, w), 1)
    off = ~a.any(axis=0)
    assert np.corrcoef(got_f[:, 0], f)[0, 1] > 0.99 and np.allclose(got_b[0][off], got_b[0][off].mean(), rtol=0.05)
    assert all(x >= y - 1e-6 * abs(x) for x, y in zip(seen, seen[1:]))


def test_background_extension(spark, recording):
    movie, rois, _ = recording
    run = Analysis(rois, movie)
    run.compute("background", frames=50, max_iter=5)
    with pytest.raises(ValueError):
        run.compute("fluorescence")
    assert run.compute("fluorescence", method="regression").where(F.col("background").isNull()).count() == 0


@pytest.mark.parametrize("how", [{"nonrigid": False}, {"nonrigid": True, "strides": (24, 24), "overlaps": (12, 12)}])
def test_motion_is_recovered(spark, how):
    from lumenframe.functions.kernels import smooth_image
    from lumenframe.functions.registration import move

    rng = np.random.default_rng(8)
    x = smooth_image(rng.normal(size=(48, 48)), 2.0) * 100 + 200
    true = rng.uniform(-3, 3, (24, 2))
    movie = arrays.imaging_from_numpy(spark, np.stack([move(x, *s, border=False) for s in true]), 10.0)
    found = motion.compute_motion(movie, **how)
    got = found.rigid.orderBy("frame").select("dy", "dx").toPandas().to_numpy()
    off = got - true
    assert np.abs(off - np.median(off, axis=0)).max() <= 0.25
    fixed = arrays.to_numpy(motion.register_motion(movie, found))[:, 8:-8, 8:-8, 0]
    raw = arrays.to_numpy(movie)[:, 8:-8, 8:-8, 0]
    assert fixed.std(axis=0).mean() < 0.2 * raw.std(axis=0).mean()


def test_integer_motion(spark):
    block = np.full((9, 16, 16), 1.0)
    for t in range(9):
        block[t, 6 + t % 3 : 8 + t % 3, 7:9] = 50
    movie = arrays.imaging_from_numpy(spark, block, 10.0)
    found = motion.compute_motion(movie, "integer", max_shift=(4, 4), bad_threshold=10)
    fixed = arrays.to_numpy(motion.register_motion(movie, found))[..., 0]
    assert fixed.std(axis=0).max() == 0
    assert found.bad_frames().where("bad").count() == 0 and found.ranges(16, 16).count() == 2


def test_segmentation_finds_planted_discs(spark):
    movie, rois, _ = generators.generate_recording(spark, 600, 48, 48, 5, radius=(4, 5), rate=0.5, sigma=5.0, seed=11)
    found = segmentation.run_segmentation(movie, tau=0.2, diameter=9)
    a, b = dense(rois), dense(found)
    best = [max(((a[i] > 0) & (b[j] > 0)).sum() / ((a[i] > 0) | (b[j] > 0)).sum() for j in range(len(b))) for i in range(len(a))]
    assert np.mean(np.array(best) > 0.4) >= 0.6
    with pytest.raises(ValueError):
        segmentation.run_segmentation(movie, "other")


def test_segmentation_sees_the_whole_movie(spark, monkeypatch):
    rng = np.random.default_rng(5)
    block = rng.normal(100, 1, (240, 24, 24))
    y, x = np.mgrid[:24, :24]
    # active only in the third of thirteen batches, only in the eleventh, and only at the end
    places = [((6, 6), 40), ((6, 17), 205), ((17, 12), 230)]
    for (cy, cx), start in places:
        block[start : start + 10][:, np.hypot(y - cy, x - cx) <= 3] += rng.uniform(10, 30, (10, 1))
    movie = arrays.imaging_from_numpy(spark, [block[:150], block[150:]], 10.0)
    seen = []

    def probe(stack, shape, **how):
        seen.append((stack, segmentation.detect_peaks(stack, shape, **how)))
        return seen[-1][1]

    monkeypatch.setitem(segmentation.METHODS, "probe", probe)
    segmentation.run_segmentation(movie, "probe", nbins=40, size=1, batch=20, diameter=6)
    stack, stats = seen[0]
    assert np.allclose(stack, block.reshape(240, -1))
    best = sorted(stats, key=lambda s: -s["score"])[:3]
    centres = [(s["ypix"].mean(), s["xpix"].mean()) for s in best]
    assert all(min(np.hypot(cy - a, cx - b) for a, b in centres) < 2 for (cy, cx), _ in places)


def test_segmentation_helpers(spark, recording):
    movie, _, _ = recording
    assert segmentation.bin_size(1000, 30.0, 0.5, 100) == 15
    flags = segmentation.normal_bad_frames(spark, movie, np.arange(200) < 3)
    assert flags.count() == 3
    assert segmentation.broadcast_ranges((1, 5), 2) == [(1, 5), (1, 5)]


def test_registry_and_regions(spark):
    assert {"fluorescence", "neuropil", "background", "df_over_f", "deconvolution"} <= set(REGISTRY)
    rois = generators.generate_rois(spark, 3, 50, 50, (5, 7))
    assert rois.select(["2", "0"]).order == ("2", "0")
    with pytest.raises(ValueError):
        rois.select(["9"])
    with pytest.raises(ValueError):
        rois.check(generators.generate_random_imaging(spark, 2, 8, 8))
    stat = [{"ypix": [1, 2], "xpix": [3, 3], "lam": [1.0, 2.0], "npix": 2, "radius": 1.5}]
    got = arrays.rois_from_stat(spark, stat, 10, 10, iscell=np.array([[1, 0.9]]))
    assert got.properties.first().properties["npix"] == 2 and isinstance(got, Rois)


def test_streams_equal_batch(spark, tmp_path):
    from lumenframe.streaming import ingest

    movie = generators.random_frames(spark, 40, 4, 4)
    timed = movie.frames.withColumn("ts", F.timestamp_seconds(F.col("frame").cast("long")))
    timed.write.parquet(str(tmp_path / "f"))
    masks = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 0.5)], "roi string, pix int, w double")
    q = ingest.trace_stream(ingest.read_frames(spark, str(tmp_path / "f")), masks).writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    want = extraction.projection(movie.pixels(), masks, ["frame"]).toPandas().sort_values("frame")["value"]
    got = spark.table("streamed").toPandas().sort_values("frame")["value"]
    assert np.allclose(got, want)
