"""Queries over sources, sinks and generators: movies and regions whose every value is known, written, read back and summed."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .catalog import query, r6
from .model import Epoch, Imaging
from .operators import algebra
from .sources import arrays, chunked, files, generators, recording, regions, store

#: Two epochs of 11 and 5 frames of 3 x 4 x 2 counters.
CM = """cm AS (SELECT e, f, y, x, z, (e * 1000 + f * 24 + (y * 4 + x) * 2 + z)::DOUBLE AS v
  FROM (VALUES (0, 11), (1, 5)) t(e, n), range(11) a(f), range(3) b(y), range(4) c(x), range(2) d(z) WHERE f < n)"""
BY_PLANE = "SELECT e::BIGINT AS epoch_index, f AS frame, z AS plane_index, count(*) AS n, sum(v) AS total FROM cm {} GROUP BY ALL"


def counters() -> list[np.ndarray]:
    x = np.arange(11 * 24).reshape(11, 3, 4, 2)
    return [x, x[:5] + 1000]


def counter_movie(spark) -> Imaging:
    return arrays.imaging_from_numpy(spark, counters(), 10.0, [0.0, 5.0])


def by_plane(movie: Imaging, frames=None):
    p = (movie.with_frames(frames) if frames is not None else movie).pixels()
    return p.groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", F.col("plane_index").cast("long").alias("plane_index")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {CM} " + BY_PLANE.format(""))
def in_memory_movie(spark, d):
    return by_plane(counter_movie(spark))


def _flat_files(spark) -> list[str]:
    """A header of 16 bytes, the frames, and part of a frame more."""
    folder = files.scratch(spark, "flat")
    for i, x in enumerate(counters()):
        files.write_bytes(f"{folder}/{i}.raw", b"h" * 16 + x.astype("<u2").tobytes() + b"tail")
    return [f"{folder}/{i}.raw" for i in range(2)]


@query(f"WITH {CM} " + BY_PLANE.format(""))
def raw_binary_movie(spark, d):
    return by_plane(recording.read_binary(spark, _flat_files(spark), 10.0, (3, 4, 2), "uint16", offset=16, partition_bytes=200))


@query(f"WITH {CM} " + BY_PLANE.format("WHERE e = 0 AND f >= 3 AND f < 8 AND z = 1"))
def raw_binary_range(spark, d):
    movie = recording.read_binary(spark, _flat_files(spark), 10.0, (3, 4, 2), "uint16", offset=16, partition_bytes=200)
    return by_plane(movie, movie.get_series(3, 8, [1], 0))


def _timed(spark) -> Imaging:
    movie = counter_movie(spark)
    times = movie.frames.select("epoch_index", "frame").distinct().withColumn("t", F.col("frame") / 8.0 + F.col("epoch_index") * 100)
    return algebra.replace(movie, times=times)


TIMED = f"WITH {CM} SELECT e::BIGINT AS epoch_index, f AS frame, sum(v) AS total, f / 8.0::DOUBLE + e * 100 AS t FROM cm GROUP BY ALL"


def _with_times(movie: Imaging):
    total = movie.pixels().groupBy("epoch_index", "frame").agg(F.sum("v").alias("total"))
    return total.join(movie.with_times(), ["epoch_index", "frame"]).select(F.col("epoch_index").cast("long").alias("epoch_index"), "frame", "total", "t")


@query(TIMED)
def raw_binary_folder(spark, d):
    folder = files.scratch(spark, "folder")
    recording.save_binary(_timed(spark), folder, "int16")
    return _with_times(store.load(spark, folder))


@query(TIMED)
def chunked_movie(spark, d):
    path = files.scratch(spark, "movie") + ".zarr"
    recording.save_chunked(_timed(spark), path, "uint16", frames_per_chunk=4)
    return _with_times(store.load(spark, path))


@query(f"WITH {CM} " + BY_PLANE.format("WHERE e = 1 AND f >= 1 AND f < 4 AND z = 0"))
def chunked_range(spark, d):
    path = files.scratch(spark, "movie") + ".zarr"
    recording.save_chunked(counter_movie(spark), path, frames_per_chunk=2)
    movie = recording.read_chunked(spark, path)
    return by_plane(movie, movie.get_series(1, 4, [0], 1))


@query("SELECT vec_id // 100 AS epoch_index, vec_id % 100 AS frame, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def chunked_movie_of_table(spark, d):
    from .catalog import movie

    path = files.scratch(spark, "movie") + ".zarr"
    recording.save_chunked(movie(spark, d), path, "float32", frames_per_chunk=32)
    p = recording.read_chunked(spark, path).pixels()
    return p.groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame").agg(r6(F.sum("v"), "total"))


@query(f"WITH {CM} " + BY_PLANE.format("WHERE e = 0"))
def registered_reader(spark, d):
    name = "CounterMovieExtractor"
    store.READERS.pop(store.reader_name(name), None)
    store.register_source(name, lambda s, path, epoch: arrays.imaging_from_numpy(s, counters()[epoch], 10.0))
    movie = store.reader_class(name)(spark, "nowhere", epoch=0)
    return by_plane(movie.content)


NAMED = ["TiffImagingExtractor", "Hdf5ImagingExtractor", "ScanImageExtractor", "MultiTIFFExtractor", "Bruker"]


@query(f"""SELECT name, 'read_' || replace(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_extractor$', ''), '_imaging', '') AS reader
FROM (VALUES {", ".join(f"('{n}')" for n in NAMED)}) t(name)""")
def reader_names(spark, d):
    return spark.createDataFrame([(n, store.reader_name(n)) for n in NAMED], "name string, reader string")


# -- regions ------------------------------------------------------------------

#: Four regions over 5 x 6 x 2: pixels of which (index + region) is divisible by 3, weighted.
RM = "rm AS (SELECT n, y, x, z, (1 + n + y * 0.5)::DOUBLE AS w FROM range(4) r(n), range(5) a(y), range(6) b(x), range(2) c(z) WHERE ((y * 6 + x) * 2 + z + n) % 3 = 0)"
BY_ROI = f"WITH {RM} SELECT (10 + n)::VARCHAR AS roi_id, count(*) AS n, sum(w) AS w, sum(w * y) AS wy, sum(w * x) AS wx, sum(w * z) AS wz FROM rm {{}} GROUP BY ALL"


def region_masks() -> np.ndarray:
    n, y, x, z = np.mgrid[:4, :5, :6, :2]
    return np.where(((y * 6 + x) * 2 + z + n) % 3 == 0, 1 + n + y * 0.5, 0.0)


def four_regions(spark):
    return arrays.rois_from_numpy(spark, region_masks(), [10, 11, 12, 13], 20.0)


def by_roi(rois):
    w = F.col("w")
    return rois.masks.groupBy("roi_id").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("plane_index")).alias("wz"))


@query(BY_ROI.format(""))
def in_memory_rois(spark, d):
    return by_roi(four_regions(spark))


@query(BY_ROI.format(""))
def rois_folder_sparse(spark, d):
    folder = files.scratch(spark, "rois")
    regions.save_rois_folder(four_regions(spark), folder)
    return by_roi(store.load(spark, folder))


@query(BY_ROI.format(""))
def rois_folder_dense(spark, d):
    folder = files.scratch(spark, "rois")
    regions.save_rois_folder(four_regions(spark), folder, sparse=False)
    return by_roi(store.load(spark, folder))


@query(BY_ROI.format("WHERE n IN (1, 3)"))
def chunked_rois_subset(spark, d):
    path = files.scratch(spark, "rois") + ".zarr"
    regions.save_rois_chunked(four_regions(spark), path)
    return by_roi(regions.read_rois_chunked(spark, path, ids=[13, 11]))


@query(BY_ROI.format(""))
def chunked_rois_dense(spark, d):
    path = files.scratch(spark, "rois") + ".zarr"
    regions.save_rois_chunked(four_regions(spark), path, sparse=False)
    return by_roi(store.load(spark, path))


@query(BY_ROI.format(""))
def rois_parquet_round_trip(spark, d):
    path = files.scratch(spark, "rois")
    store.save_rois(four_regions(spark), path)
    return by_roi(store.load(spark, path))


#: Three detected regions: n + 2 pixels on a diagonal, weights that binary masks leave out.
STAT = "st AS (SELECT n, i, n + i AS y, 2 * n + i AS x FROM range(3) a(n), range(5) b(i) WHERE i < n + 2)"


def stats() -> list[dict]:
    out = []
    for n in range(3):
        i = np.arange(n + 2)
        out.append({"ypix": n + i, "xpix": 2 * n + i, "lam": 0.1 * (i + 1), "npix": n + 2, "radius": 1.5 * n, "compact": 1.0 + n})
    return out


@query(f"WITH {STAT} SELECT n::VARCHAR AS roi_id, y * 12 + x AS pix, 1.0::DOUBLE AS w FROM st")
def rois_from_stat_list(spark, d):
    m = arrays.rois_from_stat(spark, stats(), 10, 12, 10.0).masks
    return m.select("roi_id", (F.col("y") * 12 + F.col("x")).cast("long").alias("pix"), "w")


@query("SELECT n::VARCHAR AS roi_id, k AS name, CASE k WHEN 'npix' THEN n + 2 WHEN 'radius' THEN 1.5 * n WHEN 'compact' THEN 1.0 + n WHEN 'iscell' THEN n % 2 ELSE n / 4.0 END::DOUBLE AS value FROM range(3) a(n), (VALUES ('npix'), ('radius'), ('compact'), ('iscell'), ('iscell_probability')) t(k)")
def stat_properties(spark, d):
    cell = np.array([[n % 2, n / 4.0] for n in range(3)])
    return arrays.rois_from_stat(spark, stats(), 10, 12, 10.0, iscell=cell).properties.select("roi_id", F.explode("properties").alias("name", "value"))


@query(f"WITH {STAT} SELECT n::VARCHAR AS roi_id, count(*) AS n, sum(y)::BIGINT AS y, sum(x)::BIGINT AS x, 10 AS height, 12 AS width FROM st GROUP BY ALL")
def detector_folder(spark, d):
    folder = files.scratch(spark, "detector")

    def put(name, value):
        out = io.BytesIO()
        np.save(out, value, allow_pickle=True)
        files.write_bytes(f"{folder}/{name}.npy", out.getvalue())

    put("ops", np.array({"Ly": 10, "Lxc": 12, "fs": 10.0}, dtype=object))
    put("stat", np.array(stats(), dtype=object))
    put("iscell", np.array([[1, 0.9]] * 3))
    rois = store.load(spark, folder)
    return rois.masks.groupBy("roi_id").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("x").alias("x"), F.lit(rois.height).alias("height"), F.lit(rois.width).alias("width"))


@query("SELECT * FROM (VALUES ('chunked movie', 'Imaging'), ('chunked regions', 'Rois'), ('flat folder', 'Imaging'), ('region folder', 'Rois'), ('tables', 'Imaging'), ('nothing', 'ValueError')) t(stored, loaded)")
def generic_loader(spark, d):
    base, movie, rois = files.scratch(spark, "load"), counter_movie(spark), four_regions(spark)
    recording.save_chunked(movie, f"{base}/a.zarr")
    regions.save_rois_chunked(rois, f"{base}/b.zarr")
    recording.save_binary(movie, f"{base}/c", "int16")
    regions.save_rois_folder(rois, f"{base}/d")
    store.save_imaging(movie, f"{base}/e")
    rows = []
    for name, place in (("chunked movie", "a.zarr"), ("chunked regions", "b.zarr"), ("flat folder", "c"), ("region folder", "d"), ("tables", "e"), ("nothing", "f")):
        try:
            rows.append((name, type(store.load(spark, f"{base}/{place}")).__name__))
        except ValueError as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "stored string, loaded string")


@query(f"WITH {CM} " + BY_PLANE.format(""))
def movie_parquet_round_trip(spark, d):
    path = files.scratch(spark, "movie")
    store.save_imaging(counter_movie(spark), path)
    return by_plane(store.load(spark, path))


@query("SELECT 12.5::DOUBLE AS fs, 3 AS height, 4 AS width, 2 AS planes, 2 AS epochs, 5.0::DOUBLE AS second_start, 'int64' AS dtype")
def movie_metadata_json(spark, d):
    told = arrays.describe(arrays.imaging_from_numpy(spark, counters(), 12.5, [0.0, 5.0]))
    row = spark.createDataFrame([(told,)], "j string")
    read = F.from_json("j", "fs double, height int, width int, plane_ids array<int>, dtype string, epochs array<array<double>>").alias("m")
    return row.select(read).select("m.fs", "m.height", "m.width", F.size("m.plane_ids").alias("planes"), F.size("m.epochs").alias("epochs"), F.col("m.epochs")[1][1].alias("second_start"), "m.dtype")


@query("SELECT e, bytes, n, ratio >= 1 AS smaller FROM (VALUES (0, 11 * 24 * 8, 1, 2.0), (1, 5 * 24 * 8, 1, 2.0), (NULL, 16 * 24 * 8, 2, 2.0)) t(e, bytes, n, ratio)")
def compression_ratios(spark, d):
    path = files.scratch(spark, "movie") + ".zarr"
    recording.save_chunked(counter_movie(spark), path, "int64")
    arrays_of = [chunked.Chunked.open(f"{path}/video_epoch{i}") for i in range(2)]
    rows = spark.createDataFrame([(i, int(np.prod(a.shape)) * 8, a.stored_bytes()) for i, a in enumerate(arrays_of)], "e int, raw long, stored long")
    done = rows.rollup("e").agg(F.sum("raw").cast("int").alias("bytes"), F.count("*").cast("int").alias("n"), (F.sum("raw") / F.sum("stored")).alias("ratio"))
    return done.select("e", "bytes", "n", (F.col("ratio") >= 1).alias("smaller"))


@query("SELECT count(*) AS n, 8 AS size FROM range(16 * 24) t(i)")
def blosc_frames(spark, d):
    """Blocks shuffled by bytes and by bits come back as they were."""
    import zstandard

    x = np.concatenate([c.ravel() for c in counters()]).astype("<i8")
    raw, width = x.tobytes(), 8
    by_bytes = np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, width), axis=1, bitorder="little")
    by_bits = np.packbits(bits.T, axis=1, bitorder="little").tobytes()
    back = []
    for flag, data in ((1, by_bytes), (4, by_bits)):
        packed = zstandard.ZstdCompressor().compress(data)
        head = bytes([2, 1, flag | 16 | 4 << 5, width]) + np.array([len(raw), len(raw), 24 + len(packed)], "<i4").tobytes()
        back.append(chunked.unblosc(head + np.array([20, len(packed)], "<i4").tobytes() + packed) == raw)
    whole = spark.createDataFrame(pd.DataFrame({"v": x}))
    return whole.agg(F.count("*").alias("n"), F.lit(8 if all(back) else 0).alias("size"))


# -- generators -----------------------------------------------------------------


@query("SELECT (epoch // 1)::BIGINT AS epoch_index, n, TRUE AS inside, TRUE AS varied FROM (VALUES (0, 30 * 48), (1, 12 * 48)) t(epoch, n)")
def random_movie(spark, d):
    p = generators.generate_random_imaging(spark, (30, 12), 6, 4, 2, seed=7).pixels()
    return p.groupBy(F.col("epoch_index").cast("long").alias("epoch_index")).agg(F.count("*").cast("int").alias("n"), (F.min("v") >= 0).alias("low"), (F.max("v") < 1).alias("high"), (F.countDistinct("v") > F.count("*") * 0.99).alias("varied")).select("epoch_index", "n", (F.col("low") & F.col("high")).alias("inside"), "varied")


@query("""WITH g AS (SELECT kind, y, x, z, power(y - 6, 2) + power(x - 5, 2) AS flat, sqrt((power(y - 6, 2) + power(x - 5, 2)) / 16 + power(z - 2, 2) / 4) AS far FROM (VALUES ('disc'), ('ellipsoid'), ('weighted')) k(kind), range(13) a(y), range(11) b(x), range(5) c(z)),
w AS (SELECT *, CASE kind WHEN 'disc' THEN (flat <= 16 AND z = 2)::INT::DOUBLE WHEN 'ellipsoid' THEN (far <= 1)::INT::DOUBLE ELSE greatest(0, 1 - far) END AS w FROM g)
SELECT kind, y, x, z, round(w, 6) AS w FROM w WHERE w > 0""")
def roi_ellipsoids(spark, d):
    rows = []
    for kind, depth, weighted in (("disc", None, False), ("ellipsoid", 2, False), ("weighted", 2, True)):
        w = generators.ellipsoid((13, 11, 5), (6, 5, 2), 4, depth, weighted)
        rows += [(kind, int(y), int(x), int(z), float(w[y, x, z])) for y, x, z in zip(*np.nonzero(w))]
    return spark.createDataFrame(rows, "kind string, y long, x long, z long, w double").select("kind", "y", "x", "z", r6("w"))


@query("SELECT n::VARCHAR AS roi_id, TRUE AS whole, TRUE AS fits FROM range(6) t(n)")
def generated_rois(spark, d):
    """Every region is the ellipsoid around its own centre, and fits the field."""
    g = generators.generate_rois(spark, 6, 30, 40, (3, 5, 2), seed=3, n_planes=7)
    b = g.masks.groupBy("roi_id").agg(*[f(c).alias(n + c) for c in ("y", "x", "plane_index") for n, f in (("lo_", F.min), ("hi_", F.max))])
    r, depth = (F.col("hi_y") - F.col("lo_y")) / 2, (F.col("hi_plane_index") - F.col("lo_plane_index")) / 2
    centre = b.select("roi_id", r.alias("r"), depth.alias("q"), ((F.col("hi_y") + F.col("lo_y")) / 2).alias("cy"), ((F.col("hi_x") + F.col("lo_x")) / 2).alias("cx"), ((F.col("hi_plane_index") + F.col("lo_plane_index")) / 2).alias("cz"), ((F.col("lo_y") >= 0) & (F.col("hi_y") < 30) & (F.col("lo_x") >= 0) & (F.col("hi_x") < 40)).alias("fits"))
    far = (F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("x") - F.col("cx"), 2)) / F.pow("r", 2) + F.pow(F.col("plane_index") - F.col("cz"), 2) / F.pow("q", 2)
    return g.masks.join(centre, "roi_id").groupBy("roi_id").agg((F.max(far) <= 1 + 1e-9).alias("whole"), F.bool_and("fits").alias("fits"))


@query("SELECT i::VARCHAR AS roi, 0::BIGINT AS broken, TRUE AS in_range FROM range(4) t(i)")
def fluorescence_recursion(spark, d):
    """clean[t] = spikes[t] + g clean[t-1] and traces = (1 + clean) bleach, in every frame; event numbers lie in their range."""
    from pyspark.sql import Window

    t, fs, rate, decay, bleaching = 600, 30.0, 0.5, 1.0, 30.0
    table = generators.generate_fluorescence(t, 4, fs, rate, decay, 0.0, bleaching, seed=5).table(spark)
    g = float(np.exp(-1 / (decay * fs)))
    before = F.coalesce(F.lag("clean").over(Window.partitionBy("roi").orderBy("frame")), F.lit(0.0))
    bad = (F.abs(F.col("clean") - F.col("spikes") - g * before) > 1e-9) | (F.abs(F.col("trace") - (1 + F.col("clean")) * F.exp(-F.col("frame") / fs / bleaching)) > 1e-9)
    low, high = round(0.5 * rate * t / fs), round(1.5 * rate * t / fs)
    return table.withColumn("bad", bad).groupBy("roi").agg(F.sum(F.col("bad").cast("long")).alias("broken"), F.sum("spikes").between(low, high).alias("in_range"))


@query("""WITH g AS (SELECT y, x, sqrt(power(y - 2.5, 2) + power(x - 3.5, 2)) AS r FROM range(6) a(y), range(8) b(x)), p AS (SELECT y, x, 1 - 0.25::DOUBLE * r / max(r) OVER () AS p FROM g)
SELECT y * 8 + x AS pix, round(p / avg(p) OVER (), 6) AS v FROM p""")
def vignette_profile(spark, d):
    v = generators.vignette(6, 8).ravel()
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pix long, v double").select("pix", r6("v"))


class _Sine:
    """Known draws in place of random ones."""

    @staticmethod
    def normal(mean, spread, n):
        return mean + spread * np.sin(np.arange(n) + 1.0)


@query("""WITH RECURSIVE q AS (SELECT exp(-1 / (5 * 10.0::DOUBLE)) AS phi), o(t, v) AS (SELECT 0, sqrt(1 - phi * phi) * sin(1.0::DOUBLE) FROM q UNION ALL SELECT t + 1, phi * v + sqrt(1 - phi * phi) * sin(t + 2.0::DOUBLE) FROM o, q WHERE t < 199)
SELECT t::BIGINT AS frame, round(v - avg(v) OVER (), 6) AS v FROM o""")
def ou_fluctuation(spark, d):
    v = generators.fluctuation(200, 10.0, _Sine())
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "frame long, v double").select("frame", r6("v"))


@query("""WITH s AS (SELECT f, n, (1 + (f * (n + 1)) % 5)::DOUBLE AS s FROM range(40) a(f), range(3) b(n)), m AS (SELECT n, p, CASE WHEN p % 3 = n THEN 0.5 + p / 8.0 ELSE 0 END::DOUBLE AS w FROM range(3) a(n), range(24) b(p)),
sig AS (SELECT f, p, sum(s * w) AS v FROM s JOIN m USING (n) GROUP BY ALL)
SELECT CASE WHEN f < 25 THEN 0 ELSE 1 END::BIGINT AS epoch_index, CASE WHEN f < 25 THEN f ELSE f - 25 END AS frame, round(sum(v + (10 + f % 4) * (1 + p / 24.0::DOUBLE)), 3) AS total FROM sig GROUP BY f""")
def composed_movie(spark, d):
    f, n, p = np.arange(40)[:, None], np.arange(3)[None, :], np.arange(24)
    signal = (1 + (f * (n + 1)) % 5).astype(float)
    masks = np.where(p[None, :] % 3 == np.arange(3)[:, None], 0.5 + p[None, :] / 8, 0.0)
    movie = generators.compose_movie(spark, signal, masks, 10.0 + np.arange(40) % 4, 1 + p / 24, (3, 4, 2), 10.0, (25, 15))
    total = movie.pixels().groupBy(F.col("epoch_index").cast("long").alias("epoch_index"), "frame").agg(F.sum("v").alias("total"))
    return total.select("epoch_index", "frame", F.round("total", 3).alias("total"))


@query("SELECT f AS frame, n::VARCHAR AS roi, (f + n)::DOUBLE AS trace, ((f + n) % 4 = 0)::INT::DOUBLE AS spikes, (f * n)::DOUBLE AS clean, (f - n)::DOUBLE AS neuropil FROM range(7) a(f), range(3) b(n)")
def truth_table(spark, d):
    f, n = np.mgrid[:7, :3]
    truth = generators.Fluorescence((f + n).astype(float), ((f + n) % 4 == 0).astype(float), (f * n).astype(float), (f - n).astype(float))
    return truth.table(spark).select(F.col("frame").cast("long").alias("frame"), "roi", "trace", "spikes", "clean", "neuropil")


@query("""SELECT e::BIGINT AS epoch_index, f AS frame, round(e * 3.5::DOUBLE + f / 8.0::DOUBLE, 6) AS t FROM (VALUES (0, 6), (1, 4)) t(e, n), range(6) a(f) WHERE f < n""")
def movie_time_lookups(spark, d):
    movie = Imaging(spark.createDataFrame([(e, f, 0, [0.0]) for e, n in ((0, 6), (1, 4)) for f in range(n)], "epoch_index int, frame long, plane_index int, pixels array<float>"), 8.0, 1, 1, (Epoch(6), Epoch(4, 3.5)))
    rows = [(e, f, movie.time_of(movie.frame_at(movie.time_of(f, e), e), e)) for e, n in ((0, 6), (1, 4)) for f in range(n)]
    return spark.createDataFrame(rows, "epoch_index long, frame long, t double").select("epoch_index", "frame", r6("t"))


