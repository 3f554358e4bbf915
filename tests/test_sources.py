import json
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from lumenframe.functions import text
from lumenframe.settings import IntegerSettings, MotionSettings, PiecewiseSettings
from lumenframe.sources import arrays, chunked, files, recording, regions, store


def flat_plan(tmp_path, n=50):
    x = np.arange(n * 12, dtype="<u2")
    (tmp_path / "m.raw").write_bytes(b"head" + x.tobytes() + b"x")
    return {"kind": "flat", "path": str(tmp_path / "m.raw"), "offset": 4, "dtype": "<u2", "shape": [3, 4, 1], "n": n}, x.reshape(n, 3, 4, 1)


def test_filters_narrow_the_ranges(tmp_path, monkeypatch):
    """Filters reach the reader: only the bytes of the asked frames are read."""
    told, x = flat_plan(tmp_path)
    reader = recording.FrameReader([told, told], size=4 * 12 * 8)
    left = list(reader.pushFilters([EqualTo(("epoch_index",), 1), GreaterThanOrEqual(("frame",), 13), LessThan(("frame",), 30), EqualTo(("pixels",), None)]))
    assert [f.attribute for f in left] == [("pixels",)]
    parts = reader.partitions()
    assert {p.epoch for p in parts} == {1} and [(p.start, p.stop) for p in parts] == [(13, 16), (16, 24), (24, 30)]
    read = []
    real = files.read_bytes
    monkeypatch.setattr(recording.files, "read_bytes", lambda path, start, count: read.append((start, count)) or real(path, start, count))
    rows = [b for p in parts for b in reader.read(p)]
    assert sum(c for _, c in read) == 17 * 24 and min(s for s, _ in read) == 4 + 13 * 24
    got = np.concatenate([b.column(3).flatten().to_numpy() for b in rows]).reshape(17, 3, 4, 1)
    assert np.array_equal(got, x[13:30])


def test_listed_frames_and_planes(tmp_path):
    told, x = flat_plan(tmp_path)
    reader = recording.FrameReader([told], size=1 << 20)
    assert not list(reader.pushFilters([In(("frame",), (3, 40, 41)), EqualTo(("plane_index",), 0)]))
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert [f for b in rows for f in b.column(1).to_pylist()] == [3, 40, 41]
    assert np.array_equal(np.concatenate([b.column(3).flatten().to_numpy() for b in rows]), x[[3, 40, 41]].ravel())
    empty = recording.FrameReader([told], size=1 << 20)
    list(empty.pushFilters([EqualTo(("frame",), 99)]))
    assert [b for p in empty.partitions() for b in empty.read(p)] == []


@pytest.mark.parametrize("order", ["C", "F"])
def test_second_format_of_chunked_arrays(tmp_path, order):
    x = np.arange(5 * 7, dtype="<i4").reshape(5, 7)
    base = tmp_path / "a"
    base.mkdir()
    (base / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 7], "chunks": [2, 4], "dtype": "<i4", "compressor": {"id": "zstd"}, "fill_value": -1, "order": order, "filters": None}))
    for i in range(3):
        for j in range(2):
            part = np.full((2, 4), -1, "<i4")
            piece = x[2 * i : 2 * i + 2, 4 * j : 4 * j + 4]
            part[: piece.shape[0], : piece.shape[1]] = piece
            if (i, j) != (1, 1):  # a chunk that is not stored
                (base / f"{i}.{j}").write_bytes(zstandard.ZstdCompressor().compress(part.tobytes(order)))
    x[2:4, 4:7] = -1
    a = chunked.Chunked.open(str(base))
    assert np.array_equal(a.read(), x) and np.array_equal(a.read((1, 4), (3, 6)), x[1:4, 3:6])


def test_blosc_in_several_streams():
    """A frame whose blocks are split into as many streams as a number has bytes."""
    x = np.arange(700, dtype="<i4")
    raw, block, parts = x.tobytes(), 2048, []
    for a in range(0, len(raw), block):
        piece = np.frombuffer(raw[a : a + block], np.uint8)
        shuffled = piece.reshape(-1, 4).T.tobytes()
        streams = [shuffled[i * len(shuffled) // 4 : (i + 1) * len(shuffled) // 4] for i in range(4)] if len(piece) == block else [shuffled]
        packed = [zstandard.ZstdCompressor().compress(s) for s in streams]
        packed = [p if len(p) < len(s) else s for p, s in zip(packed, streams)]
        parts.append(b"".join(np.int32(len(p)).tobytes() + p for p in packed))
    starts = 16 + 4 * len(parts) + np.cumsum([0, *map(len, parts)])[:-1]
    body = starts.astype("<i4").tobytes() + b"".join(parts)
    frame = bytes([2, 1, 1 | 4 << 5, 4]) + np.array([len(raw), block, 16 + len(body)], "<i4").tobytes() + body
    assert chunked.unblosc(frame) == raw


def test_files_that_run_code_are_refused(tmp_path):
    import pickle

    class Bad:
        def __reduce__(self):
            return os.system, ("true",)

    np.save(tmp_path / "ops.npy", np.array(Bad(), dtype=object), allow_pickle=True)
    with pytest.raises(pickle.UnpicklingError):
        files.load_npy(str(tmp_path / "ops.npy"))


def test_nothing_is_overwritten_unasked(spark, tmp_path):
    movie = arrays.imaging_from_numpy(spark, np.zeros((4, 3, 2), np.float32), 10.0)
    rois = arrays.rois_from_numpy(spark, np.ones((2, 3, 2)), fs=10.0)
    for save, thing, place in ((recording.save_binary, movie, "f"), (recording.save_chunked, movie, "z"), (regions.save_rois_folder, rois, "r"), (regions.save_rois_chunked, rois, "q")):
        save(thing, str(tmp_path / place))
        with pytest.raises(FileExistsError):
            save(thing, str(tmp_path / place))
        save(thing, str(tmp_path / place), overwrite=True)
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        regions.read_rois_chunked(spark, str(tmp_path / "q"), ids=["7"])
    with pytest.raises(FileNotFoundError):
        regions.read_detector_folder(spark, str(tmp_path))


def test_integer_types_are_rounded_and_clipped(spark, tmp_path):
    movie = arrays.imaging_from_numpy(spark, np.array([[[-5.0, 0.6], [254.7, 999.0]]], np.float32), 10.0)
    recording.save_binary(movie, str(tmp_path / "m"), "uint8")
    back = recording.read_binary_folder(spark, str(tmp_path / "m"))
    assert arrays.to_numpy(back).ravel().tolist() == [0, 1, 255, 255] and back.dtype == "uint8"


def test_settings_are_checked():
    for kind, bad in ((MotionSettings, {"batch_size": 0}), (MotionSettings, {"bounds": ((3, 1), (0, 2))}), (PiecewiseSettings, {"max_deviation": 0.0}), (IntegerSettings, {"smooth_sigma_time": 1.0}), (IntegerSettings, {"reference_frames": 0})):
        with pytest.raises(ValueError):
            kind.resolve(env={}, **bad)
    with pytest.raises(TypeError):
        MotionSettings.resolve(env={}, colour=1)
    assert MotionSettings.resolve(env={"LUMENFRAME_MOTION_BOUNDS": "[[1, 5], [2, 6]]"}).bounds == ([1, 5], [2, 6])
    with pytest.raises(ValueError):
        text.duration("soon")
