"""Regions in folders of arrays, in chunked stores and in a detector's output folder.

Masks of a few regions read just those regions' bytes or chunks: every region is
a row of a table of byte ranges, read on the executors.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MASKS, Rois
from . import files
from .arrays import rois_from_stat
from .chunked import Chunked, group_attributes, write_array, write_group
from .recording import _prepare

NAMES = ["roi_id", "plane_index", "y", "x", "w"]


def _rows(roi: str, place: np.ndarray, weight: np.ndarray, shape) -> pa.RecordBatch:
    """Mask rows of one region, from flat places in (H, W[, P])."""
    h, w, p = (*shape, 1)[:3]
    place, weight = place[weight != 0], weight[weight != 0]
    y, rest = np.divmod(place, w * p)
    x, z = np.divmod(rest, p)
    kind = lambda a: pa.array(a.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([roi] * len(place), pa.string()), kind(z), kind(y), kind(x), pa.array(weight.astype(float))], names=NAMES)


def _masks(spark: SparkSession, ids: list[str], read) -> DataFrame:
    """Mask rows of the regions; ``read(i)`` gives flat places and weights of one."""
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate(ids)], "i int, roi_id string").repartition(max(1, min(len(ids), 200)))

    def run(batches):
        for batch in batches:
            for i, roi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield read(i, roi)

    return wanted.mapInArrow(run, MASKS)


def _properties(spark: SparkSession, ids: list[str], held: dict[str, np.ndarray]) -> DataFrame | None:
    """Numeric properties by region; others are not kept."""
    held = {k: v for k, v in held.items() if v.dtype.kind in "biuf" and len(v) == len(ids)}
    rows = [(r, {k: float(v[i]) for k, v in held.items()}) for i, r in enumerate(ids)]
    return spark.createDataFrame(rows, "roi_id string, properties map<string,double>") if held else None


def read_rois_folder(spark: SparkSession, folder: str) -> Rois:
    """A folder with ``metadata.json``, ``roi_ids.npy`` and masks: ``roi_image_masks.npy``, or ``.npz`` if sparse."""
    told = files.read_json(f"{folder}/metadata.json")
    shape = (*told["shape"], 1)[:3]
    ids = [str(i) for i in files.load_npy(f"{folder}/roi_ids.npy").tolist()]
    area = int(np.prod(shape))
    if files.exists(f"{folder}/roi_image_masks.npz"):
        z = files.load_npz(f"{folder}/roi_image_masks.npz")
        if "coords" in z:
            at = np.ravel_multi_index(tuple(z["coords"][1:]), shape[: len(z["coords"]) - 1])
            order = np.argsort(z["coords"][0], kind="stable")
            place, weight = at[order], z["data"][order]
            edge = np.searchsorted(z["coords"][0][order], np.arange(len(ids) + 1))
        else:
            place, weight, edge = z["indices"], z["data"], z["indptr"]
        masks = _masks(spark, ids, lambda i, roi: _rows(roi, place[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]], shape))
    else:
        path = f"{folder}/roi_image_masks.npy"
        _, kind, begin = files.npy_header(path)

        def read(i, roi):
            dense = np.frombuffer(files.read_bytes(path, begin + i * area * kind.itemsize, area * kind.itemsize), kind).astype(float)
            at = np.flatnonzero(dense)
            return _rows(roi, at, dense[at], shape)

        masks = _masks(spark, ids, read)
    props = {}
    if files.exists(f"{folder}/properties"):
        fs, root = files.at(f"{folder}/properties")
        props = {i.base_name[:-4]: files.load_npy(i.path) for i in fs.get_file_info(files.pafs.FileSelector(root)) if i.base_name.endswith(".npy")}
    return Rois(masks, shape[0], shape[1], tuple(ids), shape[2], told["sampling_frequency"], _properties(spark, ids, props))


def _sparse(rois: Rois) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, flat places, weights) of all regions in order. The size of the region list, not of a movie."""
    flat = (F.col("y") * rois.width + F.col("x")) * rois.n_planes + F.col("plane_index")
    got = rois.masks.where("w <> 0").select("roi_id", flat.alias("at"), "w").toArrow()
    number = {r: i for i, r in enumerate(rois.order)}
    which = np.array([number[r] for r in got.column("roi_id").to_pylist()], np.int64)
    place, weight = got.column("at").to_numpy().astype(np.int64), got.column("w").to_numpy()
    order = np.lexsort((place, which))
    return np.searchsorted(which[order], np.arange(len(rois.order) + 1)), place[order], weight[order]


def _held_properties(rois: Rois) -> dict[str, np.ndarray]:
    if rois.properties is None or "properties" not in rois.properties.columns:
        return {}
    rows = {r.roi_id: r.properties for r in rois.properties.collect()}
    return {k: np.array([rows.get(r, {}).get(k, np.nan) for r in rois.order]) for k in sorted({k for v in rows.values() for k in v})}


def save_rois_folder(rois: Rois, folder: str, sparse: bool = True, overwrite: bool = False) -> None:
    _prepare(folder, overwrite)
    edge, place, weight = _sparse(rois)
    shape = (rois.height, rois.width, rois.n_planes)
    put = lambda name, save: files.write_bytes(f"{folder}/{name}", save())

    def packed(write) -> bytes:
        out = io.BytesIO()
        write(out)
        return out.getvalue()

    files.write_bytes(f"{folder}/metadata.json", json.dumps({"sampling_frequency": rois.fs, "shape": list(shape)}).encode())
    put("roi_ids.npy", lambda: packed(lambda f: np.save(f, np.array(rois.order))))
    if sparse:
        put("roi_image_masks.npz", lambda: packed(lambda f: np.savez_compressed(f, data=weight, indices=place, indptr=edge, shape=np.array((len(rois.order), *shape)), fill_value=0.0, compressed_axes=np.array([0]))))
    else:
        dense = np.zeros((len(rois.order), int(np.prod(shape))))
        dense[np.repeat(np.arange(len(rois.order)), np.diff(edge)), place] = weight
        put("roi_image_masks.npy", lambda: packed(lambda f: np.save(f, dense.reshape(len(rois.order), *shape))))
    for k, v in _held_properties(rois).items():
        put(f"properties/{k}.npy", lambda v=v: packed(lambda f: np.save(f, v)))
    files.write_bytes(f"{folder}/binary.json", json.dumps({"class": "lumenframe.sources.BinaryRois", "relative_paths": True, "kwargs": {}}).encode())


def read_rois_chunked(spark: SparkSession, path: str, group: str = "rois", ids=None) -> Rois:
    """Regions in a zarr store, all or the given ones: dense (a chunk a region) or as ``indptr``, ``indices`` and ``data``."""
    root = f"{path}/{group}"
    told = group_attributes(root)
    if "shape" not in told:
        raise ValueError(f"{root} holds no regions")
    shape = (*told["shape"], 1)[:3]
    every = [str(i) for i in Chunked.open(f"{root}/roi_ids").read().tolist()]
    number = {r: i for i, r in enumerate(every)}
    chosen = [str(i) for i in ids] if ids is not None else every
    if missing := [i for i in chosen if i not in number]:
        raise ValueError(f"unknown region ids: {missing}")
    if told.get("roi_image_masks_sparse", files.exists(f"{root}/roi_image_masks_indptr")):
        edge = Chunked.open(f"{root}/roi_image_masks_indptr").read()
        indices, data = (Chunked.open(f"{root}/roi_image_masks_{n}").spec() for n in ("indices", "data"))

        def read(_, roi):
            a, b = int(edge[number[roi]]), int(edge[number[roi] + 1])
            return _rows(roi, Chunked(**indices).read((a, b)).astype(np.int64), Chunked(**data).read((a, b)).astype(float), shape)
    else:
        dense = Chunked.open(f"{root}/roi_image_masks").spec()

        def read(_, roi):
            x = Chunked(**dense).read((number[roi], number[roi] + 1)).astype(float).ravel()
            at = np.flatnonzero(x)
            return _rows(roi, at, x[at], shape)

    props = {}
    if files.exists(f"{root}/properties"):
        fs, base = files.at(f"{root}/properties")
        for i in fs.get_file_info(files.pafs.FileSelector(base)):
            if i.type == files.pafs.FileType.Directory:
                props[i.base_name] = Chunked.open(i.path).read()
    known = _properties(spark, every, props)
    if known is not None and ids is not None:
        known = known.where(F.col("roi_id").isin(chosen))
    return Rois(_masks(spark, chosen, read), shape[0], shape[1], tuple(chosen), shape[2], told["sampling_frequency"], known)


def save_rois_chunked(rois: Rois, path: str, group: str = "rois", sparse: bool = True, overwrite: bool = False) -> None:
    root = f"{path}/{group}"
    _prepare(root, overwrite)
    edge, place, weight = _sparse(rois)
    shape = (rois.height, rois.width, rois.n_planes)
    if not files.exists(f"{path}/zarr.json"):
        write_group(path)
    write_group(root, {"sampling_frequency": rois.fs, "shape": list(shape), "roi_image_masks_sparse": sparse, "roi_image_masks_shape": [len(rois.order), *shape]})
    if sparse:
        step = [max(8 * max(1, len(place) // max(1, len(rois.order))), 1024)]
        write_array(f"{root}/roi_image_masks_indptr", edge.astype(np.int64))
        write_array(f"{root}/roi_image_masks_indices", place, step)
        write_array(f"{root}/roi_image_masks_data", weight, step)
    else:
        dense = np.zeros((len(rois.order), int(np.prod(shape))))
        dense[np.repeat(np.arange(len(rois.order)), np.diff(edge)), place] = weight
        write_array(f"{root}/roi_image_masks", dense.reshape(len(rois.order), *shape), [1, *shape])
    numeric = all(r.lstrip("-").isdigit() for r in rois.order)
    if numeric:
        write_array(f"{root}/roi_ids", np.array([int(r) for r in rois.order], np.int64))
    else:
        _write_names(f"{root}/roi_ids", list(rois.order))
    write_group(f"{root}/properties")
    for k, v in _held_properties(rois).items():
        write_array(f"{root}/properties/{k}", v)


def _write_names(path: str, names: list[str]) -> None:
    """A string array: one chunk of lengths and UTF-8 bytes."""
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": [len(names)], "data_type": "string", "fill_value": "", "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [max(1, len(names))]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "vlen-utf8", "configuration": {}}],
    }
    files.write_bytes(f"{path}/zarr.json", json.dumps(meta).encode())
    coded = [n.encode() for n in names]
    files.write_bytes(f"{path}/c/0", np.uint32(len(coded)).tobytes() + b"".join(np.uint32(len(c)).tobytes() + c for c in coded))


def read_detector_folder(spark: SparkSession, folder: str) -> Rois:
    """A detector's output: ``ops.npy`` (Ly and Lx, or Lyc and Lxc; fs), ``stat.npy`` and, if there, ``iscell.npy``.

    Objects in these files may be dicts, lists, numbers and arrays only.
    """
    for name in ("ops.npy", "stat.npy"):
        if not files.exists(f"{folder}/{name}"):
            raise FileNotFoundError(f"{folder}/{name}")
    ops = files.load_npy(f"{folder}/ops.npy").item()
    stats = list(files.load_npy(f"{folder}/stat.npy"))
    cell = files.load_npy(f"{folder}/iscell.npy") if files.exists(f"{folder}/iscell.npy") else None
    h, w = int(ops.get("Ly", ops.get("Lyc"))), int(ops.get("Lx", ops.get("Lxc")))
    return rois_from_stat(spark, stats, h, w, float(ops["fs"]), iscell=cell)
