"""Bytes of files in any store that Arrow reads (local, mounted, HDFS, S3, GCS), on the driver and on executors."""

from __future__ import annotations

import io
import json
import pickle

import numpy as np
import pyarrow.fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(str(path)) if "://" in str(path) or str(path).startswith("file:") else (pafs.LocalFileSystem(), str(path))


def reachable(path: str) -> bool:
    """Whether Arrow knows the store of this path; Spark's own readers may know others."""
    try:
        at(path)
    except Exception:  # noqa: BLE001 - whatever Arrow says of an unknown scheme
        return False
    return True


def size_of(path: str) -> int:
    fs, p = at(path)
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def exists(path: str) -> bool:
    fs, p = at(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def read_bytes(path: str, start: int = 0, count: int | None = None) -> bytes:
    fs, p = at(path)
    with fs.open_input_file(p) as f:
        return f.read_at(f.size() - start if count is None else count, start)


def write_bytes(path: str, content: bytes) -> None:
    fs, p = at(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(content)


def read_json(path: str) -> dict:
    return json.loads(read_bytes(path))


def remove(path: str) -> None:
    fs, p = at(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, where the data begin) of a .npy file in C order."""
    head = io.BytesIO(read_bytes(path, 0, min(size_of(path), 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran:
        raise ValueError(f"{path} is in column order")
    return shape, dtype, head.tell()


class _Plain(pickle.Unpickler):
    """Reads pickled dicts, lists, numbers, strings and arrays; any other class is refused, so that a file cannot run code."""

    ALLOWED = {"_reconstruct", "ndarray", "dtype", "scalar"}

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in self.ALLOWED:
            return super().find_class(module.replace("numpy.core", "numpy._core"), name)
        raise pickle.UnpicklingError(f"{module}.{name} is not read from files")


def load_npy(path: str) -> np.ndarray:
    """An array file; objects in it may be plain data only."""
    content = read_bytes(path)
    try:
        return np.load(io.BytesIO(content), allow_pickle=False)
    except ValueError:
        _, _, begin = npy_header(path)
        return _Plain(io.BytesIO(content[begin:])).load()


def load_npz(path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read_bytes(path)), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def scratch(spark, name: str) -> str:
    """A new folder for written intermediate data: in the cluster's shared folder (``spark.checkpoint.dir``), in a local session in a temporary one."""
    import tempfile
    import uuid

    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None:
        if not spark.sparkContext.isLocal:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="scratch-")
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"
