"""Chunked arrays of the zarr formats 2 and 3: metadata, chunks, and the codecs that a plain Python installation can decode."""

from __future__ import annotations

import itertools
import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import zstandard

from . import files

#: Codec numbers and flag bits of a blosc frame. Fixed values of that format.
BLOSC_CODECS = {1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
BLOSC_SHUFFLE, BLOSC_RAW, BLOSC_BITS, BLOSC_WHOLE = 1, 2, 4, 16


def _inflate(kind: str, data: bytes, size: int) -> bytes:
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 15 + 32)
    return pa.Codec({"lz4": "lz4_raw"}.get(kind, kind)).decompress(data, size).to_pybytes()


def unblosc(frame: bytes) -> bytes:
    """Contents of a blosc frame: blocks, each of them shuffled by bytes or bits, in one or several streams."""
    flags, width = frame[2], max(1, frame[3])
    total, block = (int(x) for x in np.frombuffer(frame, "<i4", 2, 4))
    if flags & BLOSC_RAW:
        return frame[16 : 16 + total]
    if flags >> 5 not in BLOSC_CODECS:
        raise ValueError("this blosc codec is not supported")
    kind, out = BLOSC_CODECS[flags >> 5], []
    for i, at in enumerate(np.frombuffer(frame, "<i4", -(-total // block), 16)):
        size = min(block, total - i * block)
        parts = width if not flags & BLOSC_WHOLE and size == block and 1 < width <= 16 and block // width >= 128 else 1
        pieces, at = [], int(at)
        for _ in range(parts):
            packed = int(np.frombuffer(frame, "<i4", 1, at)[0])
            data = frame[at + 4 : at + 4 + packed]
            pieces.append(data if packed == size // parts else _inflate(kind, data, size // parts))
            at += 4 + packed
        out.append(_unshuffle(b"".join(pieces), width, flags))
    return b"".join(out)


def _unshuffle(data: bytes, width: int, flags: int) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    if flags & BLOSC_SHUFFLE and width > 1:
        n = len(raw) // width
        return raw[: n * width].reshape(width, n).T.tobytes() + data[n * width :]
    if flags & BLOSC_BITS:
        n = len(raw) // width // 8 * 8
        bits = np.unpackbits(raw[: n * width].reshape(8 * width, n // 8), axis=1, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * width :]
    return data


@dataclass
class Chunked:
    """An array as its metadata tell it; small enough to be sent to executors."""

    path: str
    shape: list[int]
    chunks: list[int]
    dtype: str
    codecs: list[str] = field(default_factory=list)
    fill: float = 0.0
    prefix: str = ""
    separator: str = "/"
    order: str = "C"
    attributes: dict = field(default_factory=dict)

    @staticmethod
    def open(path: str) -> Chunked:
        if files.exists(f"{path}/zarr.json"):
            m = files.read_json(f"{path}/zarr.json")
            if m.get("node_type") != "array":
                raise ValueError(f"{path} is no array")
            codecs, dtype = [], np.dtype(m["data_type"]) if m["data_type"] != "string" else np.dtype(object)
            for c in m["codecs"]:
                if c["name"] == "bytes":
                    dtype = dtype.newbyteorder(">" if c.get("configuration", {}).get("endian") == "big" else "<")
                elif c["name"] in ("zstd", "gzip", "blosc", "vlen-utf8"):
                    codecs.append(c["name"])
                elif c["name"] != "crc32c":
                    raise ValueError(f"codec {c['name']} is not supported")
            key = m.get("chunk_key_encoding", {"name": "default"})
            separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
            fill = m.get("fill_value") or 0
            return Chunked(path, m["shape"], m["chunk_grid"]["configuration"]["chunk_shape"], dtype.str, codecs, float(fill) if not isinstance(fill, str) else float("nan") if fill == "NaN" else 0.0, "c" + separator if key["name"] == "default" else "", separator, "C", m.get("attributes", {}))
        m = files.read_json(f"{path}/.zarray")
        if m.get("filters"):
            raise ValueError("filters are not supported")
        codecs = [m["compressor"]["id"]] if m.get("compressor") else []
        attributes = files.read_json(f"{path}/.zattrs") if files.exists(f"{path}/.zattrs") else {}
        return Chunked(path, m["shape"], m["chunks"], m["dtype"], codecs, float(m.get("fill_value") or 0), "", m.get("dimension_separator", "."), m.get("order", "C"), attributes)

    def chunk(self, place: tuple[int, ...]) -> np.ndarray:
        """One whole chunk; the fill value where none is stored."""
        path = f"{self.path}/{self.prefix}{self.separator.join(map(str, place))}" if self.shape else f"{self.path}/{self.prefix.rstrip(self.separator)}"
        kind, count = np.dtype(self.dtype), int(np.prod(self.chunks, dtype=np.int64))
        if not files.exists(path):
            return np.full(self.chunks, self.fill, kind)
        data = files.read_bytes(path)
        for c in reversed([c for c in self.codecs if c != "vlen-utf8"]):
            data = unblosc(data) if c == "blosc" else _inflate(c, data, count * kind.itemsize if kind != object else 1 << 28)
        if kind == object:
            return np.array(_strings(data), dtype=object)
        return np.frombuffer(data, kind, count).reshape(self.chunks, order=self.order)

    def read(self, *ranges: tuple[int, int]) -> np.ndarray:
        """The elements of half-open ranges (the whole of any axis that is left out); only chunks that meet them are read."""
        ranges = [*ranges, *[(0, n) for n in self.shape[len(ranges) :]]]
        out = np.empty([max(0, b - a) for a, b in ranges], np.dtype(self.dtype))
        spans = [range(a // c, -(-b // c)) if b > a else range(0) for (a, b), c in zip(ranges, self.chunks, strict=True)]
        for place in itertools.product(*spans):
            part = self.chunk(place)
            if part.ndim != len(self.shape):
                part = part.reshape([len(part)] + [1] * (len(self.shape) - 1))
            begin = [p * c for p, c in zip(place, self.chunks, strict=True)]
            low = [max(a, s) for (a, _), s in zip(ranges, begin, strict=True)]
            high = [min(b, s + c) for (_, b), s, c in zip(ranges, begin, self.chunks, strict=True)]
            out[tuple(slice(a - r[0], b - r[0]) for a, b, r in zip(low, high, ranges, strict=True))] = part[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, begin, strict=True))]
        return out

    def stored_bytes(self) -> int:
        fs, p = files.at(self.path)
        return sum(i.size for i in fs.get_file_info(files.pafs.FileSelector(p, recursive=True)) if i.type == files.pafs.FileType.File and not i.base_name.startswith((".z", "zarr.json")))

    def spec(self) -> dict:
        return asdict(self)


def _strings(data: bytes) -> list[str]:
    count, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for _ in range(count):
        n = int(np.frombuffer(data, "<u4", 1, at)[0])
        out.append(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def create(path: str, shape, chunks, dtype: str, attributes: dict | None = None) -> Chunked:
    """Writes the metadata of a format-3 array with zstd chunks."""
    kind = np.dtype(dtype)
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind.name, "fill_value": 0, "attributes": attributes or {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}],
    }
    files.write_bytes(f"{path}/zarr.json", json.dumps(meta).encode())
    return Chunked(path, list(shape), list(chunks), kind.newbyteorder("<").str, ["zstd"], 0.0, "c/")


def write_chunk(array: Chunked, place, data: np.ndarray) -> None:
    """A chunk, filled up where the array ends inside it."""
    whole = np.zeros(array.chunks, np.dtype(array.dtype))
    whole[tuple(slice(0, n) for n in data.shape)] = data
    files.write_bytes(f"{array.path}/{array.prefix}{array.separator.join(map(str, place))}", zstandard.ZstdCompressor(level=3).compress(whole.tobytes()))


def write_array(path: str, data: np.ndarray, chunks=None, attributes: dict | None = None) -> None:
    """A small array, written from here."""
    chunks = list(chunks or data.shape)
    array = create(path, data.shape, chunks, data.dtype.name, attributes)
    for place in itertools.product(*[range(-(-n // c)) for n, c in zip(data.shape, chunks, strict=True)]):
        write_chunk(array, place, data[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks, strict=True))])


def write_group(path: str, attributes: dict | None = None) -> None:
    files.write_bytes(f"{path}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes or {}}).encode())


def group_attributes(path: str) -> dict:
    if files.exists(f"{path}/zarr.json"):
        return files.read_json(f"{path}/zarr.json").get("attributes", {})
    return files.read_json(f"{path}/.zattrs") if files.exists(f"{path}/.zattrs") else {}


def is_store(path: str) -> bool:
    return any(files.exists(f"{path}/{f}") for f in ("zarr.json", ".zgroup"))
