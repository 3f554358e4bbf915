"""Settings of motion estimation and segmentation: defaults, then environment variables, then an object, then keywords."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Base: fields with defaults; ``PREFIX`` names the environment variables."""

    PREFIX = ""

    @classmethod
    def resolve(cls, settings: Settings | dict | None = None, env: dict | None = None, **given):
        """Each later source wins: defaults, environment, object (its fields that differ from the defaults), keywords."""
        env = os.environ if env is None else env
        known = {f.name: f for f in fields(cls)}
        told = {n: cls._parse(env[cls.PREFIX + n.upper()], f.default) for n, f in known.items() if cls.PREFIX + n.upper() in env}
        if settings is not None:
            held = asdict(settings) if isinstance(settings, Settings) else dict(settings)
            plain = {f.name: f.default for f in fields(cls)}
            told |= {k: v for k, v in held.items() if isinstance(settings, dict) or k not in plain or v != plain[k]}
        told |= given
        if unknown := set(told) - set(known):
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        out = replace(cls(), **told)
        out.check()
        return out

    @staticmethod
    def _parse(text: str, default):
        if isinstance(default, bool):
            return text.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(default, str):
            return text
        value = json.loads(text)
        return tuple(value) if isinstance(value, list) else value

    def check(self) -> None:
        """Raises for values that make no sense."""

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class MotionSettings(Settings):
    """What both motion methods share."""

    PREFIX = "LUMENFRAME_MOTION_"

    batch_size: int = 500
    nonrigid: bool = True
    max_nonrigid_shift: float = 5.0
    bounds: tuple | None = None
    debug: bool = False

    def check(self) -> None:
        if self.batch_size < 1 or self.max_nonrigid_shift < 0:
            raise ValueError("batches need a frame and shifts must not be negative")
        if self.bounds is not None and any(a < 0 or a >= b for a, b in self.bounds):
            raise ValueError("bounds are ((y0, y1), (x0, x1)) with y0 < y1 and x0 < x1")


@dataclass(frozen=True)
class PiecewiseSettings(MotionSettings):
    PREFIX = "LUMENFRAME_PIECEWISE_"

    max_shift: tuple = (6, 6)
    strides: tuple = (48, 48)
    overlaps: tuple = (24, 24)
    max_deviation: float = 3.0
    rounds: int = 1
    split: int = 56
    upsample: int = 10
    filter_size: int | None = None
    border: str = "copy"
    fourier: bool = False

    def check(self) -> None:
        super().check()
        if self.nonrigid and self.max_deviation <= 0:
            raise ValueError("a non-rigid fit needs a positive deviation")
        if self.filter_size is not None and self.fourier:
            raise ValueError("a filter cannot be used with the Fourier warp")


@dataclass(frozen=True)
class IntegerSettings(MotionSettings):
    PREFIX = "LUMENFRAME_INTEGER_"

    nonrigid: bool = False
    reference_frames: int = 200
    max_shift_share: float = 0.1
    block_size: tuple = (128, 128)
    smooth_sigma: float = 1.15
    spatial_taper: float = 3.45
    smooth_sigma_time: float = 0.0
    bad_threshold: float = 1.0

    def check(self) -> None:
        super().check()
        if self.smooth_sigma_time > 0:
            raise ValueError("smoothing over time is not supported")
        if self.bounds is not None and self.nonrigid:
            raise ValueError("bounds cannot be used with block shifts")
        if self.reference_frames < 1:
            raise ValueError("at least one reference frame")


@dataclass(frozen=True)
class SegmentationSettings(Settings):
    PREFIX = "LUMENFRAME_SEGMENTATION_"

    method: str = "peaks"
    diameter: float = 8.0
    threshold: float = 0.3
    tau: float = 1.0
    #: Wanted bins; they set the length of a bin. With ``sampled``, no more than these are read, in evenly spaced batches.
    nbins: int = 5000
    sampled: bool = False
    bin_size: int | None = None
    batch_size: int = 500
    high_pass: float = 10.0
    smoothing: float = 1.0
    most: int = 2000
    classify: bool = True

    def check(self) -> None:
        if self.diameter < 1 or self.nbins < 1 or self.batch_size < 1 or self.tau < 0:
            raise ValueError("diameter, bins and batches must be at least 1, tau not negative")
