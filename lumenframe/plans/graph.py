"""Analysis graph: named, parameterised tables with dependencies.

Recomputing a table removes exactly what was derived from it. A batch is run in
dependency order, whatever order it is given in. An extension is a function
``(analysis, **params) -> DataFrame``; ``a|b`` in its dependencies means either.
"""

from __future__ import annotations

import inspect
import json
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace  # noqa: F401 - replace is part of what this module offers

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Imaging, Rois


@dataclass(frozen=True)
class Extension:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    need_imaging: bool = False


REGISTRY: dict[str, Extension] = {}


def register_extension(name: str, needs=(), optional=(), need_imaging: bool = False):
    """Registers a function as an extension; a name can be taken once."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"extension {name} is registered")
        REGISTRY[name] = Extension(name, f, tuple(needs), tuple(optional), need_imaging)
        return f

    return add


#: The column of an extension's table that is meant when none is named.
MAIN = {"fluorescence": "value", "df_over_f": "dff", "deconvolution": "spikes"}


def function_factory(name: str):
    """``compute_<name>(analysis, **params)`` of a registered extension, with its defaults as signature."""
    if name not in REGISTRY:
        raise ValueError(f"unknown extension {name}")

    def compute(analysis: Analysis, **params) -> DataFrame:
        return analysis.compute(name, **params)

    compute.__name__ = compute.__qualname__ = f"compute_{name}"
    compute.__doc__ = REGISTRY[name].run.__doc__
    own = [p for p in inspect.signature(REGISTRY[name].run).parameters.values()][1:]
    first = inspect.Parameter("analysis", inspect.Parameter.POSITIONAL_OR_KEYWORD)
    compute.__signature__ = inspect.Signature([first, *[p.replace(kind=inspect.Parameter.KEYWORD_ONLY) for p in own]])
    return compute


def default_params(name: str) -> dict:
    return {k: p.default for k, p in inspect.signature(REGISTRY[name].run).parameters.items() if p.default is not inspect.Parameter.empty}


@dataclass
class Analysis:
    rois: Rois
    imaging: Imaging | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    shared: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.imaging is not None:
            self.rois.check(self.imaging)

    def dependants(self, name: str) -> list[str]:
        """Computed tables that follow from one, nearest first."""
        out: list[str] = []
        for other in self.tables:
            e = REGISTRY[other]
            direct = any(name in need.split("|") and self._pick(need) == name for need in e.needs) or name in e.optional
            if direct and other != name:
                out += [other, *self.dependants(other)]
        return list(dict.fromkeys(out))

    def _pick(self, need: str) -> str | None:
        return next((x for x in need.split("|") if x in self.tables), None)

    def delete(self, name: str) -> None:
        for other in self.dependants(name):
            self._drop(other)
        self._drop(name)

    def _drop(self, name: str) -> None:
        for held in (self.tables, self.params, self.seconds):
            held.pop(name, None)

    def compute(self, what, share: bool = False, **params):
        """One extension with parameters, or several: a list of names or name -> parameters; ``share`` keeps the movie's rows for a batch."""
        if isinstance(what, str):
            return self._one(what, params)
        wanted = {n: {} for n in what} if not isinstance(what, dict) else dict(what)
        for n in wanted:
            self._checked(n, wanted[n])
        # those that scan the movie share its rows: they are read from storage once
        scans = [n for n in wanted if REGISTRY[n].need_imaging]
        held = self.imaging.frames.persist(StorageLevel.DISK_ONLY) if share and len(scans) > 1 else None
        for n in sort_by_needs(list(wanted)):
            self._one(n, wanted[n])
        if held is not None:
            self.shared = held
        return self

    def release(self) -> None:
        """Lets go of the rows that a batch shared."""
        if self.shared is not None:
            self.shared.unpersist()
            self.shared = None

    def _checked(self, name: str, params: dict) -> Extension:
        if name not in REGISTRY:
            raise ValueError(f"unknown extension {name}")
        if unknown := set(params) - set(default_params(name)):
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        if REGISTRY[name].need_imaging and self.imaging is None:
            raise ValueError(f"{name} needs the movie")
        return REGISTRY[name]

    def _one(self, name: str, params: dict) -> DataFrame:
        e = self._checked(name, params)
        for other in self.dependants(name):
            self._drop(other)
        self._drop(name)
        if missing := [n for n in e.needs if self._pick(n) is None]:
            raise ValueError(f"{name} needs {missing}")
        began = time.time()
        self.tables[name] = e.run(self, **params)
        self.params[name], self.seconds[name] = default_params(name) | params, time.time() - began
        return self.tables[name]

    def get(self, name: str) -> DataFrame:
        return self.tables[name]

    def get_data(self, name: str, key: str | None = None) -> DataFrame:
        """(global_frame, roi, value) of a column of an extension: its main one, or the one that is named.

        A background that was not computed raises, but for a table without regions.
        """
        table, main = self.tables[name], MAIN.get(name)
        column = {"fluorescence": "value", "deconvolved": "spikes"}.get(key, key) or main
        if column not in table.columns:
            raise ValueError(f"{name} has no {key or main}")
        if key == "background" and len(self.rois.order) and table.where(F.col(column).isNotNull()).isEmpty():
            raise ValueError(f"{name} was computed without a background")
        return table.select("global_frame", "roi", F.col(column).alias("value"))

    def with_imaging(self, movie: Imaging) -> Analysis:
        """The same analysis over another copy of its movie: shape, rate, planes, epochs and type must agree."""
        self.rois.check(movie)
        if self.imaging is not None:
            told = lambda m: (m.height, m.width, m.plane_ids, m.fs, m.dtype, tuple(e.n_frames for e in m.epochs))
            if told(self.imaging) != told(movie):
                raise ValueError("the movie is not like the one it stands in for")
            warnings.warn("the analysis had a movie; it is replaced", stacklevel=2)
        return Analysis(self.rois, movie, dict(self.tables), dict(self.params), dict(self.seconds))

    def computed(self) -> list[str]:
        """Names of the extensions that are there."""
        return list(self.tables)

    def computable(self) -> list[str]:
        """Names of the extensions whose needs are met."""
        return [n for n, e in REGISTRY.items() if all(self._pick(need) for need in e.needs) and (self.imaging is not None or not e.need_imaging)]

    def select_rois(self, ids) -> Analysis:
        """Regions and every table that has a roi column, cut to the ids; others as they are."""
        ids = [str(i) for i in ids]
        cut = lambda t: t.where(F.col("roi").isin(ids)) if "roi" in t.columns else t
        return Analysis(self.rois.select(ids), self.imaging, {n: cut(t) for n, t in self.tables.items()}, dict(self.params), dict(self.seconds))

    def remove_rois(self, ids) -> Analysis:
        return self.select_rois(self.rois.remove(ids).order)

    def copy(self) -> Analysis:
        return Analysis(self.rois, self.imaging, dict(self.tables), dict(self.params), dict(self.seconds))

    def set_property(self, name: str, values: dict, missing: float = float("nan")) -> None:
        spark = self.rois.masks.sparkSession
        column = spark.createDataFrame([(i, float(values.get(i, missing))) for i in self.rois.order], f"roi_id string, `{name}` double")
        props = self.rois.properties
        held = column if props is None else props.drop(name).join(column, "roi_id", "full")
        self.rois = Rois(self.rois.masks, self.rois.height, self.rois.width, self.rois.order, self.rois.n_planes, self.rois.fs, held)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        from ..sources.store import _meta, save_rois

        spark = self.rois.masks.sparkSession
        save_rois(self.rois, f"{path}/rois", mode)
        for n, t in self.tables.items():
            t.write.mode(mode).parquet(f"{path}/tables/{n}")
        _meta(spark, path, "analysis", json.dumps({"params": self.params, "seconds": self.seconds}), mode)

    @staticmethod
    def load(spark: SparkSession, path: str, tables: bool = True) -> Analysis:
        from ..sources.store import load

        told = json.loads(spark.read.parquet(f"{path}/meta").first().content)
        names = list(told["params"]) if tables else []
        return Analysis(load(spark, f"{path}/rois"), None, {n: spark.read.parquet(f"{path}/tables/{n}") for n in names}, told["params"] if tables else {}, told["seconds"] if tables else {})


def sort_by_needs(names: list[str]) -> list[str]:
    """Dependencies before what needs them; otherwise the order given."""
    out: list[str] = []

    def add(n: str, path: tuple[str, ...]) -> None:
        if n in path:
            raise ValueError(f"circular dependency at {n}")
        if n in out:
            return
        for need in (*REGISTRY[n].needs, *REGISTRY[n].optional) if n in REGISTRY else ():
            for x in need.split("|"):
                if x in names:
                    add(x, (*path, n))
        out.append(n)

    for n in names:
        add(n, ())
    return out
