"""Stages that are built from each other: cascading drops, rebuilds in order, and none where nothing has changed."""

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from clinfeat.sources.stages import new_path, until_exit


def file_version(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their names, sizes and times of change."""
    spark = df.sparkSession
    cells = []
    for name in sorted(df.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        cells.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join([*cells, df.schema.json()]).encode()).hexdigest()


@dataclass
class _Stage:
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    path: str | None = None
    version: str | None = None  # of its contents; a new one with every build
    built_from: tuple = ()  # versions of its inputs at the last build
    _schema: object = field(default=None, repr=False)


class StageGraph:
    """Written stages by name. ``source`` adds a table that is only read, ``stage`` one that a function makes of others.

    A stage is up to date while it exists and its inputs have the versions that it was built from: a source's version follows its
    files (or is given), a stage's changes when it is built. Stages are Parquet folders below the session's shared folder, removed
    when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, tuple[DataFrame, str | None]] = {}
        self._stages: dict[str, _Stage] = {}
        self.built: list[str] = []  # every build, in order

    def source(self, name: str, df: DataFrame, version: str | None = None) -> None:
        """Register a source, or replace it; without ``version`` that of its files counts."""
        if name in self._stages:
            raise ValueError(f"{name!r} is a stage")
        self._sources[name] = (df, version)

    def stage(self, name: str, inputs: list[str], build: Callable[..., DataFrame]) -> None:
        """Register a stage: ``build`` gets the inputs in order. A stage that is registered anew, or whose function changes, is out of date."""
        if name in self._sources:
            raise ValueError(f"{name!r} is a source")
        unknown = [x for x in inputs if x not in self._sources and x not in self._stages and x != name]
        if unknown:
            raise ValueError(f"unknown inputs {unknown}")
        before = dict(self._stages)
        self._stages[name] = _Stage(build, tuple(inputs))
        try:
            self._order()
        except CycleError:
            self._stages = before
            raise ValueError(f"{name!r} would depend on itself") from None

    def _order(self) -> list[str]:
        return [x for x in TopologicalSorter({k: s.inputs for k, s in self._stages.items()}).static_order() if x in self._stages]

    def dependants(self, name: str) -> list[str]:
        """All stages that are made of it, directly or not, in order of building."""
        found = {name}
        for x in self._order():
            if found & set(self._stages[x].inputs):
                found.add(x)
        return [x for x in self._order() if x in found and x != name]

    def drop(self, name: str, cascade: bool = False) -> list[str]:
        """Remove a stage's rows and, with ``cascade``, those of all its dependants; gives the names, dependants first.

        Without ``cascade`` a stage that others were built from is not dropped.
        """
        if name not in self._stages:
            raise KeyError(name)
        written = [x for x in self.dependants(name) if self._stages[x].path]
        if written and not cascade:
            raise ValueError(f"{name!r} is used by {written}")
        gone = [x for x in [*reversed(written), name] if self._stages[x].path]
        for x in gone:
            self._remove(self._stages[x].path)
            self._stages[x] = _Stage(self._stages[x].build, self._stages[x].inputs)
        return gone

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _version(self, name: str) -> str | None:
        if name in self._stages:
            return self._stages[name].version
        df, version = self._sources[name]
        return version if version is not None else file_version(df)

    def stale(self) -> list[str]:
        """Stages that a refresh would build, in order."""
        out, seen = [], {x: self._version(x) for x in self._sources}
        for x in self._order():
            s = self._stages[x]
            if not s.path or any(i in out for i in s.inputs) or s.built_from != tuple(seen.get(i, self._version(i)) for i in s.inputs):
                out.append(x)
        return out

    def refresh(self, *names: str) -> list[str]:
        """Build what is out of date among the named stages and all they need (all stages without names); gives what was built, in order.

        A stage is written beside the old one, which goes when the new one is there.
        """
        wanted = set(names or self._stages)
        for x in reversed(self._order()):
            if x in wanted:
                wanted |= {i for i in self._stages[x].inputs if i in self._stages}
        built = []
        for x in self.stale():
            if x not in wanted:
                continue
            s = self._stages[x]
            inputs = tuple(self._version(i) for i in s.inputs)
            df, path = s.build(*[self._read(i) for i in s.inputs]), new_path(self.spark, f"stage-{x}")
            df.write.parquet(path)
            until_exit(self.spark, path)
            old, s.path, s.version, s.built_from, s._schema = s.path, path, uuid.uuid4().hex, inputs, df.schema
            if old:
                self._remove(old)
            built.append(x)
        self.built += built
        return built

    def _read(self, name: str) -> DataFrame:
        if name in self._sources:
            return self._sources[name][0]
        s = self._stages[name]
        return self.spark.read.schema(s._schema).parquet(s.path)

    def table(self, name: str) -> DataFrame:
        """The rows of a source or stage; a stage is built first if it or what it needs is out of date."""
        if name in self._stages:
            self.refresh(name)
        return self._read(name)
