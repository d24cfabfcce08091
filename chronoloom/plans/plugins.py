"""Engines as batch functions over tracks, chosen by stage and name."""

from __future__ import annotations

import contextlib
import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

MOCK = "mock"


class EngineUnavailableError(RuntimeError):
    """An engine's module isn't installed."""


@dataclass(frozen=True)
class Engine:
    """A function from batches of a table to batches of another, with its output schema and the modules it needs."""

    name: str
    schema: str
    run: Callable[[Iterator], Iterator]
    modules: tuple[str, ...] = ()


_ENGINES: dict[str, dict[str, Engine]] = {}


def register(stage: str, engine: Engine) -> None:
    _ENGINES.setdefault(stage, {})[engine.name] = engine


def known(stage: str, name: str) -> bool:
    return name in _ENGINES.get(stage, {})


def select(stage: str, name: str = MOCK) -> Engine:
    """The engine by name; fails on the driver where it or a module is missing."""
    engines = _ENGINES.get(stage, {})
    if name not in engines:
        raise ValueError(f"unknown engine {name!r} for {stage}; known: {', '.join(sorted(engines))}")
    engine = engines[name]
    absent = [m for m in engine.modules if importlib.util.find_spec(m) is None]
    if absent:
        raise EngineUnavailableError(f"{name} needs {', '.join(absent)}")
    return engine


def apply(df: DataFrame, stage: str, name: str = MOCK, progress: Callable[[str, str], None] | None = None, **overrides) -> DataFrame:
    """Run an engine over df in Arrow batches; the output has the engine's schema. progress is told before; its errors stop nothing. overrides go to the engine."""
    engine = select(stage, name)
    if progress is not None:
        with contextlib.suppress(Exception):
            progress(stage, name)
    return df.mapInArrow(partial(engine.run, **overrides) if overrides else engine.run, engine.schema)


@contextlib.contextmanager
def described(spark: SparkSession, stage: str, engine: str | None = None, track: str | None = None):
    """Jobs started inside carry stage, engine and track in their description, for logs and the UI."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(" | ".join(f"{k}={v}" for k, v in (("stage", stage), ("engine", engine), ("track", track)) if v))
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)
