"""Runs described by configurations: plain dictionaries that are composed, overridden and swept."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators import cloud, distances, moments

Config = dict


def compose(*parts: Config) -> Config:
    """Later parts win; dictionaries are merged key by key, everything else is replaced."""
    out: Config = {}
    for part in parts:
        for key, value in part.items():
            out[key] = compose(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def override(text: str) -> Config:
    """``a.b=3`` as a nested dictionary; the value is read as JSON and taken as text if it is none."""
    path, equals, value = text.partition("=")
    if not equals or not all(path.split(".")):
        raise ValueError(f"not an override: {text!r}")
    try:
        out = json.loads(value)
    except ValueError:
        out = value
    for name in reversed(path.split(".")):
        out = {name: out}
    return out


def sweep(base: Config, axes: dict[str, list]) -> Iterator[Config]:
    """One configuration per combination of the axes, whose names are dotted paths; the last axis runs fastest."""
    for values in itertools.product(*axes.values()):
        yield compose(base, *[override(f"{name}={json.dumps(value)}") for name, value in zip(axes, values)])


def load(path: str) -> Config:
    """A JSON file, or a YAML one where the reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ImportError("YAML needs the package yaml; JSON is always read") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def _cloud(tables: dict[str, DataFrame], c: Config) -> float:
    df = moments.normalise(tables[c["table"]], c["vector"], c["normalise"]) if c.get("normalise") else tables[c["table"]]
    return cloud.compute_metrics(df, c["key"], c["vector"])[c["metric"]]


def _distance(tables: dict[str, DataFrame], c: Config) -> float:
    return distances.distance(c["metric"], tables[c["table"]], tables[c["other"]], c["key"], c["vector"], **c.get("options", {}))


TASKS: dict[str, Callable[[dict[str, DataFrame], Config], float]] = {"cloud": _cloud, "distance": _distance}


def run(tables: dict[str, DataFrame], configs: list[Config]) -> DataFrame:
    """(run, task, metric, table, value) of every configuration, in order; unknown tasks raise before any is run."""
    unknown = sorted({c["task"] for c in configs} - set(TASKS))
    if unknown:
        raise ValueError(f"unknown tasks {', '.join(unknown)}; known: {', '.join(TASKS)}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(k, c["task"], c["metric"], c["table"], float(TASKS[c["task"]](tables, c))) for k, c in enumerate(configs)]
    return spark.createDataFrame(rows, "run int, task string, metric string, table string, value double").orderBy(F.col("run"))
