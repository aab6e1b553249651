"""Run settings: typed defaults overlaid by a nested mapping, unknown keys refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SplitSettings:
    dev_size: float = 0.2
    sample_ratio: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class ModelSettings:
    enabled: tuple[str, ...] = ("lexical", "common_letter", "logreg")
    submit: str = "lexical"


@dataclass(frozen=True)
class RunSettings:
    split: SplitSettings = field(default_factory=SplitSettings)
    models: ModelSettings = field(default_factory=ModelSettings)


def load_settings(spark: SparkSession, path: str | None) -> RunSettings:
    """The defaults, overlaid by a JSON or YAML file of any file system that Spark knows; YAML where a parser is installed."""
    if path is None:
        return RunSettings()
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        return overlay(RunSettings(), json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML parser is installed; write the settings as JSON") from e
    return overlay(RunSettings(), yaml.safe_load(text) or {})


def overlay(settings: Any, updates: dict[str, Any]) -> Any:
    """``settings`` with ``updates``; lists become tuples, nested mappings overlay nested settings."""
    known = {f.name: getattr(settings, f.name) for f in fields(settings)}
    if unknown := set(updates) - set(known):
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    new = {}
    for name, value in updates.items():
        old = known[name]
        if is_dataclass(old) and isinstance(value, dict):
            value = overlay(old, value)
        elif isinstance(old, tuple) and isinstance(value, list):
            value = tuple(value)
        new[name] = value
    return replace(settings, **new)
