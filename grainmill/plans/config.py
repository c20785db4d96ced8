"""Settings of the library, read from YAML or JSON mappings, and the composition of settings files."""

from __future__ import annotations

import copy
import csv
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any


def _part(values: Mapping, key: str) -> Mapping:
    """A nested mapping; one that is missing or null is empty."""
    return values.get(key) or {}


@dataclass(frozen=True)
class Windows:
    """How documents are cut: tokens in a window, between starts, and in the shortest window that stays."""

    size: int
    stride: int
    least: int

    @classmethod
    def of(cls, values: Mapping) -> Windows:
        return cls(values.get("chunk_tokens", 1024), values.get("stride_tokens", 1024), values.get("min_chunk_tokens", 128))


@dataclass(frozen=True)
class Cleaning:
    lowercase: bool
    strip_html: bool
    collapse_whitespace: bool

    @classmethod
    def of(cls, values: Mapping) -> Cleaning:
        return cls(*(bool(values.get(key, True)) for key in ("lowercase", "strip_html", "collapse_whitespace")))


@dataclass(frozen=True)
class NearRules:
    """How near copies are found. ``lsh`` has the parameters of candidate search."""

    enabled: bool
    threshold: float
    skip_short: int
    lsh: dict[str, int]

    @classmethod
    def of(cls, values: Mapping) -> NearRules:
        search = {"n": values.get("shingle_size", 5), "num_perm": values.get("num_permutations", 128), "rows": values.get("band_size", 4)}
        return cls(bool(values.get("enabled", True)), values.get("threshold", 0.85), values.get("skip_short_tokens", 200), search)


@dataclass(frozen=True)
class Recipe:
    """What a run removes. ``threshold`` is None where no near copies go."""

    name: str
    exact: bool = False
    threshold: float | None = None

    @classmethod
    def of(cls, values: Mapping, general: float) -> Recipe:
        """A recipe that is silent on exact copies keeps them; one of near copies without a threshold (or with 0) has the general one."""
        return cls(values["name"], bool(values.get("apply_exact", False)), (values.get("near_threshold") or general) if values.get("apply_near", False) else None)


@dataclass(frozen=True)
class Settings:
    seed: int
    windows: Windows
    cleaning: Cleaning
    near: NearRules
    cross_split: bool
    recipes: tuple[Recipe, ...]


def settings(values: Mapping | None = None) -> Settings:
    """Settings from the mapping of a settings file. Keys that the library doesn't read are passed over; without ``runs`` there are three recipes."""
    values = values or {}
    own = _part(values, "dedup")
    near = NearRules.of(_part(own, "near"))
    told = values.get("runs")
    recipes = (Recipe("no_dedup"), Recipe("exact", True), Recipe("near", True, 0.85)) if told is None else tuple(Recipe.of(r, near.threshold) for r in told)
    return Settings(values.get("seed", 17), Windows.of(own), Cleaning.of(own), near, bool(own.get("cross_split", True)), recipes)


def load_settings(path: str | None) -> Settings:
    return settings(load_yaml(path) if path else None)


def load_yaml(path: str) -> dict:
    """A mapping from a YAML file, or a JSON file by its suffix."""
    if path.endswith(".json"):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def composed(base: Mapping, *overrides: Mapping) -> dict[str, Any]:
    """A deep merge: later values win, nested mappings are merged, lists are replaced."""
    out = copy.deepcopy(base)
    for over in overrides:
        for k, v in (over or {}).items():
            out[k] = composed(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else copy.deepcopy(v)
    return out


def field_map(path: str) -> list[str]:
    """The columns that make strata: the values of a YAML mapping."""
    return list(load_yaml(path).values())


def resolved(path: str, root_variable: str = "GRAINMILL_WORKDIR") -> str:
    """User and environment expanded; a relative path stands below the folder that the variable names."""
    p = os.path.expanduser(os.path.expandvars(path))
    root = os.environ.get(root_variable)
    return p if os.path.isabs(p) or not root else os.path.join(root, p)


def grid_settings(grid_csv: str, base: dict, folder: str) -> dict[str, dict]:
    """Settings for each row (name, dedup, tokens, model, seed) of a grid: the base, and the files model/, dedup/ and tokens/ of these names."""
    with open(grid_csv, newline="", encoding="utf-8") as f:
        return {r["name"]: composed(base, *[load_yaml(f"{folder}/{k}/{r[k]}.yaml") for k in ("model", "dedup", "tokens")], {"seed": int(r["seed"])} if r.get("seed") else {}) for r in csv.DictReader(f)}


def dumped(values: dict) -> str:
    return json.dumps(values, indent=2)
