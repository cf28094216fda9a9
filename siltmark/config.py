"""Run configuration: nested dataclasses, YAML, dotted overrides and a stable key."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from itertools import product


@dataclass
class SplitConfig:
    val_frac: float = 0.15
    test_frac: float = 0.24
    seed: int = 42
    near_dup_radius: int = 4
    gap_seconds: int = 300


@dataclass
class GateConfig:
    k: int = 5
    prototypes: int = 1
    target_specificity: float = 0.9
    target_precision: float = 0.9
    fold_quantile: float = 0.95


@dataclass
class EvalConfig:
    bins: int = 10
    bootstrap_reps: int = 1000
    bootstrap_seed: int = 0
    precision_at: tuple[int, ...] = (5, 10, 20)


@dataclass
class Config:
    embedder_id: str = "precomputed"
    split: SplitConfig = field(default_factory=SplitConfig)
    gate: GateConfig = field(default_factory=GateConfig)
    evaluation: EvalConfig = field(default_factory=EvalConfig)

    def to_dict(self) -> dict:
        return asdict(self)

    def key(self) -> str:
        """Names the artifacts of this configuration."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]


def _fill(target, values: dict) -> None:
    known = {f.name for f in fields(target)}
    for name, value in values.items():
        if name not in known:
            raise KeyError(f"unknown setting: {name}")
        old = getattr(target, name)
        if is_dataclass(old):
            _fill(old, value)
        else:
            setattr(target, name, tuple(value) if isinstance(old, tuple) else value)


def from_dict(values: dict | None) -> Config:
    config = Config()
    _fill(config, values or {})
    return config


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f))


def dump(config: Config, path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(json.loads(json.dumps(config.to_dict())), f, sort_keys=False)


def with_setting(config: Config, dotted: str, value: object) -> Config:
    """A copy with one setting changed, named like `gate.k`."""
    values = config.to_dict()
    *path, last = dotted.split(".")
    at = values
    for part in path:
        at = at[part]
    if last not in at:
        raise KeyError(f"unknown setting: {dotted}")
    at[last] = value
    return from_dict(values)


def grid(config: Config, axes: dict[str, list]) -> list[Config]:
    """All combinations of the given settings."""
    out = []
    for values in product(*axes.values()):
        one = config
        for name, value in zip(axes, values):
            one = with_setting(one, name, value)
        out.append(one)
    return out
