"""Settings of a split run: a YAML mapping in which every key must be known, and overrides on top."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    rule: str = "current_rule"
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    tolerance: float = 0.05
    area_epsilon_m2: float = 1.0
    tile_size_m: float = 1000.0
    per_city: bool = False

    def __post_init__(self) -> None:
        if abs(self.train + self.val + self.test - 1) > 1e-9 or min(self.train, self.val, self.test) <= 0:
            raise ValueError("ratios must be positive and add up to 1")

    @property
    def ratios(self) -> tuple[float, float, float]:
        return self.train, self.val, self.test


def settings(given: dict | None = None, **overrides: object) -> Settings:
    whole = {**(given or {}), **{k: v for k, v in overrides.items() if v is not None}}
    unknown = set(whole) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(map(str, unknown)))}")
    return Settings(**whole)


def load(path: str, **overrides: object) -> Settings:
    import yaml

    with open(path) as f:
        return settings(yaml.safe_load(f), **overrides)
