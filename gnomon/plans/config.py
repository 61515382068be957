"""Model configurations: read from YAML, checked, and identified by a hash of their content."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

KINDS = ("SINGLE_ASSET", "CPO")


@dataclass(frozen=True)
class ModelConfig:
    name: str
    kind: str = "SINGLE_ASSET"
    version: str = "1"
    signal: dict = field(default_factory=dict)
    sizing: dict = field(default_factory=lambda: {"name": "fixed_fraction", "params": {"fraction": 1.0}})
    backtest: dict = field(default_factory=dict)
    source: str = ""
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name:
            raise ValueError("a model needs a name")
        if self.kind not in KINDS:
            raise ValueError(f"no model kind {self.kind}")
        for part in ("signal", "sizing"):
            value = getattr(self, part)
            if not isinstance(value, dict) or "name" not in value:
                raise ValueError(f"{part} needs a name")

    @classmethod
    def from_dict(cls, raw: dict) -> ModelConfig:
        known = set(cls.__dataclass_fields__)
        if extra := set(raw) - known:
            raise ValueError(f"unknown: {', '.join(sorted(extra))}")
        return cls(**raw)

    @classmethod
    def from_yaml(cls, path: str) -> ModelConfig:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f))

    def content_hash(self) -> str:
        """SHA-256 of the sorted content, without source and metadata."""
        content = {k: getattr(self, k) for k in sorted(self.__dataclass_fields__) if k not in ("source", "metadata")}
        return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()
