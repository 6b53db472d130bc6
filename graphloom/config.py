"""Settings of a run, read from a dictionary or a YAML file where a YAML library is present."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class ModelSettings:
    name: str = "none"
    batch_size: int = 8
    max_length: int = 512


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = 1000
    overlap: int = 200


@dataclass(frozen=True)
class Settings:
    model: ModelSettings = field(default_factory=ModelSettings)
    processing: ChunkSettings = field(default_factory=ChunkSettings)
    logging: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Known keys of a nested dictionary; others are ignored."""

        def pick(kind: type, given: dict[str, Any] | None) -> Any:
            names = {f.name for f in fields(kind)}
            return kind(**{k: v for k, v in (given or {}).items() if k in names})

        return cls(pick(ModelSettings, values.get("model")), pick(ChunkSettings, values.get("processing")), dict(values.get("logging") or {}))

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML settings needs a YAML library") from e
        with open(path) as f:
            return cls.of(yaml.safe_load(f) or {})
