"""Engine settings: one frozen object, read from a JSON file, ``CONDENSA_*`` variables or the session's settings.

A file may be flat or nested in sections; keys that nothing here reads are named
in a warning, so that none is ignored unseen.
"""

from __future__ import annotations

import dataclasses
import json
import os
import warnings

from pyspark.sql import SparkSession


#: fixed values: keys of a nested file, by section, with the setting each one is
SECTIONS = {
    "compression": {"default_level": "level", "preserve_code": "preserve_code", "preserve_urls": "preserve_urls", "preserve_numbers": "preserve_numbers", "semantic_threshold": "semantic_threshold"},
    "vector": {"similarity_threshold": "similarity_threshold", "max_results": "max_results"},
    "learning": {"min_pattern_frequency": "min_frequency"},
}


def flattened(values: dict) -> dict:
    """Settings by their own names from a flat or nested file."""
    out = {}
    for key, value in values.items():
        if not isinstance(value, dict):
            out[key] = value
            continue
        for name, v in value.items():
            out[SECTIONS.get(key, {}).get(name, f"{key}.{name}")] = v
    return out


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    level: str = "balanced"
    domain: str | None = None
    language: str = "en"
    preserve_code: bool = True
    preserve_urls: bool = True
    preserve_numbers: bool = True
    target_compression: float = 0.6
    requires_high_quality: bool = False
    semantic_threshold: float = 0.90
    similarity_threshold: float = 0.8
    max_chars: int = 100_000
    price_per_1k_tokens: float = 0.03
    max_results: int = 10
    min_frequency: int = 3

    def __post_init__(self):
        if self.level not in ("none", "light", "balanced", "aggressive"):
            raise ValueError(f"unknown level: {self.level}")
        if not 0 <= self.target_compression <= 1:
            raise ValueError("target_compression is a share")

    @classmethod
    def load(cls, spark: SparkSession | None = None, path: str | None = None, prefix: str = "CONDENSA_") -> EngineConfig:
        """File first, then environment, then ``spark.condensa.*``; later ones win."""
        values: dict = {}
        if path:
            with open(path, encoding="utf-8") as f:
                values = flattened(json.load(f))
        for f in dataclasses.fields(cls):
            if (v := os.environ.get(prefix + f.name.upper())) is not None:
                values[f.name] = v
            if spark is not None and (v := spark.conf.get(f"spark.condensa.{f.name}", None)) is not None:
                values[f.name] = v
        kinds = {f.name: type(f.default) if f.default is not None else str for f in dataclasses.fields(cls)}
        if unknown := sorted(set(values) - set(kinds)):
            warnings.warn(f"settings that nothing reads: {', '.join(unknown)}", stacklevel=2)
        typed = {k: (str(v).lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v)) if v is not None else None for k, v in values.items() if k in kinds}
        return cls(**typed)
