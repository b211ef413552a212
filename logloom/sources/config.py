"""Settings: which families run, custom patterns, quotas and distances. Read from a dict or a JSON file."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    level: str = "WARN"
    category: str = "custom"
    kind: str = "custom"
    action: str = "match"

    def __post_init__(self) -> None:
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise ValueError(f"pattern {self.name!r}: {e}") from e


@dataclass(frozen=True)
class Config:
    #: None: the families that run by default.
    families: tuple[str, ...] | None = None
    patterns: tuple[Pattern, ...] = ()
    deduplicate: bool = True
    #: Lines of one cluster of findings; a length in lines, never in seconds.
    cluster_lines: int = 300
    incident_limit: int = 100
    quota: dict[str, int] = field(default_factory=lambda: {"FATAL": 200, "CRITICAL": 100, "SEVERE": 100, "ERROR": 5})

    @staticmethod
    def from_dict(data: dict) -> Config:
        known = {f.name for f in fields(Config)}
        if unknown := set(data) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        data = dict(data)
        if "patterns" in data:
            data["patterns"] = tuple(p if isinstance(p, Pattern) else Pattern(**p) for p in data["patterns"])
        if data.get("families") is not None:
            data["families"] = tuple(data["families"])
        return Config(**data)

    @staticmethod
    def from_file(path: str) -> Config:
        return Config.from_dict(json.loads(Path(path).read_text()))

    def to_dict(self) -> dict:
        return asdict(self)

    def pattern_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.pattern, p.level, p.category, p.kind, p.action) for p in self.patterns]
        return spark.createDataFrame(rows, "name string, pattern string, level string, category string, kind string, action string")
