"""Settings of an analysis, with required keys and per-component overrides (``Component.key`` before ``key``)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Settings:
    values: Mapping[str, str] = field(default_factory=dict)
    component: str = ""

    @classmethod
    def read(cls, path: str, component: str = "") -> Settings:
        """``key = value`` lines; blank lines and lines that start with # are skipped."""
        values = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip()
                if line and line[0] != "#":
                    k, _, v = line.partition("=")
                    values[k.strip()] = v.strip()
        return cls(values, component)

    def of(self, component: str) -> Settings:
        return Settings(self.values, component)

    def get(self, key: str, default: object = None) -> object:
        for k in (f"{self.component}.{key}", key):
            if k in self.values:
                return self.values[k]
        if default is None:
            raise KeyError(f"required setting {key} is missing")
        return default

    def int(self, key: str, default: int | None = None) -> int:
        return int(self.get(key, default))

    def float(self, key: str, default: float | None = None) -> float:
        return float(self.get(key, default))

    def bool(self, key: str, default: bool | None = None) -> bool:
        return str(self.get(key, default)).lower() in ("true", "1", "yes")

    def date(self, key: str, default: str | None = None) -> date:
        return date.fromisoformat(str(self.get(key, default)))

    def ints(self, key: str, default: str | None = None) -> list[int]:
        return [int(x) for x in str(self.get(key, default)).replace(";", ",").split(",") if x.strip()]
