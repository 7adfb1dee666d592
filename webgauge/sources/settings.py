"""Settings that change results, from the environment, with hard ranges."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Least and most of each setting.
RANGES = {
    "max_pages": (1, 5000),
    "max_depth": (0, 10),
    "max_response_bytes": (1024, None),
    "wall_clock_seconds": (10, None),
    "min_delay": (0, None),
    "max_concurrency": (1, 8),
    "request_timeout": (0, None),
    "max_cost_usd": (0, None),
    "ai_concurrency": (1, 20),
}


@dataclass(frozen=True)
class Settings:
    max_pages: int = 500
    max_depth: int = 5
    max_response_bytes: int = 5 << 20
    wall_clock_seconds: float = 1800.0
    min_delay: float = 0.5
    max_concurrency: int = 2
    request_timeout: float = 15.0
    max_cost_usd: float = 1.0
    ai_concurrency: int = 5
    model: str = "gpt-4o-2024-08-06"
    allowed_domains: tuple[str, ...] = ()

    def __post_init__(self):
        for name, (least, most) in RANGES.items():
            value = getattr(self, name)
            if value < least or (most is not None and value > most):
                raise ValueError(f"{name} is {value}; it goes from {least} to {'any' if most is None else most}")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ, prefix: str = "WEBGAUGE_") -> Settings:
        given = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                given[f.name] = tuple(x.strip().lower() for x in text.split(",") if x.strip()) if kind is tuple else kind(text)
        return cls(**given)

    def caps(self, max_pages: int | None = None, max_depth: int | None = None) -> tuple[int, int]:
        """Flags only lower the caps; 0 pages means the default, depth 0 is kept."""
        return min(max_pages or self.max_pages, self.max_pages), min(self.max_depth if max_depth is None else max_depth, self.max_depth)
