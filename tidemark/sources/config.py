"""Configuration: defaults, then a strict file, then ``TIDEMARK_*`` variables; every problem is reported at once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "TIDEMARK_"


@dataclass
class Config:
    roots: tuple[str, ...] = ()
    debounce_ms: int = 1000
    commit_ops: int = 1000
    commit_ms: int = 3000
    batch_images: int = 32
    batch_ms: int = 100
    retry_ratio: float = 0.2
    retry_base_ms: int = 5000
    retry_cap_ms: int = 1_800_000
    max_attempts: int = 8
    top_k: int = 20
    top_k_limit: int = 1000
    dead_letter_days: int = 90
    breaker_failures: int = 5
    breaker_open_ms: int = 30_000
    tombstone_ratio: float = 0.2

    def problems(self) -> list[str]:
        out = [f"{f.name} must be positive" for f in fields(self) if f.name != "roots" and getattr(self, f.name) <= 0]
        out += [f"{n} must be below 1" for n in ("retry_ratio", "tombstone_ratio") if getattr(self, n) >= 1]
        if self.top_k > self.top_k_limit:
            out.append("top_k is above top_k_limit")
        if self.retry_base_ms > self.retry_cap_ms:
            out.append("retry_base_ms is above retry_cap_ms")
        clean = [os.path.normpath(r) for r in self.roots]
        out += [f"root {a} lies in {b}" for a in clean for b in clean if a != b and a.startswith(b.rstrip("/") + "/")]
        return out


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The configuration. The file is JSON; unknown keys and unknown variables are problems."""
    known = {f.name: f for f in fields(Config)}
    values: dict = {}
    problems: list[str] = []
    if path:
        for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items():
            if k in known:
                values[k] = v
            else:
                problems.append(f"unknown key {k}")
    for name, raw in (os.environ if env is None else env).items():
        if not name.startswith(PREFIX):
            continue
        key = name.removeprefix(PREFIX).lower()
        if key not in known:
            problems.append(f"unknown variable {name}")
            continue
        default = known[key].default
        try:
            values[key] = tuple(raw.split(os.pathsep)) if key == "roots" else type(default)(raw)
        except ValueError:
            problems.append(f"{name} is not a {type(default).__name__}")
    if "roots" in values:
        values["roots"] = tuple(values["roots"])
    config = Config(**values)
    if problems := problems + config.problems():
        raise ValueError("; ".join(problems))
    return config
