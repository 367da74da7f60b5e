"""Settings: a TOML file, and what the command line gives above it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

FILE_NAME = "strataloom.toml"


@dataclass
class Config:
    store: str = "strataloom-store"
    threshold: float = 0.5
    top: int = 500
    samples: int = 5
    bucket: str = "auto"
    dedup_threshold: float = 0.95
    window: int = 60
    min_count: int = 10
    min_shared: int = 3
    max_anomaly_score: float | None = None
    max_new_patterns: int | None = None
    needles: list[str] = field(default_factory=list)
    #: url, project, label, kind and issue_type of the ticket system; see ``TicketConfig``.
    tickets: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("threshold", "dedup_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")


def places(cwd: Path) -> list[Path]:
    return [d / FILE_NAME for d in (cwd, *cwd.parents)] + [Path.home() / ".config" / "strataloom" / FILE_NAME]


def load(cwd: str | Path = ".", **given) -> Config:
    """The first file that can be parsed, from ``cwd`` upwards, then the home folder; values given (not None) win."""
    names = {f.name for f in fields(Config)}
    found: dict = {}
    for path in places(Path(cwd).resolve()):
        try:
            found = tomllib.loads(path.read_text())
            break
        except (OSError, tomllib.TOMLDecodeError):
            continue
    values = {k: v for k, v in found.items() if k in names} | {k: v for k, v in given.items() if v is not None}
    return Config(**values)
