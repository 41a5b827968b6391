"""Settings from the environment, or else from a .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def read_env(path: Path) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are skipped, quotes around values dropped."""
    out = {}
    if path.exists():
        for line in path.read_text(encoding="utf-8").splitlines():
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out


@dataclass(frozen=True)
class Config:
    store: str
    raw: str

    @staticmethod
    def load(root: str = ".", environment: dict[str, str] | None = None) -> Config:
        """Paths are relative to ``root``; the environment goes before the file."""
        found = read_env(Path(root, ".env")) | dict(os.environ if environment is None else environment)
        at = lambda name, default: str(Path(root, found.get(name, default)))
        return Config(at("EFFECTQL_STORE", "data/store"), at("EFFECTQL_RAW", "data/raw"))
