"""Configuration: environment over a .env file over a JSON file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Config:
    """Every setting with its default; the environment name is STRATALOOM_ and the field in capitals."""

    embedding_provider: str = "none"
    embedding_dim: int = 64
    max_file_bytes: int = 1 << 20
    history_months: int = 24
    history_commits: int = 20_000
    module_depth: int = 2
    metrics_window_days: int = 90
    ownership_half_life_days: float = 180.0
    cochange_max_files: int = 50
    cochange_min_pair: int = 2
    cluster_threshold: float = 0.82
    candidate_floor: float = 0.4
    price_per_million_tokens: float = 0.12


def _dotenv(path: Path) -> dict[str, str]:
    if not path.exists():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load(folder: str = ".", env: dict[str, str] | None = None) -> Config:
    env = dict(os.environ if env is None else env)
    file = Path(folder, "strataloom.json")
    data = json.loads(file.read_text()) if file.exists() else {}
    dotenv = _dotenv(Path(folder, ".env"))
    out = {}
    for f in fields(Config):
        name = "STRATALOOM_" + f.name.upper()
        value = env.get(name, dotenv.get(name, data.get(f.name, f.default)))
        out[f.name] = type(f.default)(value)
    return Config(**out)
