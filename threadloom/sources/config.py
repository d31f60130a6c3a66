"""Settings from a TOML file; what it doesn't say keeps its default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Search:
    hook_threshold: float = 0.3
    hook_limit: int = 3
    max_injected_tokens: int = 800
    hook_days: int = 30


@dataclass
class Indexing:
    index_tool_blocks: bool = False
    sweep_orphans: bool = False


@dataclass
class Embeddings:
    enabled: bool = False
    ollama_base_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    keep_alive: str = "30m"
    rerank_pool_size: int = 50
    request_timeout_seconds: float = 10.0
    batch_size: int = 32
    max_input_chars: int = 6000


@dataclass
class Hooks:
    inject_interventions: bool = True
    interventions_path: str = ""


@dataclass
class Config:
    archive_root: str = ""
    database_path: str = ""
    search: Search = field(default_factory=Search)
    indexing: Indexing = field(default_factory=Indexing)
    embeddings: Embeddings = field(default_factory=Embeddings)
    hooks: Hooks = field(default_factory=Hooks)


def load(path: str | Path | None) -> Config:
    """The file's settings; a missing file gives defaults, unknown keys are ignored, a malformed file raises tomllib.TOMLDecodeError."""
    c = Config()
    if path is None or not Path(path).is_file():
        return c
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    c.archive_root = data.get("archive", {}).get("root", c.archive_root)
    c.database_path = data.get("database", {}).get("path", c.database_path)
    for name in ("search", "indexing", "embeddings", "hooks"):
        part = getattr(c, name)
        for f in fields(part):
            setattr(part, f.name, data.get(name, {}).get(f.name, getattr(part, f.name)))
    return c
