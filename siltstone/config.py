"""Layered configuration: defaults, then the first file found, merged key by key."""

from __future__ import annotations

import copy
import os
from pathlib import Path
from typing import Any

import yaml

#: The defaults of a user's configuration.
DEFAULTS: dict[str, Any] = {
    "repo_root": "./",
    "db_dir": ".siltstone/tables",
    "table": "chunks",
    "embedding": {"model": "nomic-embed-text", "dim": 768},
    "ollama": {"host": "http://localhost:11434", "embed_model": "nomic-embed-text", "chat_model": "qwen2.5-coder:14b", "chat_context": 8192},
    "indexing": {
        "include_globs": ["**/*.java", "**/*.xml", "**/*.properties", "**/*.yml", "**/*.yaml", "**/*.gradle", "**/pom.xml"],
        "exclude_globs": ["**/target/**", "**/build/**", "**/.git/**", "**/.idea/**", "**/.gradle/**", "**/node_modules/**", "**/.m2/**", "**/.txt/**"],
        "max_file_mb": 1.5,
        "max_chunk_chars": 2400,
        "min_chunk_chars": 200,
        "include_hidden": True,
        "follow_symlinks": False,
        "encodings": ["utf-8", "utf-8-sig", "cp932", "shift_jis", "cp1252", "latin-1"],
    },
    "retrieval": {"top_k": 12, "max_context_chars": 14000},
}

ENV = "SILTSTONE_CONFIG"
FOLDER = "siltstone"


def merged(base: dict, over: dict) -> dict:
    """A new tree: nested dicts merge, every other value (lists too) is replaced."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def candidates(explicit: str | None = None) -> list[Path]:
    """Explicit path, environment, working folder, its dot folder, the user's config folder; YAML before JSON."""
    named = [Path(p) for p in (explicit, os.environ.get(ENV)) if p]
    places = [Path.cwd(), Path.cwd() / f".{FOLDER}", Path.home() / ".config" / FOLDER]
    return named + [place / f"config.{kind}" for place in places for kind in ("yaml", "json")]


def find_config_path(explicit: str | None = None) -> Path | None:
    return next((p for p in candidates(explicit) if p.is_file()), None)


def load_config(explicit: str | None = None) -> tuple[dict[str, Any], Path | None]:
    """(configuration, file it came from). A missing explicit path falls through to the next place."""
    path = find_config_path(explicit)
    loaded = yaml.safe_load(path.read_text(encoding="utf-8")) if path else None  # YAML reads JSON too
    cfg = merged(copy.deepcopy(DEFAULTS), loaded or {})
    # The embedding model has one value under two names; the embedding section decides.
    cfg["ollama"]["embed_model"] = cfg["embedding"]["model"]
    return cfg, path
