"""Tunables of the engine; environment variables named LEAFMILL_<FIELD> override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Suffixes of source files by language, and folders that are not scanned.
CODE_EXTENSIONS = {
    ".py": "python", ".pyi": "python",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
    ".rs": "rust",
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
}
SKIP_DIRS = ("__pycache__", ".git", ".github", "node_modules", ".venv", "venv", "dist", "build", ".pytest_cache", ".mypy_cache", ".ruff_cache", "output", "testing", "tests")
DOMAINS = ("immigration", "trading", "ai")
CONTENT_TYPES = ("text", "code", "image", "mixed")
MONO_FONTS = ("Mono", "Courier", "Consolas", "Menlo", "Code", "Fira")


@dataclass(frozen=True)
class Config:
    max_parent_tokens: int = 1200
    child_tokens: int = 350
    child_overlap: int = 60
    min_para_tokens: int = 40
    min_image_area: int = 4096
    scan_text_max: int = 100
    scan_area_frac: float = 0.5
    top_k_children: int = 30
    top_k_parents: int = 6
    rrf_k: int = 60
    alpha: float = 0.3
    beam: int = 6
    fanout: int = 50
    max_levels: int = 3
    min_nodes: int = 5
    max_clusters: int = 50
    reduced_dim: int = 10
    prob_threshold: float = 0.10
    summary_chars: int = 12000
    dim: int = 64
    seed: int = 42

    @classmethod
    def from_env(cls) -> Config:
        given = {f.name: os.environ.get(f"LEAFMILL_{f.name.upper()}") for f in fields(cls)}
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[f.type](given[f.name]) for f in fields(cls) if given[f.name] is not None})


DEFAULT = Config.from_env()
