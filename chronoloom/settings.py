"""Settings of a graph, from JSON (or YAML, where that can be read) with ${NAME:default} taken from the environment."""

from __future__ import annotations

import json
import os
import pathlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# What a group may be called, and the width of the vectors of models that are known.
GROUP = r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}"
WIDTHS = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768,
    "mxbai-embed-large": 1024, "all-minilm": 384, "bge-m3": 1024, "snowflake-arctic-embed": 1024,
}
LAYOUTS = ("shared", "single", "separate")


# Fixed value: how a setting names a variable, perhaps with what it reads as without one.
VARIABLE = re.compile(r"\$\{(?P<name>[A-Za-z_]\w*)(?::(?P<default>[^}]*))?\}")


def expand(text: str, env: Mapping[str, str]) -> str:
    """A text with its variables from env; one that env lacks is its default, or nothing."""
    plain = VARIABLE.split(text)  # text, name, default, text, ...
    return "".join(x if i % 3 == 0 else env.get(x, plain[i + 1] or "") for i, x in enumerate(plain) if i % 3 < 2)


@dataclass(frozen=True)
class Settings:
    groups: list[str] = field(default_factory=lambda: ["main"])
    layout: str = "shared"
    base: str = "graph"
    attempts: int = 3
    retry_seconds: float = 1.0
    timeout_seconds: float = 30.0
    similarity: float = 0.75
    atomic: bool = True
    require_source: bool = False
    min_score: float = 0.0
    multiplier: int = 3
    model: str = "text-embedding-3-small"
    dimensions: int = 1536

    def __post_init__(self):
        bad = [g for g in self.groups if not re.fullmatch(GROUP, g)]
        known = WIDTHS.get(self.model.split(":", 1)[0].strip())
        for wrong, what in (
            (not self.groups or len(set(self.groups)) < len(self.groups), "groups must be there, and each once"),
            (bool(bad), f"not a group: {bad[:1]}"),
            (self.layout not in LAYOUTS, f"not a layout: {self.layout}"),
            (not 1 <= self.attempts <= 10, "1 to 10 attempts"),
            (not 0 <= self.retry_seconds <= 60 or self.timeout_seconds <= 0, "not a number of seconds"),
            (not 0 < self.similarity <= 1, "a similarity above 0, at most 1"),
            (self.min_score < 0 or not 1 <= self.multiplier <= 10, "a score of 0 or more, and 1 to 10 candidates a result"),
            (self.dimensions < 1 or known not in (None, self.dimensions), f"{self.model} has vectors of {known}, not {self.dimensions}"),
        ):
            if wrong:
                raise ValueError(what)


def load(path: str, env: Mapping[str, str] | None = None) -> Settings:
    text = pathlib.Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    if not isinstance(raw, dict) or set(raw) - {f.name for f in fields(Settings)}:
        raise ValueError(f"{path}: not a mapping of known settings")
    env = os.environ if env is None else env
    fill = lambda v: expand(v, env) if isinstance(v, str) else v  # noqa: E731  settings are texts, numbers, and lists of texts
    return Settings(**{k: [fill(x) for x in v] if isinstance(v, list) else fill(v) for k, v in raw.items()})
