"""Parameters of memory construction and retrieval."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Fixed values are the usual defaults; every operator takes what it needs from here."""

    alpha: float = 0.7
    top_k_per_sub: int = 20
    top_n: int = 5
    top_k_q2c: int = 3
    num_fake_queries: int = 10
    version_threshold: float = 0.80
    version_chain_depth: int = 3
    max_context_tokens: int = 10_000
    fq_confidence_threshold: float = 0.80
    paragraph_top_k: int = 3
    paragraph_min_chars: int = 50
    paragraph_max_chars: int = 500
    linked_kp_top_k: int = 10
    max_parents: int = 3
    max_hits: int = 50
    drop_threshold: float = 0.9
    chunk_tokens: int = 480
    min_context_tokens: int = 1_500
    min_tail_tokens: int = 200

    @classmethod
    def of(cls, values: Mapping[str, object]) -> Config:
        """The usual values, with those given by name in place; texts become numbers. Unknown names are left alone."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in values.items() if k in known and v is not None and v != ""})

    @classmethod
    def scan(cls, path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "MNEMOSPARK_") -> Config:
        """From a file of ``name: value`` or ``NAME=value`` lines, over which the environment's ``prefix`` variables hold."""
        env = os.environ if env is None else env
        return cls.of(read_settings(path) | {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)})


def read_settings(path: str | None) -> dict[str, str]:
    """Names, in small letters, and values of a settings file: ``name: value`` or ``NAME=value`` lines, ``#`` begins a comment, sections are ignored."""
    out: dict[str, str] = {}
    if path is None or not os.path.exists(path):
        return out
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            line = line.split(" #")[0].strip()
            if not line or line.startswith("#"):
                continue
            at = min((i for i in (line.find(":"), line.find("=")) if i > 0), default=-1)
            if at > 0 and line[at + 1 :].strip():
                out[line[:at].strip().removeprefix("export ").lower()] = line[at + 1 :].strip().strip("'\"")
    return out
