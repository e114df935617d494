"""Settings of the engine, from a JSON or YAML file; secrets come from the environment only."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    reranker: str = "rule"
    similarity_threshold: float = 0.1
    filter_kind: str = "text"
    max_images: int = 3
    image_base: str = "/data/images"
    metric: str = "cosine"

    @staticmethod
    def secret(name: str) -> str | None:
        return os.environ.get(name)

    @classmethod
    def load(cls, path: str) -> Config:
        """The settings that the file names, the defaults for the others; an unknown name is an error."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("YAML settings need the yaml package; JSON ones don't") from e
                found = yaml.safe_load(f) or {}
            else:
                found = json.load(f)
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(found) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**found)


def logger(name: str, file: str | None = None) -> logging.Logger:
    """A driver-side logger at $LODESTONE_LOG (INFO): to the console, and to a file if one is named; set up once per name."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(os.environ.get("LODESTONE_LOG", "INFO"))
        for handler in [logging.StreamHandler(), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(handler)
        log.propagate = False
    return log
