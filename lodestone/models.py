"""Interfaces of the models that stay outside the engine, with deterministic stand-ins and registries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from lodestone.session import ship


class ServiceError(RuntimeError):
    """A service that didn't answer, or not with what was asked for."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Judge(Protocol):
    def score(self, metric: str, question: str, answer: str, contexts: list[str]) -> float | None: ...


class HashEmbedder:
    """Unit vectors from token digests: equal texts, equal vectors. A stand-in, not a language model."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for token in (text or "").lower().split():
                d = hashlib.sha256(token.encode()).digest()
                v[int.from_bytes(d[:4], "big") % self.size] += 1.0 if d[4] & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class FirstLineModel:
    """Replies with the prompt's last non-empty line. A stand-in."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((x for x in reversed((p or "").splitlines()) if x.strip()), "") for p in prompts]


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder}
LANGUAGE_MODELS: dict[str, Callable[[], LanguageModel]] = {"first-line": FirstLineModel}


def _made(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]()


def embedder(name: str) -> Embedder:
    return _made(EMBEDDERS, name)


def language_model(name: str) -> LanguageModel:
    return _made(LANGUAGE_MODELS, name)


def _each_batch(df: DataFrame, text_col: str, fields: list[T.StructField], work: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """df with columns that a model makes of its texts. Batches stay in Arrow: only the texts become Python objects."""
    ship(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for rb in batches:
            at = rb.schema.names
            yield pa.record_batch([*(rb.column(at.index(f.name)) for f in kept), *made(rb.column(at.index(text_col)).to_pylist())], [*(f.name for f in kept), *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def with_embeddings(df: DataFrame, make: Callable[[], Embedder], text_col: str = "text", out: str = "embedding", retries: int = 3, wait: float = 1.0) -> DataFrame:
    """df with a vector per text, one model per Python worker, batch by batch; a batch is tried again after a pause before it fails.

    A service's own error isn't tried again here: its client has done so.
    """

    def work() -> Callable[[list], list[pa.Array]]:
        model = make()

        def embed(texts: list) -> list[pa.Array]:
            for attempt in range(retries):
                try:
                    return [pa.array(model.embed(texts), pa.list_(pa.float32()))]
                except Exception as e:
                    if attempt + 1 == retries or isinstance(e, ServiceError):
                        raise
                    time.sleep(wait)
            raise ValueError("retries must be 1 at least")

        return embed

    return _each_batch(df, text_col, [T.StructField(out, T.ArrayType(T.FloatType()))], work)


def with_replies(df: DataFrame, make: Callable[[], LanguageModel], prompt_col: str = "prompt", out: str = "reply", error: str | None = None, seconds: str | None = None, attempts: int = 1, wait: float = 0.0) -> DataFrame:
    """df with a model's reply per prompt.

    error: name of a column for what a prompt's reply failed with, whose reply is then null; all other prompts keep their replies. If a
    batch fails its prompts are asked one by one, `attempts` times each. Without a name the first failure ends the job.
    seconds: name of a column for the time a reply took, shared evenly within a batch. A null prompt isn't asked.
    """
    fields = [T.StructField(out, T.StringType()), *[T.StructField(c, t) for c, t in ((error, T.StringType()), (seconds, T.DoubleType())) if c]]

    def work() -> Callable[[list], list[pa.Array]]:
        model = make()

        def one(prompt: str) -> tuple[str | None, str | None]:
            for attempt in range(attempts):
                try:
                    return model.complete([prompt])[0], None
                except Exception as e:
                    if attempt + 1 == attempts:
                        return None, str(e) or type(e).__name__
                    time.sleep(wait)
            return None, "not asked"

        def complete(prompts: list) -> list[pa.Array]:
            began = time.monotonic()
            at = [i for i, p in enumerate(prompts) if p is not None]
            replies, errors, spent = [None] * len(prompts), [None] * len(prompts), [0.0] * len(prompts)
            try:
                for i, reply in zip(at, model.complete([prompts[i] for i in at]) if at else [], strict=True):
                    replies[i], spent[i] = reply, (time.monotonic() - began) / len(at)
            except Exception:
                if not error:
                    raise
                for i in at:
                    began = time.monotonic()
                    replies[i], errors[i] = one(prompts[i])
                    spent[i] = time.monotonic() - began
            return [pa.array(replies, pa.string()), *([pa.array(errors, pa.string())] if error else []), *([pa.array(spent, pa.float64())] if seconds else [])]

        return complete

    return _each_batch(df, prompt_col, fields, work)
