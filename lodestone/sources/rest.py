"""Embedding and chat services over HTTP, for models.with_embeddings and with_replies: one client per Python worker."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterable, Iterator

from lodestone.conf import Config
from lodestone.models import ServiceError


def _post(url: str, body: dict, secret: str | None, timeout: float):
    """An open response. The key is read from the environment of the worker, never shipped."""
    headers = {"Content-Type": "application/json"}
    key = Config.secret(secret) if secret else None
    if key:
        headers["Authorization"] = f"Bearer {key}"
    try:
        return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout)
    except OSError as e:
        raise ServiceError(f"{url}: {e}") from e


def _json(url: str, body: dict, secret: str | None, timeout: float, field: str) -> list:
    with _post(url, body, secret, timeout) as r:
        try:
            found = json.loads(r.read()).get(field)
        except (ValueError, AttributeError) as e:
            raise ServiceError(f"{url}: not a JSON object") from e
    if not found or not isinstance(found, list):
        raise ServiceError(f"{url}: no {field}")
    return found


def with_retries(call, attempts: int = 3, wait: float = 1.0):
    """call() again after a pause while it fails, `attempts` times at most."""
    for attempt in range(attempts):
        try:
            return call()
        except ServiceError:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait)


class RestEmbedder:
    """Vectors from `url`/embeddings, batch by batch, in the order of the `index` that the service gives each."""

    def __init__(self, url: str, model: str, secret: str | None = None, batch: int = 128, timeout: float = 30, attempts: int = 3, wait: float = 1.0):
        self.url, self.model, self.secret, self.batch, self.timeout, self.attempts, self.wait = url.rstrip("/"), model, secret, batch, timeout, attempts, wait

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = [t or "" for t in texts[i : i + self.batch]]
            data = with_retries(lambda: _json(f"{self.url}/embeddings", {"input": part, "model": self.model}, self.secret, self.timeout, "data"), self.attempts, self.wait)
            try:
                vectors = [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
            except (KeyError, TypeError) as e:
                raise ServiceError(f"{self.url}: vectors without their places") from e
            if len(vectors) != len(part):
                raise ServiceError(f"{self.url}: {len(vectors)} vectors for {len(part)} texts")
            out.extend(vectors)
        return out


def events(lines: Iterable[bytes]) -> Iterator[str]:
    """Data of server-sent events: fields up to a blank line, several data fields joined by line feeds; comments and other fields are left out."""
    data: list[str] = []
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
        if name == "data":
            data.append(value.removeprefix(" "))
        elif not name and not colon and data:
            yield "\n".join(data)
            data = []
    if data:
        yield "\n".join(data)


def deltas(lines: Iterable[bytes]) -> Iterator[str]:
    """Pieces of a streamed reply, up to [DONE]; events that hold no JSON or no piece are left out."""
    for data in events(lines):
        if data.strip() == "[DONE]":
            return
        try:
            piece = json.loads(data)["choices"][0]["delta"]["content"]
        except (ValueError, LookupError, TypeError):
            continue
        if piece is not None:
            yield piece


class RestChat:
    """Replies from a chat service; images go along as data URIs. streamed: read the reply piece by piece."""

    def __init__(self, url: str, model: str, secret: str | None = None, path: str = "/chat/completions", streamed: bool = False, timeout: float = 180, attempts: int = 1, wait: float = 1.0, **parameters):
        self.url, self.model, self.secret, self.streamed, self.timeout, self.attempts, self.wait, self.parameters = url.rstrip("/") + path, model, secret, streamed, timeout, attempts, wait, parameters

    def _body(self, prompt: str, images: list[str]) -> dict:
        content: str | list = prompt
        if images:
            content = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": x}} for x in images)]
        return {"model": self.model, "messages": [{"role": "user", "content": content}], "stream": self.streamed, **{k: v for k, v in self.parameters.items() if v is not None}}

    def stream(self, prompt: str, images: list[str] | None = None) -> Iterator[str]:
        with _post(self.url, self._body(prompt, images or []) | {"stream": True}, self.secret, self.timeout) as r:
            yield from deltas(r)

    def reply(self, prompt: str, images: list[str] | None = None) -> str:
        if self.streamed:
            return with_retries(lambda: "".join(self.stream(prompt, images)), self.attempts, self.wait)
        choices = with_retries(lambda: _json(self.url, self._body(prompt, images or []), self.secret, self.timeout, "choices"), self.attempts, self.wait)
        return choices[0]["message"]["content"]

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.reply(p or "") for p in prompts]
