"""Embedding jobs through a pluggable client."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, BATCH, AUTO_LIMIT = 6000, 32, 100


class Embedder(Protocol):
    """Anything with these; a service's client is made once a task by its factory."""

    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors of hashed words; for tests and machines without a service."""

    def __init__(self, dim: int = 64, max_chars: int = MAX_CHARS):
        self.dim, self.max_chars = dim, max_chars

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in text[: self.max_chars].lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
            row[0] += 1e-3
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


def checked(vectors, n: int) -> np.ndarray:
    """The service's answer as (n, dim) finite vectors with a length; ValueError otherwise."""
    x = np.asarray(vectors, dtype=np.float32)
    if x.ndim != 2 or len(x) != n:
        raise ValueError(f"{n} texts, but vectors of shape {x.shape}")
    if not np.isfinite(x).all():
        raise ValueError("a vector isn't finite")
    if (np.linalg.norm(x, axis=1) == 0).any():
        raise ValueError("a vector of zeros")
    return x


def probe(embedder: Embedder) -> tuple[bool, str]:
    try:
        return True, f"{checked([embedder.embed('probe')], 1).shape[1]} components"
    except Exception as e:  # whatever the client raises is the answer
        return False, str(e)


class EmbeddingError(RuntimeError):
    """The service couldn't be reached, refused, or gave vectors that can't be used."""


@dataclass
class Probe:
    """How far a service's answers go: it is there, it knows the model, it embeds."""

    reachable: bool = False
    version: str | None = None
    model_present: bool = False
    embed_ok: bool = False
    dim: int | None = None
    error: str | None = None


@dataclass(frozen=True)
class HttpEmbedder:
    """Client of a service with /api/embed, /api/tags and /api/version, JSON over HTTP. It has no open connection, so a factory can be `lambda: client`.

    Texts longer than max_chars are cut before they are sent, so that one of them can't fail its batch; answers go through
    checked(). Whatever goes wrong is an EmbeddingError with the beginning of the service's own words.
    """

    base_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    timeout: float = 10.0
    max_chars: int | None = MAX_CHARS
    keep_alive: str | None = None

    def _ask(self, what: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/api/{what}", None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                value = json.load(answer)
        except urllib.error.HTTPError as e:
            raise EmbeddingError(f"{e.code} from /api/{what}: {e.read(500).decode('utf-8', 'replace') or e.reason}") from e
        except (OSError, ValueError) as e:
            raise EmbeddingError(f"/api/{what}: {e}") from e
        if not isinstance(value, dict):
            raise EmbeddingError(f"/api/{what}: not an object")
        return value

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body = {"model": self.model, "input": [t[: self.max_chars] for t in texts]} | ({"keep_alive": self.keep_alive} if self.keep_alive else {})
        try:
            return checked(self._ask("embed", body).get("embeddings"), len(texts)).tolist()
        except (TypeError, ValueError) as e:
            raise EmbeddingError(f"/api/embed: {e}") from e

    def probe(self) -> Probe:
        """Step by step until one fails; never raises."""
        got = Probe()
        try:
            got.version = self._ask("version").get("version")
            got.reachable = True
            names = [m.get("name") for m in self._ask("tags").get("models") or [] if isinstance(m, dict)]
            got.model_present = self.model.split(":")[0] in {n.split(":")[0] for n in names if isinstance(n, str)}
            if not got.model_present:
                raise EmbeddingError(f"the service has no model {self.model!r}")
            got.dim = len(self.embed("probe"))
            got.embed_ok = True
        except EmbeddingError as e:
            got.error = str(e)
        return got


def embed_backlog(messages: DataFrame, vectors: DataFrame, factory, model: str, now: str, batch: int = BATCH) -> DataFrame:
    """(msg_id, vector, model, dim, embedded_at, error) for each message without a vector. A batch that fails is tried one by one, so that only the offending messages come without a vector, with the error."""
    todo = messages.select("msg_id", "content").join(vectors.select("msg_id"), "msg_id", "left_anti")

    def run(frames):
        client = factory()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t or "" for t in part.content]
                try:
                    got = [(v, None) for v in checked(client.embed_batch(texts), len(texts))]
                except Exception:  # one bad text fails a whole batch
                    got = []
                    for t in texts:
                        try:
                            got.append((checked(client.embed_batch([t]), 1)[0], None))
                        except Exception as e:
                            got.append((None, str(e) or type(e).__name__))
                yield pd.DataFrame({"msg_id": part.msg_id.to_numpy(), "vector": [v for v, _ in got], "model": model, "dim": pd.array([None if v is None else len(v) for v, _ in got], "Int32"), "embedded_at": now, "error": [e for _, e in got]})

    return todo.mapInPandas(run, "msg_id long, vector array<float>, model string, dim int, embedded_at string, error string")


def embed_counts(result: DataFrame) -> DataFrame:
    return result.agg(F.count("vector").alias("embedded"), F.count("error").alias("dropped"))


def should_auto_embed(new_messages: int, enabled: bool, reachable: bool) -> bool:
    return enabled and reachable and 0 < new_messages <= AUTO_LIMIT
