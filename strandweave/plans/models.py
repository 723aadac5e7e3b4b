"""Language and embedding models as pluggable clients that run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.numbers import completion_budget, completion_room


class ModelClient(Protocol):
    """``complete`` answers one prompt; ``ping`` tells whether the model can be reached."""

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float, seed: int = 0) -> str: ...

    def ping(self, model: str) -> bool: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class CallError(RuntimeError):
    """A call that failed for good; ``status`` is that of the answer, 0 if there was none."""

    def __init__(self, message: str, status: int = 0):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class StubClient:
    """A deterministic stand-in: labels and texts follow from the MD5 digest of model, system, prompt and seed.

    Of 256 calls, ``failing`` raise (by two digits of the digest), so that errors can be tested too.
    """

    labels: tuple[str, ...] = ("post", "reply", "repost", "like", "not interested")
    failing: int = 0

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float, seed: int = 0) -> str:
        h = hashlib.md5(f"{model}|{seed}|{system}|{prompt}".encode(), usedforsecurity=False).hexdigest()
        if int(h[30:], 16) < self.failing:
            raise CallError("stand-in failure", 500)
        if "exactly one action label" in prompt:
            return self.labels[(ord(h[0]) * 31 + ord(h[1])) % len(self.labels)]
        return f"{h[:9]} {h[9:18]}"

    def ping(self, model: str) -> bool:
        return True


@dataclass(frozen=True)
class HttpClient:
    """Chat completions over HTTP.

    A context-limit answer shrinks the completion to what is left and asks again; an answer of
    500 or above, or none, is asked again after a growing pause; any other 4xx ends the call.
    """

    bases: tuple[str, ...]
    api_key: str | None = field(default=None, repr=False)
    timeout_s: float = 60.0
    attempts: int = 3
    pause_s: float = 1.0

    def __post_init__(self):
        if not self.bases:
            raise ValueError("a model needs at least one endpoint")

    def base(self, attempt: int = 0) -> str:
        """Endpoints in turn, by partition, the next one at every further attempt."""
        ctx = TaskContext.get()
        return self.bases[((ctx.partitionId() if ctx else 0) + attempt) % len(self.bases)]

    def _post(self, base: str, body: dict) -> str:
        lead = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        req = urllib.request.Request(f"{base}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", **lead})
        try:
            with urllib.request.urlopen(req, timeout=self.timeout_s) as r:  # noqa: S310
                return (json.load(r)["choices"][0]["message"]["content"] or "").strip()
        except urllib.error.HTTPError as e:
            raise CallError(e.read().decode(errors="replace"), e.code) from e
        except OSError as e:
            raise CallError(f"{type(e).__name__}: {e}") from e

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float, seed: int = 0) -> str:
        body = {"model": model, "max_tokens": max_tokens, "temperature": temperature or 0.01, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        if seed:
            body["seed"] = seed
        failed = CallError("no attempt was made")
        for attempt in range(self.attempts):
            try:
                return self._post(self.base(attempt), body)
            except CallError as e:
                failed = e
                room = completion_room(str(e))
                if room is not None:
                    body["max_tokens"] = room
                elif 400 <= e.status < 500:
                    break
                elif attempt + 1 < self.attempts:
                    time.sleep(self.pause_s * 2**attempt)
        raise failed

    def ping(self, model: str) -> bool:
        """Whether every endpoint answers."""
        try:
            for b in self.bases:
                with urllib.request.urlopen(f"{b}/models", timeout=5) as r:  # noqa: S310
                    if r.status != 200:
                        return False
        except OSError:
            return False
        return True


@dataclass(frozen=True)
class LocalClient:
    """A text-generation model loaded by path once per worker (needs the optional ``transformers``)."""

    path: str

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float, seed: int = 0) -> str:
        generate = _loaded("text-generation", self.path)
        told = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        options = {"do_sample": True, "temperature": temperature} if temperature else {"do_sample": False}
        return generate(told, max_new_tokens=max_tokens, return_full_text=False, **options)[0]["generated_text"].strip()

    def ping(self, model: str) -> bool:
        return os.path.isdir(self.path) and importlib.util.find_spec("transformers") is not None


@lru_cache(maxsize=4)
def _loaded(task: str, path: str):
    from transformers import pipeline

    return pipeline(task, model=path)


def endpoints(primary: str, others: str = "") -> tuple[str, ...]:
    """Endpoint bases with ``/v1``, each once, the primary first."""
    bases = []
    for u in [primary, *others.split(",")]:
        u = u.strip().rstrip("/")
        if u:
            bases.append(u if u.endswith("/v1") else f"{u}/v1")
    return tuple(dict.fromkeys(bases))


@dataclass(frozen=True)
class StubEmbedder:
    """Unit vectors of how often some characters occur in a text (one more than that)."""

    counted: str = "aeinort0"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.array([[t.count(c) + 1 for c in self.counted] for t in texts], np.float64).reshape(len(texts), len(self.counted))
        return out / np.sqrt((out * out).sum(1, keepdims=True))


@dataclass(frozen=True)
class EncoderEmbedder:
    """Mean-pooled token vectors of an encoder loaded by path once per worker (needs the optional ``transformers``)."""

    path: str

    def embed(self, texts: list[str]) -> np.ndarray:
        encode = _loaded("feature-extraction", self.path)
        tokens = [np.asarray(encode(t)[0]) for t in texts]
        long = max(map(len, tokens))
        stack = np.stack([np.pad(t, ((0, long - len(t)), (0, 0))) for t in tokens])
        return mean_pool(stack, np.array([[i < len(t) for i in range(long)] for t in tokens], int))


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of texts: the mean of the vectors of their real tokens. ``tokens`` is (texts, places, size)."""
    m = mask[..., None].astype(tokens.dtype)
    mean = (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Models:
    """Clients by provider, and the names of the models."""

    base: ModelClient = StubClient()
    commercial: ModelClient = StubClient()
    action: ModelClient = StubClient()
    embedder: Embedder = StubEmbedder()
    persona_model: str = "persona"
    commercial_model: str = "commercial"
    action_model: str = "action"

    def preflight(self) -> dict[str, bool]:
        return {m: c.ping(m) for c, m in ((self.base, self.persona_model), (self.commercial, self.commercial_model), (self.action, self.action_model))}


def ask(
    df: DataFrame, prompt: str, out: str, client: ModelClient, model: str | Column, *, system: str | Column = "", max_tokens: int = 512, temperature: float = 0.0,
    seed: Column | None = None, context: int = C.CONTEXT_TOKENS, at_a_time: int = 16, tasks: int | None = None,
) -> DataFrame:
    """``df`` with ``out``, the model's answer to ``prompt`` (null prompts are not asked), and ``{out}_error``.

    Model and system text may be columns: which model answers is a value of the row. A
    completion gets what the prompt leaves of ``context`` tokens, ``max_tokens`` at most. Up to
    ``at_a_time`` calls of a task are under way at once. An error is kept in the row and does
    not end the job.
    """
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    told = as_column(system)
    wanted = completion_budget(F.length(told) + F.length(F.col(prompt)), F.lit(max_tokens), context)
    call = F.struct(F.col(prompt).alias("prompt"), as_column(model).alias("model"), told.alias("system"), wanted.alias("tokens"), (F.lit(0) if seed is None else seed).cast("int").alias("seed"))
    if tasks:
        df = df.repartition(tasks)

    def one(r: dict) -> tuple[str | None, str | None]:
        try:
            more = {"seed": r["seed"]} if r["seed"] else {}
            return client.complete(r["model"], r["system"], r["prompt"], r["tokens"], temperature, **more), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_a_time) as pool:
            for calls in batches:
                rows = calls.to_dict("records")
                asked = [i for i, r in enumerate(rows) if isinstance(r["prompt"], str)]
                got: list[tuple] = [(None, None)] * len(rows)
                for i, g in zip(asked, pool.map(one, [rows[i] for i in asked]), strict=True):
                    got[i] = g
                yield pd.DataFrame(got, columns=["answer", "error"], dtype=object)

    answers = F.pandas_udf(run, "answer string, error string")
    # the answer is taken apart from one column, made once for each row
    answers = answers.asNondeterministic() if hasattr(answers, "asNondeterministic") else answers
    both = df.withColumn("_call", call).withColumn("_got", answers(F.col("_call")))
    return both.withColumns({out: F.col("_got.answer"), f"{out}_error": F.col("_got.error")}).drop("_call", "_got")


def similarity(embedder: Embedder):
    """A column function (a, b) -> cosine of two texts; null where either is empty."""

    @F.pandas_udf("double")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            a, b = a.fillna(""), b.fillna("")
            texts = pd.unique(pd.concat([a, b]))
            vec = dict(zip(texts, embedder.embed(list(texts)), strict=True))
            yield pd.Series([float(vec[x] @ vec[y]) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return lambda a, b: both(a, b)
