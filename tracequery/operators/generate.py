"""Generation as a row source: a pluggable backend, called in the executors."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..policies import USER_PREFIX
from ..schemas import GENERATION


class Backend(Protocol):
    """Turns messages into a text. One is made per task; ``metadata`` describes the model."""

    def generate(self, messages: list[dict], seed: int) -> dict: ...

    def metadata(self) -> dict: ...


@dataclass
class StubBackend:
    """Deterministic answers for tests: what ``reply`` makes of the user's text and the seed."""

    reply: Callable[[str, int], str] = lambda text, seed: f"<reasoning>\nStep 1: {seed}\n</reasoning>\n<final_answer>{len(text)}</final_answer>"
    longest_prompt: int = 1 << 20

    def generate(self, messages: list[dict], seed: int) -> dict:
        user = messages[-1]["content"]
        if len(user) > self.longest_prompt:
            raise ValueError("the prompt is too long")
        text = self.reply(user, seed)
        return {"text": text, "finish_reason": "stop", "prompt_tokens": len(user.split()), "completion_tokens": len(text.split()), "elapsed_seconds": 0.0}

    def metadata(self) -> dict:
        return {"parameter_count": 0}


@dataclass
class HttpBackend:
    """A server of chat completions: one request an attempt, no retries of its own.

    ``longest_prompt`` bounds the prompt's characters; a longer one is an error and never cut. ``extra`` goes
    into the request as it is.
    """

    model: str
    base_url: str
    api_key: str = "EMPTY"
    timeout_seconds: float = 180.0
    max_new_tokens: int = 768
    temperature: float = 0.0
    top_p: float = 1.0
    longest_prompt: int | None = None
    extra: dict = field(default_factory=dict)

    def _call(self, path: str, payload: dict | None = None) -> dict:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", None if payload is None else json.dumps(payload).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout_seconds) as answer:
            return json.load(answer)

    def models(self) -> list[str]:
        return [m["id"] for m in self._call("models")["data"]]

    def generate(self, messages: list[dict], seed: int) -> dict:
        if self.longest_prompt is not None and sum(len(m["content"]) for m in messages) > self.longest_prompt:
            raise ValueError("the prompt is too long")
        began = time.monotonic()
        got = self._call("chat/completions", {"model": self.model, "messages": messages, "max_tokens": self.max_new_tokens, "temperature": self.temperature, "top_p": self.top_p, "seed": seed, **self.extra})
        choice, usage = got["choices"][0], got.get("usage") or {}
        out = {"text": choice["message"].get("content") or "", "finish_reason": choice.get("finish_reason"), "elapsed_seconds": time.monotonic() - began}
        return out | {k: usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}

    def metadata(self) -> dict:
        return {"backend": "http", "model": self.model, "base_url": self.base_url, "parameter_count": None}


def check_model(backend: HttpBackend) -> None:
    """An error unless the server lists the configured model; called on the driver before a job starts."""
    known = backend.models()
    if backend.model not in known:
        raise ValueError(f"the server has no model {backend.model!r}; it has {known}")


BACKENDS: dict[str, Callable[..., Backend]] = {"stub": StubBackend, "http": HttpBackend}


def register_backend(name: str, factory: Callable[..., Backend]) -> None:
    BACKENDS[name] = factory


def create_backend(name: str, **options) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"no backend named {name}; known: {sorted(BACKENDS)}")
    return BACKENDS[name](**options)


def attempt_seed(base: int, index: int, attempt: int) -> int:
    """A seed that depends on the row and the attempt only, so a task that runs again makes the same text."""
    return base + index * 100 + attempt


def generate(problems: DataFrame, make: Callable[[], Backend], system: str, seed: int = 42, attempts: int = 1, accept: Callable[[dict, dict], bool] | None = None, wait: float = 0.0, first: int = 1, prefix: str = USER_PREFIX) -> DataFrame:
    """One row per attempt: ``problem_id, attempt``, the generation's columns and its error.

    ``attempts`` are numbered from ``first``, and end with the first that ``accept`` takes (all are made without
    it); the pause grows with the attempt. Errors are data, not failures. Join away finished problems
    before this.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in batches:
            rows = []
            for p in pdf.to_dict("records"):
                messages = [{"role": "system", "content": system}, {"role": "user", "content": prefix + (p["question"] or "")}]
                for n in range(first, first + attempts):
                    out = dict.fromkeys(("text", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "elapsed_seconds", "peak_memory_bytes", "generation_error"))
                    began = time.monotonic()
                    try:
                        out |= backend.generate(messages, attempt_seed(seed, int(p["source_index"]), n))
                        if out["total_tokens"] is None and out["prompt_tokens"] is not None and out["completion_tokens"] is not None:
                            out["total_tokens"] = out["prompt_tokens"] + out["completion_tokens"]
                    except Exception as e:  # a failed request is a row of its own
                        out |= {"generation_error": f"{type(e).__name__}: {e}", "elapsed_seconds": time.monotonic() - began}
                    rows.append({"problem_id": p["problem_id"], "attempt": n, **out})
                    if accept is not None and out["generation_error"] is None and accept(p, out):
                        break
                    if wait:
                        time.sleep(wait * n)
            frame = pd.DataFrame(rows)
            for c in ("prompt_tokens", "completion_tokens", "total_tokens", "peak_memory_bytes"):
                frame[c] = frame[c].astype("Int64") if len(frame) else None
            yield frame

    return problems.select("problem_id", "source_index", "question").mapInPandas(run, "problem_id string, attempt int, " + GENERATION)
