"""A chat endpoint over HTTP: the scorer of ``scoring.run_scorer`` and the call of ``scoring.replay``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from http.client import HTTPResponse

from mailloom.operators.prompts import REQUEST, SCHEMA


def request(system: str, user: str, model: str, top_logprobs: int | None = 10) -> str:
    """The same request as ``prompts.payload`` makes of columns."""
    said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    asked = {} if top_logprobs is None else {"logprobs": True, "top_logprobs": top_logprobs}
    return json.dumps({"model": model, "messages": said, **REQUEST, **asked, "guided_json": SCHEMA})


def reading(body: bytes) -> dict:
    """The fields of ``scoring.RESPONSE`` in an answer's body. An answer without choices is an error."""
    answer = json.loads(body)
    choice, usage = answer["choices"][0], answer.get("usage") or {}
    pair = lambda t: {"token": t.get("token"), "logprob": t.get("logprob")}
    seen = (choice.get("logprobs") or {}).get("content")
    tokens = None if seen is None else [{**pair(t), "top_logprobs": [pair(o) for o in t.get("top_logprobs") or []]} for t in seen]
    return {"content": choice["message"]["content"], "tokens": tokens, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens")}


@dataclass(frozen=True)
class Endpoint:
    """Where to post, and how many seconds a call may take in all, however slowly its answer arrives."""

    url: str
    timeout: float = 60.0
    headers: tuple[tuple[str, str], ...] = ()

    def post(self, payload: str) -> tuple[int, bytes]:
        """Status and body of the answer; a refusal (400 or more) is one too. No answer in time is a TimeoutError."""
        until = time.monotonic() + self.timeout
        asked = urllib.request.Request(self.url, payload.encode(), {"Content-Type": "application/json", **dict(self.headers)})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as got:
                return got.status, self._read(got, until)
        except urllib.error.HTTPError as e:
            with e:
                return e.code, self._read(e.fp, until)

    def _read(self, got: HTTPResponse, until: float) -> bytes:
        parts = []
        while part := got.read1(1 << 16):
            parts.append(part)
            if time.monotonic() > until:
                raise TimeoutError(f"no whole answer in {self.timeout:g} s")
        return b"".join(parts)

    def scorer(self, model: str, top_logprobs: int | None = 10) -> Callable[[str, str], dict]:
        """One call for each prompt. What it raises becomes the row's error, so that the id is asked again in the next run."""

        def score(system: str, user: str) -> dict:
            status, body = self.post(request(system, user, model, top_logprobs))
            if status >= 400:
                raise OSError(f"HTTP {status}")
            return reading(body)

        return score
