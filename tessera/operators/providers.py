"""Transports to hosted embedding services. They run inside the tasks; keys come from the executors' environment."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: post(url, json, headers, timeout) -> (status, body as text, parsed JSON or None)
Post = Callable[[str, dict, dict, float], tuple[int, str, dict | None]]


class TransportError(Exception):
    """The request didn't reach the service, or its answer didn't come back."""


class Refused(Exception):
    """The service gave no vectors, but may if asked again."""


def pause(attempt: int) -> float:
    """Seconds to wait before an attempt, from 1 on."""
    return min(2 ** (attempt - 1), 30)


def _requests_post() -> Post:
    import requests

    session = requests.Session()

    def post(url: str, body: dict, headers: dict, timeout: float):
        try:
            answer = session.post(url, json=body, headers=headers, timeout=timeout)
        except requests.RequestException as e:
            raise TransportError(str(e)) from e
        try:
            return answer.status_code, answer.text, answer.json()
        except ValueError:
            return answer.status_code, answer.text, None

    return post


@dataclass
class Provider:
    """POSTs to <base_url>/embeddings. retry_conflicts also retries 408, 409 and answers of the wrong length."""

    base_url: str
    api_key_env: str
    timeout_seconds: float = 120.0
    max_retries: int = 5
    encoding_format: str = "float"
    provider_id: str = "openai-compatible"
    settings: dict = field(default_factory=dict)  # as configured, without keys; part of an encoder's fingerprint
    retry_conflicts: bool = False
    post: Post | None = field(default=None, repr=False)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def embed(self, model_id: str, texts: Sequence[str]) -> list[list[float]]:
        """Vectors of the texts, tried up to max_retries times more with a pause of this task's own."""
        if not texts:
            return []
        why = ""
        for attempt in range(self.max_retries + 1):
            if attempt:
                self.sleep(pause(attempt))
            try:
                return self.embed_once(model_id, texts)
            except Refused as e:
                why = str(e)
        raise RuntimeError(f"gave up after {self.max_retries + 1} tries: {why}")

    def embed_once(self, model_id: str, texts: Sequence[str]) -> list[list[float]]:
        """Vectors of the texts by one call; Refused if another may help."""
        key = os.environ.get(self.api_key_env)
        if not key:
            raise RuntimeError(f"{self.api_key_env} is not set")
        post = self.post or _requests_post()
        body = {"model": model_id, "input": list(texts), "encoding_format": self.encoding_format}
        try:
            status, text, found = post(f"{self.base_url.rstrip('/')}/embeddings", body, {"Authorization": f"Bearer {key}"}, self.timeout_seconds)
        except TransportError as e:
            raise Refused(str(e)) from e
        if status == 429 or status >= 500 or self.retry_conflicts and status in (408, 409):
            raise Refused(f"status {status}: {text[:1000]}")
        if status >= 400:
            raise RuntimeError(f"status {status}: {text[:1000]}")
        rows = sorted((found or {}).get("data", []), key=lambda r: r["index"])
        if len(rows) != len(texts):
            why = f"{len(rows)} vectors for {len(texts)} texts"
            raise Refused(why) if self.retry_conflicts else RuntimeError(why)
        return [r["embedding"] for r in rows]


# The services' addresses and the variables that hold their keys.
PRESETS = {
    "siliconflow": {"base_url": "https://api.siliconflow.cn/v1", "api_key_env": "SILICONFLOW_API_KEY"},
    "openrouter": {"base_url": "https://openrouter.ai/api/v1", "api_key_env": "OPENROUTER_API_KEY"},
    "aiberm": {"base_url": "https://aiberm.com/v1", "api_key_env": "AIBERM_API_KEY"},
}


def create_provider(config: dict) -> Provider:
    kind = config.get("type", "siliconflow")
    if kind in PRESETS:
        given = PRESETS[kind] | {k: v for k, v in config.items() if k != "type"}
    elif kind == "openai-compatible":
        if lacking := {"base_url", "api_key_env"} - config.keys():
            raise ValueError(f"an openai-compatible provider needs {', '.join(sorted(lacking))}")
        given = {k: v for k, v in config.items() if k != "type"}
    else:
        raise ValueError(f"unknown provider type {kind}")
    secret = {"api_key", "token"}
    given = {k: v for k, v in given.items() if k not in secret}
    return Provider(**given, provider_id=kind, settings={k: v for k, v in config.items() if k not in secret}, retry_conflicts=kind == "aiberm")
