"""A completer that asks a chat endpoint over HTTP. Every way of failing becomes Unavailable, but for a request to wait."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from webgauge.operators.enrich import RESERVE, Completion, Patient, RateLimited, Unavailable

#: Fixed values of a call.
TIMEOUT, TEMPERATURE = 30.0, 0.3
_TEXT = {"type": "string"}
#: The answer has to be an object of these three texts.
ANSWER_FORMAT = {
    "type": "json_schema",
    "json_schema": {
        "name": "suggestion",
        "strict": True,
        "schema": {"type": "object", "properties": {n: _TEXT for n in ("diagnosis", "title", "meta_description")}, "required": ["diagnosis", "title", "meta_description"], "additionalProperties": False},
    },
}


def post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, bytes]:
    """One request by the standard library; OSError if there is no answer."""
    from urllib import request
    from urllib.error import HTTPError

    try:
        with request.urlopen(request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read()
    except HTTPError as e:
        return e.code, e.read()


@dataclass(frozen=True)
class Endpoint:
    """One call of a model behind an address of the usual chat form (messages in, choices and usage out). Travels to tasks as it is."""

    url: str
    key: str
    model: str
    send: Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]] = post

    def __repr__(self) -> str:  # the key stays out of logs and plans
        return f"Endpoint({self.url!r}, model={self.model!r})"

    def __call__(self, messages: list[dict]) -> Completion:
        asked = {"model": self.model, "messages": messages, "max_tokens": RESERVE, "temperature": TEMPERATURE, "response_format": ANSWER_FORMAT}
        try:
            status, body = self.send(self.url, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, json.dumps(asked).encode(), TIMEOUT)
        except TimeoutError as e:
            raise Unavailable(f"no answer in time: {e}") from e
        except OSError as e:
            raise Unavailable(f"no connection: {e}") from e
        if status == 429:
            raise RateLimited("asked too often")
        if status in (401, 403):
            raise Unavailable("the key was refused")
        if status != 200:
            raise Unavailable(f"status {status}: {body[:150].decode('utf-8', 'replace')}")
        try:
            got = json.loads(body)
            said, used = got["choices"][0]["message"], got["usage"]
            return Completion(said.get("content"), int(used["prompt_tokens"]), int(used["completion_tokens"]))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise Unavailable(f"not a chat answer: {type(e).__name__}") from e


def completer(url: str, key: str, model: str) -> Patient:
    """Asks again when told to wait; see ``Patient``."""
    return Patient(Endpoint(url, key, model))
