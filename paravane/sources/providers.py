"""Clients of hosted models over plain HTTPS: one table row a provider, no SDK."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from paravane.registry import register_augmenter

#: Seconds after which a silent connection counts as a transport failure.
TIMEOUT = 120


class EmptyResponse(Exception):
    """The provider answered with no text: a fault of the row."""


class TransportError(Exception):
    """The provider could not be reached or refused the call: a fault of the moment."""


@dataclass(frozen=True)
class Provider:
    """How a provider is asked and read; key_variable names the environment variable of its key."""

    name: str
    key_variable: str
    url: str
    headers: Callable[[str], dict]
    body: Callable[[str, str, float, int], dict]
    text: Callable[[dict], str]


#: The public interfaces of the providers.
PROVIDERS = [
    Provider(
        "anthropic",
        "ANTHROPIC_API_KEY",
        "https://api.anthropic.com/v1/messages",
        lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"},
        lambda model, prompt, temperature, tokens: {"model": model, "max_tokens": tokens, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]},
        lambda reply: "".join(part.get("text", "") for part in reply.get("content") or []),
    ),
    Provider(
        "gemini",
        "GEMINI_API_KEY",
        "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
        lambda key: {"x-goog-api-key": key},
        lambda model, prompt, temperature, tokens: {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": tokens, "thinkingConfig": {"thinkingLevel": "low"}}},
        lambda reply: "".join(part.get("text", "") for c in (reply.get("candidates") or [])[:1] for part in (c.get("content") or {}).get("parts") or [] if not part.get("thought")),
    ),
    Provider(
        "openai",
        "OPENAI_API_KEY",
        "https://api.openai.com/v1/chat/completions",
        lambda key: {"Authorization": f"Bearer {key}"},
        lambda model, prompt, temperature, tokens: {"model": model, "max_tokens": tokens, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]},
        lambda reply: "".join((c.get("message") or {}).get("content") or "" for c in (reply.get("choices") or [])[:1]),
    ),
]


def post(url: str, headers: dict, body: dict) -> dict:
    """One JSON call; any failure on the way is a transport error."""
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(ask, timeout=TIMEOUT) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as fault:
        raise TransportError(f"{fault.code} {fault.read()[:200].decode(errors='replace')}") from fault
    except (OSError, ValueError) as fault:
        raise TransportError(str(fault)) from fault


class HostedModel:
    """A provider's model; made on the worker, as its key is read from the worker's environment only."""

    def __init__(self, provider: Provider, model: str, send: Callable[[str, dict, dict], dict] = post):
        self.provider, self.model, self.send = provider, model, send
        self.key = os.environ.get(provider.key_variable)
        if not self.key:
            raise TransportError(f"{provider.key_variable} is not set")

    def complete(self, prompt: str, temperature: float, max_output_tokens: int) -> str:
        p = self.provider
        reply = self.send(p.url.format(model=self.model), p.headers(self.key), p.body(self.model, prompt, temperature, max_output_tokens))
        text = p.text(reply).strip()
        if not text:
            raise EmptyResponse(f"{p.name} answered with no text")
        return text


for _provider in PROVIDERS:
    register_augmenter(_provider.name)(_provider)
