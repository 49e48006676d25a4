"""Adapters of hosted models: one HTTP request per prompt, in each service's public format.

An adapter holds plain strings only, so that a driver can make it from its settings
and send it to the workers. A failed request raises; ``extraction.ask`` counts it
as an attempt, but a refused one, as for a wrong key, ends the job.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from .calls import ConfigurationError, opened

TEMPERATURE = 0.2
MAX_TOKENS = 8192
TIMEOUT = 120
LOCAL = "http://localhost:11434"


def _gemini(model: str, key: str, prompt: str) -> tuple[str, dict, dict, tuple]:
    settings = {"temperature": TEMPERATURE, "maxOutputTokens": MAX_TOKENS, "responseMimeType": "application/json"}
    body = {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": settings}
    return f"/v1beta/models/{model}:generateContent", {"x-goog-api-key": key}, body, ("candidates", 0, "content", "parts", 0, "text")


def _openai(model: str, key: str, prompt: str) -> tuple[str, dict, dict, tuple]:
    """JSON mode gives an object; reading an answer looks for the list in it."""
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "response_format": {"type": "json_object"}}
    return "/v1/chat/completions", {"Authorization": f"Bearer {key}"}, body, ("choices", 0, "message", "content")


def _anthropic(model: str, key: str, prompt: str) -> tuple[str, dict, dict, tuple]:
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS}
    return "/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, body, ("content", 0, "text")


def _ollama(model: str, key: str, prompt: str) -> tuple[str, dict, dict, tuple]:
    body = {"model": model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": TEMPERATURE, "num_predict": MAX_TOKENS}}
    return "/api/generate", {}, body, ("response",)


#: By name: the request of a prompt, the service's address, and the setting that holds its key.
SERVICES: dict[str, tuple[Callable, str, str | None]] = {
    "gemini": (_gemini, "https://generativelanguage.googleapis.com", "GEMINI_API_KEY"),
    "openai": (_openai, "https://api.openai.com", "OPENAI_API_KEY"),
    "anthropic": (_anthropic, "https://api.anthropic.com", "ANTHROPIC_API_KEY"),
    "ollama": (_ollama, LOCAL, None),
}


@dataclass(frozen=True)
class Hosted:
    """A provider that asks ``service`` at ``address``."""

    service: str
    model: str
    key: str = field(default="", repr=False)
    address: str = ""

    def generate(self, prompt: str) -> str:
        request, address, _ = SERVICES[self.service]
        path, headers, body, answer = request(self.model, self.key, prompt)
        call = urllib.request.Request((self.address or address) + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        with opened(call, TIMEOUT) as reply:
            return reduce(lambda found, step: found[step], answer, json.load(reply))


def hosted(service: str, environment: dict[str, str] | None = None) -> Callable[[], Hosted]:
    """What makes the provider on a worker, from the driver's settings: the service's key,
    TESSERA_MODEL (needed) and, for another address, TESSERA_ADDRESS."""
    known = os.environ if environment is None else environment
    key = SERVICES[service][2]
    missing = [name for name in (key, "TESSERA_MODEL") if name and not known.get(name)]
    if missing:
        raise ConfigurationError(f"{service} needs {' and '.join(missing)}")
    return partial(Hosted, service, known["TESSERA_MODEL"], known[key] if key else "", known.get("TESSERA_ADDRESS", ""))


#: The public catalogue's search service, and how many items a search gives.
CATALOGUE_ADDRESS = "https://www.wikidata.org/w/api.php"
SEARCH_LIMIT = 5


@dataclass(frozen=True)
class CatalogueSearch:
    """Finds items by name through a catalogue's search service."""

    address: str = CATALOGUE_ADDRESS

    def __call__(self, name: str) -> list[dict]:
        query = urllib.parse.urlencode({"action": "wbsearchentities", "search": name, "language": "en", "format": "json", "type": "item", "limit": SEARCH_LIMIT})
        call = urllib.request.Request(f"{self.address}?{query}", headers={"User-Agent": "tessera/1.0"})
        with opened(call, TIMEOUT) as reply:
            found = json.load(reply).get("search", [])
        return [{"id": x["id"], "label": x.get("label", ""), "description": x.get("description", ""), "aliases": x.get("aliases", [])} for x in found]


def catalogue_search(address: str | None = None) -> Callable[[], CatalogueSearch]:
    """What makes a search on a worker."""
    return partial(CatalogueSearch, address or CATALOGUE_ADDRESS)


def is_there(address: str = LOCAL) -> bool:
    """Whether a local service answers."""
    try:
        with urllib.request.urlopen(f"{address}/api/tags", timeout=2) as reply:
            return reply.status == 200
    except OSError:
        return False
