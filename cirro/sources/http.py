"""Requests from the driver, transport ladders and circuit breakers."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from cirro.errors import EngineError

NO_NETWORK = "CIRRO_NO_NET"


@dataclass
class Http:
    """GET with retries. 404 and 410 are gone for good, 429 and 5xx are tried again, other statuses are errors at once."""

    retry: int = 3
    open: Callable = urllib.request.urlopen
    sleep: Callable = time.sleep

    def get(self, url: str, headers: dict | None = None, query: dict | None = None, parse: str = "text"):
        if os.environ.get(NO_NETWORK) == "1" and self.open is urllib.request.urlopen:
            raise EngineError("no_network", url)
        if query:
            url = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(query)}"
        for n in range(1, self.retry + 1):
            try:
                with self.open(urllib.request.Request(url, headers=headers or {})) as r:
                    raw = r.read()
                break
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    raise EngineError("http_gone", f"{e.code}") from None
                if e.code != 429 and e.code < 500:
                    raise EngineError("http_client_error", f"{e.code}") from None
                if n == self.retry:
                    raise EngineError("http_server_error", f"{e.code} after {n} tries") from None
            except urllib.error.URLError as e:
                if n == self.retry:
                    raise EngineError("http_server_error", str(e.reason)) from None
            self.sleep(min(0.05 * 2 ** (n - 1), 1.0))
        if parse == "raw":
            return raw
        text = raw.decode()
        return json.loads(text) if parse == "json" else text.splitlines() if parse == "lines" else text


@dataclass
class Breaker:
    """Strikes of each rung; three trip it, a success clears them. Kept as JSON if there is a path."""

    path: str | None = None
    state: dict[str, dict] = field(default_factory=dict)
    threshold: int = 3

    @classmethod
    def read(cls, path: str) -> Breaker:
        state = {}
        if os.path.exists(path):
            with open(path) as f:
                state = json.load(f)
        return cls(path, state)

    def write(self) -> None:
        if self.path:
            with open(f"{self.path}.tmp", "w") as f:
                json.dump(self.state, f)
            os.replace(f"{self.path}.tmp", self.path)

    def strikes(self, rung: str) -> int:
        return self.state.get(rung, {}).get("strikes", 0)

    def tripped(self, rung: str) -> bool:
        return self.strikes(rung) >= self.threshold

    def strike(self, rung: str, now: dt.datetime) -> None:
        self.state[rung] = {"strikes": self.strikes(rung) + 1, "last_failure": now.isoformat()}

    def reset(self, rung: str) -> None:
        self.state.pop(rung, None)


@dataclass
class Rung:
    id: str
    fetch: Callable
    applies_to: tuple[str, ...]


TRANSIENT = ("http_server_error", "no_network")


def ladder_fetch(ladder: list[Rung], request: dict, breaker: Breaker, now: dt.datetime):
    """(transport, result) of the first rung that works. Lasting failures strike, passing ones don't; state is kept whatever happens."""
    failures = []
    try:
        for rung in ladder:
            if request["product"] not in rung.applies_to or breaker.tripped(rung.id):
                continue
            try:
                out = rung.fetch(request)
                breaker.reset(rung.id)
                return rung.id, out
            except EngineError as e:
                failures.append(f"{rung.id}: {e.code}")
                if e.code not in TRANSIENT:
                    breaker.strike(rung.id, now)
        raise EngineError("ladder_exhausted", "; ".join(failures))
    finally:
        breaker.write()
