"""Clients of the two web services that feed tables: yearly series, and articles behind a login.

They run on the driver and land one JSON object a line; readers.observations and html.sections take it from there. A client
is given the function that opens a request, so tests and other transports need no network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

Opener = Callable[[urllib.request.Request], bytes]


class Absent(Exception):
    """The service has no such item; asking again is no use."""


class Refused(Exception):
    """The login failed; no other request can succeed."""


def opened(request: urllib.request.Request, timeout: float = 30.0) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


@dataclass
class Throttle:
    """Waits so that no more than `most` calls fall into any `seconds`."""

    most: int
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: list[float] = field(default_factory=list)

    def wait(self) -> None:
        now = self.clock()
        self.calls = [c for c in self.calls if now - c < self.seconds]
        if len(self.calls) >= self.most:
            self.sleep(self.seconds - (now - self.calls[0]))
            now = self.clock()
            self.calls = [c for c in self.calls if now - c < self.seconds]
        self.calls.append(now)


def answer(request: urllib.request.Request, opener: Opener, throttle: Throttle | None = None, attempts: int = 3, pause: float = 1.0) -> bytes:
    """The body of an answer. Server errors and lost connections are tried again with growing pauses; a request that the service
    rejects as unknown raises Absent, one that it forbids Refused, any other HTTP error at once."""
    for turn in range(attempts):
        if throttle:
            throttle.wait()
        try:
            return opener(request)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise Refused(str(e)) from e
            if e.code == 404 or e.code == 400 and b"does not exist" in (e.read() or b""):
                raise Absent(request.full_url.split("?")[0]) from e
            if e.code < 500 or turn == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if turn == attempts - 1:
                raise
        (throttle.sleep if throttle else time.sleep)(pause * 2**turn)
    raise AssertionError


@dataclass
class Series:
    """Yearly observations, one request a series, at most a hundred a minute."""

    url: str
    key: str
    opener: Opener = opened
    throttle: Throttle = field(default_factory=lambda: Throttle(100))

    def observations(self, series: str) -> list[dict]:
        query = urllib.parse.urlencode({"series_id": series, "api_key": self.key, "file_type": "json", "frequency": "a"})
        return json.loads(answer(urllib.request.Request(f"{self.url}?{query}"), self.opener, self.throttle))["observations"]

    def land(self, series: Iterable[str], path: str) -> list[str]:
        """Write a line for each series that exists; the absent ones are returned."""
        absent = []
        with open(path, "w") as out:
            for s in series:
                try:
                    out.write(json.dumps({"series_id": s, "observations": [{"date": o["date"], "value": o["value"]} for o in self.observations(s)]}) + "\n")
                except Absent:
                    absent.append(s)
        return absent


@dataclass
class Articles:
    """Article HTML by title, behind a login whose token is asked for once and again when it has run out."""

    login_url: str
    url: str
    user: str
    password: str
    opener: Opener = opened
    titles: dict[str, str] = field(default_factory=dict)
    token: str | None = None

    def login(self) -> None:
        body = json.dumps({"username": self.user, "password": self.password}).encode()
        request = urllib.request.Request(self.login_url, body, {"Content-Type": "application/json"})
        self.token = json.loads(answer(request, self.opener))["access_token"]

    def html(self, name: str) -> str | None:
        """The HTML of an article under its own title or the one that `titles` names for it; None where the answer holds none."""
        if not self.token:
            self.login()
        place = f"{self.url}/{urllib.parse.quote(self.titles.get(name, name).replace(' ', '_'))}"
        ask = lambda: answer(urllib.request.Request(place, headers={"Authorization": f"Bearer {self.token}"}), self.opener)
        try:
            found = json.loads(ask())
        except Refused:
            self.login()
            found = json.loads(ask())
        first = found[0] if isinstance(found, list) and found else found
        return (first or {}).get("article_body", {}).get("html") if isinstance(first, dict) else None

    def land(self, names: Iterable[str], path: str) -> dict[str, str]:
        """Write {name, html} lines; what fails is returned with its reason and leaves the others be. A refused login ends it."""
        failed = {}
        self.login()
        with open(path, "w") as out:
            for name in names:
                try:
                    html = self.html(name)
                    if html is None:
                        failed[name] = "no article body"
                    else:
                        out.write(json.dumps({"name": name, "html": html}) + "\n")
                except Refused:
                    raise
                except Exception as e:
                    failed[name] = f"{type(e).__name__}: {e}"
        return failed
