"""Feeds as a web application: what is built from the state, kept with its stamps, and answered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from email.utils import format_datetime, parsedate_to_datetime
from typing import NamedTuple

from pyspark.sql import functions as F

from ..operators.state import Store
from .config import Site
from .control import not_modified
from .render import FORMATS, index_page, opml, render, stamp

#: Seconds that clients may keep a feed, and wait for one that isn't built yet.
MAX_AGE, RETRY = 300, 60


class Feed(NamedTuple):
    data: bytes
    etag: str
    modified: datetime
    content_type: str


class Feeds:
    """The served feeds of some sites. A format that is empty or fails its checks keeps the last good document."""

    def __init__(self, store: Store, sites: Iterable[Site], base_url: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.store, self.sites, self.base_url, self.clock = store, list(sites), base_url.rstrip("/"), clock
        self.served: dict[str, Feed] = {}

    def refresh(self, site: Site) -> dict[str, list[str]]:
        """Build every format of a site and keep those that may be served; returns the problems by file. Stamps last over restarts."""
        items = self.store.read("items", site.id)
        state = self.store.read("site_state", site.id).first()
        stamps = {r["path"]: (r["etag"], r["modified_at"].replace(tzinfo=timezone.utc)) for r in self.store.read("feed_stamps", site.id).collect()}
        problems: dict[str, list[str]] = {}
        for name, fmt in FORMATS.items():
            file = f"{site.id}{fmt.extension}"
            document = render(items, site, self.base_url, state and state["last_change_at"], name)
            found = fmt.check(document)
            if not re.search("<item>|<entry>", document):
                found = [*found, "has no items"]
            problems[file] = found
            if not found:
                data = document.encode()
                stamps[file] = stamp(stamps.get(file), data, self.clock())
                self.served[file] = Feed(data, *stamps[file], fmt.content_type)
        if stamps:
            rows = [(path, tag, at.astimezone(timezone.utc).replace(tzinfo=None)) for path, (tag, at) in sorted(stamps.items())]
            made = self.store.spark.createDataFrame([(p, t, at.isoformat(sep=" ")) for p, t, at in rows], "path string, etag string, modified_at string")
            self.store.write(site.id, feed_stamps=made.withColumn("modified_at", F.col("modified_at").cast("timestamp")))
        return problems

    def ready(self) -> bool:
        """Every site has had a success and has all its formats served."""
        ok = {r["site_id"] for r in self.store.read("site_state").where("last_success_at is not null").select("site_id").collect()}
        return all(s.id in ok and all(f"{s.id}{f.extension}" in self.served for f in FORMATS.values()) for s in self.sites)

    def answer(self, method: str, path: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        """(status, headers, body) of a request; header names in lower case."""
        if method not in ("GET", "HEAD"):
            return 405, {"Allow": "GET, HEAD"}, b""
        plain = {"Content-Type": "text/plain; charset=utf-8"}
        if path.startswith("/feeds/"):
            status, head, body = self._feed(path.removeprefix("/feeds/"), headers)
        elif path == "/feeds.opml":
            status, head, body = 200, {"Content-Type": "text/x-opml; charset=utf-8"}, opml(self.sites, self.base_url).encode()
        elif path == "/":
            status, head, body = 200, {"Content-Type": "text/html; charset=utf-8"}, index_page(self.sites, self.base_url).encode()
        elif path == "/healthz":
            status, head, body = 200, plain, b"ok\n"
        elif path == "/readyz":
            status, head, body = (200, plain, b"ready\n") if self.ready() else (503, plain, b"not ready\n")
        else:
            status, head, body = 404, plain, b"not found\n"
        return status, head, body if method == "GET" else b""

    def _feed(self, file: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        feed = self.served.get(file)
        if feed is None:
            known = file in {f"{s.id}{f.extension}" for s in self.sites for f in FORMATS.values()}
            return (503, {"Retry-After": str(RETRY)}, b"") if known else (404, {}, b"")
        out = {"ETag": feed.etag, "Last-Modified": format_datetime(feed.modified.astimezone(timezone.utc), usegmt=True), "Cache-Control": f"public, max-age={MAX_AGE}"}
        try:
            since = parsedate_to_datetime(headers["if-modified-since"]).timestamp()
        except (KeyError, TypeError, ValueError):
            since = None
        if not_modified(headers.get("if-none-match", ""), since, feed.etag, feed.modified.timestamp()):
            return 304, out, b""
        return 200, out | {"Content-Type": feed.content_type}, feed.data

    def __call__(self, environ: dict, start_response: Callable) -> list[bytes]:
        """The application for any WSGI server."""
        headers = {k[5:].replace("_", "-").lower(): v for k, v in environ.items() if k.startswith("HTTP_")}
        status, head, body = self.answer(environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/"), headers)
        words = {200: "OK", 304: "Not Modified", 404: "Not Found", 405: "Method Not Allowed", 503: "Service Unavailable"}
        start_response(f"{status} {words[status]}", [*head.items(), ("Content-Length", str(len(body)))])
        return [body]
