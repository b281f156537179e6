"""Control rules of fetching: addresses, robots, retries, rates and header hosts. No network code."""

from __future__ import annotations

import ipaddress
import random
import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ranges beyond the private, loopback, link-local and multicast ones.
SPECIAL = ["0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4", "::/96", "64:ff9b::/96", "64:ff9b:1::/48", "2001::/32", "2002::/16"]
PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "fc00::/7", "fe80::/10", "ff00::/8", "::1/128"]
ATTEMPTS, MAX_WAIT, ROBOTS_TTL, ROBOTS_ERROR_TTL = 3, 300.0, 86400.0, 600.0
_NETS = [ipaddress.ip_network(n) for n in (*SPECIAL, *PRIVATE)]


def public_address(text: str) -> bool:
    """A globally routable unicast address; IPv4 in IPv6 counts as IPv4."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return not any(a.version == n.version and a in n for n in _NETS)


def public_ipv4(c: Column) -> Column:
    """The same for IPv4 in dotted form, as an expression; other texts are false."""
    parts = F.split(c, r"\.")
    n = sum(F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4))
    ok = c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    for net in _NETS:
        if net.version == 4:
            ok &= ~n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(ok, F.lit(False))


def retryable(status: Column, error: Column) -> Column:
    """429, server errors and transport errors; never the final kinds (too_big, redirect, blocked, disallowed, cancelled, deadline)."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(error == "transport", F.lit(False))


def backoff(attempt: int, rng: random.Random | None = None) -> float:
    """Seconds before a further attempt: doubling from 1, within half to one and a half."""
    return 2.0 ** (attempt - 1) * (0.5 + (rng or random).random())


def wait_before(attempt: int, retry_after: float | None, rng: random.Random | None = None) -> float | None:
    """Seconds to wait, None to give up: no attempts left, or a longer wait asked for than is allowed."""
    if attempt >= ATTEMPTS or retry_after is not None and retry_after > MAX_WAIT:
        return None
    return retry_after if retry_after is not None else backoff(attempt, rng)


def headers_for(url: str, headers: dict[str, str], hosts: list[str]) -> dict[str, str]:
    """Configured headers go to the site's own hosts only."""
    return dict(headers) if urlsplit(url).netloc.lower() in {h.lower() for h in hosts} else {}


def host_rates(rates: list[tuple[str, float]]) -> dict[str, float]:
    """Requests a second by host: sites that share one get the slowest rate."""
    out: dict[str, float] = {}
    for host, rate in rates:
        out[host.lower()] = min(rate, out.get(host.lower(), rate))
    return out


class Bucket:
    """A token bucket of one: when the next request may go."""

    def __init__(self, rate: float):
        self.gap, self.next = 1 / rate, 0.0

    def take(self, now: float) -> float:
        """Seconds to wait."""
        at = max(now, self.next)
        self.next = at + self.gap
        return at - now


class Robots:
    """Rules of a robots.txt: an agent's own group replaces the general one; the longest rule wins, allow on ties."""

    def __init__(self, status: int, text: str, agent: str):
        self.all = None if 200 <= status < 300 else 400 <= status < 500
        self.rules: list[tuple[bool, str]] = []
        groups: dict[str, list[tuple[bool, str]]] = {}
        agents: list[str] = []
        open_ = False
        for line in text.lstrip("﻿").splitlines():
            key, colon, value = line.partition("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                if not open_:
                    agents = []
                open_ = True
                agents.append(value.lower())
                groups.setdefault(value.lower(), [])
            elif key in ("allow", "disallow"):
                open_ = False
                for a in agents:
                    if value:
                        groups[a].append((key == "allow", value))
        name = agent.lower()
        own = max((a for a in groups if a != "*" and a and name.startswith(a)), key=len, default=None)
        self.rules = groups.get(own if own is not None else "*", [])

    def allowed(self, path: str) -> bool:
        if path == "/robots.txt":
            return True
        if self.all is not None:
            return self.all
        best = (-1, True)
        for allow, rule in self.rules:
            pattern = re.escape(rule.rstrip("$") if rule.endswith("$") else rule).replace(r"\*", ".*") + ("$" if rule.endswith("$") else "")
            if re.match(pattern, path or "/"):
                best = max(best, (len(rule), allow))
        return best[1]


def not_modified(if_none_match: str, if_modified_since: float | None, tag: str, modified: float) -> bool:
    """Whether a conditional request for a served feed gets 304; tags come first."""
    if if_none_match:
        return any(t.strip().removeprefix("W/") in (tag, "*") for t in if_none_match.split(","))
    return if_modified_since is not None and int(modified) <= int(if_modified_since)
