"""A whole run of a site in one call: discover, plan, fetch conditionally, apply; and the loop that runs sites when they are due."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpoint
from ..operators.discovery import DiscoveryFailure, accepted, union_dedupe
from ..operators.planning import plan
from ..operators.state import Store
from ..plans.config import Discovery, Site
from ..sources.listing import read_listing
from ..sources.responses import allowed, answered, sitemap_tree
from ..sources.xml import SourceFailure, feed_candidates
from .snapshots import run

CANDIDATE = "url string, hints map<string,string>, pos array<int>"


def _one(url: str, responses: DataFrame) -> tuple[bytes, str]:
    """Body and final URL of one response; a failure is one of the source."""
    got = answered(responses.sparkSession.createDataFrame([(url,)], "url string"), responses).first()
    if got["error"]:
        raise SourceFailure(f"{url}: {got['error']}")
    return bytes(got["body"] or b""), got["final_url"]


def found_by(d: Discovery, responses: DataFrame) -> DataFrame:
    """Candidates (url, hints, pos) of one way of discovery."""
    spark = responses.sparkSession
    if d.type == "links":
        return spark.createDataFrame([(u, {}, [i]) for i, u in enumerate(d.urls)], CANDIDATE)
    if d.type == "sitemap":
        return sitemap_tree(d.url, responses)
    if d.type == "feed":
        return in_feeds({0: d}, responses)[0]
    rows = read_listing(d.url, lambda u: (lambda body, final: (body.decode("utf-8", "replace"), final))(*_one(u, responses)), d.link_selector, d.next_selector, d.max_pages)
    return spark.createDataFrame([(u, h, [i]) for i, (u, h) in enumerate(rows)], CANDIDATE)  # links of ``max_pages`` pages at most


def in_feeds(feeds: dict[int, Discovery], responses: DataFrame) -> dict[int, DataFrame]:
    """Candidates (url, hints, pos) of feeds by number. All are fetched in one pass over the responses."""
    if not feeds:
        return {}
    got = answered(responses.sparkSession.createDataFrame([(d.url, i) for i, d in feeds.items()], "url string, feed int"), responses)
    if bad := got.where("error <> ''").select("url", "error").take(1):
        raise SourceFailure(f"feed {bad[0]['url']}: {bad[0]['error']}")
    found = checkpoint(feed_candidates(got.select(F.col("final_url").alias("url"), "body", "feed"), keep=("feed",)).withColumn("pos", F.array("pos")))
    return {i: found.where(F.col("feed") == i).drop("feed") for i in feeds}


def candidates(site: Site, responses: DataFrame) -> DataFrame:
    """(site_id, url, hints, ord) of all ways of discovery. One that fails fails the whole."""
    try:
        feeds = in_feeds({i: d for i, d in enumerate(site.discovery) if d.type == "feed"}, responses)
        parts = [accepted(feeds[i] if i in feeds else found_by(d, responses), d, i) for i, d in enumerate(site.discovery)]
    except SourceFailure as e:
        raise DiscoveryFailure(f"{site.id}: {e}") from e
    return union_dedupe(parts).withColumn("site_id", F.lit(site.id))


def crawl(store: Store, site: Site, responses: DataFrame, now: datetime, robots: DataFrame | None = None, agent: str = "weftline") -> dict[str, int]:
    """One run: what discovery finds is planned against the stored items, fetched with their validators, and merged. Returns the counters.

    A failing discovery leaves items untouched and is written to the site's state by
    :func:`run`. Pages that can't be fetched count as errors and leave their items untouched.
    """
    try:
        found = candidates(site, responses)
    except DiscoveryFailure as e:
        run(store, site, responses.limit(0).select("url"), now, failure=str(e))
        raise
    at = F.lit(now.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    targets = plan(found, store.read("items", site.id), store.read("validators", site.id), site, at)
    refused = None
    if robots is not None and site.respect_robots:
        told = allowed(targets, robots, agent)
        targets, refused = told.where("allowed").drop("allowed"), told.where("not allowed")
    got = answered(targets, responses)
    failed = got.where("error <> ''").count() + (refused.count() if refused is not None else 0)
    pages = got.where("error = ''").select(
        "url", F.decode("body", "UTF-8").alias("html"), "final_url", "hints", "ord", F.col("status").cast("int").alias("status"), "not_modified",
        F.col("got_etag").alias("etag"), F.col("got_last_modified").alias("last_modified"), "hints_hash",
    )
    return run(store, site, pages, now, found, failed=failed)


def run_when_due(sites: Iterable[Site], one: Callable[[Site], object], clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep, stop: Callable[[], bool] = lambda: False, last: dict[str, float] | None = None) -> None:
    """Run the sites one at a time, the earliest due first and in configured order on ties, until ``stop``.

    A site that never ran is due at once; the next run is due an interval after the start of the
    last. A run that fails doesn't stop the loop; it is due again as any other.
    """
    sites = list(sites)
    due = {s.id: (last or {}).get(s.id, float("-inf")) + s.interval for s in sites}
    while sites and not stop():
        site = min(sites, key=lambda s: due[s.id])  # min keeps the first of equals
        if (ahead := due[site.id] - clock()) > 0:
            wait(ahead)
            continue
        due[site.id] = clock() + site.interval
        try:
            one(site)
        except ValueError:
            continue
