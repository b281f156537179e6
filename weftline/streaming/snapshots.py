"""Runs of a site over crawl snapshots, one by one or as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.discovery import DiscoveryFailure
from ..operators.extract import bodies, extract
from ..operators.merge import mark_missing, merge, save_validators, violations
from ..operators.report import run_stats, unhealthy
from ..operators.state import Store
from ..plans.config import Site

PAGES = "url string, html string, final_url string, hints map<string,string>, ord int, status int, not_modified boolean, etag string, last_modified string, hints_hash string"


def prepared(pages: DataFrame, site: Site) -> DataFrame:
    """Fetched pages as the merge wants them."""
    have = set(pages.columns)
    defaults = {"ord": "0", "not_modified": "false", "status": "200"}
    for c in ("ord", "not_modified", "status"):
        if c not in have:
            pages = pages.withColumn(c, F.expr(defaults[c]))
    out = bodies(extract(pages.withColumn("found_at", F.col("url")), site, keep=("ord", "not_modified", "found_at")), site)
    return out.withColumns({"site_id": F.lit(site.id), "url": F.col("found_at")}).drop("found_at")  # items go by the URL that was discovered, redirected or not


def run(store: Store, site: Site, pages: DataFrame, now: datetime, discovered: DataFrame | None = None, closed: bool = True, failed: int = 0, failure: str = "") -> dict[str, int]:
    """One run of a site: merge, missing markers, validators and site state become visible together. Returns its counters.

    ``discovered`` holds the URLs that discovery found (default: those of the pages); items
    outside it are marked as missing if the crawl is ``closed``, and left alone if more of it
    is to come. ``failed`` fetches count as errors. No discovered URL at all, or a ``failure`` of
    discovery, leaves the items untouched and is written to the site's state.
    """
    at = F.lit(now.astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    found = (pages if discovered is None else discovered).select(F.lit(site.id).alias("site_id"), "url").distinct()
    state = store.read("site_state", site.id)
    old = next(iter(state.collect()), None)
    if failure or found.isEmpty():
        failure = failure or f"{site.id}: discovery found nothing"
        row = store.spark.createDataFrame([(site.id, now, old and old["last_success_at"], old and old["last_change_at"], failure)], state.schema)
        store.write(site.id, site_state=row)
        raise DiscoveryFailure(failure)
    merged, outcomes = merge(store.read("items", site.id), prepared(pages, site), site, at)
    if closed:
        merged = mark_missing(merged, found, at)
    bad = violations(merged).take(1)
    if bad:
        raise ValueError(f"{site.id}: {bad[0]['key']} {bad[0]['value']} would occur {bad[0]['n']} times")
    stats = run_stats(outcomes, discovered=found)
    counters = stats.withColumn("unhealthy", unhealthy(stats).cast("int")).drop("site_id").first().asDict()
    counters["errors"] += failed
    counters["fetched"] += failed
    changed = counters["new"] + counters["updated"] > 0
    said = f"{counters['errors']} of {counters['fetched']} fetches failed" if counters["errors"] else ""
    if counters["unhealthy"]:
        said = "; ".join(filter(None, [said, f"{counters['no_content']} pages without content and {counters['no_date']} without a date"]))
    row = store.spark.createDataFrame([(site.id, now, now, now if changed else old and old["last_change_at"], said)], state.schema)
    writes = {"items": merged, "site_state": row}
    if {"etag", "last_modified", "hints_hash"} <= set(pages.columns):
        applied = outcomes.where(F.col("outcome") != "no_content").select("site_id", "url").join(pages.select("url", "etag", "last_modified", "hints_hash"), "url")
        writes["validators"] = save_validators(store.read("validators", site.id), applied.withColumns({"fetched_at": at, "status": F.lit(200)}))
    store.write(site.id, **writes)
    return counters


def stream(pages: DataFrame, store: Store, site: Site, checkpoint: str, clock: Callable[[int], datetime] | None = None, discovered: Callable[[int], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch of a page stream is a run, in order; a replayed batch gives the same items, since a page is unchanged the second time.

    Only a batch whose ``discovered`` URLs are given closes a crawl and marks items as missing.
    """
    clock = clock or (lambda _: datetime.now(timezone.utc))

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            run(store, site, df, clock(number), discovered(number) if discovered else None, closed=discovered is not None)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
