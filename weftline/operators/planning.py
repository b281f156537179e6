"""What to fetch in a run: new candidates limited to the newest, and known ones due for a refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_only_at, parse_date
from ..functions.ids import hints_hash
from ..plans.config import Site


def refresh_due(published: Column, last_fetched: Column, lastmod: Column, now: Column, site: Site) -> Column:
    """Published within the refresh window (future dates always are), or changed since by a trusted lastmod."""
    recent = F.unix_millis(now) - F.unix_millis(published) <= int(site.refresh_window * 1000)
    return F.coalesce(recent, F.lit(False)) | F.coalesce(lastmod > last_fetched, F.lit(False)) if site.trust_lastmod else F.coalesce(recent, F.lit(False))


def newest_only(fresh: DataFrame, known: DataFrame, site: Site, now: Column, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Fresh candidates that rank among the newest ``max_items`` of fresh and known together; all of them if any has no readable date hint.

    Only built-in layouts count. Ties keep fresh before known, in discovery order.
    """
    dated = fresh.withColumn("p", parse_date(F.element_at("hints", F.lit("published")), tz=site.timezone))
    at = F.when(F.col("p.date_only"), date_only_at(F.col("p.time"), now, F.col("ord"), site.timezone)).otherwise(F.col("p.time"))
    dated = dated.withColumn("at", at)
    whole = dated.groupBy(*keys).agg(F.bool_and(F.col("p").isNotNull()).alias("whole"))
    ranked = dated.select(*keys, "url", "at", F.lit(0).alias("is_known"), "ord").unionByName(known.select(*keys, "url", F.col("published_at").alias("at"), F.lit(1).alias("is_known"), F.lit(0).alias("ord")))
    best = Window.partitionBy(*keys).orderBy(F.col("at").desc(), "is_known", "ord", "url")
    top = ranked.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= site.max_items) & (F.col("is_known") == 0)).select(*keys, "url", F.lit(True).alias("top"))
    out = fresh.join(whole, list(keys)).join(top, [*keys, "url"], "left")
    return out.where(~F.col("whole") | F.col("top")).drop("whole", "top")


def plan(candidates: DataFrame, items: DataFrame, validators: DataFrame | None, site: Site, now: datetime | Column, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(keys, url, hints, ord, is_known, hints_hash, etag, last_modified), fresh ones first, in discovery order.

    Validators go with a known URL only, and only while the listing hints that the
    configuration reads are the same as when it was fetched.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    on = [*keys, "url"]
    known = items.select(*on, "published_at", "last_fetched_at", F.lit(True).alias("have"))
    both = candidates.join(known, on, "left")
    fresh = newest_only(both.where("have is null").select(*candidates.columns), items, site, now, keys)
    lastmod = parse_date(F.element_at("hints", F.lit("lastmod")), tz=site.timezone)["time"]
    again = both.where("have").where(refresh_due(F.col("published_at"), F.col("last_fetched_at"), lastmod, now, site)).select(*candidates.columns)
    out = fresh.withColumn("is_known", F.lit(False)).unionByName(again.withColumn("is_known", F.lit(True)))
    out = out.withColumn("hints_hash", hints_hash({k: F.element_at("hints", F.lit(k)) for k in site.item.listing_fields()}))
    if validators is None:
        return out.withColumns({"etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")})
    own = validators.select(*on, F.col("hints_hash").alias("old_hash"), "etag", "last_modified")
    usable = F.col("is_known") & (F.col("old_hash") == F.col("hints_hash"))
    return out.join(own, on, "left").withColumns({c: F.when(usable, F.col(c)) for c in ("etag", "last_modified")}).drop("old_hash")


def ordered(targets: DataFrame, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    return targets.orderBy(*keys, "is_known", "ord")


def due_sites(sites: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """sites (site_id, interval_s, idx) with next run and whether it is due; sites that never ran are due at once."""
    out = sites.join(state.select("site_id", "last_run_at"), "site_id", "left")
    out = out.withColumn("next_at", F.coalesce(F.timestamp_millis(F.unix_millis("last_run_at") + (F.col("interval_s") * 1000).cast("long")), now))
    return out.withColumn("due", F.col("next_at") <= now)


def earliest(sites_due: DataFrame) -> DataFrame:
    """The site to run next; ties by configured order."""
    return sites_due.orderBy("next_at", "idx").limit(1)
