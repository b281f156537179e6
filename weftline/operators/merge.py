"""The item state machine: extracted pages into keyed items, with stable times and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import checkpoint
from ..functions.dates import later_than, published_at, source_day
from ..functions.ids import content_hash, uuid5_url
from ..plans.config import Site

ITEM = "site_id string, guid string, url string, canonical_url string, title string, summary string, content_html string, author string, image_url string, categories array<string>, published_at timestamp, published_source string, source_published string, updated_at timestamp, first_seen_at timestamp, last_fetched_at timestamp, content_hash string, missing_since timestamp"
COLUMNS = [c.split()[0] for c in ITEM.split(", ")]
META = ("url", "canonical_url", "author", "source_published", "image_url", "categories")


def built(pages: DataFrame, site: Site) -> DataFrame:
    """New values of fetched pages (site_id, url, ord, canonical, title, summary, author, image, categories, published..., updated, content_html)."""
    return pages.withColumns({
        "new_hash": content_hash(F.col("title"), F.col("summary"), F.col("content_html")),
        "new_day": source_day(F.col("published"), site.timezone),
        "canonical": F.coalesce(F.nullif("canonical", F.lit("")), F.col("url")),
    })


def merge(items: DataFrame, pages: DataFrame, site: Site, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items after the run, outcomes: site_id, url, outcome, guid, no_date).

    ``pages``: extracted rows with content_html, ord, not_modified. Outcomes: not_modified
    (touched), no_content (an error, nothing stored), new, updated, unchanged (touched).
    An existing item keeps guid, first_seen, published and updated; published moves only
    if the source's day did; updated moves to a later source date, or to ``now`` for an
    edited text without one. ``no_date`` tells responses without a date, with or without
    content. Permalink sites find a moved URL by its canonical. Pages of
    one canonical in one run meet in one item: the first creates it, the last one stands.
    """
    permalink = site.item.guid == "permalink"
    tz = site.timezone
    pages = checkpoint(built(pages, site))  # each fetched page is extracted once
    old = items.select(*[F.col(c).alias(f"old_{c}") for c in COLUMNS])
    by_url = pages.join(old, (pages["site_id"] == old["old_site_id"]) & (pages["url"] == old["old_url"]), "left")
    if permalink:
        missed = by_url.where("old_guid is null and not not_modified").select(*pages.columns)
        found = missed.join(old, (missed["site_id"] == old["old_site_id"]) & (missed["canonical"] == old["old_guid"]), "left")
        by_url = by_url.where("old_guid is not null or not_modified").unionByName(found)
    g = F.coalesce("old_guid", F.col("canonical") if permalink else uuid5_url(F.col("url")))
    have = F.col("old_guid").isNotNull()
    rows = by_url.withColumn("guid", g).withColumn("have", have)

    fresh_at = published_at(F.col("published"), F.coalesce("published_date_only", F.lit(False)), F.coalesce("published_source", F.lit("")), F.coalesce("old_first_seen_at", now), F.col("ord"), tz)
    moved = have & (F.col("old_source_published") != "") & (F.col("new_day") != "") & (F.col("new_day") != F.col("old_source_published"))
    rows = rows.withColumn("at", F.when(~have | moved, fresh_at).otherwise(F.struct(F.col("old_published_at").alias("at"), F.col("old_published_source").alias("source"))))
    edited = have & (F.col("new_hash") != F.col("old_content_hash"))
    later = later_than(F.col("updated"), F.col("at.at"))
    newer = later.isNotNull() & (F.col("old_updated_at").isNull() | (later > F.col("old_updated_at")))
    rows = rows.withColumn("new_updated", F.when(~have, later).otherwise(F.when(newer, later).otherwise(F.when(edited, now).otherwise(F.col("old_updated_at")))))
    values: dict[str, Column] = {
        "site_id": F.col("site_id"), "guid": F.col("guid"), "url": F.col("url"), "canonical_url": F.col("canonical"), "title": F.col("title"), "summary": F.col("summary"), "content_html": F.col("content_html"),
        "author": F.col("author"), "image_url": F.col("image"), "categories": F.coalesce("categories", F.array().cast("array<string>")), "published_at": F.col("at.at"), "published_source": F.col("at.source"),
        "source_published": F.when(have & (F.col("new_day") == ""), F.col("old_source_published")).otherwise(F.col("new_day")), "updated_at": F.col("new_updated"),
        "first_seen_at": F.coalesce("old_first_seen_at", now), "last_fetched_at": now, "content_hash": F.col("new_hash"), "missing_since": F.lit(None).cast("timestamp"),
    }
    rows = rows.withColumn("new", F.struct(*[v.alias(k) for k, v in values.items()]))
    same = F.col("new.content_hash").eqNullSafe(F.col("old_content_hash")) & F.col("new.published_at").eqNullSafe(F.col("old_published_at")) & F.col("new.updated_at").eqNullSafe(F.col("old_updated_at"))
    for c in META:
        same &= F.col(f"new.{c}").eqNullSafe(F.col(f"old_{c}"))
    outcome = F.when(F.col("not_modified"), "not_modified").when(F.coalesce(F.col("content_html"), F.lit("")) == "", "no_content").when(~F.col("have"), "new").when(same, "unchanged").otherwise("updated")
    undated = F.col("published").isNull() & ~F.col("not_modified")
    rows = checkpoint(rows.withColumns({"outcome": outcome, "no_date": undated}).select("site_id", "url", "ord", "guid", "have", "outcome", "new", "old_guid", "no_date"))

    # One row a guid: the first page makes the item, the last says what stands.
    order = Window.partitionBy("site_id", "guid")
    stored = rows.where(F.col("outcome").isin("new", "updated", "unchanged"))
    stored = stored.withColumn("first_ord", F.min("ord").over(order)).withColumn("r", F.row_number().over(order.orderBy(F.col("ord").desc(), "url")))
    made = stored.withColumn("outcome", F.when((F.col("outcome") == "new") & (F.col("ord") != F.col("first_ord")), "updated").otherwise(F.col("outcome")))
    chosen = made.where((F.col("r") == 1) & (F.col("outcome") != "unchanged")).select("new.*")
    touched = rows.where(F.col("have") & F.col("outcome").isin("not_modified", "unchanged")).select("site_id", F.col("old_guid").alias("guid"), F.lit(True).alias("touched")).distinct()
    keep = items.join(chosen.select("site_id", "guid"), ["site_id", "guid"], "left_anti").join(touched, ["site_id", "guid"], "left")
    keep = keep.withColumn("last_fetched_at", F.when(F.col("touched"), now).otherwise(F.col("last_fetched_at")))
    told = ["site_id", "url", "outcome", "guid", "no_date"]
    outcomes = rows.where(F.col("outcome").isin("not_modified", "no_content")).select(*told).unionByName(made.select(*told))
    return keep.select(*COLUMNS).unionByName(chosen.select(*COLUMNS)), outcomes


def mark_missing(items: DataFrame, discovered: DataFrame, now: Column, keys: tuple[str, ...] = ("site_id", "url")) -> DataFrame:
    """missing_since cleared for discovered items and set for others that have none; nothing is deleted."""
    seen = discovered.select(*keys).distinct().withColumn("seen", F.lit(True))
    out = items.join(seen, list(keys), "left")
    since = F.when(F.col("seen"), F.lit(None).cast("timestamp")).otherwise(F.coalesce("missing_since", now))
    return out.withColumn("missing_since", since).select(*items.columns)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``new`` replace those of their keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def save_validators(validators: DataFrame, applied: DataFrame) -> DataFrame:
    """Validators of the responses that were applied in full; failed ones keep what they had."""
    return upsert(validators, applied, ("site_id", "url"))


def violations(items: DataFrame) -> DataFrame:
    """Keys that occur twice: (site_id, guid) and (site_id, url) must both be unique."""
    parts = [items.groupBy("site_id", F.col(k).alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("key", F.lit(k)) for k in ("guid", "url")]
    return parts[0].unionByName(parts[1])
