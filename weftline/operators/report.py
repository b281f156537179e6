"""Counters, health, recency and checks over item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import is_absolute

OUTCOMES = ("new", "updated", "unchanged", "not_modified", "no_content")


def run_stats(outcomes: DataFrame, keys: tuple[str, ...] = ("site_id",), discovered: DataFrame | None = None) -> DataFrame:
    """Counters of a run by site; ``no_date`` counts responses without a date, ``discovered`` the rows of that table, if it is given."""
    aggs = [F.count("*").alias("fetched"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if(F.col("no_date")).alias("no_date")]
    out = outcomes.groupBy(*keys).agg(*aggs).withColumn("errors", F.col("no_content"))
    if discovered is None:
        return out
    found = discovered.groupBy(*keys).agg(F.count("*").alias("discovered"))
    return found.join(out, list(keys), "left").na.fill(0, [c for c in out.columns if c not in keys])


def unhealthy(stats: DataFrame) -> Column:
    """Two or more full responses, of which over half lack content or a date; a page lacking both counts twice."""
    n = F.col("fetched") - F.col("not_modified")
    return (n >= 2) & (F.col("no_content") + F.col("no_date") > 0.5 * n)


def extraction_health(extracted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many pages have a title, a date and content."""
    return extracted.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(F.col("title") != "").alias("with_title"), F.count_if(F.col("published").isNotNull()).alias("with_published"), F.count_if(F.col("content") != "").alias("with_content"))


def recent(items: DataFrame, n: int, key: str = "site_id") -> DataFrame:
    """The newest ``n`` items of each site with their rank, by published, first seen and guid."""
    w = Window.partitionBy(key).orderBy(F.col("published_at").desc(), F.col("first_seen_at").desc(), "guid")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.col("published_at").desc(), F.col("first_seen_at").desc(), "guid").limit(n)


def channel_times(items: DataFrame, last_build: Column, key: str = "site_id") -> DataFrame:
    """pub_date: the newest published; updated: the latest change, or the last build if later, or the epoch."""
    change = F.max(F.greatest("updated_at", "published_at"))
    return items.groupBy(key).agg(F.max("published_at").alias("pub_date"), F.coalesce(F.greatest(change, F.max(last_build)), F.timestamp_seconds(F.lit(0))).alias("updated"))


def ready(sites: DataFrame, state: DataFrame, served: DataFrame, formats: int) -> DataFrame:
    """One row: whether every site has had a success and has all its formats served."""
    have = served.groupBy("site_id").agg(F.countDistinct("format").alias("have"))
    rows = sites.join(state.select("site_id", "last_success_at"), "site_id", "left").join(have, "site_id", "left")
    return rows.agg(F.coalesce(F.bool_and(F.col("last_success_at").isNotNull() & (F.coalesce("have", F.lit(0)) >= formats)), F.lit(True)).alias("ready"))


def sort_problems(items: DataFrame, key: str, pos: str, date: str) -> DataFrame:
    """Items dated after the last dated item before them."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("prev", F.last(date, ignorenulls=True).over(w)).where(F.col(date) > F.col("prev"))


def duplicate_problems(items: DataFrame, key: str, pos: str, guid: str = "guid") -> DataFrame:
    """Items whose guid came before, with the position of its first."""
    first = items.where(F.col(guid) != "").groupBy(key, guid).agg(F.min(pos).alias("first_pos"))
    return items.join(first, [key, guid]).where(F.col(pos) > F.col("first_pos"))


def item_problems(items: DataFrame, key: str = "site_id", pos: str = "rank") -> DataFrame:
    """(key, pos, problem) of feed items before they are written: what a feed checker would say of them."""
    say = F.array_compact(F.array(
        F.when((F.coalesce("title", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == ""), F.lit("has neither title nor description")),
        F.when(~is_absolute(F.col("url")), F.lit("link is no http(s) address")),
        F.when(F.coalesce("content_html", F.lit("")) == "", F.lit("content is empty")),
        F.when(F.coalesce("guid", F.lit("")) == "", F.lit("has no guid")),
        F.when(F.col("published_at").isNull(), F.lit("has no date")),
    ))
    own = items.select(key, pos, F.explode(say).alias("problem"))
    order = sort_problems(items, key, pos, "published_at").select(key, pos, F.lit("is newer than the item before it").alias("problem"))
    twice = duplicate_problems(items, key, pos).select(key, pos, F.concat(F.lit("guid stands at item "), F.col("first_pos"), F.lit(" too")).alias("problem"))
    return own.unionByName(order).unionByName(twice)
