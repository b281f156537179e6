"""Candidates of a site: union of its strategies, cleaned, filtered, deduplicated, in discovery order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import checkpoint
from ..functions.url import accept, clean_url
from ..plans.config import Discovery


class DiscoveryFailure(ValueError):
    """Discovery is whole or it fails; a run that fails leaves its items as they are."""


def accepted(found: DataFrame, strategy: Discovery, number: int) -> DataFrame:
    """Candidates (url, hints, pos and keys) of one strategy: valid, cleaned, through that strategy's filters on the cleaned URL."""
    out = found.withColumn("url", clean_url(F.col("url"))).where(F.col("url").isNotNull())
    return out.where(accept(F.col("url"), list(strategy.include), list(strategy.exclude))).withColumn("strategy", F.lit(number))


def union_dedupe(parts: Sequence[DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, url, hints, ord): one row a URL at its first place; each hint is the first strategy's that has it.

    Parts are rows of :func:`accepted`. Hints merge by an aggregate over (url, hint), so
    a URL found any number of times never meets in one row before that.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.select(*keys, "url", "hints", F.struct("strategy", "pos").alias("at"))
    first = every.groupBy(*keys, "url").agg(F.min("at").alias("at"))
    values = every.select(*keys, "url", "at", F.explode("hints").alias("k", "v")).where("v <> ''")
    merged = values.groupBy(*keys, "url", "k").agg(F.min(F.struct("at", "v")).alias("m"))
    hints = merged.groupBy(*keys, "url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("m.v").alias("v"))))).alias("hints"))
    # Ranks in two levels, so that no task holds all candidates: ranges of places, then the counts of these.
    placed = checkpoint(first.repartitionByRange(*keys, "at", "url").withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(*keys, "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("head"))
    inside = Window.partitionBy(*keys, "range").orderBy("at", "url")
    ranked = placed.join(heads, [*keys, "range"]).withColumn("ord", (F.col("head") + F.row_number().over(inside) - 1).cast("int"))
    out = ranked.join(hints, [*keys, "url"], "left")
    return out.select(*keys, "url", F.coalesce("hints", F.create_map().cast("map<string,string>")).alias("hints"), "ord")


def first_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by discovery order, for dry runs."""
    if n < 1:
        raise ValueError("the limit must be 1 or more")
    return candidates.where(F.col("ord") < n)
