"""Fetching as joins with a table of responses: redirects, validators, robots and sitemap trees without a network.

A table of responses stands in for the network: (url, status, body, location, etag,
last_modified), one row a URL. A crawler that does use a network fills such a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import OUT_ROWS, map_batches
from ..durable import checkpoint
from ..functions.url import authority, clean_url, py_resolve
from ..plans.control import Robots
from .xml import CHILDREN, DEPTH, SourceFailure, parse_sitemap

RESPONSE = "url string, status int, body binary, location string, etag string, last_modified string"
#: Redirects that are followed; largest body that is read.
HOPS, MAX_BODY = 10, 10 << 20


def _row_udf(fn, returns: str):
    return F.udf(fn, returns, useArrow=True)


def resolved(base: Column, ref: Column) -> Column:
    """A reference against its base, null unless http(s)."""
    return clean_url(_row_udf(lambda b, r: py_resolve(b or "", r or ""), "string")(base, ref))


def allowed(targets: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed``; ``robots`` has (host, status, text), a host without a row allows all. Rules are read once a text and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, Robots] = {}
            said = []
            for url, status, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if status is None:
                    said.append(True)
                    continue
                if (status, text) not in known:
                    known[status, text] = Robots(status, text or "", agent)
                parts = urlsplit(url or "")
                said.append(known[status, text].allowed(parts.path + (f"?{parts.query}" if parts.query else "")))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(said, pa.bool_())], names=[*batch.schema.names[3:], "allowed"])

    rules = robots.select(F.lower("host").alias("r_host"), F.col("status").alias("r_status"), F.col("text").alias("r_text"))
    both = targets.withColumn("r_host", authority(F.col("url"))).join(rules, "r_host", "left")
    types = ", ".join(f"`{c}` {t}" for c, t in targets.dtypes)
    return both.select(F.col("url").alias("_u"), "r_status", "r_text", *targets.columns).mapInArrow(run, f"{types}, allowed boolean")


def answered(targets: DataFrame, responses: DataFrame, hops: int = HOPS, max_body: int = MAX_BODY) -> DataFrame:
    """Targets (url, and etag and last_modified as sent, if known) with final_url, status, body, not_modified, got_etag, got_last_modified and error.

    Redirects are followed by joins, each only of the rows that still wander. A validator
    that still holds gives not_modified and no body, and stays as it was sent. Errors: no
    answer, too many redirects, a redirect off http(s), a body that is too large, a bad status.
    """
    r = responses.select(F.col("url").alias("at"), "status", "body", "location", F.col("etag").alias("got_etag"), F.col("last_modified").alias("got_last_modified"))
    sent = targets if "etag" in targets.columns else targets.withColumns({c: F.lit(None).cast("string") for c in ("etag", "last_modified")})
    rest, done = sent.withColumn("at", F.col("url")), None
    for hop in range(hops + 1):
        here = rest.join(r, "at", "left")
        moved = F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()
        here = checkpoint(here.withColumn("moved", F.coalesce(moved, F.lit(False))))
        last = here.where("not moved") if hop < hops else here
        done = last if done is None else done.unionByName(last)
        on = here.where("moved")
        if hop == hops or on.isEmpty():
            break
        rest = on.withColumn("at", F.coalesce(resolved(F.col("at"), F.col("location")), F.lit(""))).select(*sent.columns, "at")
    same = F.coalesce(F.col("got_etag") == F.col("etag"), F.lit(False)) | (F.col("got_etag").isNull() & F.coalesce(F.col("got_last_modified") == F.col("last_modified"), F.lit(False)))
    error = (
        F.when(F.col("at") == "", "redirect").when(F.col("moved"), "redirects").when(F.col("status").isNull(), "no answer")
        .when((F.col("status") == 304) | ((F.col("status") == 200) & same), "").when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status"))).when(F.octet_length("body") > max_body, "too big").otherwise("")
    )
    out = done.withColumn("error", error).withColumn("not_modified", (F.col("error") == "") & ((F.col("status") == 304) | same))
    kept = lambda c: F.when(F.col("not_modified"), F.coalesce(c, f"got_{c}")).otherwise(F.col(f"got_{c}")).alias(f"got_{c}")
    return out.select(*sent.columns, F.col("at").alias("final_url"), "status", F.when((F.col("error") == "") & ~F.col("not_modified"), F.col("body")).alias("body"), "not_modified", kept("etag"), kept("last_modified"), "error")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kind, loc, lastmod) of the entries of sitemaps. Columns: body, path."""
    for batch in batches:
        for i in range(batch.num_rows):  # a body at a time
            kind, entries = parse_sitemap(batch.column(0)[i].as_py() or b"")
            path = batch.column(1)[i].as_py()
            for at in range(0, len(entries), OUT_ROWS):
                part = entries[at : at + OUT_ROWS]
                paths = pa.array([[*path, k] for k in range(at, at + len(part))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([paths, pa.array([kind] * len(part), pa.string()), pa.array([loc for loc, _ in part], pa.string()), pa.array([mod for _, mod in part], pa.string())], names=["path", "kind", "loc", "lastmod"])


def sitemap_tree(root: str, responses: DataFrame, depth: int = DEPTH, children: int = CHILDREN) -> DataFrame:
    """(url, hints, pos) of a sitemap and those that it refers to, a level a join; pos is the place in depth-first order, as an array.

    SourceFailure if one can't be read, sitemaps nest deeper than ``depth`` levels, there are
    more than ``children`` references or one leaves the host.
    """
    spark = responses.sparkSession
    level = spark.createDataFrame([(root, [])], "url string, path array<int>")
    hosts, seen, found, total = {urlsplit(root).netloc.lower()}, [root], None, 0
    for turn in range(1, depth + 1):
        got = checkpoint(answered(level, responses))
        if bad := got.where("error <> ''").select("url", "error").take(1):
            raise SourceFailure(f"sitemap {bad[0]['url']}: {bad[0]['error']}")
        if turn == 1:
            hosts |= {urlsplit(r["final_url"]).netloc.lower() for r in got.select("final_url").take(1)}
        entries = checkpoint(map_batches(got.select("body", "path"), _maps, "path array<int>, kind string, loc string, lastmod string"))
        leaves = entries.where("kind = 'urlset'")
        found = leaves if found is None else found.unionByName(leaves)
        index = entries.where("kind = 'sitemapindex'")
        if index.isEmpty():
            break
        if turn == depth:
            raise SourceFailure(f"sitemaps nest deeper than {depth} levels")
        total += index.count()
        if total > children:
            raise SourceFailure(f"more than {children} child sitemaps")
        below = index.select(F.regexp_replace(F.trim("loc"), "#.*$", "").alias("url"), "path")
        if off := below.where(~F.coalesce(authority(F.col("url")).isin(sorted(hosts)), F.lit(False))).take(1):
            raise SourceFailure(f"child sitemap {off[0]['url']} is on another site")
        level = below.where(~F.col("url").isin(seen)).groupBy("url").agg(F.min("path").alias("path"))
        seen += [r["url"] for r in level.select("url").collect()]  # ``children`` at most
    hints = F.map_filter(F.create_map(F.lit("lastmod"), F.col("lastmod")), lambda k, v: v != "")
    return found.select(F.col("loc").alias("url"), hints.alias("hints"), F.col("path").alias("pos"))
