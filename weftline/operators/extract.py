"""Pages to extracted fields: one pass of trees in Python, everything after in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import map_batches
from ..functions.arrays import distinct_ignoring_case, join_names
from ..functions.dates import parse_date
from ..functions.text import excerpt
from ..functions.url import host
from ..html.body import content_stats, measured, normalize, plain_text
from ..html.page import Page
from ..plans.config import ItemConfig, Site

TEXTS = ("canonical", "title", "summary", "author", "image")
_RAW = "url string, base string, " + ", ".join(f"{t} array<string>, {t}_source string" for t in (*TEXTS, "categories")) + ", published_raw array<struct<v:string,s:string>>, updated_raw array<struct<v:string,s:string>>, content string, content_matches int, page_warnings array<string>"
_DATES = pa.list_(pa.struct([("v", pa.string()), ("s", pa.string())]))


def raw_fields(pages: DataFrame, item: ItemConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Values of every configured field of pages (url, html and, if there, final_url, hints), with columns ``keep``."""
    have = set(pages.columns)
    hints = F.col("hints") if "hints" in have else F.lit(None).cast("map<string,string>")
    final = F.coalesce("final_url", "url") if "final_url" in have else F.col("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html, url, hint in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                page = Page(html, url or "", dict(hint or ()))
                row = [url, page.base]
                for name in (*TEXTS, "categories"):
                    values, source = page.values(getattr(item, name), name in ("canonical", "image"))
                    row += [values, source]
                for d in (item.published, item.updated):
                    row.append([{"v": v, "s": s} for v, s in page.date_values(d.sources)])
                rows.append([*row, *page.content(item.selector, item.exclude), page.warnings])
            cols = list(zip(*rows, strict=True)) if rows else [()] * 19
            types = [pa.string(), pa.string(), *[pa.list_(pa.string()), pa.string()] * 6, _DATES, _DATES, pa.string(), pa.int32(), pa.list_(pa.string())]
            names = ["url", "base", *(x for t in (*TEXTS, "categories") for x in (t, f"{t}_source")), "published_raw", "updated_raw", "content", "content_matches", "page_warnings"]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*batch.schema.names[3:], *names])

    types = dict(pages.dtypes)
    slim = pages.select(F.col("html").cast("string"), final.alias("final_url"), hints.alias("hints"), *keep)
    return map_batches(slim, run, "".join(f"`{c}` {types[c]}, " for c in keep) + _RAW)


def _date(raw: Column, layouts: tuple[str, ...], tz: str) -> Column:
    """struct(parsed, s) of the first value that parses."""
    tried = F.transform(raw, lambda x: F.struct(parse_date(x["v"], list(layouts), tz).alias("parsed"), x["s"].alias("s")))
    return F.get(F.filter(tried, lambda x: x["parsed"].isNotNull()), F.lit(0))


def extract(pages: DataFrame, site: Site, keep: tuple[str, ...] = ()) -> DataFrame:
    """The extracted schema: fields, dates with their kind, content, winning sources and warnings.

    Never fails on a page: what can't be found is '' or null and says so in warnings.
    """
    item = site.item
    raw = raw_fields(pages, item, keep)
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    out = raw.withColumns({"published_found": _date(F.col("published_raw"), item.published.layouts, site.timezone), "updated_found": _date(F.col("updated_raw"), item.updated.layouts, site.timezone)})
    source = lambda c: F.nullif(F.col(f"{c}_source"), F.lit(""))
    fields = {c: source(c) for c in (*TEXTS, "categories")} | {"published": F.col("published_found.s"), "updated": F.col("updated_found.s")}
    bad = lambda c, name: F.when(F.col(f"{c}_found").isNull() & (F.size(f"{c}_raw") > 0), F.lit(f"bad {name} date"))
    canonical = first(F.col("canonical"))
    warnings = F.array_compact(F.array(
        F.when((canonical != "") & (host(canonical) != host(F.col("url"))), F.lit("canonical is on another host")),
        F.when(first(F.col("title")) == "", F.lit("no title")),
        F.when(F.col("published_found").isNull(), F.lit("no date")),
        F.when(F.col("content") == "", F.lit("no content")),
        bad("published", "published"), bad("updated", "updated"),
    ))
    return out.select(
        *keep, "url", "base", F.coalesce(F.nullif(canonical, F.lit("")), F.col("url")).alias("canonical"), first(F.col("title")).alias("title"), first(F.col("summary")).alias("summary"),
        join_names(distinct_ignoring_case(F.col("author"))).alias("author"), first(F.col("image")).alias("image"), distinct_ignoring_case(F.col("categories")).alias("categories"),
        F.col("published_found.parsed.time").alias("published"), F.col("published_found.parsed.date_only").alias("published_date_only"), F.col("published_found.s").alias("published_source"),
        F.col("updated_found.parsed.time").alias("updated"), F.col("updated_found.parsed.date_only").alias("updated_date_only"), "content", "content_matches",
        F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("sources"),
        F.concat(F.col("page_warnings"), warnings).alias("warnings"),
    )


def bodies(extracted: DataFrame, site: Site) -> DataFrame:
    """content_html, its plain text and summary (or an excerpt of 300 characters) of extracted rows."""
    keep_image, keep_video = site.item.keep_first_image, site.item.keep_video

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, base, image = (batch.column(c).to_pylist() for c in ("content", "base", "image"))
            html = [normalize(c, b or "", keep_video, i if keep_image else "") if c else "" for c, b, i in zip(content, base, image, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(html, pa.string()), pa.array([plain_text(h) for h in html], pa.string())], names=[*batch.schema.names, "content_html", "content_text"])

    types = ", ".join(f"`{c}` {t}" for c, t in extracted.dtypes)
    out = map_batches(extracted, run, types + ", content_html string, content_text string")
    return out.withColumn("summary", F.when(F.col("summary") == "", excerpt(F.col("content_text"), 300)).otherwise(F.col("summary")))


def html_column(fn, column: Column, returns: str = "string") -> Column:
    """A row function on HTML text as an Arrow-batched expression."""
    return F.udf(fn, returns, useArrow=True)(column)


def normalized_body(c: Column, base: str = "") -> Column:
    return html_column(lambda h: normalize(h or "", base), c)


def text_of(c: Column) -> Column:
    return html_column(plain_text, c)


def stats_of(c: Column) -> Column:
    return html_column(lambda h: content_stats(h or ""), c, "map<string,int>")


_MEASURES = pa.struct([("stats", pa.map_(pa.string(), pa.int32())), ("counts", pa.map_(pa.string(), pa.int32())), ("text", pa.string())])


def measured_of(c: Column) -> Column:
    """struct(stats, counts, text) of bodies: one tree a body, and equal bodies of a batch are read once."""

    def run(bodies: pa.Array) -> pa.Array:
        coded = bodies.fill_null("").dictionary_encode()
        made = [dict(zip(("stats", "counts", "text"), (list(stats.items()), list(counts.items()), text), strict=True)) for stats, counts, text in map(measured, coded.dictionary.to_pylist())]
        return pa.array(made, _MEASURES).take(coded.indices)

    run.__annotations__ = {"bodies": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "stats map<string,int>, counts map<string,int>, text string")(c)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a small file of many rows would be one task, however long its rows take in Python."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
