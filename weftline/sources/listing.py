"""Listing pages and fixed link lists as candidate sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..html.css import compile_selector
from ..html.page import links
from .xml import SourceFailure

CANDIDATE = "url string, hints map<string,string>, pos int"


def page_links(pages: DataFrame, selector: str, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, hints, pos) of the links that match on each page, with the text of the match as title hint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = compile_selector(selector)
        for batch in batches:
            at, urls, hints, pos = [], [], [], []
            for i, (u, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for k, (found, title) in enumerate(links(h, u or "", want)[0]):
                    at.append(i)
                    urls.append(found)
                    hints.append([("title", title)] if title else [])
                    pos.append(k)
            kept = batch.select(list(keep)).take(pa.array(at, pa.int64())).columns if keep else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array(urls, pa.string()), pa.array(hints, pa.map_(pa.string(), pa.string())), pa.array(pos, pa.int32())], names=[*keep, "url", "hints", "pos"])

    compile_selector(selector)
    types = dict(pages.dtypes)
    return pages.select(F.col(url).alias("_u"), F.col(html).alias("_h"), *keep).mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + CANDIDATE)


def read_listing(start: str, fetch: Callable[[str], tuple[str, str]], link_selector: str, next_selector: str = "", max_pages: int = 5) -> list[tuple[str, dict[str, str]]]:
    """Candidates of a listing and its next pages; a next page off the site is an error, but never on the last page allowed."""
    out: list[tuple[str, dict[str, str]]] = []
    visited: set[str] = set()
    hosts = {urlsplit(start).netloc.lower()}
    url = start
    for turn in range(max_pages):
        if not url or url in visited:
            break
        visited.add(url)
        html, final = fetch(url)
        if not turn:
            hosts.add(urlsplit(final).netloc.lower())
        found, following = links(html, final, compile_selector(link_selector), compile_selector(next_selector) if next_selector else None)
        out.extend((u, {"title": t} if t else {}) for u, t in found)
        if following and turn + 1 < max_pages and urlsplit(following).netloc.lower() not in hosts:
            raise SourceFailure(f"next page {following} is on another site")
        url = following
    return out


def fixed_links(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u, {}, i) for i, u in enumerate(urls)], CANDIDATE)
