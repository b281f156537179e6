"""Extraction without storing anything: what a site's configuration finds on some pages, as rows, a table or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract
from .config import Site

FIELDS = ("title", "canonical", "published", "updated", "author", "summary", "image", "categories", "content_matches", "content", "sources", "warnings")


def checked(pages: DataFrame, site: Site) -> DataFrame:
    """Extracted pages (url, html and perhaps hints) with ``error`` as it came with the page, and ``ok``: no error, a title and content."""
    errors = pages.select(F.col("url").alias("of"), (F.coalesce("error", F.lit("")) if "error" in pages.columns else F.lit("")).alias("error"))
    out = extract(pages, site).select("url", *FIELDS).join(errors, F.col("url") == F.col("of")).drop("of")
    return out.withColumn("ok", (F.col("error") == "") & (F.col("title") != "") & (F.col("content") != ""))


def _plain(v: object) -> object:
    return v.strftime("%Y-%m-%dT%H:%M:%SZ") if hasattr(v, "strftime") else v


def rows_of(found: DataFrame, limit: int) -> list[dict]:
    """The first ``limit`` by URL; a dry run looks at a few pages."""
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in found.orderBy("url").limit(limit).collect()]


def as_json(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True)


def as_table(rows: list[dict], width: int = 72) -> str:
    """A block a page: each field in one line, cut to the width, with the source that gave it."""
    cut = lambda s: s if len(s) <= width else s[: width - 1] + "…"
    out = []
    for r in rows:
        out.append(f"{'ok ' if r['ok'] else 'BAD'} {r['url']}" + (f"  ({r['error']})" if r["error"] else ""))
        for k in FIELDS[:-2]:
            value = r[k]
            text = ", ".join(value) if isinstance(value, list) else f"{len(value)} characters" if k == "content" else "" if value is None else str(value)
            source = (r["sources"] or {}).get(k, "")
            out.append(f"    {k:<16}{cut(' '.join(text.split()))}" + (f"  [{source}]" if source else ""))
        out += [f"    ! {w}" for w in r["warnings"]]
    return "\n".join(out) + "\n"
