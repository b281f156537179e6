"""Commands: lint, check, build, serve, version. Exit codes: 0 done, 1 something is amiss, 2 the command can't be read."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

from . import __version__
from .plans.config import Global, Site, lint, load

log = logging.getLogger("weftline")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftline")
    p.add_argument("--config", default="weftline.yaml", help="the engine's own file")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("lint").add_argument("files", nargs="*")
    for name in ("check", "build", "serve"):
        c = sub.add_parser(name)
        c.add_argument("sites", nargs="*", help="ids; all if none is named")
        c.add_argument("--responses", required=True, help="a Parquet table of fetched responses")
    check = sub.choices["check"]
    check.add_argument("--url", action="append", default=[])
    check.add_argument("--limit", type=int, default=5)
    check.add_argument("--json", action="store_true")
    sub.choices["serve"].add_argument("--port", type=int)
    return p


def environment(args: argparse.Namespace) -> tuple[Global, list[Site]]:
    """Configuration and the sites that are meant; errors end the command."""
    g, sites, errors = load(args.config)
    if errors or g is None:
        raise SystemExit("\n".join(map(str, errors)))
    unknown = set(args.sites) - {s.id for s in sites}
    if unknown:
        raise SystemExit(f"no site is called {', '.join(sorted(unknown))}")
    logging.basicConfig(level=g.log_level.upper().replace("WARN", "WARNING"), stream=sys.stderr, format='{"time":"%(asctime)s","level":"%(levelname)s","msg":"%(message)s"}' if g.log_format == "json" else "%(asctime)s %(levelname)s %(message)s")
    return g, [s for s in sites if not args.sites or s.id in args.sites]


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .operators.discovery import first_candidates
    from .plans.dryrun import as_json, as_table, checked, rows_of
    from .sources.responses import answered
    from .streaming.crawl import candidates

    if args.limit < 1:
        raise SystemExit("--limit must be 1 or more")
    _, sites = environment(args)
    spark = session()
    responses, good = spark.read.parquet(args.responses), True
    for site in sites:
        if args.url:  # pages named by hand come without hints of a listing
            targets = spark.createDataFrame([(u, {}, i) for i, u in enumerate(args.url)], "url string, hints map<string,string>, ord int")
        else:
            targets = first_candidates(candidates(site, responses), args.limit).select("url", "hints", "ord")
        got = answered(targets, responses).withColumn("html", F.decode("body", "UTF-8"))
        rows = rows_of(checked(got, site), max(args.limit, len(args.url)))
        print(as_json(rows) if args.json else as_table(rows))
        good &= all(r["ok"] for r in rows)
    return 0 if good else 1


def build(args: argparse.Namespace) -> int:
    """Run each site once and write its feeds; the last good ones stay where a run or a document fails."""
    from .operators.state import Store
    from .plans.render import FORMATS, index_page, opml, publish, render, write_atomic
    from .streaming.crawl import crawl

    g, sites = environment(args)
    spark = session()
    store, responses, good = Store(spark, g.store_path), spark.read.parquet(args.responses), True
    now = datetime.now(timezone.utc)
    for site in sites:
        try:
            log.info("%s: %s", site.id, crawl(store, site, responses, now))
        except ValueError as e:
            log.error("%s", e)
            good = False
        state = store.read("site_state", site.id).first()
        for name, fmt in FORMATS.items():
            problems = publish(render(store.read("items", site.id), site, g.public_base_url, state and state["last_change_at"], name), name, str(Path(g.out_dir) / "feeds" / f"{site.id}{fmt.extension}"))
            good &= not problems
            for p in problems:
                log.error("%s%s: %s", site.id, fmt.extension, p)
    write_atomic(str(Path(g.out_dir) / "feeds.opml"), opml(sites, g.public_base_url).encode())
    write_atomic(str(Path(g.out_dir) / "index.html"), index_page(sites, g.public_base_url).encode())
    return 0 if good else 1


def serve(args: argparse.Namespace) -> int:
    from wsgiref.simple_server import make_server

    from .operators.state import Store
    from .plans.serve import Feeds

    g, sites = environment(args)
    feeds = Feeds(Store(session(), g.store_path), sites, g.public_base_url)
    for site in sites:
        feeds.refresh(site)
    host, _, port = g.listen.rpartition(":")
    make_server(host, args.port or int(port), feeds).serve_forever()
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "lint":
        errors = lint(args.files, args.config if Path(args.config).exists() or not args.files else None)
        print("\n".join(map(str, errors)) or "no errors")
        return 1 if errors else 0
    try:
        return {"check": check, "build": build, "serve": serve}[args.command](args)
    except SystemExit as e:
        if isinstance(e.code, str):
            print(e.code, file=sys.stderr)
            return 1
        raise


if __name__ == "__main__":
    sys.exit(main())
