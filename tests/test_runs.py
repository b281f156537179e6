"""State that survives stops, runs from discovery to feeds, serving and the commands."""

import json
from datetime import datetime, timezone

import pytest

from weftline import __main__ as commands
from weftline.operators.discovery import DiscoveryFailure
from weftline.operators.state import ConcurrentWrite, Store
from weftline.plans.config import DateField, Discovery, ItemConfig, Site, compile_source
from weftline.plans.serve import Feeds
from weftline.sources.responses import answered, sitemap_tree
from weftline.sources.xml import SourceFailure, read_sitemaps
from weftline.streaming.crawl import crawl, run_when_due
from weftline.streaming.snapshots import run, stream

RESPONSE = "url string, status int, body binary, location string, etag string, last_modified string"
SITE = Site("quay", title="Quay", link="https://quay.example/", description="Ships", max_items=4, discovery=(Discovery("feed", url="https://quay.example/feed"),),
            item=ItemConfig(title=(compile_source("listing:title"), compile_source("css:h1")), canonical=(compile_source("request"),), published=DateField((compile_source("listing:published"), compile_source("meta:date")))))


def at(day, hour=0):
    return datetime(2031, 5, day, hour, tzinfo=timezone.utc)


def page(n, text="Text", date="2031-05-01"):
    meta = f'<meta name="date" content="{date}">' if date else ""
    return f"<html><head>{meta}</head><body><article><h1>Ship {n}</h1><p>{text}</p></article></body></html>"


def feed(*entries):
    items = "".join(f"<item><title>{t}</title><link>https://quay.example/{n}</link><pubDate>{d}</pubDate></item>" for n, t, d in entries)
    return f"<rss version='2.0'><channel>{items}</channel></rss>"


def web(spark, **pages):
    rows = []
    for path, answer in pages.items():
        status, body, etag, *to = answer if isinstance(answer, tuple) else (200, answer, None)
        rows.append((f"https://quay.example/{path}", status, bytearray(body.encode()), to[0] if to else None, etag, None))
    return spark.createDataFrame(rows, RESPONSE)


def rows(store, table="items"):
    return {r["url"].rpartition("/")[2]: r for r in store.read(table).collect()}


def snapshot(store):
    return sorted((r["site_id"], r["guid"], r["content_hash"], r["missing_since"]) for r in store.read("items").collect())


def pages_of(spark, *ns, text="Text", date="2031-05-01"):
    return spark.createDataFrame([(f"https://quay.example/{n}", page(n, text, date), n) for n in ns], "url string, html string, ord int")


def test_a_stop_anywhere_leaves_the_last_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    run(store, SITE, pages_of(spark, 1, 2), at(1))
    before = snapshot(store)
    assert len(before) == 2
    for stop in ("_commit", "_folder"):
        with monkeypatch.context() as m:
            m.setattr(Store, stop, lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                run(store, SITE, pages_of(spark, 1, 2, 3, text="Edited"), at(2))
        assert snapshot(Store(spark, str(tmp_path / "s"))) == before
    # A manifest that was cut short doesn't count, nor do files that no manifest names.
    (tmp_path / "s" / "manifest-00000099.json").write_text('{"schema_version": 2, "tab')
    assert snapshot(Store(spark, str(tmp_path / "s"))) == before


def test_two_writers_dont_overwrite_each_other(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    run(one, SITE, pages_of(spark, 1), at(1))
    stale = two._manifest()
    run(one, SITE, pages_of(spark, 1, 2), at(2))
    with pytest.raises(ConcurrentWrite):
        two._commit(stale)
    assert len(snapshot(two)) == 2


def test_a_run_writes_its_own_site_only(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Site("pier", item=SITE.item)
    run(store, SITE, pages_of(spark, 1, 2), at(1))
    folder = store._manifest()["tables"]["items"]["quay"]
    run(store, other, pages_of(spark, 7), at(1))
    assert store._manifest()["tables"]["items"]["quay"] == folder and store.read("items", "pier").count() == 1 and store.read("items").count() == 3
    run(store, SITE, pages_of(spark, 1, 2, 3), at(2))
    run(store, SITE, pages_of(spark, 1, 2, 3), at(3))
    store.vacuum(keep=1)
    assert store.read("items").count() == 4 and not (tmp_path / "s" / folder).exists()


def test_state_of_the_first_schema_is_migrated(spark, tmp_path):
    seed = Store(spark, str(tmp_path / "seed"))
    run(seed, SITE, pages_of(spark, 1, 2), at(1))
    run(seed, Site("pier", item=SITE.item), pages_of(spark, 3), at(1))
    old = tmp_path / "old"
    seed.read("items").write.parquet(str(old / "items" / "v3"))
    (old / "manifest.json").write_text(json.dumps({"schema_version": 1, "tables": {"items": 3}}))
    store = Store(spark, str(old))
    assert snapshot(store) == snapshot(seed) and store.read("items", "pier").count() == 1


def test_batches_of_an_open_crawl_mark_nothing_as_missing(spark, tmp_path):
    for n in (1, 2):
        pages_of(spark, n).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
    source = lambda: spark.readStream.schema("url string, html string, ord int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    store = Store(spark, str(tmp_path / "open"))
    stream(source(), store, SITE, str(tmp_path / "c1"), lambda n: at(n + 1)).awaitTermination(180)
    assert len(rows(store)) == 2 and all(r["missing_since"] is None for r in rows(store).values())
    found = spark.createDataFrame([("https://quay.example/2",)], "url string")
    store = Store(spark, str(tmp_path / "closed"))
    stream(source(), store, SITE, str(tmp_path / "c2"), lambda n: at(n + 1), lambda n: found).awaitTermination(180)
    assert {n: r["missing_since"] is None for n, r in rows(store).items()} == {"1": False, "2": True}


def test_undated_pages_are_counted_and_make_a_run_unhealthy(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    got = run(store, SITE, pages_of(spark, 1, 2, 3, date=None), at(1))
    assert (got["no_date"], got["discovered"], got["unhealthy"]) == (3, 3, 1) and "without a date" in store.read("site_state", "quay").first()["last_error"]
    assert run(store, SITE, pages_of(spark, 1, 2, 3), at(2))["unhealthy"] == 0


def test_crawl_from_feed_to_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    listed = [(n, f"Ship {n}", f"0{n} May 2031 10:00:00 GMT") for n in range(1, 7)]
    answers = {str(n): (200, page(n), f"e{n}") for n in range(1, 7)}
    first = crawl(store, SITE, web(spark, feed=feed(*listed), **answers), at(10))
    assert (first["discovered"], first["fetched"], first["new"]) == (6, 4, 4), "the newest four of six"
    assert set(rows(store)) == {"3", "4", "5", "6"} and rows(store, "validators")["5"]["etag"] == "e5"
    answers |= {"3": (200, page(3, "Other"), "new"), "4": (404, "", None), "5": (301, "", None, "/moved"), "moved": (200, page(5), "e5")}
    robots = spark.createDataFrame([("quay.example", 200, "User-agent: *\nDisallow: /6")], "host string, status int, text string")
    again = crawl(store, SITE, web(spark, feed=feed(*listed), **answers), at(11), robots)
    assert (again["not_modified"], again["updated"], again["errors"], again["new"]) == (1, 1, 2, 0)
    renamed = [(n, f"Vessel {n}", d) for n, _, d in listed]
    last = crawl(store, SITE, web(spark, feed=feed(*renamed[1:]), **answers), at(12))
    assert last["not_modified"] == 0, "a changed hint makes a validator useless"
    assert rows(store)["6"]["title"] == "Vessel 6"


def test_failing_discovery_leaves_items(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    run(store, SITE, pages_of(spark, 1), at(1))
    for answers in ({"feed": (500, "", None)}, {"other": "x"}):
        with pytest.raises(DiscoveryFailure):
            crawl(store, SITE, web(spark, **answers), at(2))
    state = store.read("site_state", "quay").first()
    assert rows(store)["1"]["missing_since"] is None and "feed" in state["last_error"] and state["last_success_at"] == datetime(2031, 5, 1)


def test_redirects_and_sizes(spark):
    big = web(spark, a=(302, "", None, "b"), b=(302, "", None, "c"), c=(200, "there", "x"), d=(302, "", None, "javascript:1"), f=(200, "y" * 50, None))
    sent = spark.createDataFrame([(f"https://quay.example/{p}", "x" if p == "a" else None, None) for p in "abdfz"], "url string, etag string, last_modified string")
    got = {r["url"][-1]: (r["final_url"][-1:], r["not_modified"], r["error"]) for r in answered(sent, big, max_body=40).collect()}
    assert got == {"a": ("c", True, ""), "b": ("c", False, ""), "d": ("", False, "redirect"), "f": ("f", False, "too big"), "z": ("z", False, "no answer")}
    assert {r["error"] for r in answered(sent.where("url like '%/a'"), big, hops=1).collect()} == {"redirects"}


def nested(levels, last="https://quay.example/leaf"):
    index = lambda u: f"<sitemapindex><sitemap><loc>{u}</loc></sitemap></sitemapindex>"
    files = {f"m{i}": index(f"https://quay.example/m{i + 1}#part") for i in range(levels)}
    return files | {f"m{levels}": f"<urlset><url><loc>{last}</loc><lastmod>2031</lastmod></url></urlset>"}


def test_sitemaps_nest_three_levels_deep(spark):
    for levels, fine in ((0, True), (2, True), (3, False)):
        files = nested(levels)
        fetch = lambda u, files=files: (files[u.rpartition("/")[2]].encode(), u)
        if fine:
            assert read_sitemaps("https://quay.example/m0", fetch) == [("https://quay.example/leaf", {"lastmod": "2031"})]
            assert [(r["url"], len(r["pos"])) for r in sitemap_tree("https://quay.example/m0", web(spark, **files)).collect()] == [("https://quay.example/leaf", levels + 1)]
        else:
            with pytest.raises(SourceFailure, match="deeper"):
                read_sitemaps("https://quay.example/m0", fetch)
            with pytest.raises(SourceFailure, match="deeper"):
                sitemap_tree("https://quay.example/m0", web(spark, **files))
    with pytest.raises(SourceFailure, match="another site"):
        sitemap_tree("https://quay.example/m0", web(spark, m0="<sitemapindex><sitemap><loc>https://far.example/</loc></sitemap></sitemapindex>"))
    with pytest.raises(SourceFailure, match="no answer"):
        sitemap_tree("https://quay.example/none", web(spark, a="x"))


def test_sites_run_when_they_are_due():
    now, ran = [0.0], []
    sites = [Site("a", interval=50.0), Site("b", interval=30.0), Site("c", interval=1000.0)]

    def one(site):
        ran.append((site.id, now[0]))
        now[0] += 5
        if site.id == "b":
            raise ValueError("a failing run")

    def wait(seconds):
        now[0] += seconds

    run_when_due(sites, one, lambda: now[0], wait, lambda: len(ran) >= 7)
    assert ran == [("a", 0.0), ("b", 5.0), ("c", 10.0), ("b", 35.0), ("a", 50.0), ("b", 65.0), ("b", 95.0)]


def test_served_feeds(spark, tmp_path):
    clock = [at(3)]
    store = Store(spark, str(tmp_path / "s"))
    feeds = Feeds(store, [SITE], "https://feeds.example", lambda: clock[0])
    get = lambda path, **headers: feeds.answer("GET", path, {k.replace("_", "-"): v for k, v in headers.items()})
    assert get("/feeds/quay.xml")[0] == 503 and get("/feeds/quay.xml")[1]["Retry-After"] and get("/feeds/none.xml")[0] == 404 and get("/readyz")[0] == 503
    assert feeds.refresh(SITE) == {"quay.xml": ["has no items"], "quay.atom": ["has no items"]} and get("/feeds/quay.xml")[0] == 503
    run(store, SITE, pages_of(spark, 1, 2), at(2))
    assert feeds.refresh(SITE) == {"quay.xml": [], "quay.atom": []} and get("/readyz")[0] == 200
    status, head, body = get("/feeds/quay.xml")
    assert status == 200 and b"<item>" in body and head["Content-Type"].startswith("application/rss+xml")
    assert get("/feeds/quay.xml", if_none_match=f'W/{head["ETag"]}')[0] == 304 and get("/feeds/quay.xml", if_modified_since=head["Last-Modified"])[0] == 304
    assert get("/feeds/quay.xml", if_none_match='"other"', if_modified_since=head["Last-Modified"])[0] == 200
    clock[0] = at(4)
    later = Feeds(store, [SITE], "https://feeds.example", lambda: clock[0])  # after a restart: same content, same stamps
    later.refresh(SITE)
    assert later.answer("GET", "/feeds/quay.xml", {})[1]["Last-Modified"] == head["Last-Modified"]
    assert feeds.answer("HEAD", "/", {})[2] == b"" and feeds.answer("POST", "/", {})[0] == 405 and b"quay.xml" in get("/feeds.opml")[2] and get("/healthz")[2] == b"ok\n" and get("/nothing")[0] == 404
    told = []
    assert feeds({"REQUEST_METHOD": "GET", "PATH_INFO": "/feeds/quay.xml", "HTTP_IF_NONE_MATCH": head["ETag"]}, lambda s, h: told.append(s)) == [b""] and told == ["304 Not Modified"]


CONFIG = """public_base_url: https://feeds.example
"""
SITE_FILE = """id: quay
version: 1
channel: {title: Quay, link: 'https://quay.example/', description: Ships}
discovery: [{type: feed, url: 'https://quay.example/feed'}]
item:
  title: ['css:h1']
  published: {sources: ['meta:date']}
  content: {selector: article}
"""


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "sites").mkdir()
    (tmp_path / "sites" / "quay.yaml").write_text(SITE_FILE)
    (tmp_path / "weftline.yaml").write_text(CONFIG)
    config = ["--config", str(tmp_path / "weftline.yaml")]
    listed = [(n, f"Ship {n}", f"0{n} May 2031 10:00:00 GMT") for n in (1, 2)]
    web(spark, feed=feed(*listed), **{"1": page(1), "2": page(2)}).write.parquet(str(tmp_path / "web"))
    web(spark, feed=feed(*listed), **{"1": page(1), "2": (500, "", None)}).write.parquet(str(tmp_path / "bad"))
    assert commands.main(["version"]) == 0 and commands.main([*config, "lint"]) == 0
    assert commands.main([*config, "check", "--responses", str(tmp_path / "web")]) == 0
    assert "Ship 1" in capsys.readouterr().out
    assert commands.main([*config, "check", "quay", "--json", "--url", "https://quay.example/2", "--responses", str(tmp_path / "bad")]) == 1
    (told,) = json.loads(capsys.readouterr().out)
    assert told["error"] == "status 500" and told["ok"] is False
    assert commands.main([*config, "build", "--responses", str(tmp_path / "web")]) == 0
    assert "<item>" in (tmp_path / "public" / "feeds" / "quay.xml").read_text() and (tmp_path / "public" / "feeds.opml").exists()
    kept = (tmp_path / "public" / "feeds" / "quay.xml").read_text()
    web(spark, other="x").write.parquet(str(tmp_path / "none"))
    assert commands.main([*config, "build", "--responses", str(tmp_path / "none")]) == 1 and (tmp_path / "public" / "feeds" / "quay.xml").read_text() == kept
    assert commands.main([*config, "build", "nobody", "--responses", "x"]) == 1
    (tmp_path / "sites" / "quay.yaml").write_text(SITE_FILE.replace("css:h1", "css:h1["))
    assert commands.main([*config, "lint", str(tmp_path / "sites" / "quay.yaml")]) == 1
    with pytest.raises(SystemExit) as e:
        commands.main(["frobnicate"])
    assert e.value.code == 2
