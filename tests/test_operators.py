"""State machine, planning, sources, feeds and control rules on small tables."""

import gzip
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weftline.functions.dates import parse_date
from weftline.operators import merge, planning, report
from weftline.operators.state import Store
from weftline.plans import control, render
from weftline.plans.config import DateField, ItemConfig, Site, compile_source
from weftline.sources.listing import read_listing
from weftline.sources.xml import SourceFailure, parse_feed, parse_sitemap, read_sitemaps
from weftline.streaming.snapshots import run, stream

UTC = timezone.utc


def source(*raw):
    return tuple(compile_source(r) for r in raw)


def site(**item):
    return Site("s", title="S", link="https://e.example/", description="D", max_items=3, item=ItemConfig(title=source("css:h1"), canonical=source("css:link[rel=canonical]@href", "request"), published=DateField(source("meta:date")), **item))


def page(n, text="text", canonical=None, date=None, url=None):
    head = (f'<link rel=canonical href="{canonical}">' if canonical else "") + (f'<meta name=date content="{date}">' if date else "")
    return (url or f"https://e.example/{n}", f"<head>{head}</head><body><article><h1>T{n}</h1><p>{text}</p></article>", n)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string, ord int")


def items(store):
    return {r["guid"]: r for r in store.read("items").collect()}


def day(d, h=0):
    return datetime(2026, 9, d, h, tzinfo=UTC)


def test_life_of_items(spark, tmp_path):
    store, s = Store(spark, str(tmp_path / "state")), site()
    first = run(store, s, pages(spark, page(1, date="2026-09-01"), page(2), page(3, text="", date="2026-09-01")), day(10))
    assert first["new"] == 3 and first["errors"] == 0, "a heading alone is content"
    got = items(store)
    assert got["https://e.example/1"]["published_source"] == "meta:date (date)" and got["https://e.example/2"]["published_source"] == "first_seen"
    again = run(store, s, pages(spark, page(1, "edited", date="2026-09-01"), page(2), page(4)), day(11))
    assert (again["new"], again["updated"], again["unchanged"]) == (1, 1, 1)
    got = items(store)
    one, three = got["https://e.example/1"], got["https://e.example/3"]
    assert one["updated_at"] is not None and one["published_at"] == datetime(2026, 9, 1, 0, 0, 0, 998000) and one["first_seen_at"] == datetime(2026, 9, 10)
    assert three["missing_since"] == datetime(2026, 9, 11) and got["https://e.example/2"]["updated_at"] is None
    run(store, s, pages(spark, page(3, "", date="2026-09-01"), page(1, "edited", date="2026-09-05")), day(12))
    got = items(store)
    assert got["https://e.example/3"]["missing_since"] is None and got["https://e.example/4"]["missing_since"] is not None
    assert got["https://e.example/1"]["published_at"].day == 5, "the source moved its date"
    assert store.read("site_state").collect()[0]["last_success_at"] is not None


def test_moved_page_keeps_its_item(spark, tmp_path):
    store, s = Store(spark, str(tmp_path / "state")), site()
    run(store, s, pages(spark, page(1, canonical="https://e.example/a")), day(1))
    out = run(store, s, pages(spark, page(1, canonical="https://e.example/a", url="https://e.example/moved")), day(2))
    got = items(store)
    assert list(got) == ["https://e.example/a"] and out["updated"] == 1
    assert got["https://e.example/a"]["url"] == "https://e.example/moved" and got["https://e.example/a"]["updated_at"] is None


def test_stable_hash_items_never_match_by_canonical(spark, tmp_path):
    store, s = Store(spark, str(tmp_path / "state")), site(guid="stable-hash")
    run(store, s, pages(spark, page(1, canonical="https://e.example/a"), page(2, canonical="https://e.example/a")), day(1))
    assert len(items(store)) == 2


def test_nothing_found_leaves_items(spark, tmp_path):
    store, s = Store(spark, str(tmp_path / "state")), site()
    run(store, s, pages(spark, page(1)), day(1))
    with pytest.raises(ValueError, match="found nothing"):
        run(store, s, pages(spark), day(2))
    assert items(store)["https://e.example/1"]["missing_since"] is None and store.read("site_state").collect()[0]["last_error"]


def test_stream_equals_runs(spark, tmp_path):
    folder = tmp_path / "in"
    for n, rows in enumerate(([page(1), page(2)], [page(1, "edited"), page(2)])):
        pages(spark, *rows).coalesce(1).write.mode("append").parquet(str(folder / f"b={n}"))
    s, plain = site(), Store(spark, str(tmp_path / "plain"))
    for n in range(2):
        run(plain, s, spark.read.parquet(str(folder / f"b={n}")), day(n + 1))
    streamed = Store(spark, str(tmp_path / "streamed"))
    feed = spark.readStream.schema("url string, html string, ord int").option("maxFilesPerTrigger", 1).parquet(str(folder / "b=*"))
    q = stream(feed, streamed, s, str(tmp_path / "cp"), lambda n: day(n + 1))
    q.awaitTermination(180)
    assert q.exception() is None
    strip = lambda store: sorted((r["guid"], r["content_hash"], r["updated_at"]) for r in store.read("items").collect())
    assert strip(streamed) == strip(plain)


def test_newest_only(spark):
    known = spark.createDataFrame([("s", f"k{i}", day(i)) for i in (5, 6)], "site_id string, url string, published_at timestamp")
    fresh = [("s", "a", {"published": "2026-09-07"}, 0), ("s", "b", {"published": "2026-09-01"}, 1), ("s", "c", {"published": "2026-09-08T00:00:00Z"}, 2)]
    schema = "site_id string, url string, hints map<string,string>, ord int"
    now = F.lit("2026-09-20 00:00:00").cast("timestamp")
    got = planning.newest_only(spark.createDataFrame(fresh, schema), known, site(), now)
    assert sorted(r["url"] for r in got.collect()) == ["a", "c"]
    undated = planning.newest_only(spark.createDataFrame([*fresh, ("s", "d", {}, 3)], schema), known, site(), now)
    assert undated.count() == 4


@pytest.mark.parametrize(
    ("raw", "want", "date_only"),
    [
        ("2026-09-17T07:00:00-07:00", "2026-09-17 14:00:00", False), ("2026-09-17T07:00:00.123Z", "2026-09-17 07:00:00.123", False), ("2026-09-17", "2026-09-17 07:00:00", True), ("Thu, 17 Sep 2026 07:00:00 +0000", "2026-09-17 07:00:00", False),
        ("Thu, 7 Sep 2026 07:00:00 GMT", "2026-09-07 07:00:00", False), ("17 Sep 2026 07:00:00 -0100", "2026-09-17 08:00:00", False), ("2026-09-17 10:00:00", "2026-09-17 17:00:00", False), ("Sep 7, 2026", "2026-09-07 07:00:00", True),
        ("2026-01-17", "2026-01-17 08:00:00", True), ("yesterday", None, None), ("2026", None, None), ("", None, None),
    ],
)
def test_dates(spark, raw, want, date_only):
    p = parse_date(F.lit(raw), ["Jan 2, 2006"], "America/Los_Angeles")
    r = spark.range(1).select(F.date_format(p["time"], "yyyy-MM-dd HH:mm:ss.SSS").alias("t"), p["date_only"].alias("d")).first()
    assert (r["t"] or "").removesuffix(".000") == (want or "") and r["d"] == date_only


RSS = b"""<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><atom:link href="https://e.example/f"/>
<item><title>A &amp; B &nbsp; C</title><link>/a</link><pubDate>Thu, 17 Sep 2026 07:00:00 GMT</pubDate><category>x</category><category> y </category></item>
<item><title>guid</title><guid>https://e.example/g</guid><dc:creator>Ann</dc:creator><dc:date>2026-01-02</dc:date></item><item><guid isPermaLink="false">no</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:base="https://e.example/b/"><entry><title type="html">&lt;b&gt;T&lt;/b&gt;</title><link rel="edit" href="no"/><link href="x"/><updated>2026-01-02T00:00:00Z</updated><author><name>A</name></author><category term="c"/></entry><entry><title>none</title></entry></feed>"""


def test_feeds():
    one, two = parse_feed(RSS, "https://e.example/")
    assert one == ("https://e.example/a", {"title": "A & B C", "published": "Thu, 17 Sep 2026 07:00:00 GMT", "category": "x\ny"})
    assert two == ("https://e.example/g", {"title": "guid", "author": "Ann", "published": "2026-01-02"})
    assert parse_feed(ATOM, "https://x.example/") == [("https://e.example/b/x", {"title": "T", "published": "2026-01-02T00:00:00Z", "updated": "2026-01-02T00:00:00Z", "author": "A", "category": "c"})]
    with pytest.raises(SourceFailure):
        parse_feed(b"<html></html>", "")


def test_sitemaps():
    leaf = lambda *u: "<urlset xmlns='x'>" + "".join(f"<url><loc> {v} </loc><lastmod>2026-01-01 </lastmod></url>" for v in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{v}</loc></sitemap>" for v in u) + "</sitemapindex>"
    files = {"https://e.example/0": index("https://e.example/1", "https://e.example/2", "https://e.example/1"), "https://e.example/1": leaf("https://e.example/a"), "https://e.example/2": leaf("https://e.example/b")}
    fetch = lambda u: (gzip.compress(files[u].encode()), u)
    assert read_sitemaps("https://e.example/0", fetch) == [("https://e.example/a", {"lastmod": "2026-01-01 "}), ("https://e.example/b", {"lastmod": "2026-01-01 "})]
    files["https://e.example/2"] = index("https://other.example/x")
    with pytest.raises(SourceFailure, match="another site"):
        read_sitemaps("https://e.example/0", fetch)
    with pytest.raises(SourceFailure, match="not a sitemap"):
        parse_sitemap(b"<rss/>")


def test_listing_pages():
    files = {"https://e.example/l": '<a class=p href="/1">One</a><a class=n href="/l2">next</a>', "https://e.example/l2": '<h2 class=p><a href="2">Two</a></h2><a class=n href="https://other.example/">next</a>'}
    fetch = lambda u: (files[u], u)
    want = [("https://e.example/1", {"title": "One"}), ("https://e.example/2", {"title": "Two"})]
    assert read_listing("https://e.example/l", fetch, ".p", ".n", 2) == want
    with pytest.raises(SourceFailure, match="another site"):
        read_listing("https://e.example/l", fetch, ".p", ".n", 3)


def test_feed_documents(spark):
    rows = [("s", "https://e.example/b", "https://e.example/b", "Second <post>", "Summary & more", "<p>Body with ]]> inside\x01</p>", "Ann", ["News"], day(17, 14), day(25), "https://cdn.example/b.png?w=1"), ("s", "5f0c7d0e-1111-5222-8333-444455556666", "https://e.example/a", "", "", "<p>a</p>", "", [], day(1), None, "")]
    table = spark.createDataFrame(rows, "site_id string, guid string, url string, title string, summary string, content_html string, author string, categories array<string>, published_at timestamp, updated_at timestamp, image_url string").withColumn("first_seen_at", F.col("published_at"))
    s = site()
    rss = render.render(table.where("title <> ''"), s, "https://f.example", day(24), "rss")
    for part in ("<title>Second &lt;post&gt;</title>", "<description>Summary &amp;amp; more</description>", "<content:encoded><![CDATA[<p>Body with ]]]]><![CDATA[> inside</p>]]></content:encoded>", '<guid isPermaLink="true">https://e.example/b</guid>', "<pubDate>Thu, 17 Sep 2026 14:00:00 +0000</pubDate>", '<media:content url="https://cdn.example/b.png?w=1" medium="image"></media:content>'):
        assert part in rss
    assert render.RSS.check(rss) == [] and "\x01" not in rss and "<enclosure" not in rss
    atom = render.render(table.where("title <> ''"), s, "https://f.example", day(24), "atom")
    assert render.ATOM.check(atom) == [] and "<updated>2026-09-25T00:00:00Z</updated>" in atom
    both = render.render(table, s, "https://f.example", None, "rss")
    assert render.RSS.check(both) == ["number 2: title or description is absent or empty", "number 2: permalink is no http(s) address: '5f0c7d0e-1111-5222-8333-444455556666'"]


def test_bad_feed_never_replaces_a_good_one(tmp_path):
    path = tmp_path / "f.xml"
    path.write_text("old")
    assert render.publish("<rss", "rss", str(path)) and path.read_text() == "old"
    assert "opml" in render.opml([site()], "https://f.example") and "<ul>" in render.index_page([site()], "https://f.example")


def test_public_addresses():
    public = ["1.1.1.1", "93.184.215.14", "223.255.255.1", "2001:4860:4860::8888", "2a00:1450::1"]
    special = ["0.1.2.3", "10.20.30.40", "172.31.0.9", "192.168.77.1", "127.8.8.8", "169.254.1.1", "100.100.0.7", "198.19.4.4", "230.1.1.1", "255.255.255.255", "::", "::1", "fe80::7", "fc12::1", "ff02::5", "::ffff:192.168.0.3", "64:ff9b::7f00:1", "2002:a00::1", "host", "1.2.3", ""]
    assert all(control.public_address(a) for a in public) and not any(control.public_address(a) for a in special)


def test_robots_rules():
    text = "# comment\nUser-Agent: other\nUser-Agent: reader\nDisallow: /drafts\nAllow: /drafts/open\nDisallow: /*.pdf$\nDisallow:\n\nUser-agent: *\nDisallow: /\n"
    r = control.Robots(200, text, "Reader/2.1")
    assert [p for p in ("/", "/drafts", "/drafts/1", "/drafts/open/2", "/a/b.pdf", "/a/b.pdf?x", "/robots.txt") if r.allowed(p)] == ["/", "/drafts/open/2", "/a/b.pdf?x", "/robots.txt"]
    assert not control.Robots(200, text, "another").allowed("/x") and control.Robots(200, "", "another").allowed("/x")
    assert not control.Robots(500, "", "reader").allowed("/x") and control.Robots(410, text, "reader").allowed("/drafts")


def test_waits_and_rates():
    assert control.wait_before(2, 7.5) == 7.5 and control.wait_before(1, control.MAX_WAIT + 1) is None and control.wait_before(control.ATTEMPTS, 1.0) is None
    assert all(0.5 * 2 ** (n - 1) <= control.backoff(n) <= 1.5 * 2 ** (n - 1) for n in (1, 2, 3) for _ in range(50))
    b = control.Bucket(control.host_rates([("a.example", 4.0), ("A.example", 0.25), ("b.example", 1.0)])["a.example"])
    assert [b.take(10), b.take(11), b.take(30)] == [0, 3, 0]


def test_checks_of_items(spark):
    rows = [("s", 1, "g", "t", "https://e.example/", "c", day(5)), ("s", 2, "g", "", "x", "", day(6)), ("s", 3, "", "t", "https://e.example/", "c", None)]
    df = spark.createDataFrame(rows, "site_id string, rank int, guid string, title string, url string, content_html string, published_at timestamp").withColumn("summary", F.lit(""))
    got = {(r["rank"], r["problem"]) for r in report.item_problems(df).collect()}
    assert got == {(2, "has neither title nor description"), (2, "link is no http(s) address"), (2, "content is empty"), (2, "is newer than the item before it"), (2, "guid stands at item 1 too"), (3, "has no guid"), (3, "has no date")}


def test_store_refuses_newer_schema(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"schema_version": 99, "tables": {}}')
    with pytest.raises(ValueError, match="newer"):
        Store(spark, str(tmp_path))


def test_entry_registers_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"clean_url", "merge_items", "render_rss_item"} <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert merge.COLUMNS[0] == "site_id"
