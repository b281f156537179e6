"""What larger and odder tables have shown."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import catalogue, catalogue_more
from weftline.batches import BATCH_BYTES, map_batches
from weftline.html import body
from weftline.plans import control
from weftline.sources.responses import answered


def test_a_body_is_measured_on_one_tree(monkeypatch):
    made = []
    one = body.fragment
    monkeypatch.setattr(body, "fragment", lambda html: made.append(html) or one(html))
    stats, counts, text = body.measured("<p>ab</p><pre><code>x</code></pre><img src=a><table></table>")
    assert len(made) == 1 and text == "ab x" and counts == {"code": 1, "img": 1, "p": 1, "pre": 1, "table": 1}
    assert stats == {"chars": 4, "blocks": 4, "img": 1, "pre": 1, "table": 1, "embeds": 0}


def test_a_long_site_lists_its_pages_in_several_feeds(spark, tmp_path, monkeypatch):
    spark.range(120).selectExpr("id AS page_id", "'<h1>t</h1><article>' || id || '</article>' AS html").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(catalogue_more, "FEED", 50)
    monkeypatch.setattr(answered, "__defaults__", (10, 6000))  # a feed of all pages has over 8,000 bytes
    got = {r["page_id"]: r for r in catalogue.queries()["crawl_runs"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [k for k in range(120) if k % 10 != 3]
    assert all(r["title"] == f"Page {k}" and (r["missing"] == "2024-02-02") == (k % 10 == 9) for k, r in got.items())


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Titles cut within a reference, two pages of one address, documents without text, parts in special ranges."""
    folder = tmp_path_factory.mktemp("odd")
    titles = ["A &amp; b", "Cut &", "Cut &a", "Cut &am", "Cut &amp", "Cut &quo", "Say &quot", "Say &quot;x&quot;", "&copy; x", "Plain"]
    page = lambda k, t: f"<html><body><article><h1>{t}</h1><p>{t} it's &lt;1&gt; &amp;am<br>b</article></body></html>"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [(k, f"https://e.example/{k // 2}", page(k, titles[k % 10])) for k in range(30)])
    con.execute("create table documents as select k as doc_id, case when k % 5 = 3 then '' else 'text ' || k end as text, 'en' as lang, 'web' as source, 6::bigint as n_chars from range(40) t(k)")
    con.execute("create table part as select k as p_partkey from range(65536) t(k)")
    for name in ("pages", "documents", "part"):
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["public_addr", "run_stats", "extract_title", "extract_content", "body_normalize", "check_pages", "site_runs"])
def test_odd_tables_give_what_the_sql_gives(spark, odd, name):
    folder, con = odd
    found = con.execute(catalogue.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = catalogue.queries()[name](spark, str(folder)).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_special_ranges_are_not_public(spark):
    k = F.col("id")
    made = spark.range(65536).select(F.concat_ws(".", (k % 256).cast("string"), F.floor(k / 256).cast("string"), F.lit("7"), F.lit("9")).alias("ip"))
    assert all(r["said"] == control.public_address(r["ip"]) for r in made.select("ip", control.public_ipv4(F.col("ip")).alias("said")).collect())


def test_made_sitemaps_get_more_not_longer(spark, tmp_path):
    spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-05 00:00:00' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    counts = [r["body"].count("<loc>") for r in catalogue_more._locs(spark, str(tmp_path), 10).collect()]
    assert sum(counts) == 3000 and max(counts) <= 10


def test_bodies_reach_a_worker_in_bounded_batches(spark):
    rows = spark.range(5000).selectExpr("id", "repeat('x', 4000) AS t").coalesce(1)
    sizes = map_batches(rows, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 5000 and max(r["size"] for r in sizes) < 2 * BATCH_BYTES
