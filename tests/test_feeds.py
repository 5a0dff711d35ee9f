"""Feeds and sitemaps read element by element."""

from hirescope.sources import feeds, payloads


def item(i, title="Acme: Analyst", **more):
    fields = {"title": f"<![CDATA[{title} {i}]]>", "link": f"https://w.example/{i}", "description": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;",
              "pubDate": "Mon, 06 May 2024 10:00:00 +0000"} | more
    return "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in fields.items()) + "</item>"


def test_one_feed_in_many_splits_gives_the_rows_of_the_whole(spark, tmp_path):
    text = "<rss><channel><title>Feed</title>\n" + "\n".join(item(i, region="Ohio") for i in range(3000)) + "\n</channel></rss>"
    (tmp_path / "feed.xml").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = feeds.elements(spark, str(tmp_path / "feed.xml"), "item", feeds.RSS)
        assert rows.rdd.getNumPartitions() > 4
        got = feeds.feed_postings(rows).select("title", "company", "url", "location", "description", "posted_at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = payloads.weworkremotely(spark.createDataFrame([(text,)], "payload string")).select(
        "title", "company", "url", "location", "description", "posted_at").collect()
    assert sorted(got) == sorted(whole) and len(got) == 3000


def test_a_broken_item_costs_only_itself(spark, tmp_path):
    bad = "<item><title>half</tit></item>"
    (tmp_path / "a.xml").write_text("<rss><channel>" + item(1) + bad + item(2) + "</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel></channel></rss>")
    rows = feeds.elements(spark, str(tmp_path), "item", feeds.RSS)
    assert sorted(r.url for r in feeds.feed_postings(rows).collect()) == ["https://w.example/1", "https://w.example/2"]
    [row] = feeds.broken(rows).collect()
    assert "half" in row.raw and row.file.endswith("a.xml")


def test_a_sitemap_by_its_links(spark, tmp_path):
    link = "https://j.org/jobs/data-analyst-columbus-ohio-united-states-0a1b2c3d-0000-1111-2222-0123456789ab/{}"
    urls = "".join(f"<url><loc> {link.format(i)} </loc><lastmod>2024-05-01</lastmod></url>" for i in range(5))
    text = f"<urlset><url><loc>https://j.org/about</loc></url>{urls}</urlset>"
    (tmp_path / "map.xml").write_text(text)
    got = feeds.sitemap_postings(feeds.elements(spark, str(tmp_path), "url", feeds.SITEMAP), "acme", "/jobs/")
    want = payloads.sitemap(spark.createDataFrame([(text, "acme")], "payload string, company string"), "/jobs/")
    cols = ["title", "company", "url", "location", "posted_at", "external_id"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect()) and got.count() == 5
