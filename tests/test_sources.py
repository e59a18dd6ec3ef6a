import json

import fixtures as fx
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions.binding import TEXT_TASKS
from contentflow.operators import audit
from contentflow.plans import dumps
from contentflow.sources import articles, cards, feeds, opml, pages, providers, robots
from contentflow.sources.clean import with_clean_body
from contentflow.sources.elements import _plain, _Reader, page_elements, read, rule_tests, selector, squeeze

DAY = 86_400_000
JAN3 = 1_704_240_000_000  # 2024-01-03


def raw(spark, *docs):
    rows = [{"source_id": "s", "seq": i, "status": 200, "url": "https://e.org/feed", "content_type": "", **d} for i, d in enumerate(docs)]
    names = schemas.columns(schemas.RAW_FETCH)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.RAW_FETCH)


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:dc="d" xmlns:media="m"><channel><title> My  feed </title>
<image><url>/logo.png</url></image>
<item><title>First &amp; best</title><link>/a?x=1</link><pubDate>Tue, 02 Jan 2024 23:30:00 -0500</pubDate><description>&lt;p&gt;One&lt;/p&gt;&lt;p&gt;two &amp;amp; three&lt;/p&gt;</description>
<content:encoded><![CDATA[ <p>Body <b>x</b></p> ]]></content:encoded><dc:creator>Ann</dc:creator><media:content url="/m.png"/></item>
<item><title>No link but guid</title><guid isPermaLink="true">https://e.org/g</guid><enclosure url="/e.mp3"/></item>
<item><title> </title><link>/untitled</link></item>
<item><title>My feed</title><link>/somewhere</link></item>
<item><title>GitHub</title><link>https://github.com/me</link></item>
<item><title>Sparse post</title><link>/sparse</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Atom</title><icon>/i.ico</icon><entry><title type="html">E</title>
<link rel="self" href="/self"/><link rel="alternate" href="/alt"/><updated>2024-01-03T01:00:00+02:00</updated><author><name>Bob</name></author><summary>Sum</summary></entry></feed>"""
JSON_FEED = json.dumps(
    {"version": "https://jsonfeed.org/version/1.1", "title": "", "favicon": "/f.ico",
     "items": [{"id": "https://e.org/j1", "title": "J", "content_html": "<p>a</p><p>b</p>", "date_modified": "2024-01-03T23:00:00-09:00", "authors": [{"name": "Cy"}], "image": "//c.org/i.png"}, {"id": "x"}]}
)


def test_feeds(spark):
    docs = raw(spark, dict(text=RSS), dict(text=ATOM), dict(text=JSON_FEED))
    rows = fx.as_dicts(feeds.parse_feeds(docs), "url")
    assert set(rows) == {"https://e.org/a?x=1", "https://e.org/g", "https://e.org/sparse", "https://e.org/alt", "https://e.org/j1"}
    first = rows["https://e.org/a?x=1"]
    assert (first["title"], first["author"], first["published_at"], first["summary"]) == ("First & best", "Ann", JAN3, "One two & three")
    assert (first["feed_content_html"], first["image_url"]) == ("<p>Body <b>x</b></p>", "https://e.org/m.png")
    assert rows["https://e.org/g"]["image_url"] == "https://e.org/e.mp3"
    atom = rows["https://e.org/alt"]
    assert (atom["title"], atom["author"], atom["published_at"], atom["summary"]) == ("E", "Bob", JAN3 - DAY, "Sum")
    item = rows["https://e.org/j1"]
    assert (item["author"], item["published_at"], item["summary"], item["image_url"]) == ("Cy", JAN3, "a b", "https://c.org/i.png")


def test_feed_heads_icons_and_rejects(spark):
    docs = raw(spark, dict(text=RSS, source_id="a"), dict(text=ATOM, source_id="b", url="http://localhost/feed"), dict(text=JSON_FEED, source_id="c"), dict(text='{"a":1}', source_id="d"), dict(text="{broken", source_id="e"))
    heads = {r["source_id"]: (r["title"], r["icon_url"]) for r in feeds.feed_heads(docs).collect()}
    assert heads == {"a": ("My feed", "https://e.org/logo.png"), "b": ("Atom", "http://localhost/i.ico"), "c": ("e.org", "https://e.org/f.ico")}
    assert {r["source_id"] for r in feeds.feed_icons(docs).collect()} == {"a", "c"}
    assert sorted(r["source_id"] for r in feeds.parse_json_feeds(docs)[1].collect()) == ["d", "e"]


def test_long_bodies_are_kept_whole(spark):
    items = spark.createDataFrame([("x" * 300_000,), ("  ",)], "v string").select(F.length(feeds.feed_html(F.col("v"))).alias("n")).collect()
    assert [r["n"] for r in items] == [300_000, None]


@pytest.mark.parametrize(
    "kind, body, want",
    [("application/rss+xml", "x", True), ("text/html", "  {}", True), ("text/html", "<rss>", False), ("text/html", "<?xml version='1.0'?> <feed>", True), ("text/html", "<html>", False), (None, "<html>", False)],
)
def test_sniff(spark, kind, body, want):
    row = spark.createDataFrame([(kind, body)], "k string, b string").select(feeds.is_feed(F.col("k"), F.col("b")).alias("f")).first()
    assert row["f"] is want


def test_opml(spark):
    text = """<opml version="2.0"><body><outline text="News"><outline title=" Tech  world "><outline title="One" xmlUrl=" https://One.example.org/feed/ "/>
    <outline text="dup" xmlUrl="https://one.example.org/feed?utm_source=a"/></outline><outline text="folder only"/></outline>
    <outline text="Local" xmlurl="http://localhost:1200/x"/><outline text="Private" xmlUrl="http://10.0.0.1/x"/><outline text="Known" xmlUrl="https://known.example.org/"/></body></opml>"""
    deep = "<opml><body>" + "".join(f"<outline text='folder {i}'>" for i in range(12)) + "<outline text='leaf' xmlUrl='https://deep.example.org/'/>" + "</outline>" * 12 + "</body></opml>"
    parsed = opml.parse_opml(raw(spark, dict(text=text), dict(text=deep), dict(text="<html/>"), dict(text="<opml><body/></opml>"), dict(text="no xml")))
    rows = parsed.orderBy("seq", "pos").collect()
    good = [r for r in rows if r["problem"] is None]
    assert [(r["title"], r["category"]) for r in good[:3]] == [("One", "News / Tech world"), ("dup", "News / Tech world"), ("Local", None)]
    assert good[-1]["category"] == " / ".join(f"folder {i}" for i in range(12))
    assert sorted(r["seq"] for r in rows if r["problem"]) == [2, 3, 4]
    fresh, counts = opml.import_opml(parsed.where("seq = 0"), fx.sources(spark, dict(id="k", url="https://known.example.org")))
    assert tuple(counts.first()) == (2, 2, 1)
    assert {(r["title"], r["loopback"]) for r in fresh.collect()} == {("One", False), ("Local", True)}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private # secret\nAllow: /\nUser-agent: other\nDisallow: /o\nUSER-AGENT: ContentFlow\nDisallow: /mine\nDisallow:\nno separator"
    rules = robots.robots_rules(raw(spark, dict(url="https://a.org/robots.txt", text=text), dict(url="https://b.org/robots.txt", text=text, status=404)))
    assert {tuple(r) for r in rules.collect()} == {("https://a.org", "/private"), ("https://a.org", "/mine")}
    targets = spark.createDataFrame([("https://a.org/private/x",), ("https://a.org/ok",), ("https://a.org/mine?x",), ("https://b.org/private",), ("http://a.org/private",)], "url string")
    assert {r["url"] for r in robots.filter_robots(targets, rules).collect()} == {"https://a.org/ok", "https://b.org/private", "http://a.org/private"}


def test_tree_closes_what_html_leaves_open():
    page = read("<p><b>one<br><p>two</p><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table><script>if (a<b) {}</script>")
    found = lambda tag: [e for e in page.elements if e.tag == tag]
    assert [squeeze(page.text(e)) for e in found("p")] == ["one", "two"]
    assert [squeeze(page.text(e)) for e in found("li")] == ["a", "bc", "c"]
    assert len(found("tr")) == 2 and len(found("td")) == 3
    assert "if" not in "".join(t for _, t in page.pieces) and found("script")[0].own == "if (a<b) {}"
    assert all(page.elements[i].last >= e.last for e in page.elements for i in e.above)


def test_selectors():
    page = read('<div id="main" class="post-list x"><a data-k="a/b" href="/seg/1">t</a><span class="y"></span></div><div class="x:y"></div>')
    main, anchor, _, other = page.elements
    matches = lambda e, source: selector(source)(page, e)
    assert matches(anchor, 'a[href*="/seg/"]') and matches(anchor, "#main a") and matches(anchor, "b, div.post-list.x a[data-k]")
    assert not matches(anchor, "span a") and not matches(anchor, "[data-k='a']") and matches(other, r".x\:y") and matches(main, "*")
    for unsupported in ("li > a", "li:first-child", "a +b", "", "a,,b"):
        with pytest.raises(ValueError):
            selector(unsupported)
    assert rule_tests("{broken")[1] and rule_tests("[1]")[1] and rule_tests('{"itemRootSelector":"li > a"}')[1] and rule_tests(None) == ({}, None)


def cleaned(spark, *bodies, url="https://e.org/p/"):
    """Cleaned HTML of ``(html, title, summary, scientific)``, in order."""
    rows = [(i, url, *body, *(None, None, False)[len(body) - 1 :]) for i, body in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "i bigint, url string, html string, title string, summary string, scientific boolean")
    out = with_clean_body(frame, "html", "url", "title", "summary", "scientific")
    return [r["clean"] for r in sorted(out.collect(), key=lambda r: r["i"])]


def test_hostile_markup_ends_no_job(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    tex = '<p>see \\url{http://10.0.0.1/a} and \\href{https://e.org/b}{B} <img src="/i.png" alt="\\url{https://e.org/x}"></p><pre>\\url{https://e.org/y}</pre>'
    nested, clean = cleaned(spark, (deep,), (tex,))
    assert nested == deep
    assert 'href="http://10' not in clean and '<a href="https://e.org/b">B</a>' in clean and '<pre>\\url{https://e.org/y}</pre>' in clean and clean.count("<a ") == 1
    broken = pages.extract_listing(page(spark, cards_html(3), "{broken"))
    assert broken[1].first()["method"] == "cards"


def test_bodies_are_cleaned_node_by_node(spark):
    """Pictures, links, headings and the lead of bodies of several shapes, beside repeated, empty and missing ones."""
    got = cleaned(
        spark,
        ('<figure><picture><source srcset="/w.webp 300w, /big.webp 900w"><img src="/s.png"></picture><a href="/x"><img src="/big.webp"></a></figure><p>t<img src="/s.png"></p>',),
        ('<div><noscript>&lt;img src="/n.png" alt="q"&gt;</noscript><p>z</p></div><div><img class="lazy"><noscript><img src="/lazy.png"></noscript></div>',),
        ('<h2>T <a class="headerlink" href="#x">#</a></h2><h2>U</h2><div class="post-meta">m</div><ul><li>a<li>b</ul>', "T"),
        ('<div>nav</div><div><p>meta</p><p>This is the lead sentence of it.</p><p>x<br>y</p></div><div id="comments">c</div>', "", "This is the lead sentence of it", True),
        ('<a href="/q"></a><a href="javascript:1">k</a><input type=checkbox><a href="/z"><b>x &lt; y</b></a>',),
        ('<div><img src="/a-100x200.png"><img src="/a.png"><img src="/b.png"></div><img src="/b.png">',),
        ("<p>a &amp; b</p>",), ("<p>a &amp; b</p>",), ("",), (None,),
    )
    assert got == [
        '<figure><picture><img src="https://e.org/big.webp"></picture></figure><p>t<img src="https://e.org/s.png"></p>',
        '<div><img src="https://e.org/n.png" alt="q"><p>z</p></div><div><img src="https://e.org/lazy.png"></div>',
        "<h2>U</h2><ul><li>a</li><li>b</li></ul>",
        "<div><p>This is the lead sentence of it.</p><p>x<br>y</p></div>",
        '<a href="https://e.org/q">https://e.org/q</a>k<span>☐ </span><a href="https://e.org/z"><b>x &lt; y</b></a>',
        '<div><img src="https://e.org/a-100x200.png"><img src="https://e.org/b.png"></div><img src="https://e.org/b.png">',
        "<p>a &amp; b</p>", "<p>a &amp; b</p>", "", "",
    ]


def page(spark, html, rule=None, url="https://e.org/blog/"):
    return spark.createDataFrame([(1, url, html, rule)], "page_id bigint, url string, html string, rule string")


def cards_html(n, cls="post-card", date=True):
    stamp = '<time datetime="2024-01-{:02d}T09:00:00Z"></time>' if date else ""
    return "".join(
        f'<article class="{cls}"><h2><a href="/post/{i}">Post number {i} of many</a></h2>{stamp.format(i % 28 + 1)}<p class="meta">by</p><p>A summary that is clearly longer than forty characters {i}</p><img src="/i{i}.png"></article>' for i in range(n)
    )


def test_cards_and_confidence(spark):
    entries, result = pages.extract_listing(page(spark, f"<title>Blog</title>{cards_html(3)}<nav><li>x</li></nav>"))
    rows = fx.as_dicts(entries, "entry_url")
    assert set(rows) == {f"https://e.org/post/{i}" for i in range(3)}
    one = rows["https://e.org/post/2"]
    assert (one["title"], one["published_at"], one["summary"], one["image_url"]) == ("Post number 2 of many", JAN3, "A summary that is clearly longer than forty characters 2", "https://e.org/i2.png")
    outcome = result.first()
    assert (outcome["method"], outcome["selector"], outcome["fallback"]) == ("cards", "article", False)
    assert outcome["confidence"] == pytest.approx(0.45 + 0.15 + min(3, 2.8 + 0.24) * 0.08)


def test_large_archives_are_read_whole(spark):
    items = "".join(f'<li>2024-01-{i % 28 + 1:02d} <a href="/p/{i}">Entry {i} of the long archive</a><p>{"text " * 12}</p></li>' for i in range(731))
    assert pages.extract_listing(page(spark, f"<ul>{items}</ul>"))[0].count() == 731
    assert pages.extract_listing(page(spark, f"<ul>{items}</ul>", '{"itemRootSelector":"li"}'))[0].count() == 731


def test_json_ld_wins(spark):
    record = {"@graph": [{"@type": ["Thing", "NewsArticle"], "headline": "H", "url": "/n", "datePublished": "2024-01-03", "author": {"name": "N"}}, {"@type": "Person", "name": "no"}, {"itemListElement": [{"item": {"@type": "Article", "name": "L", "mainEntityOfPage": {"@id": "/l"}}}]}]}
    html = f'<script type="application/ld+json">{json.dumps(record)}</script><script type="application/ld+json">{{bad</script>{cards_html(5)}'
    entries, result = pages.extract_listing(page(spark, html))
    assert {(r["title"], r["entry_url"], r["author"]) for r in entries.collect()} == {("H", "https://e.org/n", "N"), ("L", "https://e.org/l", None)}
    assert (result.first()["method"], result.first()["confidence"]) == ("json_ld", 0.91)


def test_rules_apply_heal_and_fall_back(spark):
    fits = '{"itemRootSelector":"article.post-card","titleSelector":"h2","summarySelector":".meta"}'
    entries, result = pages.extract_listing(page(spark, cards_html(3), fits))
    assert result.first()["method"] == "rule" and {r["summary"] for r in entries.collect()} == {"by"}
    narrow = '{"itemRootSelector":"a[href*=\\"/post/1\\"]"}'
    result = pages.extract_listing(page(spark, cards_html(40), narrow))[1].first()
    assert (result["method"], result["rule_replaced"]) == ("cards", True)
    own = '{"itemRootSelector":"a[href*=\\"/post/1\\"]","titleSelector":"a"}'
    assert pages.extract_listing(page(spark, cards_html(40), own))[1].first()["method"] == "rule"
    gone = pages.extract_listing(page(spark, cards_html(4), '{"itemRootSelector":".gone"}'))
    assert gone[1].first()["method"] == "fallback" and gone[0].count() == 1


def test_fallback_card(spark):
    html = '<head><meta property="og:title" content="OG"><meta property="og:url" content="/o"><meta name="description" content=" d "><meta property="article:published_time" content="2024-01-03"></head><article><h1>x</h1></article>'
    row = pages.extract_listing(page(spark, html))[0].first()
    assert (row["title"], row["entry_url"], row["summary"], row["published_at"]) == ("OG", "https://e.org/o", "d", JAN3)


def test_date_only_from_the_title_header(spark):
    inside = '<article><header><h1>T</h1><span class="byline">Jan 3, 2024</span></header><p>2020-01-01</p></article>'
    beside = '<article><h1>T</h1><aside class="date">2020-01-01</aside></article>'
    days = [pages.extract_listing(page(spark, html))[0].first()["published_at"] for html in (inside, beside)]
    assert days == [JAN3, None]


def test_single_cards_only_for_calibration(spark):
    html = cards_html(1)
    assert pages.extract_listing(page(spark, html))[1].first()["method"] == "fallback"
    shown = pages.calibration_candidates(page(spark, html)).collect()
    assert shown and {r["entries"] for r in shown} == {1}
    assert "文章卡片（1 篇，单篇监测）" in {r["label"] for r in shown}
    linked = pages.calibration_candidates(page(spark, cards_html(6))).collect()
    assert "「/post/」文章链接（6 篇）" in {r["label"] for r in linked}


def test_discovery(spark):
    html = '<link rel="stylesheet" href="/a.css"><link rel="alternate" type="application/atom+xml" href="/atom"><a href="/about">about</a><a href="rss.xml">i</a><a href="?format=rss">Subscribe</a><a href="/atom">again</a>' + "".join(f'<a href="/feed/{i}">f</a>' for i in range(9))
    got = [r["feed_url"] for r in pages.discover_feeds(page(spark, html)).orderBy("rank").collect()]
    assert got == ["https://e.org/atom", "https://e.org/blog/rss.xml", "https://e.org/blog/?format=rss"] + [f"https://e.org/feed/{i}" for i in range(9)]
    assert [r["feed_url"] for r in pages.discover_feeds(page(spark, html), 2).orderBy("rank").collect()] == got[:2]


def test_date_enrichment(spark):
    rows = [("s", i, f"https://e.org/{i}", None) for i in range(40)] + [("s", 50, "https://e.org/2024/01/03/x", None), ("s", 51, "https://e.org/k", 7)]
    entries = spark.createDataFrame(rows, "source_id string, seq bigint, url string, published_at bigint")
    dates = entries.select("url", F.lit(5).cast("bigint").alias("article_day"))
    got = {r["seq"]: r["published_at"] for r in pages.enrich_dates(entries, dates).collect()}
    assert [got[i] for i in (0, 31, 32, 39, 50, 51)] == [5, 5, 5, 5, JAN3, 7]


ARTICLE = """<html><head><meta property="og:image" content="/cover-300x200.png"><meta name="author" content=" Ann "></head><body><main>site chrome {filler}</main><article>
<header>head</header><h1>The title</h1><p class="x" onclick="e()">By Ann | 2024-01-03 | 3 min</p><p>{filler}</p><div class="related-posts">more</div>
<figure><noscript><img src="/pic.png" alt="n"></noscript><img data-src="/pic-100x50.png"></figure><p><a href="javascript:x()">bad</a> <a href="/ok">ok</a> <img src="http://127.0.0.1/x.png"> \\url{{https://e.org/tex}}</p>
<img src="/cover.png"><script>bad()</script><details><summary>s</summary>d</details><input type="checkbox" checked></article></body></html>"""


def test_article_body(spark):
    html = ARTICLE.format(filler="plain words " * 30)
    row = articles.extract_articles(spark.createDataFrame([(1, "https://e.org/p", html)], "page_id bigint, url string, html string")).first()
    body = row["content_html"]
    assert (row["title"], row["author"], row["priority"], row["render_profile"]) == ("The title", "Ann", 7, "standard")
    for gone in ("script", "onclick", "javascript", "127.0.0.1", "related", "head", "The title", "By Ann", "class="):
        assert gone not in body
    assert body.count("pic") == 1 and '<a href="https://e.org/ok">ok</a>' in body and "<details open>" in body and "☑" in body
    assert '<a href="https://e.org/tex">https://e.org/tex</a>' in body
    assert row["cover_image_url"] is None  # the same picture stands in the body


def test_scientific_pages_start_at_the_lead(spark):
    html = '<div id="content"><div id="PostContent"><div>首页 nav</div><div><p>meta</p><p>This is the lead sentence of the post and more.</p><p>$x$</p></div><div id="comments">c</div></div></div>'
    frame = spark.createDataFrame([(1, "https://kexue.fm/a", html, "This is the lead sentence of the post and")], "page_id bigint, url string, html string, entry_summary string")
    row = articles.extract_articles(frame).first()
    assert row["render_profile"] == "scientific" and row["text"].startswith("This is the lead") and "首页" not in row["text"]


def test_short_containers_are_no_article(spark):
    frame = spark.createDataFrame([(1, "https://e.org/a", "<article>tiny</article>"), (2, "https://e.org/b", "<p>" + "body text " * 20)], "page_id bigint, url string, html string")
    assert [r["page_id"] for r in articles.extract_articles(frame).collect()] == [2]


def test_fallback_chain(spark):
    rows = fx.entries(
        spark, *[dict(canonical_url=f"https://e.org/{n}", id=n, source_id="f", original_url=f"https://e.org/{n}?utm_source=q", summary="A summary <b> with enough text") for n in ("page", "body", "summary")],
        dict(canonical_url="https://e.org/web", id="web", source_id="w", summary="A summary with enough text in it"), dict(canonical_url="https://e.org/image", id="image", source_id="f"), dict(canonical_url="https://e.org/none", id="none", source_id="f", summary="short"),
    )
    shown = spark.createDataFrame([("https://e.org/page?utm_source=q", "<p>page</p>", 300)], "url string, content_html string, text_length int")
    items = spark.createDataFrame(
        [("f", 1, "https://e.org/page", "<p>unused</p>"), ("f", 2, "https://e.org/body/#c", "<p onclick=x>feed body that is long enough</p>"), ("f", 3, "https://e.org/summary", "<p>tiny</p>"), ("f", 4, "https://e.org/image", '<img src="/i.png">'), ("w", 5, "https://e.org/web", "<p>feed body that is long enough</p>")],
        "source_id string, seq bigint, url string, feed_content_html string",
    )
    got = fx.as_dicts(articles.article_with_fallback(rows, shown, items, fx.sources(spark, dict(id="f"), dict(id="w", kind="generic"))), "id")
    assert {k: r["content_mode"] for k, r in got.items()} == {"page": "article", "body": "feed_body", "summary": "feed_summary", "web": "unavailable", "image": "feed_body", "none": "unavailable"}
    assert got["body"]["content_html"] == "<p>feed body that is long enough</p>" and got["summary"]["content_html"] == "<p>A summary &lt;b&gt; with enough text</p>"


def test_posts(spark):
    dump = {
        "username": "me", "data": [
            {"id": "5", "text": " hello\nworld ", "created_at": "2024-01-03T10:00:00.000Z", "entities": {"urls": [{"url": ""}, {"url": "https://t.co/1", "expanded_url": "https://long.example.org"}]}},
            {"id": "6", "text": "reply", "in_reply_to_user_id": "1"}, {"id": "7", "text": "rt", "referenced_tweets": [{"type": "retweeted", "id": "1"}]},
            {"id": "8", "text": "quote", "referenced_tweets": [{"type": "quoted", "id": "1"}]}, {"id": "9", "text": "  "},
        ],
    }
    frame = raw(spark, dict(text=json.dumps(dump)))
    rows = fx.as_dicts(providers.parse_posts(frame), "external_id")
    assert set(rows) == {"5", "8"}
    assert (rows["5"]["url"], rows["5"]["title"], rows["5"]["published_at"]) == ("https://x.com/me/status/5", "hello world", JAN3 + 36_000_000)
    links = {r["post_id"]: r["external_url"] for r in providers.post_links(providers.post_rows(frame)).collect()}
    assert links["5"] == "https://long.example.org" and links["8"] is None


def test_failed_searches(spark):
    rows = spark.createDataFrame([("a", 1)], "source_id string, n int")
    statuses = spark.createDataFrame([("a", "p", False), ("b", "p", False), ("b", "q", False), ("c", "p", False), ("c", "q", True)], "source_id string, provider string, ok boolean")
    union, failed = providers.provider_union([rows, rows.withColumn("more", F.lit(1))], statuses)
    assert union.count() == 2 and [r["source_id"] for r in failed.collect()] == ["b"]


def test_follow_cards(spark):
    now = JAN3 + 12 * 3_600_000
    card = '<div class="ContentItem"{attr}><h2>{title}</h2><a href="{href}">read more</a>{time}</div>'
    made = [
        ("/question/1/answer/2", "", "1 小时前", "First title"), ("/p/3", ' data-created-time="1704240000"', "", "Second title"), ("/pin/9", "", "", "Pin title"), ("/p/3", "", "", "Twice title"),
        ("https://zhuanlan.zhihu.com/p/4?spu=biz%3D0", "", "", "Promoted"), ("/zvideo/5", "", "昨天 08:15", "Video title"), ("/p/6", "", "12月30日", "Last year"), ("/p/7", "", "2023年5月6日 07:08", "Exact title"),
    ]
    html = "".join(card.format(title=t, href=h, attr=a, time=f'<span class="Time">{s}</span>') for h, a, s, t in made)
    rows = fx.as_dicts(cards.parse_follow_cards(raw(spark, dict(text=html, url="https://www.zhihu.com/follow")), now), "title")
    assert set(rows) == {"First title", "Second title", "Video title", "Last year", "Exact title"}
    assert {t: r["published_at"] for t, r in rows.items()} == {
        "First title": now - 3_600_000, "Second title": JAN3, "Video title": JAN3 - DAY + 29_700_000, "Last year": JAN3 - 4 * DAY, "Exact title": 1_683_356_880_000,
    }
    assert rows["First title"]["url"] == "https://www.zhihu.com/question/1/answer/2"


def test_notes(spark):
    state = {"a": [{"noteCard": {"noteId": "aaaaaaaa1", "displayTitle": "Card", "cover": {"urlDefault": "//c.org/1.png"}, "time": 1_704_240_000}}, {"noteId": "aaaaaaaa1", "title": "again", "type": "x"}],
             "b": {"noteId": "bbbbbbbb2", "desc": "only a text", "user": {"nickname": " N "}, "createTime": "2024-01-03"}, "c": {"noteId": "short", "title": "t", "type": "x"}, "d": {"noteId": "dddddddd4", "title": "no evidence"}}
    html = f"<script>track()</script><script>window.__INITIAL_STATE__ = {json.dumps(state)}; more()</script><script>{{broken</script>"
    rows = fx.as_dicts(cards.parse_hydration_notes(raw(spark, dict(text=html, url="https://www.xiaohongshu.com/user/profile/u")), 1), "external_id")
    assert set(rows) == {"aaaaaaaa1", "bbbbbbbb2"}
    assert (rows["aaaaaaaa1"]["title"], rows["aaaaaaaa1"]["published_at"], rows["aaaaaaaa1"]["image_url"]) == ("Card", JAN3, "https://c.org/1.png")
    assert (rows["bbbbbbbb2"]["title"], rows["bbbbbbbb2"]["author"], rows["bbbbbbbb2"]["published_at"]) == ("only a text", "N", JAN3)
    many = {"n": [{"noteId": f"note{i:06d}", "title": "t", "type": "x"} for i in range(130)]}
    assert cards.parse_hydration_notes(raw(spark, dict(text=f"<script>{json.dumps(many)}</script>")), 1).count() == 130


def test_source_audit(spark):
    sources = fx.sources(
        spark, dict(id="r", kind="rss", url="https://r.org/feed"), dict(id="conf", kind="generic", extraction_rule='{"feedUrl":"https://c.org/f"}'), dict(id="up", kind="generic"), dict(id="none", kind="generic"),
        dict(id="down", kind="generic"), dict(id="off", kind="generic", polling_enabled=False), dict(id="dead", kind="rss", url="https://dead.org/feed"),
    )
    found = spark.createDataFrame([("https://r.org/feed", 3, 9), ("https://c.org/f", 1, 1), ("https://u.org/2?k=1", 2, 2)], "feed_url string, entries bigint, newest bigint")
    listed = spark.createDataFrame([("up", 1, "https://u.org/1"), ("up", 2, "https://u.org/2?k=1"), ("conf", 1, "https://c.org/f")], "source_id string, rank int, feed_url string")
    answers = spark.createDataFrame([(n, n not in ("down", "dead"), "x" if n != "down" else "failed, token=abc") for n in ("r", "conf", "up", "none", "down", "off", "dead")], "source_id string, ok boolean, message string")
    got = fx.as_dicts(audit.audit_sources(sources, found, listed, answers), "source_id")
    assert {k: r["status"] for k, r in got.items()} == {"r": "ok", "conf": "ok", "up": "upgrade-available", "none": "no-feed", "down": "unreachable", "dead": "unreachable"}
    assert got["up"]["feed_url"] == "https://u.org/2?…" and got["conf"]["candidates"] == 1 and got["down"]["issue"] == "failed, token=[redacted]"


def test_references_count_with_their_semicolon():
    page = read('<title>a &amp;&amp;&amp</title><p>x&ltb &nosuch; &ampfoo; &#65; &#66</p><a href="/q?a=1&copy=2&amp;b=3&amp">t & u</a>')
    assert [t for _, t in page.pieces] == ["a &&&amp", "x&ltb &nosuch; &ampfoo; A &#66", "t & u"]
    assert page.elements[2].attrs == {"href": "/q?a=1&copy=2&b=3&amp"}


def test_notes_of_long_keys_stay_apart(spark):
    keys = [*range(999_992, 1_000_012), *range(12_345_600, 12_345_640)]
    parts = spark.createDataFrame([(k, f"part {k}", "brand", "type") for k in keys], "p_partkey bigint, p_name string, p_brand string, p_type string")
    made = dumps.note_pages(parts)
    assert made.count() == made.select("seq").distinct().count()
    assert cards.parse_hydration_notes(made, 0).count() == len(keys)


# --- reading pages ---

BITS = [
    "<p>", "</p>", '<div class="a b">', "</div>", "text ", "a &amp; b", "&amp", "&#39;x", "<br/>", "<br />", "<img src='x y' alt>", '<a href="/q?a=1&b=2&copy;">', "</a>", "<li>", "<ul>", "</ul>",
    "<script>x<b</script>", '<script type="application/ld+json">{"a":"b &amp; &c"}</script>', "<SCRIPT>a</p>b</script>", "<script>", "</script>", "<style></style>", "<script><!-- x --></script>", "<script />",
    "<!-- c -->", "<!DOCTYPE html>", " \n", "<", "&", "<P Class='X' class=\"y\">", "<td>", "<tr>", "<table>", "</table>", "<a b=c>", "</p >", "<title>T &lt;</title>", "<a href=\"x\"href='y'>", "\ue000",
]


@given(st.lists(st.sampled_from(BITS), max_size=9).map("".join))
@settings(max_examples=500, deadline=None)
def test_plain_pages_are_read_as_by_the_whole_reader(html):
    page = _plain(html)
    whole = _Reader(html).page
    assert page is None or (page == whole and [list(e.attrs) for e in page.elements] == [list(e.attrs) for e in whole.elements])


def test_most_pages_are_plain():
    assert _plain('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="a"><p>b &amp; c<br/>d</p></body></html>') is not None


def test_pages_of_one_file_are_dealt_out(spark):
    """Small pages are one partition by their bytes, however long they take to read."""
    pages = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(64)], "page_id long, html string").coalesce(1)
    named = spark.conf.get(TEXT_TASKS)
    spark.conf.unset(TEXT_TASKS)
    try:
        rows = page_elements(pages)
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert {(r["page_id"], r["pieces"][0]["text"]) for r in rows.collect()} == {(i, str(i)) for i in range(64)}
    finally:
        spark.conf.set(TEXT_TASKS, named)


def test_cards_inside_cards_keep_their_own_texts(spark):
    outer = '<div class="ContentItem"><h2>Outer heading</h2><a href="/p/1">outer read</a><article><h3>Inner heading</h3><a href="/people/me">Me</a><a href="/p/22">inner</a><p>发布于 2024年1月5日 08:30</p></article></div>'
    html = f"<html><p>before</p>{outer}<article><a href='/p/3'>a</a><h2>Third one here</h2></article></html>"
    raw = spark.createDataFrame([(1, "f", None, html)], "seq long, source_id string, url string, text string")
    got = {(r["url"].rsplit("/", 1)[1], r["title"], r["author"], r["published_at"] is not None) for r in cards.parse_follow_cards(raw, 1_706_702_400_000).collect()}
    assert got == {("1", "Outer heading", "Me", True), ("22", "Inner heading", "Me", True), ("3", "Third one here", None, False)}
