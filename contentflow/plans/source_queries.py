"""Parsers, audits and streams as jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import urls
from contentflow.operators import audit, folders, health, merge
from contentflow.operators.normalize import normalize
from contentflow.plans import dumps, roles
from contentflow.plans.queries import query
from contentflow.plans.roles import AS_OF, null, table
from contentflow.session import scratch_path
from contentflow.sources import articles, cards, feeds, opml, pages, probe, providers, robots
from contentflow.sources.clean import with_clean_body
from contentflow.sources.page_facts import page_facts
from contentflow.sources.snapshots import Library
from contentflow.streaming import changes, ingest
from contentflow.streaming import health as health_stream

# --- feeds ---


def _feeds(spark, sf):
    return dumps.feed_documents(table(spark, sf, "documents"))


@query
def feed_sniff(spark, sf):
    """Which fetched documents go to the feed parsers: pages and made feeds together."""
    crawled = dumps.raw_fetch(table(spark, sf, "pages"), url=F.col("url"), content_type=F.lit("text/html"), text=F.col("html"))
    both = crawled.unionByName(_feeds(spark, sf))
    return both.select("url", feeds.is_feed(F.col("content_type"), F.col("text")).alias("is_feed"), feeds.is_feed(F.lit(""), F.col("text")).alias("looks_like_feed"))


@query
def feed_items(spark, sf):
    return feeds.parse_feeds(_feeds(spark, sf)).select("source_id", "seq", "url", "title", "author", "published_at", "summary", F.col("feed_content_html").isNotNull().alias("has_body"))


@query
def feed_heads(spark, sf):
    return feeds.feed_heads(_feeds(spark, sf)).select("feed_url", "title", "icon_url", "items")


@query
def feed_icons(spark, sf):
    return feeds.feed_icons(_feeds(spark, sf))


@query
def feed_json_rejects(spark, sf):
    """Provider answers sent to the JSON Feed parser by mistake: all rejected."""
    raw = dumps.qa_dumps(table(spark, sf, "orders")).unionByName(_feeds(spark, sf))
    return feeds.parse_json_feeds(raw)[1].select("source_id", "seq")


@query
def feed_nav_items(spark, sf):
    """Bare feed items judged as navigation or content."""
    key = F.col("p_partkey")
    url = (
        F.when(key % 4 == 0, F.concat(F.lit("https://github.com/u"), key))
        .when(key % 4 == 1, F.lit("https://news.example.org/feed"))
        .when(key % 4 == 2, F.concat(F.lit("https://news.example.org/post/"), key))
        .otherwise(F.concat(F.lit("https://www.linkedin.com/in/"), key))
    )
    title = F.when(key % 3 == 0, "GitHub").when(key % 3 == 1, "News").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", url.alias("url"), title.alias("title"))
    return rows.select("p_partkey", feeds.is_nav_item(F.col("url"), F.col("title"), F.lit("https://news.example.org/feed"), F.lit("News"), key % 5 != 0).alias("nav"))


@query
def feeds_to_entries(spark, sf):
    """Feeds end to end: parse, normalise, merge."""
    items = feeds.parse_feeds(_feeds(spark, sf))
    made = spark.createDataFrame([(f"feed-{d}",) for d in dumps.DIALECTS], "sid string")
    sources = roles._source_rows(made, id=F.col("sid"), url=F.lit("https://news.example.org/"), kind=F.lit("rss"), connector_id=F.lit("rss"))
    state = merge.merge_entries(schemas.empty_state(spark), normalize(items, sources, AS_OF)).state
    return state.entries.select("canonical_url", "source_id", "title", "published_at", "canonical_identity")


# --- subscription files, robots ---


@query
def opml_outlines(spark, sf):
    return opml.parse_opml(dumps.opml_files(table(spark, sf, "customer"))).select("seq", "pos", "url", "title", "category")


@query
def opml_import(spark, sf):
    outlines = opml.parse_opml(dumps.opml_files(table(spark, sf, "customer")))
    return opml.import_opml(outlines, roles.sources(spark, sf))[1]


@query
def opml_new_sources(spark, sf):
    outlines = opml.parse_opml(dumps.opml_files(table(spark, sf, "customer")))
    return opml.import_opml(outlines, roles.sources(spark, sf))[0]


@query
def robots_rules(spark, sf):
    return robots.robots_rules(dumps.robots_files(table(spark, sf, "pages")))


@query
def robots_allowed(spark, sf):
    crawl = table(spark, sf, "pages")
    return robots.filter_robots(crawl.select("page_id", "url"), robots.robots_rules(dumps.robots_files(crawl)))


# --- pages ---


@query
def feed_discovery(spark, sf):
    made = dumps.listing_pages(table(spark, sf, "part"))
    return pages.discover_feeds(made.select(F.col("seq").alias("page_id"), "url", F.col("text").alias("html")))


@query
def feed_candidates(spark, sf):
    """Configured and discovered feed addresses of every site, each once, configured first."""
    made = dumps.listing_pages(table(spark, sf, "part"))
    found = pages.discover_feeds(made.select(F.col("seq").alias("page_id"), "url", F.col("text").alias("html")))
    configured = made.select(F.lit("https://list.example.org/rss.xml").alias("feed_url"), F.col("seq").alias("rank"))
    joined = merge.distinct_in_order(configured, found.withColumn("rank", F.col("page_id") * 10 + F.col("rank")), key="feed_url", order="rank")
    return joined.select("feed_url", "part")


def _listing(spark, sf):
    made = dumps.listing_pages(table(spark, sf, "part"))
    return made.select(F.col("seq").alias("page_id"), "url", F.col("text").alias("html"))


@query
def page_cards(spark, sf):
    """Entries of list pages: JSON-LD, card and list-item layouts."""
    return pages.extract_listing(_listing(spark, sf))[0].select("page_id", "method", "entry_url", "title", "published_at", "summary")


@query
def page_listing_result(spark, sf):
    """How every list page was read, and the extraction's verdict."""
    result = pages.extract_listing(_listing(spark, sf))[1]
    verdict = pages.needs_review(result)
    return result.join(verdict.drop("confidence"), "page_id").select("page_id", "page_title", "method", "selector", F.round("confidence", 4).alias("confidence"), "requires_review", "initial_status")


@query
def page_rules(spark, sf):
    """List pages read with a saved rule: fitting, too narrow, or finding nothing."""
    rule = F.when(F.col("page_id") % 2 == 0, '{"version":1,"itemRootSelector":"article.post-card","titleSelector":"h2"}').otherwise('{"version":1,"itemRootSelector":".gone"}')
    entries, result = pages.extract_listing(_listing(spark, sf).withColumn("rule", rule))
    counts = entries.groupBy("page_id").agg(F.count("*").alias("entries"))
    return result.join(counts, "page_id").select("page_id", "method", "entries", "rule_replaced")


@query
def page_calibration(spark, sf):
    shown = pages.calibration_candidates(_listing(spark, sf))
    return shown.select("page_id", "rank", "selector", "entries", F.round("confidence", 4).alias("confidence"), "row", "entry_url")


@query
def page_fallback_card(spark, sf):
    """The crawl dump has no lists: every page becomes one card from its own metadata."""
    return pages.extract_listing(table(spark, sf, "pages"))[0].select("page_id", "method", "entry_url", "title")


@query
def date_enrichment(spark, sf):
    """List entries without a date: from the address, else from the article, the first ones per source."""
    key = F.col("o_orderkey")
    url = F.when(key % 3 == 0, F.concat(F.lit("https://e.example.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"), key)).otherwise(F.concat(F.lit("https://e.example.org/"), key))
    orders = table(spark, sf, "orders")
    entries = orders.select(
        F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("source_id"), key.alias("seq"), url.alias("url"), F.when(key % 5 == 0, F.lit(AS_OF)).cast("bigint").alias("published_at")
    )
    dates = orders.where(key % 2 == 0).select(url.alias("url"), roles.ms("o_orderdate").alias("article_day"))
    return pages.enrich_dates(entries, dates)


@query
def page_articles(spark, sf):
    found = articles.extract_articles(table(spark, sf, "pages"))
    return found.select("page_id", "title", F.md5("text").alias("text_md5"), F.col("text_length").cast("bigint").alias("text_length"), "render_profile", F.col("priority").cast("bigint").alias("priority"))


@query
def page_quality(spark, sf):
    """Quality score of every article body, from the counts of its container."""
    return articles.extract_articles(table(spark, sf, "pages")).select("page_id", "quality")


@query
def article_html(spark, sf):
    """Cleaned HTML of every crawled page's body."""
    return articles.extract_articles(table(spark, sf, "pages")).select("page_id", "content_html")


def _cleaned_documents(spark, sf, html, title=None, scientific=None):
    """Document texts inside bodies made around them, cleaned."""
    key = F.col("doc_id")
    bodies = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://e.example.org/a/"), key).alias("url"), html.alias("html"), (F.lit("") if title is None else title).alias("title"),
        F.lit("Quoted words at the end").alias("summary"), (F.lit(False) if scientific is None else scientific).alias("scientific"),
    )
    return with_clean_body(bodies, "html", "url", "title", "summary", "scientific").select("doc_id", F.col("clean").alias("content_html"))


def _paragraph():
    return F.concat(F.lit('<p onclick="x()">'), dumps.escaped(F.coalesce("text", F.lit(""))), F.lit("</p>"))


@query
def article_chrome(spark, sf):
    """Bodies with headers, bylines, repeated titles, heading links, navigation and discussions; on scientific pages with a lead."""
    key = F.col("doc_id")
    name = F.concat(F.lit("Doc "), key)
    html = F.concat(
        F.lit("<header>Site</header><h1>"), name, F.lit('</h1><p>By A | 2024-01-03 | 3 min</p><div class="post-meta x">m</div><h2 id="s">Part<a class="headerlink" href="#s">#</a></h2>'),
        _paragraph(), F.lit("<nav>n</nav><div><p>Quoted words at the end</p></div>"),
        F.when(key % 2 == 0, '<div id="comments"><p>c</p></div>').otherwise(""), F.lit('<div class="entry-footer">f</div>'),
    )
    return _cleaned_documents(spark, sf, html, F.when(key % 5 != 0, name).otherwise("Other"), key % 3 == 0)


@query
def article_images(spark, sf):
    """Bodies whose pictures state their address in several places, twice, or in a noscript only."""
    key = F.col("doc_id")
    ways = [
        '<figure><img src="/s/ID.png" data-src="/d/ID.png" data-original="/o/ID.png"></figure>',
        '<picture><source srcset="/w/ID-300.webp 300w, /w/ID-900.webp 900w"><img src="/s/ID.png"></picture>',
        '<div><img class="lazy" alt=""><noscript><img src="/n/ID.png" alt="n ID"></noscript></div>',
        '<div>t<noscript><img src="/n/ID.png" alt="n &amp; ID"></noscript></div>',
        '<figure><img src="/p/ID-200x100.png"><a href="/p/ID.png"><img src="/p/ID.png#x"></a><figcaption>c</figcaption></figure><p><img src="/p/ID.png"></p>',
        '<div><img src="http://10.0.0.8/ID.png"><img data-src="/p/ID-20x10.png"><noscript><img src="/p/ID.png" alt="a ID"></noscript></div>',
    ]
    way = F.get(F.array(*[F.lit(w) for w in ways]), (key % len(ways)).cast("int"))
    return _cleaned_documents(spark, sf, F.concat(F.replace(way, F.lit("ID"), key.cast("string")), _paragraph()))


@query
def page_dates(spark, sf):
    """Publication statements found in list pages and the crawl dump."""
    both = _listing(spark, sf).unionByName(table(spark, sf, "pages").select((F.lit(10**9) + F.col("page_id")).alias("page_id"), "url", "html"))
    facts = page_facts(both, ["head"], keep=["page_id"]).drop("html")
    return facts.select("page_id", pages.page_day(F.col("head.dates")).alias("published_at"))


@query
def article_fallback(spark, sf):
    """What to show per document entry: its page, the feed's body, its summary, or nothing."""
    documents = table(spark, sf, "documents")
    key = F.col("doc_id")
    url = F.concat(F.lit("https://news.example.org/a/"), key)
    entries = documents.select(
        F.concat(F.lit("e"), key).alias("id"), F.when(key % 7 == 0, "web").otherwise("feed").alias("source_id"), url.alias("canonical_url"), F.concat(url, F.lit("?utm_source=z")).alias("original_url"),
        F.lit("t").alias("title"), F.when(key % 3 != 0, F.concat(F.lit("A stored summary of the document number "), key)).alias("summary"),
    )
    shown = documents.where(key % 5 == 0).select(F.concat(url, F.lit("?utm_source=z")).alias("url"), F.lit("<p>page</p>").alias("content_html"), F.lit(300).alias("text_length"))
    items = documents.where(key % 2 == 0).select(F.lit("feed").alias("source_id"), key.alias("seq"), F.concat(url, F.lit("/#x")).alias("url"), dumps.escaped(F.col("text")).alias("feed_content_html"))
    sources = roles._source_rows(spark.createDataFrame([("feed", "rss"), ("web", "generic")], "sid string, skind string"), id=F.col("sid"), kind=F.col("skind"))
    return articles.article_with_fallback(entries, shown, items, sources).select("id", "content_mode", (F.length("content_html") > 0).alias("has_html"))


def _probed(spark, sf):
    """List pages, crawl dump and feeds as one dump; half the list pages find their feed in it."""
    lists = dumps.listing_pages(table(spark, sf, "part"))
    crawl = dumps.raw_fetch(table(spark, sf, "pages"), source_id=F.lit("crawl"), seq=F.lit(10**6) + F.col("page_id"), url=F.col("url"), content_type=F.lit("text/html"), text=F.col("html"))
    item = F.concat(F.lit("<item><title>From the feed "), F.col("seq"), F.lit("</title><link>/f/"), F.col("seq"), F.lit("</link></item>"))
    found = lists.where(F.col("seq") % 2 == 0).withColumns(
        {
            "text": F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed '), F.col("seq"), F.lit("</title>"), item, F.lit("</channel></rss>")),
            "url": F.concat(F.lit("https://list.example.org/feed/"), F.col("seq"), F.lit(".xml")), "seq": F.lit(2 * 10**6) + F.col("seq"), "content_type": F.lit("application/rss+xml"),
        }
    )
    return lists.unionByName(crawl).unionByName(found)


@query
def probe_verdicts(spark, sf):
    """First look at every address: kind, title, confidence, whether a person must look."""
    verdicts, _ = probe.probe(_probed(spark, sf))
    return verdicts.select("seq", "kind", "url", "title", F.round("confidence", 4).alias("confidence"), "requires_review", "initial_status")


@query
def probe_previews(spark, sf):
    _, shown = probe.probe(_probed(spark, sf))
    return shown.select("seq", F.col("row").cast("bigint").alias("row"), "url", "title")


# --- providers ---


@query
def social_posts(spark, sf):
    return providers.parse_posts(dumps.post_dumps(table(spark, sf, "events"))).select("source_id", "url", "title", "author", "published_at", "external_id", "canonical_identity")


@query
def social_links(spark, sf):
    return providers.post_links(providers.post_rows(dumps.post_dumps(table(spark, sf, "events"))))


@query
def qa_items(spark, sf):
    return providers.parse_qa_items(dumps.qa_dumps(table(spark, sf, "orders"))).select("seq", "url", "title", "author", "published_at", "summary")


@query
def qa_followees(spark, sf):
    return providers.parse_followees(dumps.followee_dumps(table(spark, sf, "customer")), AS_OF).select("source_id", "url_token", "fullname", "headline", "follower_count")


def _works(spark, sf):
    parts = table(spark, sf, "part")
    authors = parts.select(F.concat(F.lit("author"), F.col("p_partkey") % 4).alias("source_id")).distinct().select(
        "source_id", F.upper("source_id").alias("author_name"), F.lit("0000-0000-0000-0001").alias("orcid")
    )
    return providers.parse_scholarly(dumps.scholarly_dumps(parts), authors)


@query
def scholarly_works(spark, sf):
    return _works(spark, sf).select("source_id", "url", "title", "author", "published_at", "summary", "external_id", "canonical_identity", "provider_label")


@query
def scholarly_entries(spark, sf):
    """Works normalised by the scholarly policy: DOI addresses, identity hashes."""
    works = _works(spark, sf)
    made = table(spark, sf, "part").select(F.concat(F.lit("author"), F.col("p_partkey") % 4).alias("sid")).distinct()
    sources = roles._source_rows(made, id=F.col("sid"), url=F.col("sid"), kind=F.lit("academic"), connector_id=F.lit("academic"))
    return normalize(works, sources, AS_OF).select("canonical_url", "canonical_identity", "content_hash", "provider_id")


@query
def provider_union(spark, sf):
    """Works per provider that answered, and searches that failed everywhere without a result."""
    works = _works(spark, sf)
    key = F.col("c_custkey")
    statuses = table(spark, sf, "customer").select(F.concat(F.lit("author"), key % 6).alias("source_id"), roles.pick(dumps.PROVIDERS, key).alias("provider"), (key % 6 < 3).alias("ok"))
    parts = [works.where(F.col("provider_label") == label) for label in ("OpenAlex", "Semantic Scholar", "ORCID")]
    rows, failed = providers.provider_union(parts, statuses)
    counts = rows.groupBy("source_id").agg(F.count("*").alias("works"), F.lit(False).alias("failed"))
    return counts.unionByName(failed.select("source_id", F.lit(0).cast("bigint").alias("works"), F.lit(True).alias("failed")))


@query
def author_merge(spark, sf):
    raw = dumps.author_dumps(table(spark, sf, "customer"), table(spark, sf, "supplier"))
    return providers.merge_authors(providers.author_candidates(raw))


@query
def follow_cards(spark, sf):
    return cards.parse_follow_cards(dumps.follow_pages(table(spark, sf, "orders")), AS_OF).select("seq", "url", "title", "author", "summary", "published_at")


@query
def hydration_notes(spark, sf):
    return cards.parse_hydration_notes(dumps.note_pages(table(spark, sf, "part")), AS_OF).select("url", "title", "author", "summary", "published_at", "canonical_identity")


# --- audit ---


def _document_entries(spark, sf):
    key = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.lpad(key.cast("string"), 12, "0").alias("id"), F.col("source").alias("source_id"), F.when(key % 4 != 0, F.lit(AS_OF) - (key * 7919) % 100_000).alias("published_at"),
        (F.lit(AS_OF) + key).alias("observed_at"), key.alias("created_at"), F.concat(F.lit("Document "), key).alias("title"),
    )


@query
def audit_samples(spark, sf):
    return audit.audit_samples(_document_entries(spark, sf)).select("source_id", "id", F.col("rank").cast("bigint").alias("rank"), "sample")


@query
def audit_pool(spark, sf):
    """Full-coverage audit plan: every entry of every source, up to the pool size."""
    return audit.audit_samples(_document_entries(spark, sf), all_entries=True).select("source_id", "id", F.col("rank").cast("bigint").alias("rank"), "sample")


def _document_articles(spark, sf):
    kind = F.when(F.col("source").endswith("7"), "academic").otherwise("rss")
    return table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), kind.alias("kind"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("entry_id"), F.col("doc_id"), F.lit("no such title").alias("entry_title"),
        F.lit(None).cast("string").alias("summary"), dumps.escaped(F.col("text")).alias("content_html"), F.lit("article").alias("content_mode"), F.lit("standard").alias("render_profile"),
    )


@query
def article_text_quality(spark, sf):
    judged = audit.audit_articles(_document_articles(spark, sf))
    return judged.select("doc_id", F.col("text_length").cast("bigint").alias("text_length"), F.array_join("issues", "; ").alias("issues"), "status")


@query
def audit_totals(spark, sf):
    judged = audit.audit_articles(_document_articles(spark, sf))
    samples = audit.audit_samples(_document_entries(spark, sf), all_entries=True)
    sources = roles.document_sources(table(spark, sf, "documents"))
    totals = audit.audit_totals(audit.audit_report(sources, samples, judged))
    return totals.select("status", "samples", F.col("issues").cast("bigint").alias("issues"))


@query
def source_freshness(spark, sf):
    return audit.source_freshness(_document_entries(spark, sf))


@query
def source_audit(spark, sf):
    """Feed status of every polled feed or web source."""
    sources = roles.sources(spark, sf)
    number = F.substring("id", 2, 20).cast("bigint")
    sources = sources.withColumn("extraction_rule", F.when(number % 16 == 1, F.concat(F.lit('{"feedUrl":"https://f.example.org/'), number, F.lit('"}'))))
    own = sources.where(F.col("kind") == "rss").select(F.col("url").alias("feed_url"))
    found = sources.where(number % 3 == 1).select(F.concat(F.lit("https://f.example.org/"), number).alias("feed_url"))
    working = own.unionByName(found).select("feed_url", F.length("feed_url").cast("bigint").alias("entries"), F.lit(AS_OF).alias("newest"))
    listed = sources.where(number % 2 == 1).select(F.col("id").alias("source_id"), F.lit(1).alias("rank"), F.concat(F.lit("https://f.example.org/"), number).alias("feed_url"))
    fetches = sources.select(F.col("id").alias("source_id"), (number % 5 != 4).alias("ok"), F.when(number % 5 == 4, F.lit("timeout token=abc")).alias("message"))
    return audit.audit_sources(sources, working, listed, fetches).select("source_id", "status", "feed_url", "entries", "candidates", "issue")


@query
def source_filter(spark, sf):
    return audit.pick_sources(roles.sources(spark, sf), " SUPPLIER#000000007 ").select("id", "title")


@query
def folder_groups(spark, sf):
    return folders.folder_groups(roles.sources(spark, sf), collation=None)


# --- changes and streams ---


@query
def changed_pages(spark, sf):
    """Pages whose body differs from the last one seen at their address."""
    raw = dumps.raw_fetch(table(spark, sf, "pages"), source_id=F.lit("crawl"), seq=F.col("page_id"), url=F.col("url"), text=F.col("html"))
    seen = raw.select("url", F.when(F.col("seq") % 3 != 0, F.sha2("text", 256)).otherwise(F.lit("older")).alias("fingerprint"))
    return changes.changed_fetches(raw, seen).select("seq", "url", "fingerprint")


@query
def replayed_pages(spark, sf):
    """Changed pages plus all pages of sources an older parser has read."""
    crawl = table(spark, sf, "pages")
    raw = dumps.raw_fetch(crawl, source_id=urls.url_host(F.col("url")), seq=F.col("page_id"), url=F.col("url"), text=F.col("html"))
    seen = raw.select("url", F.when(F.col("seq") % 3 != 0, F.sha2("text", 256)).otherwise(F.lit("older")).alias("fingerprint"))
    hosts = raw.select("source_id").distinct()
    sources = roles._source_rows(hosts, id=F.col("source_id"), metadata_revision=F.when(F.col("source_id").startswith("www."), 3).otherwise(changes.FEED_REVISION))
    return changes.replayed_fetches(raw, seen, sources).select("seq", "source_id")


@query
def stale_results(spark, sf):
    """Orders read for a source that has changed meanwhile are left out."""
    before = roles.sources(spark, sf)
    number = F.substring("id", 2, 20).cast("bigint")
    after = before.where(number % 7 != 0).withColumn("extraction_rule", F.when(number % 3 == 0, F.lit('{"version":2}'))).withColumn(
        "kind", F.when(number % 11 == 0, F.lit("manual")).otherwise(F.col("kind"))
    )
    batch = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("s"), F.col("o_custkey") % 120).alias("source_id"))
    return changes.still_current(batch, before, after)


def _posts_and_cursor(spark, sf):
    events = table(spark, sf, "events")
    posts = events.select(F.concat(F.lit("u"), F.col("user_id")).alias("author_id"), F.col("event_id").cast("string").alias("post_id"), "event_type")
    since = posts.where(F.col("event_type") == "signup").groupBy("author_id").agg(F.min_by("post_id", F.col("post_id").cast("decimal(38,0)")).alias("since_id"))
    return posts, since


@query
def since_id_increment(spark, sf):
    """Posts newer than each author's cursor; replies are read past but not kept."""
    posts, since = _posts_and_cursor(spark, sf)
    fresh, _ = changes.increment(posts, since)
    return fresh.where(F.col("event_type") != "click").select("author_id", "post_id")


@query
def since_id_cursors(spark, sf):
    posts, since = _posts_and_cursor(spark, sf)
    return changes.increment(posts, since)[1]


@query
def latest_cursor(spark, sf):
    posts, since = _posts_and_cursor(spark, sf)
    return changes.latest_id(changes.increment(posts, since)[1])


@query
def stream_health(spark, sf):
    """The event log as a stream of runs, folded batch by batch into source health."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = scratch_path(spark, "stream-health")
    running = health_stream.source_health_stream(roles.runs(stream), f"{root}/state", f"{root}/checkpoint")
    running.awaitTermination()
    last = running.lastProgress["batchId"] if running.lastProgress else 0
    summary = health_stream.read_summary(spark, f"{root}/state/summary", max(last, 0))
    return health.health_of(summary, roles.run_sources(events))


def _broken(spark, sf):
    """Pages fetched for sources of other kinds: no feed, no answer, no connector."""
    key = F.col("page_id")
    return dumps.raw_fetch(
        table(spark, sf, "pages"), source_id=F.concat(F.lit("broken-"), key % 3), seq=F.lit(10**7) + key, url=F.col("url"), content_type=F.lit("text/html"), text=F.col("html")
    )


def _all_kinds(spark, sf):
    """One batch of every connector's fetches, readable or not, and the sources they belong to."""
    orders = table(spark, sf, "orders")
    works = dumps.scholarly_dumps(table(spark, sf, "part"))
    hosts = F.create_map(*[F.lit(v) for host, name in ingest.PROVIDER_HOSTS for v in (name, f"https://api.{host}/works")])
    works = works.withColumn("url", F.element_at(hosts, F.col("provider"))).drop("provider")
    parts = {
        "rss": _feeds(spark, sf), "zhihu": dumps.qa_dumps(orders), "x": dumps.post_dumps(table(spark, sf, "events")), "zhihu_follow": dumps.follow_pages(orders),
        "xiaohongshu": dumps.note_pages(table(spark, sf, "part")), "academic": works, "broken": _broken(spark, sf),
    }
    raw = made = None
    for kind, part in parts.items():
        kinds = F.lit(kind) if kind != "broken" else roles.pick(["rss", "x", "telegraph"], F.substring("sid", 8, 1).cast("int"))
        own = part.select(F.col("source_id").alias("sid")).distinct().select("sid", kinds.alias("skind"))
        raw, made = (part, own) if raw is None else (raw.unionByName(part), made.unionByName(own))
    sources = roles._source_rows(
        made, id=F.col("sid"), url=F.concat(F.lit("https://"), F.col("sid"), F.lit(".example.org/")), kind=F.col("skind"), connector_id=F.col("skind"),
        config_json=F.concat(F.lit('{"authorName":"'), F.col("sid"), F.lit('","orcid":"0000-0000-0000-0001"}')),
    )
    return raw, schemas.write_through(sources, "all-kinds-sources")


@query
def ingest_runs(spark, sf):
    """Run log of a batch of every kind of fetch: what was read from each source, and why others failed."""
    raw, sources = _all_kinds(spark, sf)
    state = schemas.empty_state(spark).with_tables(sources=sources)
    _, runs = ingest.ingest_batch(state, raw, ingest.Registry(*ingest.DEFAULT_CONNECTORS), AS_OF, "all")
    return runs.select("source_id", "outcome", F.col("fetched_count").cast("bigint").alias("fetched"), "message")


@query
def ingest_rejects(spark, sf):
    """Documents that no parser could read, with the reason."""
    raw, sources = _all_kinds(spark, sf)
    _, rejects = ingest.Registry(*ingest.DEFAULT_CONNECTORS).parse(raw, ingest.Context(sources, AS_OF))
    return rejects.select("source_id", "seq", "problem")


@query
def stream_ingest(spark, sf):
    """Feeds landed as files, streamed through parse, normalise and merge into library versions."""
    root = scratch_path(spark, "stream-ingest")
    _feeds(spark, sf).write.parquet(f"{root}/landing")
    made = spark.createDataFrame([(f"feed-{d}",) for d in dumps.DIALECTS], "sid string")
    sources = roles._source_rows(made, id=F.col("sid"), url=F.lit("https://news.example.org/"), kind=F.lit("rss"), connector_id=F.lit("rss"))
    library = Library(spark, f"{root}/library")
    library.publish("seed", sources=sources)
    running = ingest.ingest_stream(spark, ingest.landing_stream(spark, f"{root}/landing", 1_000), library, f"{root}/checkpoint", AS_OF)
    running.awaitTermination()
    return library.load().entries.select("canonical_url", "source_id", "title", "published_at", "canonical_identity")


@query
def preview_saved(spark, sf):
    """Sources confirmed from a probe, with the entries that their previews brought; confirming twice changes nothing."""
    verdicts, shown = probe.probe(_probed(spark, sf))
    library = Library(spark, scratch_path(spark, "previews"))
    for _ in range(2):
        ingest.confirm_previews(library, verdicts, shown, AS_OF, "confirm-0")
    state = library.load()
    counts = state.entry_origins.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("entries"))
    subscribed = state.subscriptions.select(F.col("source_id").alias("id"))
    return state.sources.join(subscribed, "id").join(counts, "id").select("url", "kind", "status", "polling_enabled", "entries")


# --- references to characters ---

REFERENCES = ["&mdash;", "&#8217;", "&#x2026;", "&amp;lt;", "&NotEqualTilde;", "&#150;", "&nosuch;", "&#xD800;"]


@query
def entity_texts(spark, sf):
    """Part descriptions with references of every kind as a reader sees them."""
    reference = roles.pick(REFERENCES, F.col("p_partkey"))
    written = F.concat(F.lit("<p>"), F.col("p_name"), F.lit(" "), reference, F.col("p_type"), F.lit("&nbsp;& "), reference, F.lit("</p>"))
    return table(spark, sf, "part").select("p_partkey", feeds.snippet(written).alias("said"))


# --- syncs over several batches ---

HOUR = 3_600_000


def _numbered_feeds(spark, sf):
    """The feeds with five sources to a dialect, and those sources; ``number`` is a source's own."""
    raw = _feeds(spark, sf)
    number = F.floor(F.col("seq") / 3) % 5
    raw = schemas.write_through(raw.withColumn("source_id", F.concat("source_id", F.lit("-"), number)), "numbered-feeds")
    made = raw.select("source_id").distinct().select(F.col("source_id").alias("sid"), F.substring_index("source_id", "-", -1).cast("int").alias("number"))
    return raw, made


def _rss_sources(made, **fields):
    return roles._source_rows(
        made, **{"id": F.col("sid"), "url": F.lit("https://news.example.org/"), "kind": F.lit("rss"), "connector_id": F.lit("rss"), "metadata_revision": F.lit(changes.FEED_REVISION), **fields}
    )


def _sync(library, raw, run, as_of, meanwhile=None):
    """One batch read, and committed after what others do meanwhile."""
    version = library.version()
    sources = library.load(version).sources
    fetched = ingest.read_batch(raw, sources, library.lookup(version), ingest.Registry(*ingest.DEFAULT_CONNECTORS), as_of, run)
    if meanwhile is not None:
        meanwhile()
    ingest.commit_batch(library, fetched, as_of, run)


def _seen_before(raw):
    """What is stored of the documents when two of three have not changed since."""
    known = F.when(F.floor(F.col("seq") / 3) % 3 != 0, F.sha2("text", 256)).otherwise(F.lit("older"))
    return raw.select("source_id", "url", known.alias("fingerprint"), F.lit(AS_OF).alias("updated_at"))


@query
def ingest_unchanged(spark, sf):
    """Runs over documents of which two in three are what was seen last: those are not parsed."""
    raw, made = _numbered_feeds(spark, sf)
    library = Library(spark, scratch_path(spark, "unchanged"))
    library.publish("seed", sources=_rss_sources(made), seen=_seen_before(raw))
    _sync(library, raw, "sync-0", AS_OF)
    return library.load().runs.select("source_id", "outcome", F.col("fetched_count").cast("bigint").alias("fetched"), F.col("inserted_count").cast("bigint").alias("inserted"))


@query
def ingest_replayed(spark, sf):
    """Entries of changed documents, and of all documents of sources that an older parser read."""
    raw, made = _numbered_feeds(spark, sf)
    older = F.when(F.col("sid").startswith("feed-atom"), changes.FEED_REVISION - 1).otherwise(changes.FEED_REVISION)
    library = Library(spark, scratch_path(spark, "replayed"))
    library.publish("seed", sources=_rss_sources(made, metadata_revision=older), seen=_seen_before(raw))
    _sync(library, raw, "sync-0", AS_OF)
    return library.load().entries.select("canonical_url", "source_id")


@query
def ingest_stale(spark, sf):
    """Entries that are left when sources are deleted, or become another kind, while their documents are read."""
    raw, made = _numbered_feeds(spark, sf)
    sources = schemas.write_through(_rss_sources(made), "stale-sources")
    library = Library(spark, scratch_path(spark, "stale"))
    library.publish("seed", sources=sources)

    def meanwhile():
        kind = F.when(F.col("id").endswith("-1"), F.lit("manual")).otherwise(F.col("kind"))
        changed = sources.where(~F.col("id").startswith("feed-json")).withColumns({"kind": kind, "extraction_rule": F.lit('{"version":2}')})
        library.publish("user", sources=changed)

    _sync(library, raw, "sync-0", AS_OF, meanwhile)
    return library.load().entries.select("canonical_url", "source_id")


@query
def ingest_sources(spark, sf):
    """Sources after two batches: read, then failed, not modified, seen before, not fetched or unreadable, by number."""
    raw, made = _numbered_feeds(spark, sf)
    interval = F.when(F.col("number") % 2 == 1, F.lit(60))
    library = Library(spark, scratch_path(spark, "synced"))
    library.publish("seed", sources=_rss_sources(made, metadata_revision=null("int"), polling_enabled=F.lit(True), refresh_interval_minutes=interval))
    first = raw.withColumn("etag", F.concat(F.lit("t"), F.col("seq")))
    _sync(library, first, "sync-0", AS_OF)
    number = F.substring_index("source_id", "-", -1).cast("int")
    status = F.when(number == 0, 503).when(number == 1, 304).otherwise(200)
    etag = F.when(number == 2, F.col("etag"))
    body = F.when(number == 4, F.lit("<gone")).when(number == 2, F.col("text")).otherwise("")
    second = first.where(number != 3).withColumns({"status": status, "etag": etag, "text": body})
    _sync(library, second, "sync-1", AS_OF + HOUR)
    return library.load().sources.select(
        "id", "status", F.col("failure_count").cast("bigint").alias("failure_count"), "etag", "last_error", "last_checked_at", "next_check_at", F.col("metadata_revision").cast("bigint").alias("metadata_revision"), "icon_url"
    )


@query
def ingest_checkpoints(spark, sf):
    """Cursors of subscriptions after two overlapping batches, the second of which fails for some sources."""
    raw = schemas.write_through(dumps.post_dumps(table(spark, sf, "events")), "posts")
    made = raw.select("source_id").distinct().withColumnRenamed("source_id", "sid")
    sources = roles._source_rows(made, id=F.col("sid"), url=F.concat(F.lit("https://x.com/"), F.col("sid")), kind=F.lit("x"), connector_id=F.lit("x"))
    subscriptions = made.select(F.concat(F.lit("sub-"), "sid").alias("id"), F.col("sid").alias("source_id"), F.lit("x").alias("connector_id"), *[null("string").alias(c) for c in ("account_id", "target_id", "config_json")], F.lit(AS_OF).alias("created_at"), F.lit(AS_OF).alias("updated_at"))
    library = Library(spark, scratch_path(spark, "cursors"))
    library.publish("seed", sources=sources, subscriptions=subscriptions)
    _sync(library, raw.where("seq % 2 = 0"), "sync-0", AS_OF)
    fails = F.substring("source_id", 2, 20).cast("bigint") % 5 == 0
    _sync(library, raw.withColumn("status", F.when(fails, 500).otherwise(200)), "sync-1", AS_OF + HOUR)
    return library.load().checkpoints.select("subscription_id", "since_id", "updated_at")


@query
def stream_ingest_batches(spark, sf):
    """Feeds that land in three overlapping waves, each streamed into the library as a batch of changes."""
    root = scratch_path(spark, "stream-batches")
    raw, made = _numbered_feeds(spark, sf)
    library = Library(spark, f"{root}/library")
    library.publish("seed", sources=_rss_sources(made))
    for wave in range(3):
        again = (F.col("seq") % 3 < wave) & (F.floor(F.col("seq") / 3) % 4 == 0)
        raw.where((F.col("seq") % 3 == wave) | again).write.mode("append").parquet(f"{root}/landing")
        ingest.ingest_stream(spark, ingest.landing_stream(spark, f"{root}/landing", 100_000), library, f"{root}/checkpoint", AS_OF).awaitTermination()
    return library.load().entries.select("canonical_url", "source_id", "title", "published_at", "canonical_identity")


@query
def stream_health_late(spark, sf):
    """The event log landing in four waves, the last of which holds a tenth of all runs, late for every source."""
    events = table(spark, sf, "events")
    root = scratch_path(spark, "health-late")
    late, third = F.col("event_id") % 10 == 0, F.pmod(F.floor(F.col("event_id") / 1000), F.lit(3))
    for wave in range(4):
        events.where(late if wave == 3 else ~late & (third == wave)).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/landing")
        health_stream.source_health_stream(roles.runs(stream), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return health.health_of(health_stream.read_summary(spark, f"{root}/state/summary", 3), roles.run_sources(events))
