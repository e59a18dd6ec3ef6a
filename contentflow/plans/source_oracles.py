"""SQL of the parser, audit and stream jobs: what the documents were made from, not how they are parsed."""

from __future__ import annotations

from contentflow.plans.oracles import ORACLES, SOURCES, collapse, compact, pick, refresh
from contentflow.plans.roles import AS_OF, DAY

DIALECT = pick(["rss", "atom", "json"], "doc_id")
RANK = "doc_id % 3"
CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')"


def unescape(text: str) -> str:
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    return text


BLOCK = r"(?is)</?(?:h\d|br|p|ul|ol|li|blockquote|section|table|tr|div)(?:\s[^>]*)?/?>"
SNIPPET = unescape(f"regexp_replace(regexp_replace({CLEAN}, '{BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g')")
FEED = f"""feed AS (SELECT doc_id, {DIALECT} AS d, doc_id // 15 AS doc, 'https://news.example.org/a/' || doc_id || '?utm_source=x&p=' || doc_id AS url,
  'Doc & ' || doc_id AS title, lang, epoch_ms(make_date(2024, 1, (1 + doc_id % 28)::INT)::TIMESTAMP) + CASE WHEN {RANK} < 2 THEN {DAY} ELSE 0 END AS published_at,
  CASE WHEN {RANK} < 2 THEN {SNIPPET} ELSE text END AS body, trim({CLEAN}, ' ') <> '' AND {RANK} < 2 AS has_body, {RANK} AS r FROM documents)"""
FEED_URL = "'https://news.example.org/' || d || '/' || doc || '.xml'"

ORACLES["feed_sniff"] = f"""WITH {FEED}
SELECT url, false AS is_feed, false AS looks_like_feed FROM pages UNION ALL SELECT DISTINCT {FEED_URL}, true, true FROM feed"""
ORACLES["feed_items"] = f"""WITH {FEED}
SELECT 'feed-' || d AS source_id, (doc * 3 + r) * 1000000 + (doc_id % 15) // 3 AS seq, url, title, lang AS author, published_at, {compact('body')} AS summary, has_body FROM feed"""
ORACLES["feed_heads"] = f"""WITH {FEED}
SELECT {FEED_URL} AS feed_url, 'Feed ' || doc AS title, CASE WHEN d = 'rss' THEN 'https://news.example.org/logo-' || doc || '.png' END AS icon_url, count(*) AS items FROM feed GROUP BY d, doc"""
ORACLES["feed_icons"] = f"WITH {FEED} SELECT 'feed-rss' AS source_id, 'https://news.example.org/logo-' || max(doc) || '.png' AS icon_url FROM feed WHERE d = 'rss'"
ORACLES["feed_json_rejects"] = "SELECT DISTINCT 'qa' AS source_id, o_orderkey // 50 AS seq FROM orders"
ORACLES["feed_nav_items"] = """
SELECT p_partkey, p_partkey % 5 <> 0 AND CASE p_partkey % 4 WHEN 1 THEN true WHEN 2 THEN p_partkey % 3 = 1 ELSE p_partkey % 3 IN (0, 1) END AS nav FROM part"""
ENTRY = "'https://news.example.org/a/' || doc_id || '?p=' || doc_id"
ORACLES["feeds_to_entries"] = f"""WITH {FEED}
SELECT {ENTRY} AS canonical_url, 'feed-' || d AS source_id, title, published_at, {ENTRY} AS canonical_identity FROM feed"""
ORACLES["stream_ingest"] = ORACLES["feeds_to_entries"]

OPML = """o AS (SELECT c_custkey AS k, c_custkey // 40 AS seq, c_custkey % 40 AS pos, trim(c_name) AS title, 'All folders / Part ' || c_custkey // 40 AS category,
  CASE c_custkey % 10 WHEN 7 THEN 'http://192.168.0.' || c_custkey % 200 || '/rss' WHEN 8 THEN 'http://localhost:' || c_custkey || '/rss'
   ELSE 'https://H' || c_custkey % 7 || '.example.org/feed/' || c_custkey % 300 || '/?utm_source=o' END AS url,
  CASE c_custkey % 10 WHEN 7 THEN 'private' WHEN 8 THEN 'http://localhost:' || c_custkey || '/rss' ELSE 'https://h' || c_custkey % 7 || '.example.org/feed/' || c_custkey % 300 END AS identity FROM customer)"""
JUDGED = """j AS (SELECT *, CASE WHEN identity = 'private' THEN 'skipped' WHEN identity IN (SELECT url FROM src) THEN 'existing'
  WHEN row_number() OVER (PARTITION BY identity ORDER BY k) > 1 THEN 'existing' ELSE 'imported' END AS outcome FROM o)"""
ORACLES["opml_outlines"] = f"WITH {OPML} SELECT seq, pos, url, title, category FROM o"
ORACLES["opml_import"] = f"""WITH {SOURCES}, {OPML}, {JUDGED}
SELECT count(*) FILTER (WHERE outcome = 'imported') AS imported, count(*) FILTER (WHERE outcome = 'existing') AS existing, count(*) FILTER (WHERE outcome = 'skipped') AS skipped FROM j"""
ORACLES["opml_new_sources"] = f"WITH {SOURCES}, {OPML}, {JUDGED} SELECT url, title, category, k % 10 = 8 AS loopback FROM j WHERE outcome = 'imported'"

ROBOTS = """rob AS (SELECT regexp_extract(url, '^https?://[^/?#]*') AS origin, min(page_id) AS first FROM pages GROUP BY 1),
 rules AS (SELECT origin, '/en/' || first % 10 AS rule FROM rob UNION ALL SELECT origin, '/fr/' FROM rob)"""
ORACLES["robots_rules"] = f"WITH {ROBOTS} SELECT origin, rule FROM rules"
ORACLES["robots_allowed"] = f"""WITH {ROBOTS}
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM rules WHERE origin = regexp_extract(p.url, '^https?://[^/?#]*')
  AND starts_with(regexp_extract(p.url, '^https?://[^/?#]*([^#]*)', 1), rule))"""

LIST = """li AS (SELECT p_partkey AS k, p_partkey // 8 AS doc, (p_partkey // 8) % 3 AS kind, 'Report on ' || p_name || ' ' || p_partkey AS title,
  'A summary long enough to count as an excerpt of ' || p_type || ' ' || p_partkey AS teaser, epoch_ms(make_date(2024, 2, (1 + p_partkey % 28)::INT)::TIMESTAMP) AS day FROM part)"""
LINK = """CASE kind WHEN 0 THEN 'https://list.example.org/posts/' || k || '?ref=list' WHEN 1 THEN 'https://list.example.org/archive-' || k || '.html' ELSE 'https://list.example.org/posts/' || k END"""
ORACLES["feed_discovery"] = f"""WITH {LIST}
SELECT DISTINCT doc AS page_id, r AS rank, ['https://list.example.org/feed/' || doc || '.xml', 'https://list.example.org/rss.xml', 'https://list.example.org/export?format=json'][r] AS feed_url
FROM li, (VALUES (1), (2), (3)) AS v(r)"""
ORACLES["feed_candidates"] = f"""WITH {LIST}
SELECT DISTINCT 'https://list.example.org/feed/' || doc || '.xml' AS feed_url, 1 AS part FROM li UNION ALL SELECT 'https://list.example.org/rss.xml', 0 UNION ALL SELECT 'https://list.example.org/export?format=json', 1"""
ORACLES["page_cards"] = f"""WITH {LIST}
SELECT doc AS page_id, CASE kind WHEN 2 THEN 'json_ld' ELSE 'cards' END AS method, {LINK} AS entry_url, title, day AS published_at, teaser AS summary FROM li"""
ORACLES["page_listing_result"] = f"""WITH {LIST}
SELECT DISTINCT doc AS page_id, 'List ' || doc AS page_title, CASE kind WHEN 2 THEN 'json_ld' ELSE 'cards' END AS method, CASE kind WHEN 0 THEN 'article' WHEN 1 THEN 'li' END AS selector,
  CASE kind WHEN 2 THEN 0.91 ELSE 0.89 END::DOUBLE AS confidence, false AS requires_review, 'active' AS initial_status FROM li"""
ORACLES["page_rules"] = f"""WITH {LIST}
SELECT DISTINCT doc AS page_id, CASE WHEN kind = 2 THEN 'json_ld' WHEN kind = 0 AND doc % 2 = 0 THEN 'rule' ELSE 'fallback' END AS method,
  CASE WHEN kind = 2 OR (kind = 0 AND doc % 2 = 0) THEN 8 ELSE 1 END AS entries, false AS rule_replaced FROM li"""
ORACLES["page_calibration"] = f"""WITH {LIST}
SELECT doc AS page_id, g AS rank, CASE WHEN kind = 1 THEN 'li' ELSE ['article', 'article.post-card', 'a[href*="/posts/"]'][g] END AS selector, 8 AS entries, 0.98::DOUBLE AS confidence,
  k % 8 + 1 AS row, {LINK} AS entry_url FROM li, (VALUES (1), (2), (3)) AS v(g) WHERE kind = 0 OR (kind = 1 AND g = 1)"""
TITLE = compact(unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
ORACLES["page_fallback_card"] = f"SELECT page_id, 'fallback' AS method, url AS entry_url, {TITLE} AS title FROM pages"
ORACLES["date_enrichment"] = f"""WITH e AS (SELECT 's' || o_custkey % 20 AS source_id, o_orderkey AS seq, o_orderkey % 3 = 0 AS dated, CASE WHEN o_orderkey % 5 = 0 THEN {AS_OF} END AS published_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://e.example.org/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey ELSE 'https://e.example.org/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) >= 2000 THEN epoch_ms(o_orderdate) END AS url_day, epoch_ms(o_orderdate) AS day FROM orders),
 asked AS (SELECT *, row_number() OVER (PARTITION BY source_id, (published_at IS NULL AND url_day IS NULL) ORDER BY seq) AS place FROM e)
SELECT source_id, seq, url, coalesce(published_at, url_day, CASE WHEN seq % 2 = 0 THEN day END) AS published_at FROM asked"""
BODY = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


def visible(html: str) -> str:
    return collapse(unescape(f"regexp_replace({html}, '<[^>]*>', '', 'g')"))


REST = f"replace({BODY}, '<h1>' || {H1} || '</h1>', '')"
# A container with less than 40 visible characters is no article.
SHOWN = f"{visible(REST)} <> '' AND length({visible(BODY)}) >= 40"
ORACLES["page_articles"] = f"""
SELECT page_id, {visible(H1)} AS title, md5({visible(REST)}) AS text_md5, length({visible(REST)}) AS text_length, 'standard' AS render_profile, 7 AS priority FROM pages WHERE {SHOWN}"""
ORACLES["page_quality"] = f"""
SELECT page_id, length({visible(BODY)}) + 120 * len(regexp_extract_all({BODY}, '<p>')) + 90 AS quality FROM pages WHERE {SHOWN}"""
# An open paragraph ends, with the bold text in it, where the next one starts.
ORACLES["article_html"] = f"""
SELECT page_id, replace(regexp_replace({REST}, '<br>(<p>|$)', '<br></b></p>\\1', 'g'), '&quot;', '"') AS content_html FROM pages WHERE {SHOWN}"""
PARAGRAPH = f"'<p>' || replace(replace(replace({CLEAN.replace('text', "coalesce(text, '')")}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'"
QUOTE = "'<div><p>Quoted words at the end</p></div>'"
ORACLES["article_chrome"] = f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {QUOTE} ELSE CASE WHEN doc_id % 5 = 0 THEN '<h1>Doc ' || doc_id || '</h1>' ELSE '' END || '<h2>Part</h2>' || {PARAGRAPH} || {QUOTE}
  || CASE WHEN doc_id % 2 = 0 THEN '<div><p>c</p></div>' ELSE '' END END AS content_html FROM documents"""
IMAGE = "'<img src=\"https://e.example.org/"
ORACLES["article_images"] = f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<figure>' || {IMAGE}o/' || doc_id || '.png"></figure>' WHEN 1 THEN '<picture>' || {IMAGE}w/' || doc_id || '-900.webp"></picture>'
  WHEN 2 THEN '<div>' || {IMAGE}n/' || doc_id || '.png"></div>' WHEN 3 THEN '<div>t' || {IMAGE}n/' || doc_id || '.png" alt="n &amp; ' || doc_id || '"></div>'
  WHEN 4 THEN '<figure>' || {IMAGE}p/' || doc_id || '-200x100.png"><figcaption>c</figcaption></figure><p>' || {IMAGE}p/' || doc_id || '.png"></p>'
  ELSE '<div>' || {IMAGE}p/' || doc_id || '-20x10.png" alt="a ' || doc_id || '"></div>' END || {PARAGRAPH} AS content_html FROM documents"""
ORACLES["page_dates"] = f"""WITH {LIST}
SELECT doc AS page_id, arg_min(day, k) FILTER (WHERE kind = 2) AS published_at FROM li GROUP BY doc UNION ALL SELECT 1000000000 + page_id, NULL FROM pages"""
ORACLES["article_fallback"] = f"""WITH m AS (SELECT 'e' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'article'
  WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 AND length({collapse(CLEAN)}) >= 24 THEN 'feed_body' WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 'feed_summary' ELSE 'unavailable' END AS content_mode FROM documents)
SELECT id, content_mode, CASE WHEN content_mode <> 'unavailable' THEN true END AS has_html FROM m"""

POST = "(100000000000000000 + event_id)::VARCHAR"
ORACLES["social_posts"] = f"""
SELECT 'x' || user_id AS source_id, 'https://x.com/user%20' || user_id || '/status/' || {POST} AS url, 'post ' || props || ' <x>' AS title, '@user ' || user_id AS author,
  epoch_us(ts) // 1000 AS published_at, {POST} AS external_id, 'x:' || {POST} AS canonical_identity FROM events WHERE event_type NOT IN ('click', 'error')"""
ORACLES["social_links"] = f"SELECT {POST} AS post_id, 'https://e.example.org/' || event_id AS external_url FROM events"
ORACLES["qa_items"] = """
SELECT o_orderkey // 50 * 1000000 + o_orderkey % 50 AS seq, 'https://www.zhihu.com/question/1/answer/' || o_orderkey AS url, CASE WHEN o_orderkey % 4 <> 0 THEN 'Order ' || o_orderkey ELSE '知乎内容' END AS title,
  'c' || o_custkey AS author, epoch_ms(o_orderdate) // 1000 * 1000 AS published_at, o_orderpriority AS summary FROM orders WHERE o_orderkey % 9 <> 0"""
ORACLES["qa_followees"] = """
SELECT 'acc' || c_custkey % 3 AS source_id, 't' || c_custkey AS url_token, CASE WHEN c_custkey % 6 <> 0 THEN c_name ELSE '知乎用户' END AS fullname, c_mktsegment AS headline, floor(c_acctbal)::BIGINT AS follower_count
FROM customer"""
WORKS = """w AS (SELECT p_partkey AS k, p_partkey % 3 AS prov, 'author' || (p_partkey // 30) % 4 AS source_id, 'On ' || p_name || ' ' || p_partkey AS title, p_type,
  CASE WHEN p_partkey % 5 < 3 THEN '10.1234/part.' || p_partkey END AS doi, 'https://works.example.org/' || p_partkey AS landing, 'https://openalex.org/W' || p_partkey AS oa,
  make_timestamp(2000 + p_partkey % 25, 3, 1 + p_partkey % 31, 0, 0, 0) AS full_day, make_timestamp(2000 + p_partkey % 25, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END, 1, 0, 0, 0) AS part_day FROM part),
 works AS (SELECT k, prov, source_id, title, upper(source_id) AS author, coalesce('https://doi.org/' || doi, CASE WHEN prov = 0 AND k % 2 = 1 THEN oa ELSE landing END) AS url,
  epoch_ms(CASE WHEN prov = 2 THEN part_day ELSE full_day END) AS published_at,
  CASE prov WHEN 0 THEN 'OpenAlex · 学术论文' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN p_type ELSE 'Semantic Scholar · 学术论文' END ELSE 'ORCID · 公开 works 记录' END AS summary,
  CASE prov WHEN 0 THEN oa WHEN 1 THEN 'p' || k ELSE k::VARCHAR END AS external_id,
  coalesce('doi:' || doi, CASE prov WHEN 0 THEN 'openalex:' || oa WHEN 1 THEN CASE WHEN k % 5 = 3 THEN 'arxiv:arx' || k ELSE 'semantic:p' || k END ELSE 'orcid:0000-0000-0000-0001:' || k END) AS canonical_identity,
  ['OpenAlex', 'Semantic Scholar', 'ORCID'][prov + 1] AS provider_label FROM w WHERE prov < 2 OR doi IS NOT NULL OR k % 7 <> 0)"""
ORACLES["scholarly_works"] = f"WITH {WORKS} SELECT source_id, url, title, author, published_at, summary, external_id, canonical_identity, provider_label FROM works"
ORACLES["scholarly_entries"] = f"""WITH {WORKS}
SELECT url AS canonical_url, canonical_identity, sha256(canonical_identity || chr(10) || title || chr(10) || summary) AS content_hash, 'academic' AS provider_id FROM works"""
ORACLES["provider_union"] = f"""WITH {WORKS}, st AS (SELECT 'author' || c_custkey % 6 AS source_id, bool_or(c_custkey % 6 < 3) AS ok FROM customer GROUP BY 1)
SELECT source_id, count(*) AS works, false AS failed FROM works GROUP BY 1 UNION ALL SELECT source_id, 0, true FROM st WHERE NOT ok AND source_id NOT IN (SELECT source_id FROM works)"""
ORACLES["author_merge"] = """
WITH c AS (SELECT 'q' || s_nationkey % 5 AS search, 0 AS rank, s_suppkey AS k, 'Author ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' a' ELSE ' B' END AS name, 'A' || s_suppkey AS oa, NULL AS sem,
  CASE WHEN s_suppkey % 4 = 0 THEN '0000-0000-0000-00' || lpad(s_nationkey::VARCHAR, 2, '0') END AS orcid FROM supplier
 UNION ALL SELECT 'q' || c_nationkey % 5, 1, c_custkey, 'Author ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' a' ELSE ' B' END, NULL, 'S' || c_custkey,
  CASE WHEN c_custkey % 4 = 0 THEN '0000-0000-0000-00' || lpad(c_nationkey::VARCHAR, 2, '0') END FROM customer),
 o AS (SELECT *, row_number() OVER (ORDER BY rank, k) AS n, coalesce(orcid, lower(name)) AS key FROM c)
SELECT search, key AS author_key, CASE WHEN count(*) > 1 THEN arg_max(name, n) ELSE any_value(name || CASE rank WHEN 0 THEN ' · OpenAlex' ELSE ' · Semantic Scholar' END) END AS title,
  arg_min(CASE WHEN oa IS NOT NULL THEN 'openalex:' || oa ELSE 'semantic:' || sem END, n) AS target_id, arg_max(name, n) AS author_name,
  arg_max(oa, n) FILTER (WHERE oa IS NOT NULL) AS openalex_id, arg_max(sem, n) FILTER (WHERE sem IS NOT NULL) AS semantic_id, arg_max(orcid, n) FILTER (WHERE orcid IS NOT NULL) AS orcid
FROM o GROUP BY search, key"""
ORACLES["follow_cards"] = f"""WITH f AS (SELECT *, o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN '/p/' || o_orderkey WHEN 1 THEN '/question/7/answer/' || o_orderkey WHEN 3 THEN '/zvideo/' || o_orderkey
  WHEN 5 THEN '/p/' || o_orderkey // 12 END AS path FROM orders)
SELECT k // 10 * 1000000 + k % 10 AS seq, 'https://www.zhihu.com' || path AS url, 'Order title ' || k AS title, 'Customer ' || o_custkey AS author, o_orderpriority || ' summary of the whole order text' AS summary,
  CASE k % 4 WHEN 0 THEN CASE WHEN year(o_orderdate) >= 2000 THEN epoch_ms(o_orderdate) + 37230000 ELSE {AS_OF // DAY * DAY + 37200000} END WHEN 1 THEN CASE WHEN epoch_ms(o_orderdate) // 1000 + 1000000000 >= 1000000000 THEN epoch_ms(o_orderdate) + 1000000000000 END
   WHEN 2 THEN {AS_OF} - 10800000 ELSE 1704443400000 END AS published_at
FROM f WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k // 10, path ORDER BY k) = 1"""
ORACLES["hydration_notes"] = """
SELECT 'https://www.xiaohongshu.com/explore/note-' || lpad(p_partkey::VARCHAR, 6, '0') AS url, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || p_partkey ELSE p_type END AS title, p_brand AS author,
  p_type AS summary, (1700000000 + p_partkey) * 1000 AS published_at, 'xiaohongshu:note-' || lpad(p_partkey::VARCHAR, 6, '0') AS canonical_identity FROM part"""

AUDIT = f"""ent AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source AS source_id, CASE WHEN doc_id % 4 <> 0 THEN {AS_OF} - (doc_id * 7919) % 100000 END AS published_at, {AS_OF} + doc_id AS observed_at, doc_id AS created_at FROM documents),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at IS NULL, published_at DESC, observed_at DESC, created_at DESC, id) AS rank FROM ent)"""
ORACLES["audit_samples"] = f"""WITH {AUDIT}, pool AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, list_sum(list_transform(string_split(source_id, ''), lambda x: unicode(x)))::BIGINT AS code FROM ranked)
SELECT source_id, id, rank, CASE WHEN rank = 1 THEN 'newest' ELSE 'historical' END AS sample FROM pool WHERE rank = 1 OR (n > 1 AND rank = 1 + least(n - 1, 1 + code % (n - 1)))"""
ORACLES["audit_pool"] = f"WITH {AUDIT} SELECT source_id, id, rank, 'all' AS sample FROM ranked"
ORACLES["source_freshness"] = f"WITH {AUDIT} SELECT source_id, count(*) AS entries, count(*) FILTER (WHERE published_at IS NULL) AS undated, max(published_at) AS newest FROM ent GROUP BY 1"
PLAIN = collapse(CLEAN)
LEAK = r"""(regexp_matches(f, '\\[A-Za-z]+') OR ((regexp_matches(f, '[A-Za-zα-ωΑ-Ω0-9)}\]]\s*[_^]\s*(\{[^}\r\n]+\}|[A-Za-zα-ωΑ-Ω0-9])') OR regexp_matches(f, '[=<>±÷]')
  OR regexp_matches(f, '^[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*$')) AND NOT regexp_matches(f, '(^|[.!?])\s+(@|https?://|[A-Z])')))"""
JUDGE = rf"""txt AS (SELECT doc_id, source, {PLAIN} AS t FROM documents),
 q AS (SELECT doc_id, source, length(t) AS text_length, length(t) < 180 AND source NOT LIKE '%7' AS short, regexp_matches(t, '\\([A-Za-z]+|[{{}}\[\]\\])') AS raw,
  len(list_filter(list_transform(regexp_extract_all(t, '\$([^$\r\n]+)\$', 1), lambda x: trim(x, ' ')), lambda f: {LEAK})) > 0 AS leak FROM txt),
 judged AS (SELECT *, list_filter([CASE WHEN short THEN '正文过短' END, CASE WHEN raw THEN '正文中残留未渲染的 TeX 命令' END, CASE WHEN leak THEN '正文中残留未渲染的 $…$ 行内公式' END], lambda x: x IS NOT NULL) AS issues FROM q)"""
ORACLES["article_text_quality"] = f"""WITH {JUDGE}
SELECT doc_id, text_length, array_to_string(issues, '; ') AS issues, CASE WHEN len(issues) > 0 THEN 'issues' ELSE 'passed' END AS status FROM judged"""
ORACLES["audit_totals"] = f"""WITH {JUDGE}
SELECT CASE WHEN len(issues) > 0 THEN 'issues' ELSE 'passed' END AS status, count(*) AS samples, sum(len(issues))::BIGINT AS issues FROM judged GROUP BY 1"""
ORACLES["source_audit"] = f"""WITH {SOURCES}, p AS (SELECT *, k % 16 = 1 AS conf, 'https://f.example.org/' || k AS f FROM src WHERE kind IN ('rss', 'generic') AND polling_enabled),
 c AS (SELECT *, CASE WHEN kind = 'rss' THEN url WHEN conf OR k % 2 = 1 THEN f END AS cand FROM p),
 w AS (SELECT *, CASE WHEN cand IS NULL THEN NULL WHEN kind = 'rss' THEN cand WHEN k % 3 = 1 THEN cand END AS work FROM c)
SELECT id AS source_id, CASE WHEN k % 5 = 4 THEN 'unreachable' WHEN work IS NULL THEN 'no-feed' WHEN kind = 'rss' OR conf THEN 'ok' ELSE 'upgrade-available' END AS status, work AS feed_url,
  length(work) AS entries, (cand IS NOT NULL)::INT AS candidates, CASE WHEN k % 5 = 4 THEN 'timeout token=[redacted]' END AS issue FROM w"""
ORACLES["source_filter"] = f"WITH {SOURCES} SELECT id, title FROM src WHERE lower(title) = 'supplier#000000007'"
ORACLES["folder_groups"] = f"""WITH {SOURCES}, g AS (SELECT *, CASE WHEN kind = 'academic' THEN 'academic' WHEN kind IN ('zhihu', 'zhihu_follow', 'x', 'xiaohongshu') THEN 'platform' ELSE 'web' END AS base FROM src)
SELECT CASE WHEN category IS NOT NULL THEN 'custom:' || lower(category) ELSE base END AS folder_id,
  CASE WHEN category IS NOT NULL THEN category WHEN base = 'web' THEN '网页与订阅' WHEN base = 'platform' THEN '平台动态' ELSE '学术追踪' END AS folder_title,
  CASE WHEN category IS NOT NULL THEN 99 WHEN base = 'web' THEN 0 WHEN base = 'platform' THEN 1 ELSE 2 END AS folder_rank, category IS NOT NULL AS custom, id AS source_id, title AS source_title FROM g"""

REASON = "CASE page_id % 3 WHEN 0 THEN 'no feed document' WHEN 1 THEN 'no readable list of posts' ELSE 'no connector for telegraph' END"
ORACLES["ingest_rejects"] = f"SELECT 'broken-' || page_id % 3 AS source_id, 10000000 + page_id AS seq, {REASON} AS problem FROM pages"
ORACLES["ingest_runs"] = f"""WITH {WORKS}, r AS (
 SELECT 'feed-' || {DIALECT} AS source_id, count(*) AS fetched FROM documents GROUP BY 1
 UNION ALL SELECT 'qa', count(*) FILTER (WHERE o_orderkey % 9 <> 0) FROM orders
 UNION ALL SELECT 'x' || user_id, count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) FROM events GROUP BY 1
 UNION ALL SELECT 'follow', count(*) FROM ({ORACLES["follow_cards"]})
 UNION ALL SELECT 'notes', count(*) FROM part
 UNION ALL SELECT source_id, count(*) FROM works GROUP BY 1)
SELECT source_id, 'success' AS outcome, fetched, NULL AS message FROM r
UNION ALL SELECT DISTINCT 'broken-' || page_id % 3, 'failure', 0, {REASON} FROM pages"""

ORACLES["changed_pages"] = "SELECT page_id AS seq, url, sha256(html) AS fingerprint FROM pages WHERE page_id % 3 = 0"
ORACLES["replayed_pages"] = """SELECT page_id AS seq, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS source_id FROM pages
WHERE page_id % 3 = 0 OR lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) LIKE 'www.%'"""
ORACLES["stale_results"] = f"""WITH {SOURCES}
SELECT o_orderkey, 's' || o_custkey % 120 AS source_id FROM orders JOIN src ON src.id = 's' || o_custkey % 120
WHERE k % 7 <> 0 AND (k % 11 <> 0 OR kind = 'manual') AND (k % 3 <> 0 OR kind <> 'generic')"""
CURSOR = """cur AS (SELECT 'u' || user_id AS author_id, min(event_id) AS since FROM events WHERE event_type = 'signup' GROUP BY 1)"""
ORACLES["since_id_increment"] = f"""WITH {CURSOR}
SELECT e.a AS author_id, event_id::VARCHAR AS post_id FROM (SELECT *, 'u' || user_id AS a FROM events) e LEFT JOIN cur ON cur.author_id = e.a WHERE (since IS NULL OR event_id > since) AND event_type <> 'click'"""
ORACLES["since_id_cursors"] = "SELECT 'u' || user_id AS author_id, max(event_id)::VARCHAR AS since_id FROM events GROUP BY 1"
ORACLES["latest_cursor"] = "SELECT max(event_id)::VARCHAR AS since_id FROM events"
ORACLES["stream_health"] = ORACLES["source_health"]

ORACLES["probe_verdicts"] = f"""WITH {LIST}, d AS (SELECT DISTINCT doc, kind FROM li)
SELECT doc AS seq, CASE WHEN doc % 2 = 0 THEN 'rss' ELSE 'generic' END AS kind, CASE WHEN doc % 2 = 0 THEN 'https://list.example.org/feed/' || doc || '.xml' ELSE 'https://list.example.org/p/' || doc END AS url,
  CASE WHEN doc % 2 = 0 THEN 'Feed ' || doc ELSE 'List ' || doc END AS title, CASE WHEN doc % 2 = 0 THEN 0.98 WHEN kind = 2 THEN 0.91 ELSE 0.89 END::DOUBLE AS confidence, false AS requires_review, 'active' AS initial_status FROM d
UNION ALL SELECT 2000000 + doc, 'rss', 'https://list.example.org/feed/' || doc || '.xml', 'Feed ' || doc, 1.0, false, 'active' FROM d WHERE doc % 2 = 0
UNION ALL SELECT 1000000 + page_id, 'generic', url, {TITLE}, 0.2, true, 'needs_review' FROM pages"""
ORACLES["probe_previews"] = f"""WITH {LIST}, d AS (SELECT DISTINCT doc FROM li WHERE doc % 2 = 0)
SELECT doc AS seq, k % 8 + 1 AS row, {LINK} AS url, title FROM li WHERE doc % 2 = 1
UNION ALL SELECT doc, 1, 'https://list.example.org/f/' || doc, 'From the feed ' || doc FROM d UNION ALL SELECT 2000000 + doc, 1, 'https://list.example.org/f/' || doc, 'From the feed ' || doc FROM d
UNION ALL SELECT 1000000 + page_id, 1, url, {TITLE} FROM pages"""
# The document texts have no escaped dollars; a blank pair never counts, its second dollar may open the next pair.
ORACLES["paired_tex"] = r"""SELECT doc_id, len(regexp_extract_all(text, '\$([ \t]*[^$\s][^$\r\n]*)\$'))::BIGINT AS pairs FROM documents"""

ORACLES["preview_saved"] = f"""WITH {LIST}
SELECT 'https://list.example.org/feed/' || doc || '.xml' AS url, 'rss' AS kind, 'active' AS status, true AS polling_enabled, 1 AS entries FROM li WHERE doc % 2 = 0 GROUP BY doc
UNION ALL SELECT 'https://list.example.org/p/' || doc, 'generic', 'active', true, count(DISTINCT {LINK}) FROM li WHERE doc % 2 = 1 GROUP BY doc
UNION ALL SELECT DISTINCT url, 'generic', 'needs_review', true, 1 FROM pages"""
SAID = "CASE p_partkey % 8 WHEN 0 THEN chr(8212) WHEN 1 THEN chr(8217) WHEN 2 THEN chr(8230) WHEN 3 THEN '&lt;' WHEN 4 THEN chr(8770) || chr(824) WHEN 5 THEN chr(8211) WHEN 6 THEN '&nosuch;' ELSE chr(65533) END"
ORACLES["entity_texts"] = f"""WITH p AS (SELECT *, {SAID} AS c FROM part)
SELECT p_partkey, chr(10) || p_name || ' ' || c || p_type || chr(160) || '& ' || c || chr(10) AS said FROM p"""

# Five sources to a dialect, numbered by the document's place.
NUMBERED = f"{FEED}, nf AS (SELECT *, 'feed-' || d || '-' || doc % 5 AS source_id, doc % 5 AS number FROM feed)"
ORACLES["ingest_unchanged"] = f"""WITH {NUMBERED}
SELECT source_id, 'success' AS outcome, count(*) FILTER (WHERE doc % 3 = 0) AS fetched, count(*) FILTER (WHERE doc % 3 = 0) AS inserted FROM nf GROUP BY source_id"""
ORACLES["ingest_replayed"] = f"WITH {NUMBERED} SELECT {ENTRY} AS canonical_url, source_id FROM nf WHERE doc % 3 = 0 OR d = 'atom'"
ORACLES["ingest_stale"] = f"WITH {NUMBERED} SELECT {ENTRY} AS canonical_url, source_id FROM nf WHERE d <> 'json' AND number <> 1"
CHECKED = f"CASE number WHEN 3 THEN {AS_OF} ELSE {AS_OF + 3_600_000} END"
ORACLES["ingest_sources"] = f"""WITH {NUMBERED}, s AS (SELECT source_id, d, number, max(doc * 3 + r) AS newest, max(doc) AS last, {CHECKED} AS checked, CASE WHEN number % 2 = 1 THEN 60 END AS minutes FROM nf GROUP BY ALL)
SELECT source_id AS id, CASE WHEN number IN (0, 4) THEN 'error' ELSE 'active' END AS status, (number IN (0, 4))::BIGINT AS failure_count, 't' || newest AS etag,
  CASE WHEN number = 0 THEN 'HTTP 503' WHEN number = 4 AND d = 'json' THEN 'no feed document' WHEN number = 4 THEN 'feed cannot be parsed' END AS last_error, checked AS last_checked_at,
  CASE WHEN number IN (0, 4) THEN checked + 300000 ELSE checked + {refresh('source_id', 'checked', 'minutes')} END AS next_check_at,
  4::BIGINT AS metadata_revision, CASE WHEN d = 'rss' THEN 'https://news.example.org/logo-' || last || '.png' END AS icon_url FROM s"""
ORACLES["ingest_checkpoints"] = f"""WITH c AS (SELECT user_id, max(event_id) FILTER (WHERE user_id % 5 <> 0 OR event_id // 200 % 2 = 0) AS newest FROM events GROUP BY user_id)
SELECT 'sub-x' || user_id AS subscription_id, (100000000000000000 + newest)::VARCHAR AS since_id, {AS_OF} + CASE WHEN user_id % 5 = 0 THEN 0 ELSE 3600000 END AS updated_at FROM c WHERE newest IS NOT NULL"""
ORACLES["stream_ingest_batches"] = f"""WITH {NUMBERED}
SELECT {ENTRY} AS canonical_url, source_id, title, published_at, {ENTRY} AS canonical_identity FROM nf"""
ORACLES["stream_health_late"] = ORACLES["source_health"]
