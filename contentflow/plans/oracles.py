"""The registered jobs as plain SQL over the same tables, for checking results.

These are written from the meaning of each job, with windows and subqueries,
not from its Spark plan.
"""

from __future__ import annotations

from contentflow.plans.roles import AS_OF, DAY, KINDS, ORDER_CLOCK, STATUSES

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values, number: str) -> str:
    return f"({_list(values)})[(({number}) % {len(values)} + 1)::INT]"


def canon(url: str) -> str:
    """Canonical form of the address shapes that occur in the tables."""
    base = f"regexp_replace({url}, '#.*$', '')"
    host = f"lower(regexp_extract({base}, '^https?://[^/?#]*'))"
    path = f"regexp_extract({base}, '^https?://[^/?#]*([^?#]*)', 1)"
    slim = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    query = f"regexp_extract({base}, '\\?(.*)$', 1)"
    drop = "(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|ref|source)(=|$)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{drop}')), '&')"
    return f"({host} || {slim} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"


WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'), ' ')"


def compact(text: str) -> str:
    return f"nullif({collapse(text)}, '')"


def shortened(text: str, limit: int) -> str:
    clean = collapse(text)
    return f"CASE WHEN {clean} = '' THEN NULL WHEN length({clean}) > {limit} THEN substr({clean}, 1, {limit - 1}) || '…' ELSE {clean} END"


def hash32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def refresh(source: str, checked: str, interval: str) -> str:
    draw = hash32(f"{source} || ':' || {checked}::VARCHAR")
    jitter = f"floor({interval} * 0.1 * (({draw} % 2001)::DOUBLE / 1000 - 1) + 0.5)"
    return f"""(CASE WHEN coalesce({interval}, 0) = 0 THEN 30 + {draw} % 31
        ELSE greatest(5, {interval} + {jitter}) END * 60000)::BIGINT"""


SOURCES = f"""src AS (SELECT 's' || s_suppkey AS id, 'https://h' || s_suppkey % 7 || '.example.org/feed/' || s_suppkey AS url, s_name AS title,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Nation ' || s_nationkey END AS category, {pick(KINDS, 's_suppkey')} AS kind,
  {pick(KINDS, 's_suppkey')} AS connector_id, {pick(STATUSES, 's_suppkey // 2')} AS status, s_suppkey % 6 <> 0 AS polling_enabled,
  CASE s_suppkey % 3 WHEN 1 THEN 30 WHEN 2 THEN 120 END AS refresh_interval_minutes, 'tag' || s_suppkey AS etag,
  {AS_OF - 5 * DAY} + round(s_acctbal * 100)::BIGINT * 600 AS next_check_at, s_suppkey * 1000 AS created_at,
  s_suppkey * 1000 + s_nationkey AS updated_at, s_suppkey AS k FROM supplier)"""

ORIGINS = """org AS (SELECT 'e' || l_orderkey AS entry_id, 's' || l_suppkey AS source_id,
  CASE l_returnflag WHEN 'A' THEN 'rss' WHEN 'N' THEN 'generic' ELSE 'x' END AS provider_id, l_linenumber::VARCHAR AS external_id,
  'https://www.example.org/o/' || l_orderkey || '?line=' || l_linenumber AS original_url, max(epoch_ms(l_shipdate)) AS observed_at
  FROM lineitem GROUP BY ALL)"""

ENTRIES = f"""own AS (SELECT entry_id, source_id AS owner FROM org
    QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY observed_at, source_id) = 1),
 ent AS (SELECT 'e' || o_orderkey AS id, coalesce(owner, 's' || o_custkey % 10) AS source_id, 'https://www.example.org/o/' || o_orderkey AS canonical_url,
  'Order ' || o_orderkey AS title, 'Customer ' || o_custkey AS author,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN epoch_ms(o_orderdate) END AS published_at,
  epoch_ms(o_orderdate) + {DAY} * (o_custkey % 30) AS created_at,
  CASE WHEN o_custkey % 4 <> 0 THEN epoch_ms(o_orderdate) + {DAY} * (o_custkey % 30) + 1000 END AS observed_at,
  o_orderstatus = 'F' AS is_read, o_orderpriority = '1-URGENT' AS is_favorite, {pick(KINDS, 'o_custkey')} AS provider_id
  FROM orders LEFT JOIN own ON own.entry_id = 'e' || o_orderkey)"""

LIBRARY = f"WITH {SOURCES}, {ORIGINS}, {ENTRIES}"

DOCS = f"""doc AS (SELECT doc_id AS seq, source AS source_id, 'https://News.Example.org/a/' || md5(text) || '/?utm_source=' || source || '&id=1#top' AS original_url,
  'https://news.example.org/a/' || md5(text) || '?id=1' AS canonical_url, 'Document ' || doc_id AS title,
  CASE WHEN doc_id % 3 <> 0 THEN lang END AS author, CASE WHEN doc_id % 4 = 0 THEN {AS_OF} - doc_id * 60000 END AS published_at,
  CASE WHEN doc_id % 5 <> 0 THEN 'n=' || n_chars END AS summary, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS external_id,
  {AS_OF} + doc_id AS observed_at, 'rss' AS provider_id FROM documents)"""

RUNS = """run AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, 'u' || user_id AS source_id, user_id AS k,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'empty' ELSE 'success' END AS outcome,
  floor(value)::BIGINT AS fetched, floor(value / 2)::BIGINT AS inserted, 'run ' || props AS message, epoch_us(ts) // 1000 AS created_at, event_id FROM events)"""

ORACLES["canonical_urls"] = f"SELECT page_id, {canon('url')} AS canonical_url, true AS is_public FROM pages"

ORACLES["public_url_check"] = """
SELECT c_custkey, c_custkey % 11 IN (0, 9) OR (c_custkey % 11 = 3 AND NOT (c_custkey % 40 BETWEEN 16 AND 31)) AS is_public,
  c_custkey % 11 IN (0, 9, 4, 5, 8) OR (c_custkey % 11 = 3 AND NOT (c_custkey % 40 BETWEEN 16 AND 31)) AS feed_allowed FROM customer"""

ORACLES["taxonomy_filter"] = f"""
WITH p AS (SELECT page_id, {pick(["tag", "posts", "archives", "Category", "tagged", "categories"], "page_id")} AS folder FROM pages)
SELECT page_id, lower(folder) IN ('tag', 'archives', 'category', 'categories') AS deep_page, lower(folder) IN ('tag', 'archives', 'category', 'categories') AS flat_page,
  lower(folder) IN ('tag', 'archives', 'category', 'categories') AS deep_stored, false AS flat_stored FROM p"""

ORACLES["source_marks"] = f"""WITH {SOURCES}
SELECT id, CASE kind WHEN 'generic' THEN 'web' WHEN 'manual' THEN 'link' WHEN 'zhihu_follow' THEN 'zhihu-follow' ELSE kind END AS mark,
  CASE WHEN kind IN ('rss', 'generic') THEN 'https://h' || k % 7 || '.example.org/favicon.ico' END AS favicon FROM src"""

ORACLES["profile_targets"] = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'id_' || c_custkey END AS profile_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'https://www.xiaohongshu.com/user/profile/id_' || c_custkey END AS url FROM customer"""

ORACLES["link_dates"] = """
SELECT o_orderkey, epoch_ms(try_cast((2000 + o_orderkey % 30) || '-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS TIMESTAMP)) AS published_at
FROM orders"""

ORACLES["published_days"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 OR year(o_orderdate) < 2000 THEN NULL ELSE epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) END AS published_at FROM orders"""

ORACLES["compact_text"] = f"SELECT doc_id, md5({compact('text')}) AS whole_md5, {shortened('text', 240)} AS title, {shortened('text', 500)} AS summary FROM documents"

SECRET = r"(?i)\b(access[_-]?token|api[_-]?key|client[_-]?secret|token|secret|signature|sig)\s*[=:]\s*[^\s,;]+"
ORACLES["redacted_text"] = rf"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)Bearer\s+\S+', 'Bearer [redacted]', 'g'), '{SECRET}', '\1=[redacted]', 'g')) AS redacted_md5 FROM documents"""

ORACLES["redacted_messages"] = """
SELECT event_id, 'GET https://h' || event_id % 9 || '.example.org/feed?… failed, Bearer [redacted] api_key=[redacted]' AS message FROM events"""

# The document texts have no escaped dollars, so no look-behind is needed here.
FORMULA = r"""regexp_matches(f, '\\[A-Za-z]+') AS command,
  regexp_matches(f, '[A-Za-zα-ωΑ-Ω0-9)}\]]\s*[_^]\s*(\{[^}\r\n]+\}|[A-Za-zα-ωΑ-Ω0-9])') AS script,
  regexp_matches(f, '[=<>±÷]') AS operator, regexp_matches(f, '^[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*$') AS symbol,
  regexp_matches(f, '(^|[.!?])\s+(@|https?://|[A-Z])') AS sentence"""
ORACLES["leaked_tex"] = rf"""
WITH found AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\$([^$\r\n]{{1,400}})\$', 1), lambda x: trim(x, ' ')) AS fs FROM documents),
 one AS (SELECT doc_id, i, fs[i] AS f FROM (SELECT doc_id, fs, unnest(range(1, len(fs) + 1)) AS i FROM found)),
 judged AS (SELECT doc_id, i, f, {FORMULA} FROM one),
 hit AS (SELECT doc_id, i, f FROM judged WHERE (command OR script OR operator OR symbol) AND NOT (sentence AND NOT command))
SELECT d.doc_id, count(hit.i) AS leaked, coalesce(arg_min('$' || f || '$', i), '') AS first FROM documents d LEFT JOIN hit ON hit.doc_id = d.doc_id GROUP BY d.doc_id"""

EXCERPT = collapse("regexp_replace(text, '<[^>]*>', ' ', 'g')")
ORACLES["model_excerpt"] = f"""
SELECT doc_id, part, source AS source_title, md5(p) AS excerpt_md5, length(p) AS n_chars FROM (
 SELECT doc_id, source, part, substr(e, part * 18000 + 1, 18000) AS p FROM (
  SELECT doc_id, source, e, unnest(range(0, (length(e) + 17999) // 18000)) AS part FROM (SELECT doc_id, source, {EXCERPT} AS e FROM documents)))"""

ORACLES["failure_classes"] = f"""
SELECT event_id, 'u' || user_id AS source_id, {pick(["proxy", "dns", "timeout", "other"], "event_id")} AS failure_class FROM events WHERE event_type = 'error'"""

ORACLES["srcset_choice"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 * 90 > 100 THEN '//img.example.org/' || p_partkey || '.png'
  ELSE 'https://cdn.example.org/w_' || p_partkey % 7 * 100 || ',c_fit/' || p_partkey END AS image FROM part"""

# --- merge ---


def last_known(column: str, order: str = "seq") -> str:
    return f"arg_max({column}, {order}) FILTER (WHERE {column} IS NOT NULL)"


def upsert(order: str = "seq", where: str = "true") -> str:
    return f"""SELECT canonical_url, arg_min(source_id, {order}) AS source_id, arg_min(original_url, {order}) AS original_url,
  arg_max(title, {order}) AS title, {last_known('author', order)} AS author, {last_known('published_at', order)} AS published_at,
  {last_known('summary', order)} AS summary, {last_known('external_id', order)} AS external_id, arg_min(observed_at, {order}) AS observed_at,
  arg_max(sha256(title || chr(0) || coalesce(published_at::VARCHAR, '') || chr(0) || coalesce(summary, '')), {order}) AS content_hash, 'rss' AS provider_id
  FROM doc WHERE {where} GROUP BY canonical_url"""


ORACLES["entries_upsert"] = f"WITH {DOCS} {upsert()}"
ORACLES["entries_upsert_two_batches"] = f"WITH {DOCS} {upsert('(seq % 2) * 1000000000 + seq')}"
ORACLES["pages_upsert"] = f"""
SELECT canonical_url, arg_min(url, page_id) AS original_url, arg_max(title, page_id) AS title, {AS_OF} + min(page_id) AS observed_at FROM (
  SELECT page_id, url, {canon('url')} AS canonical_url, {compact("replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")} AS title FROM pages)
GROUP BY canonical_url"""
ORACLES["new_entries"] = f"""WITH {DOCS}, first AS ({upsert(where='seq % 3 = 0')}),
 gone AS (SELECT canonical_url FROM first WHERE author = 'en')
SELECT DISTINCT canonical_url FROM doc WHERE seq % 3 <> 0 AND canonical_url NOT IN (SELECT canonical_url FROM first) AND canonical_url NOT IN (SELECT canonical_url FROM gone)"""
ORACLES["tombstoned_merge"] = f"""WITH {DOCS}
SELECT canonical_url, arg_min(source_id, seq) AS source_id, arg_max(title, seq) AS title FROM doc
WHERE canonical_url NOT IN (SELECT canonical_url FROM doc WHERE seq % 10 = 0) GROUP BY canonical_url"""
ORACLES["origins_flat"] = f"""WITH {DOCS}, o AS (SELECT *, (seq % 2) * 1000000000 + seq AS ord, coalesce(external_id, '') AS ext FROM doc)
SELECT sha256(canonical_url) AS entry_id, source_id, provider_id, ext AS external_id, arg_max(original_url, ord) AS original_url, arg_max(observed_at, ord) AS observed_at
FROM o GROUP BY canonical_url, source_id, provider_id, ext"""
ORACLES["origins_nested"] = f"""{LIBRARY}
SELECT id, 0 AS part, 1 AS parts, count(org.entry_id) AS n, arg_min(org.source_id, row(org.observed_at, org.source_id, org.provider_id, org.external_id)) AS first_source,
  max(org.observed_at) AS last_observed FROM ent LEFT JOIN org ON org.entry_id = ent.id GROUP BY id"""
ORACLES["origins_per_provider"] = f"""{LIBRARY}
SELECT DISTINCT org.entry_id, org.provider_id AS provider FROM org JOIN ent ON ent.id = org.entry_id LEFT JOIN src ON src.id = ent.source_id
WHERE org.provider_id IS DISTINCT FROM src.connector_id"""
ORACLES["source_lookup"] = f"""{LIBRARY}
SELECT ent.id, ent.source_id, src.title AS source_title, src.connector_id AS source_connector FROM ent LEFT JOIN src ON src.id = ent.source_id"""
ORACLES["entry_by_url"] = f"{LIBRARY} SELECT id, title, author FROM ent WHERE canonical_url = 'https://www.example.org/o/77'"

# --- timeline ---
T = "id, source_id, published_at, observed_at, created_at"
KEY = "coalesce(published_at, observed_at, created_at)"
ORDER = "published_at IS NULL, published_at DESC, observed_at DESC NULLS LAST, created_at DESC, id"
ORACLES["timeline_page"] = f"{LIBRARY} SELECT {T} FROM ent ORDER BY {ORDER} LIMIT 200"
ORACLES["timeline_range"] = f"{LIBRARY} SELECT {T} FROM ent WHERE {KEY} >= {ORDER_CLOCK} AND {KEY} < {ORDER_CLOCK + 60 * DAY}"
ORACLES["timeline_by_source"] = f"{LIBRARY} SELECT {T} FROM ent WHERE source_id = 's5' OR id IN (SELECT entry_id FROM org WHERE source_id = 's5')"
ORACLES["timeline_unbounded"] = f"{LIBRARY} SELECT {T} FROM ent"
TODAY = f"{KEY} >= {ORDER_CLOCK - DAY // 2} AND {KEY} < {ORDER_CLOCK + DAY // 2}"
ORACLES["library_counts"] = f"""{LIBRARY} SELECT count(*) FILTER (WHERE NOT is_read) AS unread, count(*) FILTER (WHERE is_favorite) AS favorite,
  count(*) FILTER (WHERE {TODAY}) AS today FROM ent"""
ORACLES["view_today"] = f"{LIBRARY} SELECT {T} FROM ent WHERE {TODAY}"
ORACLES["view_unread"] = f"{LIBRARY} SELECT {T} FROM ent WHERE NOT is_read"
ORACLES["view_favorite"] = f"{LIBRARY} SELECT {T} FROM ent WHERE is_favorite AND (source_id = 's1' OR id IN (SELECT entry_id FROM org WHERE source_id = 's1'))"

# --- health ---
ORACLES["source_health"] = f"""WITH {RUNS},
 marked AS (SELECT *, sum((outcome <> 'failure')::INT) OVER w AS ok_island, sum((outcome = 'success')::INT) OVER w AS full_island,
   row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS back
   FROM run WINDOW w AS (PARTITION BY source_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)),
 folded AS (SELECT *, sum((outcome = 'failure')::INT) OVER (PARTITION BY source_id, ok_island) AS failures,
   sum((outcome = 'empty')::INT) OVER (PARTITION BY source_id, full_island) AS empties FROM marked),
 last AS (SELECT *, {pick(KINDS, 'k')} AS kind, CASE WHEN k % 3 <> 0 THEN 60 END AS minutes FROM folded WHERE back = 1),
 st AS (SELECT *, CASE WHEN outcome = 'failure' AND failures >= 5 THEN 'paused' WHEN outcome = 'failure' THEN 'error'
   WHEN kind = 'generic' AND empties >= 3 THEN 'needs_review' ELSE 'active' END AS status FROM last)
SELECT source_id, status, CASE WHEN outcome = 'failure' THEN failures ELSE 0 END::BIGINT AS failure_count, empties::BIGINT AS consecutive_empty,
  CASE WHEN outcome = 'failure' THEN message END AS last_error, created_at AS last_checked_at,
  CASE status WHEN 'error' THEN created_at + least(21600000, 300000 * 2 ** (failures - 1))::BIGINT
    WHEN 'active' THEN CASE WHEN k % 7 <> 0 THEN created_at + {refresh('source_id', 'created_at', 'minutes')} END END AS next_check_at FROM st"""
ORACLES["run_log_latest"] = f"WITH {RUNS} SELECT id, source_id, outcome, created_at FROM run ORDER BY created_at DESC, id DESC LIMIT 100"
ORACLES["run_log_of_source"] = f"WITH {RUNS} SELECT id, source_id, outcome, created_at FROM run WHERE source_id = 'u7' ORDER BY created_at DESC, id DESC LIMIT 50"
ORACLES["run_totals"] = f"WITH {RUNS} SELECT source_id, outcome, count(*) AS runs, sum(fetched)::BIGINT AS fetched, sum(inserted)::BIGINT AS inserted FROM run GROUP BY ALL"
DUE = f"polling_enabled AND status IN ('active', 'error') AND next_check_at <= {AS_OF}"
ORACLES["due_sources"] = f"WITH {SOURCES} SELECT id, next_check_at FROM src WHERE {DUE}"
ORACLES["fetch_plan"] = f"""WITH {SOURCES}, due AS (SELECT *, 'h' || k % 7 || '.example.org' AS host FROM src WHERE {DUE})
SELECT id AS source_id, host, row_number() OVER (PARTITION BY host ORDER BY next_check_at, id) AS wave, {hash32('host')} % 2 AS lane, next_check_at FROM due"""
ORACLES["next_checks"] = f"""WITH {SOURCES}
SELECT id, {AS_OF} + k + {refresh('id', f'({AS_OF} + k)', 'refresh_interval_minutes')} AS next_check_at FROM src"""
ORACLES["sources_by_update"] = f"WITH {SOURCES} SELECT id, title, updated_at FROM src"

# --- mutations ---
LEFT_AFTER = """left_org AS (SELECT * FROM org WHERE source_id NOT LIKE '%3'),
 heir AS (SELECT entry_id, source_id AS heir FROM left_org QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY observed_at, source_id) = 1)"""
ORACLES["source_delete"] = f"""{LIBRARY}, {LEFT_AFTER}
SELECT id, CASE WHEN source_id LIKE '%3' THEN heir ELSE source_id END AS source_id FROM ent JOIN heir ON heir.entry_id = ent.id"""
ORACLES["source_delete_origins"] = f"""{LIBRARY}, {LEFT_AFTER}
SELECT source_id, count(*) AS origins, count(DISTINCT entry_id) AS entries FROM left_org GROUP BY source_id"""
ORACLES["rule_reset"] = f"""{LIBRARY}, gen AS (SELECT id FROM src WHERE kind = 'generic'),
 left_org AS (SELECT * FROM org WHERE source_id NOT IN (FROM gen)),
 heir AS (SELECT entry_id, source_id AS heir FROM left_org QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY observed_at, source_id) = 1),
 kept AS (SELECT ent.id, CASE WHEN source_id IN (FROM gen) THEN heir ELSE source_id END AS source_id FROM ent JOIN heir ON heir.entry_id = ent.id)
SELECT src.id, CASE WHEN kind = 'generic' THEN 'active' ELSE status END AS status, CASE WHEN kind = 'generic' THEN {AS_OF} ELSE next_check_at END AS next_check_at,
  CASE WHEN kind = 'generic' THEN '{{"version":1}}' END AS extraction_rule, (SELECT count(*) FROM kept WHERE kept.source_id = src.id) AS entries FROM src"""
ORACLES["rule_replace"] = f"""WITH {SOURCES}
SELECT id, status, CASE WHEN kind = 'generic' THEN '{{"version":1}}' END AS extraction_rule, CASE WHEN kind = 'generic' THEN {AS_OF} ELSE updated_at END AS updated_at, next_check_at FROM src"""
ORACLES["origin_delete"] = f"""{LIBRARY}, pairs AS (SELECT DISTINCT entry_id, source_id FROM org WHERE external_id IN ('1', '2', '3')),
 left_org AS (SELECT org.* FROM org ANTI JOIN pairs USING (entry_id, source_id)),
 heir AS (SELECT entry_id, source_id AS heir FROM left_org QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY observed_at, source_id) = 1)
SELECT id, CASE WHEN (id, source_id) IN (SELECT (entry_id, source_id) FROM pairs) THEN coalesce(heir, source_id) ELSE source_id END AS source_id
FROM ent LEFT JOIN heir ON heir.entry_id = ent.id WHERE heir IS NOT NULL OR id NOT IN (SELECT entry_id FROM pairs)"""
ACTIONS = """act AS (SELECT 'e' || (event_id * 7 + user_id) % 20000 AS entry_id, CASE WHEN event_type IN ('view', 'click') THEN 'read'
  WHEN event_type IN ('purchase', 'signup') THEN 'favorite' ELSE 'dismiss' END AS action, event_type IN ('view', 'purchase') AS value, event_id AS seq FROM events),
 done AS (SELECT entry_id, arg_max(value, seq) FILTER (WHERE action = 'read') AS r, arg_max(value, seq) FILTER (WHERE action = 'favorite') AS f,
  bool_or(action = 'dismiss') AS gone FROM act GROUP BY entry_id)"""
ORACLES["user_actions"] = f"""{LIBRARY}, {ACTIONS}
SELECT id, coalesce(r, is_read) AS is_read, coalesce(f, is_favorite) AS is_favorite FROM ent LEFT JOIN done ON done.entry_id = ent.id WHERE NOT coalesce(gone, false)"""
ORACLES["user_dismissals"] = f"""{LIBRARY}, {ACTIONS}
SELECT canonical_url AS canonical_identity, {AS_OF} AS dismissed_at FROM ent JOIN done ON done.entry_id = ent.id WHERE gone"""
ORACLES["register_sources"] = f"""WITH {SOURCES}, want AS (SELECT c_custkey AS seq, 'https://h' || c_custkey % 7 || '.example.org/feed/' || c_custkey % 500 AS url, c_name, c_mktsegment FROM customer),
 fresh AS (SELECT * FROM want WHERE url NOT IN (SELECT url FROM src) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT url, title, category, kind, next_check_at, NULL AS target_id FROM src
UNION ALL SELECT url, c_name, trim(c_mktsegment), 'rss', {AS_OF}, 't' || seq FROM fresh"""
SETTINGS = f"""want AS (SELECT *, CASE WHEN k % 11 = 0 THEN '' ELSE 'New ' || title END AS new_title, CASE WHEN k % 4 = 0 THEN 'Shared folder' END AS new_category,
  CASE WHEN k % 2 = 0 THEN kind ELSE {pick(["generic", "manual", "rss", "x"], "k")} END AS new_kind, k % 5 <> 0 AS want_poll, CASE WHEN k % 3 = 0 THEN 45 ELSE 60 END AS want_minutes FROM src),
 judged AS (SELECT *, CASE WHEN new_title = '' THEN 'title missing' WHEN kind NOT IN ('rss', 'generic', 'manual') AND new_kind <> kind THEN 'kind is fixed by the connector'
  WHEN kind IN ('rss', 'generic', 'manual') AND new_kind NOT IN ('rss', 'generic', 'manual') THEN 'kind not public' WHEN want_poll AND want_minutes = 45 THEN 'interval not offered' END AS reject,
  CASE WHEN new_kind = 'manual' THEN false ELSE want_poll END AS new_poll FROM want),
 done AS (SELECT *, CASE WHEN new_poll THEN want_minutes END AS new_minutes, reject IS NULL AS ok, reject IS NULL AND new_kind <> kind AS moved FROM judged)"""
ORACLES["settings_check"] = f"WITH {SOURCES}, {SETTINGS} SELECT id, reject FROM done"
ORACLES["settings_update"] = f"""WITH {SOURCES}, {SETTINGS}
SELECT id, CASE WHEN ok THEN new_title ELSE title END AS title, CASE WHEN ok THEN new_category ELSE category END AS category, CASE WHEN ok THEN new_kind ELSE kind END AS kind,
  CASE WHEN moved THEN new_kind ELSE connector_id END AS connector_id, CASE WHEN moved THEN 'active' ELSE status END AS status,
  CASE WHEN ok THEN new_poll ELSE polling_enabled END AS polling_enabled, CASE WHEN ok THEN new_minutes ELSE refresh_interval_minutes END AS refresh_interval_minutes,
  CASE WHEN NOT moved THEN etag END AS etag,
  CASE WHEN NOT ok THEN next_check_at WHEN new_poll THEN {AS_OF} + {refresh('id', str(AS_OF), 'new_minutes')} END AS next_check_at, CASE WHEN ok THEN {AS_OF} ELSE updated_at END AS updated_at FROM done"""
ORACLES["settings_subscriptions"] = f"""WITH {SOURCES}, {SETTINGS}
SELECT id AS source_id, CASE WHEN moved THEN new_kind ELSE connector_id END AS connector_id, CASE WHEN NOT moved THEN 'acc' END AS account_id, id LIKE '%1' AND NOT moved AS marked FROM done"""
ORACLES["pause_sources"] = f"""WITH {SOURCES}
SELECT id, CASE WHEN kind = 'x' THEN 'paused' ELSE status END AS status, polling_enabled AND kind <> 'x' AS polling_enabled, CASE WHEN kind <> 'x' THEN next_check_at END AS next_check_at,
  CASE WHEN kind = 'x' THEN repeat('gone ', 80) END AS last_error FROM src"""
ORACLES["subscription_upsert"] = f"""WITH {SOURCES}, ch AS (SELECT 's' || o_custkey % 150 AS source_id, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 150 ORDER BY o_orderkey DESC) = 1)
SELECT coalesce(src.id, ch.source_id) AS source_id, coalesce(src.id, 'sub' || ch.k) AS id, CASE WHEN ch.k IS NOT NULL THEN 't' || ch.k END AS target_id,
  CASE WHEN ch.k IS NULL THEN 'acc' END AS account_id, coalesce(src.created_at, ch.k) AS created_at, coalesce(ch.k, src.updated_at) AS updated_at FROM src FULL JOIN ch ON ch.source_id = src.id"""
ORACLES["followee_upsert"] = """
SELECT 'f' || c_custkey % 700 AS url_token, arg_max(c_name, c_custkey) AS fullname, arg_max(c_mktsegment, c_custkey) AS headline, arg_max(floor(c_acctbal)::BIGINT, c_custkey) AS follower_count
FROM customer GROUP BY c_custkey % 700"""
ORACLES["library_backfill"] = f"""{LIBRARY},
 old AS (SELECT ent.*, coalesce(CASE WHEN is_read THEN ent.provider_id END, src.kind) AS prov FROM ent LEFT JOIN src ON src.id = ent.source_id),
 own2 AS (SELECT id AS entry_id, source_id, coalesce(prov, 'generic') AS provider_id, '' AS external_id FROM old),
 alls AS (SELECT entry_id, source_id, provider_id, external_id FROM org WHERE provider_id <> 'rss' UNION SELECT * FROM own2)
SELECT id, prov AS provider_id, coalesce(observed_at, created_at) AS observed_at, canonical_url AS canonical_identity, (SELECT count(*) FROM alls WHERE alls.entry_id = old.id) AS origins FROM old"""

# --- maintenance ---
LEGACY = """raw AS (SELECT *, o_orderkey AS k, o_orderkey % 8 AS shape FROM orders),
 linked AS (SELECT *, CASE WHEN shape < 3 THEN 'rss' WHEN shape < 6 THEN 'gen' ELSE 'fol' END AS source_id,
  CASE WHEN shape < 2 THEN 'https://scour.ing/r/rss/item-' || k // 24 || '?as=' || k WHEN shape = 2 AND k % 16 = 2 THEN 'https://scour.ing/r/rss/item-' || k // 24
   WHEN shape = 2 THEN 'https://rss.example.org/' || k WHEN shape = 3 THEN 'https://blog.example.org/tags/' || k || '/' WHEN shape = 4 THEN 'https://blog.example.org/?legacy=' || k
   WHEN shape = 5 THEN 'https://blog.example.org/post/' || k WHEN shape = 6 THEN 'https://www.zhihu.com/pin/' || k
   ELSE 'https://zhuanlan.zhihu.com/p/' || k || CASE WHEN k % 3 = 0 THEN '?spu=biz%3D0' ELSE '' END END AS link FROM raw),
 e AS (SELECT k, shape, 'e' || k AS id, source_id, link AS canonical_url, CASE WHEN shape = 4 THEN 'https://blog.example.org/' ELSE link END AS original_url,
  CASE WHEN k % 5 = 0 THEN 'c' || o_custkey END AS author, CASE WHEN k % 3 = 0 THEN epoch_ms(o_orderdate) END AS published_at, CASE WHEN k % 2 = 0 THEN o_orderpriority || ' ' || k END AS summary,
  o_orderstatus = 'F' AS is_read, o_orderpriority = '1-URGENT' AS is_favorite, k * 1000 AS created_at, k * 1000 + o_custkey AS observed_at
  FROM linked QUALIFY row_number() OVER (PARTITION BY link ORDER BY k) = 1),
 grp AS (SELECT *, 'https://scour.ing/r/rss/item-' || k // 24 AS target, CASE WHEN shape < 2 THEN 0 ELSE 1 END AS held FROM e WHERE canonical_url LIKE 'https://scour.ing/%'),
 live AS (SELECT * FROM grp QUALIFY count(*) FILTER (WHERE held = 0) OVER (PARTITION BY target) > 0),
 q AS (SELECT *, is_favorite::INT * 1000000 + is_read::INT * 100000 + (published_at IS NOT NULL)::INT * 10000 + coalesce(length(summary), 0) * 10 + observed_at AS quality FROM live),
 r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY quality DESC, held, created_at, id) AS rk, row_number() OVER (PARTITION BY target ORDER BY held, created_at, id) AS pos FROM q),
 win AS (SELECT target, max(id) FILTER (WHERE rk = 1) AS id, bool_or(is_read) AS is_read, bool_or(is_favorite) AS is_favorite,
  coalesce(max(author) FILTER (WHERE rk = 1), arg_min(author, pos) FILTER (WHERE author IS NOT NULL)) AS author,
  coalesce(max(published_at) FILTER (WHERE rk = 1), arg_min(published_at, pos) FILTER (WHERE published_at IS NOT NULL)) AS published_at,
  arg_min(summary, -length(summary) * 1000000 + pos) FILTER (WHERE summary <> '') AS summary, min(created_at) AS created_at, max(observed_at) AS observed_at FROM r GROUP BY target),
 o AS (SELECT id AS entry_id, source_id, source_id AS provider_id, original_url, observed_at FROM e UNION ALL
  SELECT id, 'other', 'x', original_url, created_at FROM e WHERE k % 7 = 0),
 moved AS (SELECT win.id AS entry_id, o.source_id, o.provider_id, o.original_url, o.observed_at FROM o JOIN r ON r.id = o.entry_id JOIN win ON win.target = r.target
  QUALIFY row_number() OVER (PARTITION BY win.id, o.source_id, o.provider_id ORDER BY (r.rk <> 1)::INT, r.pos) = 1),
 mo AS (SELECT entry_id, source_id AS owner FROM moved QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY observed_at, source_id) = 1)"""
OUT = "id, source_id, canonical_url, is_read, is_favorite, author, published_at, summary, created_at, observed_at"
MERGED = "SELECT win.id, owner AS source_id, target AS canonical_url, is_read, is_favorite, author, published_at, summary, created_at, observed_at FROM win JOIN mo ON mo.entry_id = win.id"
ORACLES["duplicate_merge"] = f"WITH {LEGACY} SELECT {OUT} FROM e WHERE id NOT IN (SELECT id FROM r) UNION ALL {MERGED}"
ORACLES["duplicate_merge_origins"] = f"""WITH {LEGACY}
SELECT entry_id, source_id, provider_id, original_url, observed_at FROM o WHERE entry_id NOT IN (SELECT id FROM r) UNION ALL FROM moved"""
HOME = "home AS (SELECT min(k) AS k, 'https://blog.example.org/?p=' || k // 16 AS target FROM e WHERE shape = 4 GROUP BY 2)"
ORACLES["homepage_repair"] = f"WITH {LEGACY}, {HOME} SELECT 'e' || k AS id, 'gen' AS source_id, target FROM home"
DOOMED = "(shape IN (3, 6) OR (shape = 7 AND k % 3 = 0))"
ORACLES["maintenance_report"] = f"""WITH {LEGACY}, {HOME}
SELECT 3 AS inspected_sources, 3 AS maintained_sources, 0 AS skipped_sources, count(*) FILTER (WHERE shape = 3) AS taxonomy_entries_removed, (SELECT count(*) FROM home) AS homepage_urls_repaired,
  count(*) FILTER (WHERE shape < 2) AS wrapper_entries_merged, count(*) FILTER (WHERE shape = 6) AS unsupported_entries_removed, count(*) FILTER (WHERE shape = 7 AND k % 3 = 0) AS promotions_removed FROM e"""
ORACLES["maintenance_entries"] = f"""WITH {LEGACY}, {HOME}
SELECT e.id, CASE WHEN {DOOMED.replace('k %', 'e.k %')} THEN 'other' ELSE source_id END AS source_id, coalesce(target, canonical_url) AS canonical_url,
  is_read, is_favorite, author, published_at, summary, created_at, observed_at FROM e LEFT JOIN home ON home.k = e.k
WHERE id NOT IN (SELECT id FROM r) AND (NOT {DOOMED.replace('k %', 'e.k %')} OR e.k % 7 = 0) UNION ALL {MERGED}"""
ORACLES["nav_prune"] = f"""WITH n AS (SELECT p_partkey AS k, {pick(["GitHub", "YouTube", "X (@me)", "Real post"], "p_partkey")} AS title,
  p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND (p_partkey % 4 < 3 OR p_partkey % 9 = 3) AS doomed FROM part)
SELECT 'e' || k AS id, CASE WHEN doomed THEN 'm' ELSE 'n' || k % 3 END AS source_id, title FROM n WHERE NOT doomed OR k % 6 = 0"""
