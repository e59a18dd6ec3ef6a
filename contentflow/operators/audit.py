"""Quality audit: which stored articles to look at, what is wrong with them, and per-source reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow.functions import text
from contentflow.functions.binding import staged
from contentflow.operators.ranking import ranked
from contentflow.operators.timeline import timeline_order

# --- fixed values -----------------------------------------------------------
SHORT_TEXT = 180
LENIENT_KINDS = ["zhihu_follow", "academic"]
LENIENT_MODES = ["feed_body", "feed_summary"]
OPENING = 700
LEAD_LENGTH, LEAD_MINIMUM = 28, 12
ISSUE_SHORT = "正文过短"
ISSUE_EXECUTABLE = "净化失败：发现可执行标记"
ISSUE_FORMULA = "公式渲染失败或残留占位符"
ISSUE_RAW_TEX = "正文中残留未渲染的 TeX 命令"
ISSUE_INLINE_TEX = "正文中残留未渲染的 $…$ 行内公式"
ISSUE_SCIENTIFIC_TEX = "科学空间残留原始 TeX"
ISSUE_CHROME = "科学空间页首元信息未清理"
ISSUE_LEAD = "科学空间正文起点与卡片摘要不一致"
ISSUE_NOTHING = "没有可审计的文章"
SITE_CHROME = r"首页|数学研究|信息时代"
BYLINE = r"(?i)\bBy\s+.+?\|\s*\d{4}-\d{2}-\d{2}\b"
EXECUTABLE = r"(?is)<(?:script|iframe|object|embed)\b|<[^>]*\son[a-z]+\s*=|<[^>]*\s(?:href|src)\s*=\s*[\"']?\s*javascript:"
# ---------------------------------------------------------------------------


def memberships(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """Entries per source that owns them or has seen them, each once."""
    seen = origins.select("source_id", F.col("entry_id").alias("id"))
    pairs = entries.select("source_id", "id").unionByName(seen).distinct()
    return pairs.join(entries.drop("source_id"), "id")


def _id_number(source_id: Column) -> Column:
    codes = F.transform(F.split(source_id, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda total, code: total + code)


def audit_samples(entries: DataFrame, all_entries: bool = False, pool: int | None = None) -> DataFrame:
    """Newest and one fixed older entry per source, or all of them.

    The older one is drawn from the whole source, or from its newest ``pool``
    entries if the caller asks for that.
    """
    placed = ranked(entries, ["source_id"], timeline_order()) if pool is None else top_per_group(entries, ["source_id"], timeline_order(), pool)
    if all_entries:
        return placed.withColumn("sample", F.lit("all"))
    sizes = placed.groupBy("source_id").agg(F.count("*").alias("available"))
    counted = placed.join(sizes, "source_id")
    others = F.col("available") - 1
    offset = F.when(others > 0, F.pmod(_id_number(F.col("source_id")), F.greatest(others, F.lit(1))))
    historical = F.least(others, F.lit(1) + offset) + 1
    sample = F.when(F.col("rank") == 1, "newest").when((F.col("available") > 1) & (F.col("rank") == historical), "historical")
    return counted.withColumn("sample", sample).where(F.col("sample").isNotNull()).drop("available")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """First ``k`` rows per group with their ``rank``.

    A group is first cut to ``k`` rows inside each of ``salts`` slices, so the
    final ranking sees at most ``salts * k`` rows of one group.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    cut = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order)))
    last = cut.where(F.col("rank") <= k).drop("salt", "rank")
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def plain(html: Column) -> Column:
    return text.collapse(text.unescape_entities(F.regexp_replace(html, r"<[^>]*>", "")))


def audit_articles(articles: DataFrame) -> DataFrame:
    """Issues of every article as an array, with the metrics behind them.

    ``articles`` carries ``source_id, kind, entry_id, entry_title, summary,
    content_html, content_mode, render_profile``; every other column passes through.
    """
    html = F.col("content_html")
    literal = r"(?is)<(pre|code)\b[^>]*>.*?</\1>"
    texts = staged(articles, text=plain(html), lead=F.substring(plain(F.coalesce("summary", F.lit(""))), 1, LEAD_LENGTH))
    # Only articles with literal code are read a second time without it.
    texts = staged(texts, prose=F.when(html.rlike(r"(?i)<(pre|code)\b"), plain(F.regexp_replace(html, literal, ""))).otherwise(F.col("text")))
    found = staged(
        texts,
        raw_tex=text.raw_tex_commands(F.col("prose")),
        inline_tex=text.leaked_math(F.col("prose")),
        opening=F.substring("text", 1, OPENING),
    )
    scientific = F.col("render_profile") == "scientific"
    lenient = F.col("kind").isin(LENIENT_KINDS) | F.col("content_mode").isin(LENIENT_MODES)
    chrome = F.col("opening").rlike(SITE_CHROME) | F.col("opening").rlike(BYLINE) | F.col("opening").contains(F.col("entry_title"))
    stray_heading = html.rlike(r"(?i)<h[1-6][^>]*>[^<]*#\s*</h")
    lead_missing = (F.length("lead") >= LEAD_MINIMUM) & ~F.col("opening").contains(F.col("lead"))
    checks = [
        ((F.length("text") < SHORT_TEXT) & ~lenient, ISSUE_SHORT),
        (html.rlike(EXECUTABLE), ISSUE_EXECUTABLE),
        (html.rlike(r"(?i)class=\"[^\"]*katex-error|<mjx-merror\b"), ISSUE_FORMULA),
        (F.size("raw_tex") > 0, ISSUE_RAW_TEX),
        (F.size("inline_tex") > 0, ISSUE_INLINE_TEX),
        (scientific & F.regexp_replace(html, literal, "").rlike(r"\\begin\{|\$\$|\\\("), ISSUE_SCIENTIFIC_TEX),
        (scientific & (stray_heading | chrome), ISSUE_CHROME),
        (scientific & lead_missing, ISSUE_LEAD),
    ]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in checks]))
    kept = [c for c in articles.columns if c not in ("content_html", "summary")]
    diagnostics = F.transform(F.slice(F.concat("raw_tex", "inline_tex"), 1, 2), lambda f: F.substring(text.collapse(f), 1, 220))
    return found.select(
        *kept,
        F.length("text").alias("text_length"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<img\b)"), F.lit(1))).alias("images"),
        diagnostics.alias("tex_diagnostics"),
        issues.alias("issues"),
    ).withColumn("status", F.when(F.size("issues") > 0, "issues").otherwise("passed"))


def audit_report(sources: DataFrame, samples: DataFrame, audited: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """One row per sample with its status; sources without samples are ``skipped``.

    A sample whose article is missing has ``failed``; one whose page robots
    rules forbid (``blocked``: ``entry_id``) is ``skipped``.
    """
    planned = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source"), "kind").join(
        samples.select("source_id", F.col("id").alias("entry_id"), "sample"), "source_id", "left"
    )
    done = audited.select("source_id", "entry_id", "status", "issues", "text_length")
    joined = planned.join(done, ["source_id", "entry_id"], "left")
    barred = F.lit(False)
    if blocked is not None:
        joined = joined.join(blocked.select("entry_id", F.lit(True).alias("barred")), "entry_id", "left")
        barred = F.coalesce("barred", F.lit(False))
    status = F.when(F.col("entry_id").isNull() | barred, "skipped").otherwise(F.coalesce("status", F.lit("failed")))
    issues = F.when(F.col("entry_id").isNull(), F.array(F.lit(ISSUE_NOTHING))).otherwise(F.coalesce("issues", F.array().cast("array<string>")))
    return joined.select("source_id", "source", "kind", "entry_id", "sample", status.alias("status"), issues.alias("issues"), "text_length")


def audit_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("samples"), F.sum(F.size("issues")).alias("issues"))


def pick_sources(sources: DataFrame, name: str | None) -> DataFrame:
    """Sources whose id or title is ``name``, ignoring case; all without a name."""
    wanted = (name or "").strip().lower()
    return sources.where((F.lower("id") == wanted) | (F.lower("title") == wanted)) if wanted else sources


def source_freshness(entries: DataFrame) -> DataFrame:
    """Entries, entries without a date and newest date per source."""
    return entries.groupBy("source_id").agg(
        F.count("*").alias("entries"), F.count_if(F.col("published_at").isNull()).alias("undated"), F.max("published_at").alias("newest")
    )


def audit_sources(sources: DataFrame, feeds: DataFrame, discovered: DataFrame, fetches: DataFrame) -> DataFrame:
    """Feed status of every polled feed or web source.

    ``feeds`` are parsed feed documents ``(feed_url, entries, newest)``,
    ``discovered`` the addresses a homepage declares ``(source_id, rank,
    feed_url)``, ``fetches`` the homepage answers ``(source_id, ok, message)``.
    A web source takes its configured feed first, then the discovered ones in order.
    """
    polled = sources.where(F.col("kind").isin("rss", "generic") & F.col("polling_enabled"))
    configured = F.get_json_object("extraction_rule", "$.feedUrl")
    base = polled.select(
        F.col("id").alias("source_id"), F.col("title").alias("source"), "kind", "url", text.blank_to_null(configured).alias("configured")
    )
    own = base.where(F.col("kind") == "rss").select("source_id", F.lit(0).alias("rank"), F.col("url").alias("feed_url"))
    declared = base.where((F.col("kind") == "generic") & F.col("configured").isNotNull()).select(
        "source_id", F.lit(0).alias("rank"), F.col("configured").alias("feed_url")
    )
    listed = discovered.join(base.where(F.col("kind") == "generic").select("source_id"), "source_id", "left_semi").select("source_id", "rank", "feed_url")
    candidates = own.unionByName(declared).unionByName(listed).groupBy("source_id", "feed_url").agg(F.min("rank").alias("rank"))
    working = candidates.join(feeds, "feed_url").groupBy("source_id").agg(F.min_by(F.struct("feed_url", "entries", "newest"), "rank").alias("feed"))
    counts = candidates.groupBy("source_id").agg(F.count("*").alias("candidates"))
    joined = base.join(fetches.select("source_id", "ok", "message"), "source_id", "left").join(working, "source_id", "left").join(counts, "source_id", "left")
    status = (
        F.when(~F.coalesce("ok", F.lit(False)), "unreachable")
        .when(F.col("feed").isNull(), F.when(F.col("kind") == "rss", "unreachable").otherwise("no-feed"))
        .when((F.col("kind") == "rss") | F.col("configured").isNotNull(), "ok")
        .otherwise("upgrade-available")
    )
    return joined.select(
        "source_id",
        "source",
        "kind",
        status.alias("status"),
        F.when(F.col("feed").isNotNull(), text.redact_url(F.col("feed.feed_url"))).alias("feed_url"),
        F.col("feed.entries").alias("entries"),
        F.col("feed.newest").alias("newest"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        text.redact_message(F.col("message")).alias("issue"),
    ).orderBy(F.lower("source"), "source_id")
