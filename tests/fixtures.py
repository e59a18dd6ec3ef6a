"""Small library tables for tests, and the reference semantics written out row by row."""

from __future__ import annotations

from contentflow import schemas

SOURCE = dict(
    icon_url=None, category=None, kind="rss", connector_id=None, account_id=None, config_json=None, status="active", extraction_rule=None,
    metadata_revision=None, polling_enabled=True, refresh_interval_minutes=None, etag=None, last_modified=None, last_checked_at=None,
    next_check_at=0, consecutive_empty=0, failure_count=0, last_error=None, created_at=0, updated_at=0,
)
ENTRY = dict(
    source_id="s", title="T", author=None, published_at=None, summary=None, image_url=None, content_hash="h", is_read=False, is_favorite=False,
    created_at=1, observed_at=1, provider_id="rss", provider_label=None, external_id=None,
)


def _frame(spark, ddl, rows):
    names = schemas.columns(ddl)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def sources(spark, *rows):
    full = [{**SOURCE, "title": r["id"], "url": f"https://{r['id']}.example.org/", **r} for r in rows]
    return _frame(spark, schemas.SOURCES, [{**r, "connector_id": r["connector_id"] or r["kind"]} for r in full])


def entries(spark, *rows):
    full = [{**ENTRY, **r} for r in rows]
    for r in full:
        r.setdefault("id", "e:" + r["canonical_url"])
        r.setdefault("original_url", r["canonical_url"])
        r.setdefault("canonical_identity", r["canonical_url"])
    return _frame(spark, schemas.ENTRIES, full)


def batch(spark, *rows):
    """Normalised entries with their order."""
    frame = [{**ENTRY, **r} for r in rows]
    for i, r in enumerate(frame):
        r.setdefault("original_url", r["canonical_url"])
        r.setdefault("canonical_identity", r["canonical_url"])
        r.setdefault("id", f"id:{r['canonical_url']}")
        r.setdefault("seq", i)
    return _frame(spark, schemas.ENTRIES + ", seq bigint", frame)


def origins(spark, *rows):
    full = [{"provider_id": "rss", "external_id": "", "provider_label": None, "original_url": "u", "observed_at": 1, **r} for r in rows]
    return _frame(spark, schemas.ORIGINS, full)


def own_origins(spark, entry_frame):
    from pyspark.sql import functions as F

    return entry_frame.select(
        F.col("id").alias("entry_id"), "source_id", "provider_id", F.coalesce("external_id", F.lit("")).alias("external_id"), "provider_label", "original_url", "observed_at"
    )


def as_dicts(frame, key=None):
    rows = [r.asDict() for r in frame.collect()]
    return {r[key]: r for r in rows} if key else rows


def sequential_upsert(rows, dismissed=()):
    """Row-by-row upsert by canonical URL and by origin key."""
    stored, seen, inserted = {}, {}, 0
    for row in sorted(rows, key=lambda r: r["seq"]):
        if (row["canonical_identity"] or row["canonical_url"]) in dismissed:
            continue
        url = row["canonical_url"]
        if url not in stored:
            stored[url], inserted = dict(row), inserted + 1
        else:
            held = stored[url]
            held["title"], held["content_hash"] = row["title"], row["content_hash"]
            for name in ("author", "published_at", "summary", "image_url", "provider_id", "provider_label", "external_id", "canonical_identity"):
                held[name] = row[name] if row[name] is not None else held[name]
        key = (url, row["source_id"], row["provider_id"], row["external_id"] or "")
        label = row["provider_label"] or (seen[key][0] if key in seen else None)
        seen[key] = (label, row["original_url"], row["observed_at"])
    return stored, seen, inserted


def sequential_health(runs, kind):
    """One source's runs in order: status, failure streak, empty streak."""
    failures = empties = 0
    status = "active"
    for outcome in runs:
        if outcome == "failure":
            failures += 1
            status = "paused" if failures >= 5 else "error"
        else:
            failures = 0
            empties = empties + 1 if outcome == "empty" else 0
            status = "needs_review" if kind == "generic" and empties >= 3 else "active"
    return status, failures, empties
