"""Folders: sources grouped by their own category, else by what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text
from contentflow.functions.binding import staged

# --- fixed values -----------------------------------------------------------
DEFAULT_FOLDERS = [("web", "网页与订阅"), ("platform", "平台动态"), ("academic", "学术追踪")]
PLATFORM_KINDS = ["zhihu", "zhihu_follow", "x", "xiaohongshu"]
CUSTOM_RANK = 99
# ---------------------------------------------------------------------------


def folder_groups(sources: DataFrame, collation: str | None = "zh") -> DataFrame:
    """One row per source with its folder, folders and sources in display order.

    Flat on purpose: a default folder may hold most sources, so it is sorted
    across the cluster rather than collected into one array. ``collation=None``
    sorts titles by code point.
    """
    bridged = F.get_json_object("config_json", "$.sourceProvider") == "rsshub"
    default = (
        F.when(F.col("kind") == "academic", "academic")
        .when(F.coalesce(bridged, F.lit(False)) | F.col("kind").isin(PLATFORM_KINDS), "platform")
        .otherwise("web")
    )
    custom = text.blank_to_null(F.trim("category"))
    named = staged(sources.select("id", "title", "kind", "category", "config_json", "created_at"), custom=custom, base=default)
    title = F.col("custom")
    rank = F.lit(CUSTOM_RANK)
    for place, (folder, label) in enumerate(DEFAULT_FOLDERS):
        title = F.when(F.col("custom").isNull() & (F.col("base") == folder), F.lit(label)).otherwise(title)
        rank = F.when(F.col("custom").isNull() & (F.col("base") == folder), F.lit(place)).otherwise(rank)
    folder = F.coalesce(F.concat(F.lit("custom:"), F.lower("custom")), "base")
    rows = named.select(
        folder.alias("folder_id"), title.alias("own_title"), rank.alias("folder_rank"), F.col("custom").isNotNull().alias("custom"),
        F.col("id").alias("source_id"), F.col("title").alias("source_title"), "created_at",
    )
    # Spellings that differ in case share a folder, which takes the first spelling as title.
    titles = rows.groupBy("folder_id").agg(F.min_by("own_title", F.struct("created_at", "source_id")).alias("folder_title"))
    joined = rows.join(titles, "folder_id").drop("own_title", "created_at")

    def order(column: str):
        return F.collate(column, collation) if collation else F.col(column)

    return joined.orderBy("folder_rank", order("folder_title"), "folder_id", order("source_title"), "source_id").select(
        "folder_id", "folder_title", "folder_rank", "custom", "source_id", "source_title"
    )


def folder_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("folder_id", "folder_title", "folder_rank").agg(F.count("*").alias("sources"))
