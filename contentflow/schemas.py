"""Tables of a content library and the small bundle that carries them through a job."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from contentflow.session import scratch_path

RULE = """struct<version:int, autoRepairRevision:int, publicationDateRevision:int, feedDiscoveryRevision:int,
 feedUrl:string, rendererRequired:boolean, itemRootSelector:string, titleSelector:string, timeSelector:string,
 authorSelector:string, imageSelector:string, summarySelector:string>"""

SOURCES = """id string, url string, title string, icon_url string, category string, kind string, connector_id string,
 account_id string, config_json string, status string, extraction_rule string, metadata_revision int,
 polling_enabled boolean, refresh_interval_minutes int, etag string, last_modified string, last_checked_at bigint,
 next_check_at bigint, consecutive_empty int, failure_count int, last_error string, created_at bigint, updated_at bigint"""

ENTRIES = """id string, source_id string, canonical_url string, original_url string, title string, author string,
 published_at bigint, summary string, image_url string, content_hash string, is_read boolean, is_favorite boolean,
 created_at bigint, observed_at bigint, provider_id string, provider_label string, external_id string,
 canonical_identity string"""

ORIGINS = """entry_id string, source_id string, provider_id string, external_id string, provider_label string,
 original_url string, observed_at bigint"""

DISMISSED = "canonical_identity string, dismissed_at bigint"
SUBSCRIPTIONS = """id string, source_id string, connector_id string, account_id string, target_id string,
 config_json string, created_at bigint, updated_at bigint"""
CHECKPOINTS = "subscription_id string, cursor string, since_id string, data_json string, updated_at bigint"
RUNS = """id string, source_id string, outcome string, fetched_count int, inserted_count int, message string,
 created_at bigint"""
MAINTENANCE = "source_id string, revision int, updated_at bigint"
FOLLOWEES = """url_token string, fullname string, url string, avatar_url string, headline string,
 follower_count bigint, updated_at bigint"""

# The last document read at an address for a source, by its validator.
SEEN = "source_id string, url string, fingerprint string, updated_at bigint"

RAW_FETCH = """source_id string, seq bigint, url string, status int, content_type string, text string, etag string,
 last_modified string, fetched_at bigint"""

# What every parser produces: one row per collected item, before normalisation.
RAW_ENTRY = """source_id string, seq bigint, url string, title string, author string, published_at bigint,
 summary string, image_url string, external_id string, canonical_identity string, observed_at bigint,
 provider_id string, provider_label string, feed_content_html string"""

ORIGIN_KEY = ["entry_id", "source_id", "provider_id", "external_id"]

TABLES = {
    "sources": SOURCES,
    "entries": ENTRIES,
    "entry_origins": ORIGINS,
    "dismissed": DISMISSED,
    "subscriptions": SUBSCRIPTIONS,
    "checkpoints": CHECKPOINTS,
    "maintenance": MAINTENANCE,
    "followees": FOLLOWEES,
    "runs": RUNS,
    "seen": SEEN,
}


def columns(schema: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in schema.replace("\n", " ").split(",")]


@dataclasses.dataclass(frozen=True)
class State:
    """The library tables. Jobs take a state and return a new one; nothing is updated in place."""

    sources: DataFrame
    entries: DataFrame
    entry_origins: DataFrame
    dismissed: DataFrame
    subscriptions: DataFrame
    checkpoints: DataFrame
    maintenance: DataFrame
    followees: DataFrame
    runs: DataFrame
    seen: DataFrame

    def with_tables(self, **tables: DataFrame) -> "State":
        return dataclasses.replace(self, **tables)

    def written(self, label: str, *names: str) -> "State":
        """The same state with the named tables written to the shared folder and read back.

        Steps that read a table several times start from files instead of
        replaying everything before them, and a lost executor costs one file.
        """
        return self.with_tables(**{name: write_through(getattr(self, name), f"{label}-{name}") for name in names})


def write_through(rows: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write the rows below the shared folder and read them back."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def empty_state(spark: SparkSession) -> State:
    return State(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})


def state_of(spark: SparkSession, **tables: DataFrame) -> State:
    """State from the tables given; the others start empty."""
    return empty_state(spark).with_tables(**tables)
