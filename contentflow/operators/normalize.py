"""Raw items to entries: canonical URL, identity, hash and provenance per provider policy."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.functions import text, urls
from contentflow.functions.binding import let, staged

ColumnRule = Callable[[], Column]


@dataclasses.dataclass(frozen=True)
class Policy:
    """What a provider does differently. Every hook builds a Column over the raw entry's columns.

    ``identity`` may use ``default_url``; ``canonical`` may use ``default_url`` and ``identity``.
    """

    default_url: ColumnRule = lambda: urls.canonical_content_url(F.col("url"))
    identity: ColumnRule = lambda: F.coalesce(F.col("canonical_identity"), F.col("default_url"))
    canonical: ColumnRule = lambda: F.col("default_url")
    identity_hash: bool = False
    provider_id: str | None = None
    provider_label: str | None = None


def _social_identity() -> Column:
    return F.coalesce(
        text.blank_to_null(F.col("canonical_identity")),
        F.concat(F.lit("x:"), F.coalesce(text.blank_to_null(F.col("external_id")), F.col("url"))),
    )


def _scholarly_identity() -> Column:
    doi = text.normal_doi(F.col("url"))
    return F.coalesce(
        text.blank_to_null(F.col("canonical_identity")),
        F.concat(F.lit("doi:"), doi),
        F.concat(F.lit("academic:"), text.blank_to_null(F.col("external_id"))),
        F.concat(F.lit("url:"), F.col("url")),
    )


DEFAULT_POLICY = Policy()

# Keyed by connector id; connectors not listed use the default policy.
POLICIES: dict[str, Policy] = {
    "academic": Policy(
        default_url=lambda: F.col("url"),
        identity=_scholarly_identity,
        canonical=lambda: urls.scholarly_url(F.col("identity"), F.col("url")),
        identity_hash=True,
        provider_id="academic",
    ),
    "x": Policy(
        default_url=lambda: F.col("url"),
        identity=_social_identity,
        identity_hash=True,
        provider_id="x",
        provider_label="X",
    ),
    "xiaohongshu": Policy(
        default_url=lambda: urls.canonical_url(F.col("url")),
        provider_id="xiaohongshu",
        provider_label="小红书",
    ),
    "zhihu": Policy(provider_id="zhihu", provider_label="知乎"),
    "zhihu_follow": Policy(provider_id="zhihu_follow", provider_label="知乎"),
}


def by_connector(policies: dict[str, Policy], pick: Callable[[Policy], Column | None], default: Column) -> Column:
    """``when connector = …`` over the policies that differ, else the default."""
    chosen = None
    for connector, policy in policies.items():
        value = pick(policy)
        if value is None:
            continue
        test = F.col("connector") == connector
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return default if chosen is None else chosen.otherwise(default)


def hook(policies: dict[str, Policy], name: str) -> Column:
    """A policy hook per connector; connectors that keep the default share one expression."""
    default = getattr(DEFAULT_POLICY, name)
    own = {connector: policy for connector, policy in policies.items() if getattr(policy, name) is not default}
    return by_connector(own, lambda policy: getattr(policy, name)(), default())


def repair_homepage_link(keyed: DataFrame) -> DataFrame:
    """Generic items that link to the source home take their own identity URL instead.

    Needs ``default_url``, ``source_home`` and ``source_kind`` next to the raw columns.
    """
    home = F.col("source_home")
    applies = (F.col("source_kind") == "generic") & (F.col("default_url") == home)

    def page_of(identity: Column) -> Column:
        return F.when((urls.url_origin(identity) == urls.url_origin(home)) & (identity != home), identity)

    # The case guards the rule: only home links are ever canonicalised a second time.
    target = F.when(applies, let(urls.canonical_content_url(F.col("canonical_identity")), page_of))
    return staged(keyed, target=target).withColumns(
        {name: F.coalesce("target", name) for name in ("url", "default_url", "canonical_identity")}
    )


def normalize(raw: DataFrame, sources: DataFrame, as_of: int, policies: dict[str, Policy] | None = None) -> DataFrame:
    """Entries ready for the merge, in the order given by ``seq``.

    The source dimension is joined once for kind and connector. Ids are a hash
    of the canonical URL, so a replay produces the same ids. Rows whose URL
    cannot be parsed have no key and are left out, as are rows of unknown sources.
    """
    policies = POLICIES if policies is None else policies
    dimension = sources.select(
        F.col("id").alias("source_id"),
        urls.canonical_content_url(F.col("url")).alias("source_home"),
        F.col("kind").alias("source_kind"),
        F.coalesce(text.blank_to_null(F.col("connector_id")), F.col("kind")).alias("connector"),
    )
    joined = raw.join(dimension, "source_id")
    provider = F.coalesce(F.col("provider_id"), F.col("connector"))
    keyed = staged(joined, default_url=hook(policies, "default_url"))
    keyed = repair_homepage_link(keyed)
    keyed = staged(keyed, identity=hook(policies, "identity"))
    keyed = staged(keyed, final_url=hook(policies, "canonical"))
    by_identity = text.identity_hash(F.col("identity"), F.col("title"), F.col("summary"))
    by_metadata = text.content_hash(F.col("title"), F.col("published_at"), F.col("summary"))
    observed = F.coalesce(F.col("observed_at"), F.lit(as_of).cast("bigint"))
    return keyed.where(F.col("final_url").isNotNull()).select(
        F.sha2(F.col("final_url"), 256).alias("id"),
        "source_id",
        F.col("final_url").alias("canonical_url"),
        F.col("url").alias("original_url"),
        "title",
        "author",
        "published_at",
        "summary",
        "image_url",
        by_connector(policies, lambda p: by_identity if p.identity_hash else None, by_metadata).alias("content_hash"),
        F.lit(False).alias("is_read"),
        F.lit(False).alias("is_favorite"),
        F.lit(as_of).cast("bigint").alias("created_at"),
        observed.alias("observed_at"),
        by_connector(policies, lambda p: F.lit(p.provider_id) if p.provider_id else None, provider).alias("provider_id"),
        by_connector(
            policies, lambda p: F.lit(p.provider_label) if p.provider_label else None, F.col("provider_label")
        ).alias("provider_label"),
        "external_id",
        F.col("identity").alias("canonical_identity"),
        "seq",
    )
