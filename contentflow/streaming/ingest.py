"""Micro-batch ingest: landed fetches to merged library versions."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentflow import schemas
from contentflow.functions import text, urls
from contentflow.functions.binding import staged
from contentflow.operators import maintenance, merge
from contentflow.operators.health import EMPTY, FAILURE, SUCCESS, WARNING, after_run
from contentflow.operators.mutations import delete_origin_rows, register_sources
from contentflow.operators.normalize import normalize
from contentflow.schemas import State, write_through
from contentflow.sources import cards, providers
from contentflow.sources.feeds import feed_verdict, parse_feeds
from contentflow.sources.pages import extract_listing
from contentflow.sources.snapshots import KEYS, Conflict, Library
from contentflow.streaming import changes

Parser = Callable[[DataFrame, "Context"], DataFrame]

# What became of a fetch: not answered, nothing new, not readable, or handed to a parser.
FAILED, UNCHANGED, REJECTED, READ = "failed", "unchanged", "rejected", "read"
#: Times a batch is merged again because somebody else committed meanwhile.
ATTEMPTS = 5


@dataclasses.dataclass(frozen=True)
class Context:
    """What a parser may need besides the documents."""

    sources: DataFrame
    as_of: int


@dataclasses.dataclass(frozen=True)
class Connector:
    """How one kind of source turns fetched documents into raw entries.

    ``verdict`` gives struct(problem, icon) for a document: what keeps it from
    being read, null for nothing, and an icon it declares. Without it every
    document can be read. ``cursor`` gives (source_id, since_id), the newest id
    that the documents of a source show.
    """

    connector_id: str
    parse: Parser
    verdict: Callable[[], Column] | None = None
    cursor: Callable[[DataFrame], DataFrame] | None = None


def verdict(problem: Column) -> Column:
    return F.struct(problem.cast("string").alias("problem"), F.lit(None).cast("string").alias("icon"))


def _scholarly(raw: DataFrame, context: Context) -> DataFrame:
    """Works of the providers told apart by the address of the answer; the author is in the source's configuration."""
    host = urls.url_host(F.col("url"))
    provider = F.coalesce(*[F.when(host.endswith(domain), name) for domain, name in PROVIDER_HOSTS])
    config = F.col("config_json")
    authors = context.sources.select(
        F.col("id").alias("source_id"), F.get_json_object(config, "$.authorName").alias("author_name"), F.get_json_object(config, "$.orcid").alias("orcid")
    )
    return providers.parse_scholarly(raw.withColumn("provider", provider), authors)


def _not_json(schema: str, field: str, what: str) -> Callable[[], Column]:
    return lambda: verdict(F.when(F.from_json("text", schema)[field].isNull(), F.lit(f"no readable {what}")))


def _not_works() -> Column:
    found = [F.from_json("text", schema)[field].isNotNull() for schema, field in ((providers.OPENALEX, "results"), (providers.SEMANTIC, "data"), (providers.ORCID, "group"))]
    return verdict(F.when(~(found[0] | found[1] | found[2]), F.lit("no readable list of works")))


def _not_shown(marks: str, what: str) -> Callable[[], Column]:
    """Pages that have to show certain marks; a login page does not."""
    return lambda: verdict(F.when(~F.coalesce(F.col("text").rlike(marks), F.lit(False)), F.lit(f"no {what} on the page")))


def _newest_post(documents: DataFrame) -> DataFrame:
    number = F.col("post_id").try_cast("decimal(38,0)")
    return providers.post_rows(documents).groupBy("source_id").agg(F.max_by("post_id", number).alias("since_id"))


def parse_listing_pages(raw: DataFrame) -> DataFrame:
    """Generic web pages: the listing cascade, rows in document order."""
    pages = raw.select(F.col("seq").alias("page_id"), "url", F.col("text").alias("html"))
    entries, _ = extract_listing(pages)
    owner = raw.select(F.col("seq").alias("page_id"), "source_id")
    missing = F.lit(None)
    named = entries.join(owner, "page_id")
    return named.select(
        "source_id",
        (F.col("page_id") * 1_000_000 + F.col("place")).alias("seq"),
        F.col("entry_url").alias("url"),
        "title",
        "author",
        "published_at",
        "summary",
        "image_url",
        *[missing.cast(t).alias(n) for n, t in (("external_id", "string"), ("canonical_identity", "string"), ("observed_at", "bigint"))],
        *[missing.cast("string").alias(n) for n in ("provider_id", "provider_label", "feed_content_html")],
    )


class Registry:
    """Connectors by id; the only extension point of the ingest."""

    def __init__(self, *connectors: Connector):
        self._by_id: dict[str, Connector] = {}
        for connector in connectors:
            self.register(connector)

    def register(self, connector: Connector) -> None:
        if connector.connector_id in self._by_id:
            raise ValueError(f"connector {connector.connector_id} is registered already")
        self._by_id[connector.connector_id] = connector

    def __contains__(self, connector_id: str) -> bool:
        return connector_id in self._by_id

    def get(self, connector_id: str) -> Connector:
        if connector_id not in self._by_id:
            raise KeyError(f"unknown connector {connector_id}")
        return self._by_id[connector_id]

    def judged(self, raw: DataFrame, sources: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """The fetches with ``connector, fingerprint, problem, icon, fate``.

        A document whose fingerprint is the last one seen for its source and
        address is unchanged and not looked at any further, unless an older
        parser read the source last.
        """
        bound = sources.select(F.col("id").alias("source_id"), F.coalesce("connector_id", "kind").alias("connector"), "metadata_revision")
        rows = raw.withColumn("fingerprint", changes.fingerprint()).join(bound, "source_id", "left")
        if seen is None:
            rows = rows.withColumn("known", F.lit(None).cast("string"))
        else:
            rows = rows.join(seen.select("source_id", "url", F.col("fingerprint").alias("known")), ["source_id", "url"], "left")
        answered = F.col("status").between(200, 299)
        current = F.col("metadata_revision").eqNullSafe(F.lit(changes.FEED_REVISION))
        same = (F.col("status") == 304) | (answered & current & F.coalesce(F.col("known") == F.col("fingerprint"), F.lit(False)))
        cases = F.when(F.col("connector").isNull(), verdict(F.lit("unknown source")))
        cases = cases.when(~F.col("connector").isin(list(self._by_id)), verdict(F.concat(F.lit("no connector for "), F.col("connector"))))
        for name, connector in self._by_id.items():
            if connector.verdict is not None:
                cases = cases.when(F.col("connector") == name, connector.verdict())
        nothing = verdict(F.lit(None))
        rows = staged(rows, same=same).withColumn("found", F.when(answered & ~F.col("same"), cases.otherwise(nothing)).otherwise(nothing))
        problem = F.col("found.problem")
        fate = F.when(F.col("same"), UNCHANGED).when(~answered, FAILED).when(problem.isNotNull(), REJECTED).otherwise(READ)
        return rows.select(*raw.columns, "connector", "fingerprint", problem.alias("problem"), F.col("found.icon").alias("icon"), fate.alias("fate"))

    def read(self, judged: DataFrame, context: Context) -> tuple[DataFrame, DataFrame]:
        """Raw entries of all readable documents in one union, and the newest id each source shows: (source_id, since_id)."""
        good = judged.where(F.col("fate") == READ)
        # Kinds of source are few; those that sent nothing are left out of the plan.
        present = {r["connector"] for r in good.select("connector").distinct().collect()}
        spark = judged.sparkSession
        union, cursors = spark.createDataFrame([], schemas.RAW_ENTRY), spark.createDataFrame([], "source_id string, since_id string")
        for name, connector in self._by_id.items():
            if name in present:
                documents = good.where(F.col("connector") == name).select(*schemas.columns(schemas.RAW_FETCH))
                union = union.unionByName(connector.parse(documents, context))
                if connector.cursor is not None:
                    cursors = cursors.unionByName(connector.cursor(documents))
        return union, cursors

    def parse(self, raw: DataFrame, context: Context) -> tuple[DataFrame, DataFrame]:
        """Every connector's readable documents through its parser; and the documents that were rejected."""
        judged = write_through(self.judged(raw, context.sources), "fetches")
        return self.read(judged, context)[0], rejected(judged)


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("fate") == REJECTED).select("source_id", "seq", "url", "problem")


# What a follow timeline and a page of notes show at least; a login page has neither.
FOLLOW_MARKS = rf"""(?i)<{cards.FOLLOW_TAG}[\s>]|class\s*=\s*["'][^"']*(?:{"|".join(cards.FOLLOW_CLASSES)})"""
NOTE_PAGE_MARKS = rf"""{"|".join(f'"{name}"' for name in cards.NOTE_IDS)}"""
PROVIDER_HOSTS = [("openalex.org", "openalex"), ("semanticscholar.org", "semantic"), ("orcid.org", "orcid")]

DEFAULT_CONNECTORS = [
    Connector("rss", lambda raw, _: parse_feeds(raw), feed_verdict),
    Connector("generic", lambda raw, _: parse_listing_pages(raw)),
    Connector("zhihu", lambda raw, _: providers.parse_qa_items(raw), _not_json(providers.QA_ITEMS, "Items", "list of answers")),
    Connector("zhihu_follow", lambda raw, context: cards.parse_follow_cards(raw, context.as_of), _not_shown(FOLLOW_MARKS, "timeline")),
    Connector("x", lambda raw, _: providers.parse_posts(raw), _not_json(providers.POSTS, "data", "list of posts"), _newest_post),
    Connector("xiaohongshu", lambda raw, context: cards.parse_hydration_notes(raw, context.as_of), _not_shown(NOTE_PAGE_MARKS, "list of notes")),
    Connector("academic", _scholarly, _not_works),
    # Nothing is fetched for a manual source; what arrives for one is a page somebody saved.
    Connector("manual", lambda raw, _: parse_listing_pages(raw)),
]


@dataclasses.dataclass(frozen=True)
class Fetched:
    """A batch that was judged and parsed, in written tables; ``sources`` are those it was read with."""

    fetches: DataFrame
    items: DataFrame
    cursors: DataFrame
    sources: DataFrame


def read_batch(raw: DataFrame, sources: DataFrame, stored: merge.Stored, registry: Registry, as_of: int, run: str) -> Fetched:
    """Gate the fetches by what was seen before and parse the rest. Nothing is stored yet."""
    judged = write_through(registry.judged(raw, sources, stored("seen", raw.select("source_id", "url"))), f"fetches-{run}")
    items, cursors = registry.read(judged, Context(sources, as_of))
    return Fetched(judged, write_through(items, f"items-{run}"), cursors, sources)


def settled(fetched: Fetched, sources: DataFrame, stored: merge.Stored, as_of: int, run: str) -> dict[str, DataFrame]:
    """The rows a batch changes in every table, and its ``runs``, given the sources as they are now.

    What was read from a source that is gone meanwhile, or bound to another
    connector or rule, is dropped without a trace.
    """
    current = changes.current_sources(fetched.sources, sources)
    unknown = fetched.fetches.where(F.col("connector").isNull())
    fetches = fetched.fetches.join(current, "source_id", "left_semi").unionByName(unknown)
    items = fetched.items.join(current, "source_id", "left_semi")
    batch = write_through(normalize(items, sources, as_of), f"batch-{run}")
    merged = merge.merged_rows(batch, stored, lambda rows: write_through(rows, f"folded-{run}"))
    outcomes = run_outcomes(answered(fetches), items, merged.inserted, sources)
    # One row per source, which four tables are made from.
    outcomes = write_through(with_health(outcomes, sources, as_of), f"outcomes-{run}")
    read = fetches.where(F.col("fate") == READ)
    newest = read.groupBy("source_id", "url").agg(F.max_by("fingerprint", "seq").alias("fingerprint"))
    return {
        "entries": merged.entries,
        "entry_origins": merged.entry_origins,
        "sources": synced_sources(sources, outcomes, as_of),
        "checkpoints": moved_checkpoints(fetched.cursors.join(current, "source_id", "left_semi"), outcomes, stored, as_of),
        "seen": newest.withColumn("updated_at", F.lit(as_of).cast("bigint")).select(*schemas.columns(schemas.SEEN)),
        "runs": run_log(outcomes, as_of, run),
    }


def answered(fetches: DataFrame) -> DataFrame:
    """One row per source: how it answered, what could not be read, and what its newest answers say about it."""
    fine, order = F.col("fate").isin(READ, UNCHANGED), F.col("seq")

    def newest(column: str) -> Column:
        return F.max_by(F.col(column), F.when(fine & text.blank_to_null(F.col(column)).isNotNull(), order)).alias(column)

    return fetches.groupBy("source_id").agg(
        F.bool_or(F.col("status") < 400).alias("ok"),
        F.bool_and(F.col("fate") == UNCHANGED).alias("unchanged"),
        F.max("status").alias("status"),
        F.min("problem").alias("problem"),
        F.bool_or(F.col("fate") == READ).alias("parsed"),
        newest("etag"),
        newest("last_modified"),
        F.max_by(F.struct("icon", "url"), F.when(F.col("icon").isNotNull(), order)).alias("declared"),
    )


def run_outcomes(answers: DataFrame, items: DataFrame, inserted: DataFrame, sources: DataFrame) -> DataFrame:
    """The answers with ``outcome, message, fetched, inserted``: failed, empty, or successful.

    Only a web source that answered but showed nothing is ``empty``; an
    unchanged answer or an empty feed is a healthy success.
    """
    counts = items.groupBy("source_id").agg(F.count("*").alias("fetched"))
    kinds = sources.select(F.col("id").alias("source_id"), F.coalesce("connector_id", "kind").alias("connector"))
    new = inserted.groupBy("source_id").agg(F.count("*").alias("inserted"))
    joined = answers.join(counts, "source_id", "left").join(new, "source_id", "left").join(kinds, "source_id", "left")
    joined = joined.na.fill(0, ["fetched", "inserted"]).withColumn("read", F.col("problem").isNull())
    empty = (F.col("connector") == "generic") & ~F.col("unchanged") & (F.col("fetched") == 0)
    outcome = F.when(~F.col("ok") | ~F.col("read"), FAILURE).when(F.coalesce(empty, F.lit(False)), EMPTY).otherwise(SUCCESS)
    message = F.when(~F.col("ok"), text.redact_message(F.concat(F.lit("HTTP "), F.col("status")))).otherwise(F.col("problem"))
    return joined.select(*answers.columns, outcome.alias("outcome"), message.alias("message"), "fetched", "inserted")


def with_health(outcomes: DataFrame, sources: DataFrame, as_of: int) -> DataFrame:
    """The outcomes with ``health``, the state of each known source after its run."""
    health = after_run(sources, outcomes, as_of)
    named = health.select("source_id", F.struct(*[c for c in health.columns if c != "source_id"]).alias("health"))
    return outcomes.join(named, "source_id", "left")


def run_log(outcomes: DataFrame, as_of: int, run: str) -> DataFrame:
    """One run per fetched source; an empty one that leaves the source in need of review is a warning."""
    review = (F.col("outcome") == EMPTY) & F.coalesce(F.col("health.status") == "needs_review", F.lit(False))
    return outcomes.select(
        F.concat(F.lit(run), F.lit(":"), F.col("source_id")).alias("id"),
        "source_id",
        F.when(review, WARNING).otherwise(F.col("outcome")).alias("outcome"),
        F.col("fetched").cast("int").alias("fetched_count"),
        F.col("inserted").cast("int").alias("inserted_count"),
        F.when(review, F.lit("the extraction rule needs a review")).otherwise(F.col("message")).alias("message"),
        F.lit(as_of).cast("bigint").alias("created_at"),
    )


def synced_sources(sources: DataFrame, outcomes: DataFrame, as_of: int) -> DataFrame:
    """The sources of a batch after it: status, streaks, next check, and after a success validators, parser revision and icon."""
    told = outcomes.where(F.col("health").isNotNull()).select(
        F.col("source_id").alias("id"), "health", "parsed", "declared", (F.col("outcome") != FAILURE).alias("ok"),
        F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"),
    )
    rows = staged(sources.join(told, "id"), icon=urls.absolute_url(F.col("declared.icon"), F.col("declared.url")))
    rows = staged(rows, public=F.coalesce(urls.is_public_url(F.col("icon")), F.lit(False)))
    ok = F.col("ok")
    changed = {
        **{c: F.col(f"health.{c}") for c in outcomes.schema["health"].dataType.names},
        "etag": F.when(ok, F.coalesce("new_etag", "etag")).otherwise(F.col("etag")),
        "last_modified": F.when(ok, F.coalesce("new_modified", "last_modified")).otherwise(F.col("last_modified")),
        "metadata_revision": F.when(ok & F.col("parsed"), F.lit(changes.FEED_REVISION)).otherwise(F.col("metadata_revision")),
        "icon_url": F.when(ok & F.col("public"), F.col("icon")).otherwise(F.col("icon_url")),
        "updated_at": F.lit(as_of),
    }
    return rows.select(*[changed.get(c, F.col(c)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns])


def moved_checkpoints(cursors: DataFrame, outcomes: DataFrame, stored: merge.Stored, as_of: int) -> DataFrame:
    """Checkpoints of the subscriptions whose source ran well and showed an id; a cursor never moves back."""
    well = cursors.join(outcomes.where(F.col("outcome") != FAILURE), "source_id", "left_semi").where(F.col("since_id").isNotNull())
    owners = stored("subscriptions", well).select("source_id", F.col("id").alias("subscription_id"))
    new = well.join(owners, "source_id").select("subscription_id", F.col("since_id").alias("newest"))
    rows = new.join(stored("checkpoints", new), "subscription_id", "left")
    further = changes._number("newest") > changes._number("since_id")
    moved = F.when(F.col("since_id").isNull() | F.coalesce(further, F.lit(False)), F.col("newest")).otherwise(F.col("since_id"))
    return rows.withColumns({"since_id": moved, "updated_at": F.lit(as_of).cast("bigint")}).select(*schemas.columns(schemas.CHECKPOINTS))


def answering(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Sources that answered with a document, told apart by whether they declare a feed."""
    ids = fetches.where(F.col("fate").isin(READ, REJECTED)).select(F.col("source_id").alias("id")).distinct()
    return sources.join(ids, "id", "left_semi").withColumn("remove_homepage", F.get_json_object("extraction_rule", "$.feedUrl").isNotNull())


def ingest_batch(state: State, raw: DataFrame, registry: Registry, as_of: int, run_key: str) -> tuple[State, DataFrame]:
    """One sync run over a batch of fetches and a state held in frames; the state after it and the batch's runs.

    A failed fetch, and a document that cannot be read, is logged as a failure
    and contributes nothing.
    """

    def whole(name: str, keys: DataFrame) -> DataFrame:
        return getattr(state, name)

    fetched = read_batch(raw, state.sources, whole, registry, as_of, run_key)
    doomed = write_through(maintenance.nav_rows(state.entries, answering(state.sources, fetched.fetches)), f"nav-{run_key}")
    state = state if doomed.isEmpty() else delete_origin_rows(state, doomed)
    after = settled(fetched, state.sources, whole, as_of, run_key)
    runs = after.pop("runs")
    kept = {
        name: getattr(state, name).join(after[name].select(*key), key, "left_anti").select(*after[name].columns).unionByName(after[name])
        for name, key in KEYS.items() if name in ("sources", "checkpoints", "seen")
    }
    return state.with_tables(entries=after["entries"], entry_origins=after["entry_origins"], **kept), runs


def commit_batch(library: Library, fetched: Fetched, as_of: int, run: str) -> int:
    """Merge a batch into the newest version and commit it; if somebody else commits meanwhile, merge again into theirs.

    Only rows the batch changes are written. Parsing is not repeated, but what
    the sources are now is asked every time.
    """
    for _ in range(ATTEMPTS):
        version = library.version()
        state = library.load(version)
        try:
            doomed = write_through(maintenance.nav_rows(state.entries, answering(state.sources, fetched.fetches)), f"nav-{run}")
            if not doomed.isEmpty():
                # Stored cards that were never content are rare: only then are the tables written whole.
                pruned = delete_origin_rows(state, doomed)
                version = library.publish(f"nav-{run}", based_on=version, entries=pruned.entries, entry_origins=pruned.entry_origins)
                state = library.load(version)
            after = settled(fetched, state.sources, library.lookup(version), as_of, run)
            runs = after.pop("runs")
            return library.publish(run, added={"runs": runs}, changed=after, based_on=version)
        except Conflict:
            continue
    raise Conflict(f"{run} met another writer {ATTEMPTS} times")


def confirm_previews(library: Library, verdicts: DataFrame, previews: DataFrame, as_of: int, run: str) -> int | None:
    """Register probed addresses, and store what their previews showed as the first batch of each.

    ``verdicts`` and ``previews`` are those of ``probe``. An address that has a
    source keeps it and nothing of its preview is stored; of several verdicts
    for one address the first counts. Sources, subscriptions and entries are
    one commit under ``run``, so doing it again changes nothing.
    """
    if library.has_run(run):
        return None
    missing = F.lit(None).cast("string")
    trusted = F.when((F.col("kind") == "rss") & urls.is_loopback(F.col("url")), F.lit('{"allowTrustedLoopbackFeed":true}'))
    inputs = verdicts.select(
        "seq", "url", "title", missing.alias("category"), "kind", missing.alias("connector_id"), missing.alias("account_id"), trusted.alias("config_json"),
        F.col("initial_status").alias("status"), missing.alias("extraction_rule"), (F.col("kind") != "manual").alias("polling_enabled"), F.lit(None).cast("int").alias("refresh_interval_minutes"),
    )
    inputs = write_through(merge.first_by_key(inputs, ["url"], "seq"), f"confirmed-{run}")
    previews = write_through(previews, f"previews-{run}")
    for _ in range(ATTEMPTS):
        version = library.version()
        state = library.load(version)
        after = register_sources(state, inputs, as_of)
        created = write_through(after.sources.join(state.sources.select("id"), "id", "left_anti").select(*schemas.columns(schemas.SOURCES)), f"created-{run}")
        subscriptions = after.subscriptions.join(created.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        owners = inputs.select(F.col("seq").alias("page"), "url").join(created.select(F.col("id").alias("source_id"), "url"), "url").drop("url")
        shown = previews.withColumnRenamed("seq", "page").join(owners, "page").withColumn("seq", F.struct("page", "row"))
        kinds = {part.split()[0]: part.split()[1] for part in schemas.RAW_ENTRY.replace("\n", " ").split(",")}
        items = shown.select(*[F.col(c) if c in ("source_id", "seq", "url", "title", "published_at") else F.lit(None).cast(kinds[c]).alias(c) for c in kinds])
        batch = write_through(normalize(items, created, as_of), f"first-{run}")
        merged = merge.merged_rows(batch, library.lookup(version), lambda rows: write_through(rows, f"folded-{run}"))
        try:
            return library.publish(
                run, changed={"sources": created, "subscriptions": subscriptions.select(*schemas.columns(schemas.SUBSCRIPTIONS)), "entries": merged.entries, "entry_origins": merged.entry_origins}, based_on=version
            )
        except Conflict:
            continue
    raise Conflict(f"{run} met another writer {ATTEMPTS} times")


def ingest_stream(
    spark: SparkSession,
    landing: DataFrame,
    library: Library,
    checkpoint: str,
    as_of: int,
    registry: Registry | None = None,
) -> StreamingQuery:
    """Merge every landed micro-batch into the next library version.

    ``landing`` is a streaming frame of fetches. The library's commit names the
    stream's batch: one that is committed already is skipped, so a restart
    after the write but before the stream's own checkpoint changes nothing.
    """
    registry = registry or Registry(*DEFAULT_CONNECTORS)
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def step(batch: DataFrame, number: int) -> None:
        run = f"{stream}-{number}"
        if library.has_run(run):
            return
        version = library.version()
        fetched = read_batch(batch, library.load(version).sources, library.lookup(version), registry, as_of, run)
        commit_batch(library, fetched, as_of, run)
        library.compact()

    return landing.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def secondary_sync(library: Library, run: str, steps: dict[str, Callable[[State], dict[str, DataFrame]]]) -> DataFrame:
    """Extra tables after a successful run (collections, followees), each on its own.

    A step maps the current state to the tables it changes. One that fails is
    reported and does not keep the others from being published.
    """
    outcomes = []
    for name, step in steps.items():
        key = f"{name}-{run}"
        try:
            if not library.has_run(key):
                library.publish(key, **step(library.load()))
            outcomes.append((name, "success", None))
        except Exception as error:  # any failure of one step is a row of the report
            outcomes.append((name, "failure", str(error)))
    report = library.spark.createDataFrame(outcomes, "step string, outcome string, message string")
    return report.withColumn("message", text.redact_message(F.col("message")))


def landing_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Fetches landed as parquet files, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schemas.RAW_FETCH).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
