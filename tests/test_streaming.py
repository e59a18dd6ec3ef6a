import hashlib
from concurrent.futures import ThreadPoolExecutor

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.operators import merge
from contentflow.session import scratch_path
from contentflow.sources import files
from contentflow.sources.snapshots import Conflict, Library, write_report
from contentflow.streaming import changes, ingest
from tests_support import land

ITEM = "<item><title>{title}</title><link>https://e.org/{link}</link>{date}</item>"


def rss(*items):
    return "<rss version='2.0'><channel><title>F</title>" + "".join(ITEM.format(title=t, link=u, date=f"<pubDate>{d}</pubDate>" if d else "") for t, u, d in items) + "</channel></rss>"


def run(spark, root, library):
    running = ingest.ingest_stream(spark, ingest.landing_stream(spark, f"{root}/landing"), library, f"{root}/checkpoint", 1000)
    running.awaitTermination()
    return library.load()


def test_batches_merge_and_replays_change_nothing(spark):
    root = scratch_path(spark, "ingest-test")
    library = Library(spark, f"{root}/library", buckets=2)
    listing = "".join(f'<article class="post-card"><h2><a href="/w/{i}">Web post number {i}</a></h2><p>A teaser that is longer than forty characters {i}</p></article>' for i in range(3))
    library.publish(
        "seed", sources=fx.sources(spark, dict(id="f", url="https://e.org/feed"), dict(id="w", kind="generic", url="https://w.org/"), dict(id="bad")), dismissed=spark.createDataFrame([("https://e.org/hidden", 1)], schemas.DISMISSED)
    )
    land(spark, root, dict(source_id="f", seq=1, content_type="application/xml", text=rss(("One", "1", None), ("Hidden", "hidden", None))), dict(source_id="w", seq=2, url="https://w.org/", text=listing), dict(source_id="bad", seq=3, status=503, text=""))
    state = run(spark, root, library)
    assert {r["canonical_url"] for r in fx.as_dicts(state.entries)} == {"https://e.org/1", "https://w.org/w/0", "https://w.org/w/1", "https://w.org/w/2"}
    assert {(r["source_id"], r["outcome"], r["fetched_count"], r["inserted_count"]) for r in fx.as_dicts(state.runs)} == {("f", "success", 2, 1), ("w", "success", 3, 3), ("bad", "failure", 0, 0)}
    # a late replay brings a date, a new title and a page that shows nothing
    land(spark, root, dict(source_id="f", seq=4, content_type="application/xml", text=rss(("One again", "1?utm_source=x", "Wed, 03 Jan 2024 10:00:00 GMT"), ("Two", "2", None))), dict(source_id="w", seq=5, url="https://w.org/", status=304, text=""))
    state = run(spark, root, library)
    row = fx.as_dicts(state.entries, "canonical_url")["https://e.org/1"]
    assert (row["title"], row["published_at"], row["original_url"]) == ("One again", 1_704_240_000_000, "https://e.org/1")
    assert state.entries.count() == 5 and state.runs.count() == 5
    # a stored card of an answering feed that is only its home link goes with the next batch
    home = fx.batch(spark, dict(canonical_url="https://e.org/feed", source_id="f", title="F", seq=1))
    library.publish("legacy", **{n: getattr(merge.merge_entries(state, home).state, n) for n in ("entries", "entry_origins")})
    assert library.load().entries.count() == 6
    land(spark, root, dict(source_id="f", seq=6, content_type="application/xml", text=rss(("Two", "2", None))))
    state = run(spark, root, library)
    assert state.entries.count() == 5 and "https://e.org/feed" not in {r["canonical_url"] for r in fx.as_dicts(state.entries)}
    version = library.version()
    stream = ingest.ingest_stream  # the same batches again, as after a lost stream checkpoint
    again = ingest.landing_stream(spark, f"{root}/landing")
    stream(spark, again, library, f"{root}/checkpoint", 1000).awaitTermination()
    assert library.version() == version
    before = {tuple(r) for r in state.entries.collect()}
    other = ingest.ingest_stream(spark, ingest.landing_stream(spark, f"{root}/landing"), library, f"{root}/checkpoint2", 1000)
    other.awaitTermination()
    assert {r["canonical_url"] for r in fx.as_dicts(library.load().entries)} == {r[2] for r in before}


def test_all_connectors_and_broken_documents(spark):
    qa = '{"Items":[{"Url":"https://www.zhihu.com/question/1/answer/2","Title":"Q","CreatedAt":1704240000},{"Url":"https://www.zhihu.com/question/1/answer/3","Title":"R","CreatedAt":9223372036854775807}]}'
    posts = '{"username":"me","data":[{"id":"5","text":"hello"}]}'
    works = '{"results":[{"id":"https://openalex.org/W1","title":"T","publication_date":"2024-01-03"}]}'
    notes = '<script>window.__INITIAL_STATE__={"n":[{"noteId":"note000001","title":"t","type":"x","time":1e30}]}</script>'
    follow = '<div class="ContentItem"><h2>A long title</h2><a href="/p/3">read</a></div>'
    documents = {
        "cut": ("rss", "application/xml", "<rss><channel><title>F</title><item><title>On"), "login": ("rss", "text/html", "<html>log in</html>"), "feed": ("rss", "application/xml", rss(("One", "1", None))),
        "qa": ("zhihu", "application/json", qa), "qa-broken": ("zhihu", "application/json", "{oops"), "x": ("x", "application/json", posts), "works": ("academic", "application/json", works),
        "notes": ("xiaohongshu", "text/html", notes), "follow": ("zhihu_follow", "text/html", follow), "odd": ("telegraph", "text/plain", "stop"),
    }
    rows = [dict(id=n, kind=kind, connector_id=kind, url=f"https://{n}.example.org/", config_json='{"authorName":"Ann"}') for n, (kind, _, _) in documents.items()]
    state = schemas.empty_state(spark).with_tables(sources=fx.sources(spark, *rows))
    names = schemas.columns(schemas.RAW_FETCH)
    raw = spark.createDataFrame(
        [tuple({"source_id": n, "seq": i, "url": {"works": "https://api.openalex.org/works", "follow": "https://www.zhihu.com/follow"}.get(n, f"https://{n}.example.org/"), "status": 200, "content_type": kind, "text": body}.get(c) for c in names) for i, (n, (_, kind, body)) in enumerate(documents.items())],
        schemas.RAW_FETCH,
    )
    after, runs = ingest.ingest_batch(state, raw, ingest.Registry(*ingest.DEFAULT_CONNECTORS), 1000, "all-kinds")
    got = {r["source_id"]: (r["outcome"], r["fetched_count"], r["message"]) for r in runs.collect()}
    assert {n: g[:2] for n, g in got.items()} == {
        "cut": ("failure", 0), "login": ("failure", 0), "feed": ("success", 1), "qa": ("success", 2), "qa-broken": ("failure", 0), "x": ("success", 1),
        "works": ("success", 1), "notes": ("success", 1), "follow": ("success", 1), "odd": ("failure", 0),
    }
    assert got["odd"][2] == "no connector for telegraph" and got["login"][2] == "no feed document" and got["cut"][2] == "feed cannot be parsed"
    assert after.entries.count() == 7


def test_committed_batches_are_skipped(spark):
    library = Library(spark, scratch_path(spark, "lib"), buckets=2)
    assert library.version() is None and library.load().entries.count() == 0
    library.publish("run-1", entries=fx.entries(spark, dict(canonical_url="u")))
    assert library.has_run("run-1") and not library.has_run("run-2")
    library.publish("run-2", dismissed=spark.createDataFrame([("x", 1)], schemas.DISMISSED))
    state = library.load()
    assert library.version() == 2 and state.entries.count() == 1 and state.dismissed.count() == 1


def test_two_writers_cannot_take_one_version(spark):
    library = Library(spark, scratch_path(spark, "writers"), buckets=2)
    library.publish("seed", entries=fx.entries(spark, dict(canonical_url="u")))
    base = library.version()
    library.publish("first", based_on=base, entries=fx.entries(spark, dict(canonical_url="first")))
    with pytest.raises(Conflict):
        library.publish("second", based_on=base, entries=fx.entries(spark, dict(canonical_url="second")))
    assert [r["canonical_url"] for r in library.load().entries.collect()] == ["first"] and not library.has_run("second")
    assert [r["canonical_url"] for r in library.load(base).entries.collect()] == ["u"]


def test_runs_are_added_not_rewritten(spark):
    library = Library(spark, scratch_path(spark, "log"), buckets=2)
    row = lambda i: spark.createDataFrame([(f"r{i}", "s", "success", 1, 1, None, i)], schemas.RUNS)
    library.publish("one", added={"runs": row(1)})
    first = {r["path"] for r in library.commits().where("table = 'runs'").collect()}
    library.publish("two", added={"runs": row(2)}, dismissed=spark.createDataFrame([("x", 1)], schemas.DISMISSED))
    assert sorted(r["id"] for r in library.load().runs.collect()) == ["r1", "r2"]
    assert first < {r["path"] for r in library.commits().where("table = 'runs'").collect()}


def _parts(library, table):
    return {r["path"]: r for r in library.commits().where(F.col("table") == table).collect()}


def test_batches_write_what_they_change_and_read_touched_buckets(spark):
    library = Library(spark, scratch_path(spark, "changes"), buckets=8)
    library.publish("seed", entries=fx.entries(spark, *[dict(canonical_url=f"u{i}", title="old") for i in range(300)]))
    base = _parts(library, "entries")
    library.publish("change", changed={"entries": fx.entries(spark, dict(canonical_url="u1", title="new"), dict(canonical_url="more"))}, removed={"entries": spark.createDataFrame([("u2",)], "canonical_url string")})
    after = _parts(library, "entries")
    # The base keeps its files; the batch added three rows.
    assert set(base) < set(after) and [after[p]["rows"] for p in set(after) - set(base)] == [3]
    rows = fx.as_dicts(library.load().entries, "canonical_url")
    assert len(rows) == 300 and rows["u1"]["title"] == "new" and "u2" not in rows and "more" in rows and rows["u3"]["title"] == "old"
    assert fx.as_dicts(library.load(1).entries, "canonical_url")["u1"]["title"] == "old"
    found = library.lookup()("entries", spark.createDataFrame([("u1",), ("u2",), ("u5",), ("none",)], "canonical_url string"))
    assert {(r["canonical_url"], r["title"]) for r in found.collect()} == {("u1", "new"), ("u5", "old")}
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert scans and all(line.split("PartitionFilters: [")[1].startswith("bucket") for line in scans)


def test_compaction_keeps_the_rows(spark):
    library = Library(spark, scratch_path(spark, "compact"), buckets=2)
    url = lambda n: spark.createDataFrame([(n,)], "canonical_url string")
    library.publish("seed", entries=fx.entries(spark, *[dict(canonical_url=f"u{i}", title="0") for i in range(40)]))
    for i in range(6):
        library.publish(f"run-{i}", changed={"entries": fx.entries(spark, dict(canonical_url=f"u{i % 2}", title=str(i + 1)))}, removed={"entries": url(f"u{10 + i}")}, added={"runs": spark.createDataFrame([(f"r{i}", "s", "success", 1, 1, None, i)], schemas.RUNS)})
    before = sorted(map(tuple, library.load().entries.collect()))
    assert library.compact(fanout=7) is None
    # Tiers first: six parts of changes become one, two rounds of it, and removed keys stay removed.
    library.compact(fanout=3, share=9)
    tiers = sorted((r["kind"], r["tier"], r["rows"]) for r in library.commits().collect())
    assert tiers == [("added", 1, 6), ("base", 0, 40), ("changed", 1, 8)]
    assert sorted(map(tuple, library.load().entries.collect())) == before and library.load().runs.count() == 6
    library.publish("run-6", changed={"entries": fx.entries(spark, dict(canonical_url="u11", title="back"))})
    assert {r["canonical_url"] for r in library.load().entries.collect()} == {r[2] for r in before} | {"u11"}
    library.compact(fanout=2, share=0.2)
    assert sorted((r["kind"], r["rows"]) for r in library.commits().where("table = 'entries'").collect()) == [("base", 35)]
    assert fx.as_dicts(library.load().entries, "canonical_url")["u1"]["title"] == "6" and library.has_run("run-6") and library.has_run("run-2") and not library.has_run("run-7")


def test_many_writers_one_version(spark):
    library = Library(spark, scratch_path(spark, "race"), buckets=2)
    library.publish("seed", dismissed=spark.createDataFrame([("x", 1)], schemas.DISMISSED))

    def write(i):
        try:
            library.publish(f"writer{i}", based_on=1, changed={"dismissed": spark.createDataFrame([(f"w{i}", 1)], schemas.DISMISSED)})
            return i
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [i for i in pool.map(write, range(6)) if i is not None]
    assert len(won) == 1 and library.version() == 2
    assert {r[0] for r in library.load().dismissed.collect()} == {"x", f"w{won[0]}"}


def test_a_file_is_created_once(spark):
    path = f"{scratch_path(spark, 'claims')}/1.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: files.created(spark, path, str(i)), range(16)))
    assert sum(made) == 1 and files.content(spark, path) == str(made.index(True)) and files.names(spark, path.rsplit("/", 1)[0]) == ["1.json"]
    assert files.names(spark, f"{path}/none") == [] and files.local_path("s3://b/x") is None and files.local_path("file:///a%20b") == "/a b"
    # The Hadoop client's way, on the same file system.
    other = "viewfs://claims/shared/1.json"
    spark.conf.set("fs.viewfs.mounttable.claims.link./shared", f"file://{path.rsplit('/', 1)[0]}")
    try:
        assert files.names(spark, other.rsplit("/", 1)[0]) == ["1.json"]
        assert not files.created(spark, other, "again") and files.created(spark, other.replace("1.json", "2.json"), "two")
    finally:
        spark.conf.unset("fs.viewfs.mounttable.claims.link./shared")
    assert files.content(spark, path.replace("1.json", "2.json")) == "two"


def fetch(spark, *docs):
    names = schemas.columns(schemas.RAW_FETCH)
    rows = [{"status": 200, "url": "https://e.org/feed", "content_type": "application/xml", **d} for d in docs]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.RAW_FETCH)


def seeded(spark, label, sources, **tables):
    library = Library(spark, scratch_path(spark, label), buckets=2)
    library.publish("seed", sources=fx.sources(spark, *sources), **tables)
    return library


def sync(spark, library, run, as_of, *docs, meanwhile=None):
    """One batch: read, what others do meanwhile, commit."""
    # Web pages show nothing here.
    quiet = ingest.Connector("generic", lambda raw, _: spark.createDataFrame([], schemas.RAW_ENTRY))
    registry = ingest.Registry(*[c for c in ingest.DEFAULT_CONNECTORS if c.connector_id != "generic"], quiet)
    version = library.version()
    fetched = ingest.read_batch(fetch(spark, *docs), library.load(version).sources, library.lookup(version), registry, as_of, run)
    if meanwhile:
        meanwhile()
    ingest.commit_batch(library, fetched, as_of, run)
    return library.load()


def test_a_sync_is_written_back(spark):
    feed = lambda i: rss((f"Post {i}", str(i), None)).replace("<title>F</title>", "<title>F</title><image><url>/icon.png</url></image>")
    posts = lambda *ids: '{"username":"me","data":[' + ",".join(f'{{"id":"{i}","text":"hello {i}"}}' for i in ids) + "]}"
    subscription = spark.createDataFrame([(f"sub-{s}", s, "x", None, None, None, 1, 1) for s in ("x", "y")], schemas.SUBSCRIPTIONS)
    old = spark.createDataFrame([("sub-y", "c", "99999999999999999999", '{"a":1}', 5)], schemas.CHECKPOINTS)
    library = seeded(
        spark, "sync", [dict(id="f", polling_enabled=True, refresh_interval_minutes=60, failure_count=3, last_error="old", etag="e0"), dict(id="w", kind="generic", consecutive_empty=2), dict(id="bad", failure_count=4), dict(id="x", kind="x"), dict(id="y", kind="x"), dict(id="idle")],
        subscriptions=subscription, checkpoints=old,
    )
    page = "<html><body><p>nothing listed</p></body></html>"
    state = sync(
        spark, library, "s-1", 1_000_000, dict(source_id="f", seq=1, text=feed(1), etag="e1"), dict(source_id="w", seq=2, url="https://w.org/", content_type="text/html", text=page), dict(source_id="bad", seq=3, status=503),
        dict(source_id="x", seq=4, url="https://x.com/me", content_type="application/json", text=posts(9, 10)), dict(source_id="y", seq=5, url="https://x.com/y", content_type="application/json", text=posts(7)), dict(source_id="nobody", seq=6, text=feed(2)),
    )
    got = fx.as_dicts(state.sources, "id")
    f, w, bad = got["f"], got["w"], got["bad"]
    assert (f["status"], f["failure_count"], f["last_error"], f["etag"], f["metadata_revision"], f["icon_url"], f["last_checked_at"]) == ("active", 0, None, "e1", changes.FEED_REVISION, "https://e.org/icon.png", 1_000_000)
    assert 1_000_000 + 54 * 60_000 <= f["next_check_at"] <= 1_000_000 + 66 * 60_000
    assert (w["status"], w["consecutive_empty"], w["next_check_at"]) == ("needs_review", 3, None)
    assert (bad["status"], bad["failure_count"], bad["last_error"], bad["next_check_at"]) == ("paused", 5, "HTTP 503", None)
    assert got["idle"]["last_checked_at"] is None
    runs = {r["source_id"]: r for r in fx.as_dicts(state.runs)}
    assert {s: r["outcome"] for s, r in runs.items()} == {"f": "success", "w": "warning", "bad": "failure", "x": "success", "y": "success", "nobody": "failure"}
    assert runs["nobody"]["message"] == "unknown source"
    cursors = {r["subscription_id"]: (r["since_id"], r["cursor"], r["updated_at"]) for r in fx.as_dicts(state.checkpoints)}
    # A cursor does not move back.
    assert cursors == {"sub-x": ("10", None, 1_000_000), "sub-y": ("99999999999999999999", "c", 1_000_000)}
    # The same documents again are unchanged: nothing is parsed, and that is a healthy success.
    state = sync(spark, library, "s-2", 2_000_000, dict(source_id="f", seq=7, text=feed(1), etag="e1"), dict(source_id="w", seq=8, url="https://w.org/", content_type="text/html", text=page))
    runs = {r["id"]: r for r in fx.as_dicts(state.runs)}
    assert (runs["s-2:f"]["outcome"], runs["s-2:f"]["fetched_count"]) == ("success", 0) and runs["s-2:w"]["outcome"] == "success"
    got = fx.as_dicts(state.sources, "id")
    assert got["w"]["status"] == "active" and got["w"]["consecutive_empty"] == 0 and got["f"]["last_checked_at"] == 2_000_000 and got["bad"]["status"] == "paused"


def test_older_parsers_results_are_read_again(spark):
    library = seeded(spark, "replay", [dict(id="new", metadata_revision=changes.FEED_REVISION), dict(id="old", metadata_revision=changes.FEED_REVISION - 1)])
    one, two = rss(("One", "1", None)), rss(("Two", "2", None))
    tag = lambda body: hashlib.sha256(body.encode()).hexdigest()
    library.publish("seen", seen=spark.createDataFrame([(s, f"https://e.org/{s}", tag(body), 1) for s, body in (("new", one), ("old", two))], schemas.SEEN))
    docs = [dict(source_id="new", seq=1, url="https://e.org/new", text=one), dict(source_id="old", seq=2, url="https://e.org/old", text=two)]
    state = sync(spark, library, "p-1", 10, *docs)
    assert [r["canonical_url"] for r in state.entries.collect()] == ["https://e.org/2"]
    assert fx.as_dicts(state.sources, "id")["old"]["metadata_revision"] == changes.FEED_REVISION
    state = sync(spark, library, "p-2", 20, *docs, dict(source_id="new", seq=3, url="https://e.org/old", text=two))
    # What another source has seen at an address does not count for this one.
    assert {(r["id"], r["fetched_count"]) for r in state.runs.collect() if r["id"].startswith("p-2")} == {("p-2:new", 1), ("p-2:old", 0)}


def test_results_for_changed_sources_are_dropped(spark):
    library = seeded(spark, "stale", [dict(id=n) for n in ("same", "gone", "moved")])

    def meanwhile():
        library.publish("user", sources=fx.sources(spark, dict(id="same", title="renamed"), dict(id="moved", kind="manual")))

    docs = [dict(source_id=n, seq=i, url=f"https://e.org/{n}", text=rss((n, f"a-{n}", None))) for i, n in enumerate(("same", "gone", "moved"))]
    state = sync(spark, library, "g-1", 10, *docs, meanwhile=meanwhile)
    assert [r["source_id"] for r in state.entries.collect()] == ["same"] and [r["source_id"] for r in state.runs.collect()] == ["same"]
    got = fx.as_dicts(state.sources, "id")
    assert got["same"]["title"] == "renamed" and got["same"]["last_checked_at"] == 10 and got["moved"]["last_checked_at"] is None


def test_a_batch_is_merged_again_into_what_others_committed(spark):
    library = seeded(spark, "again", [dict(id="f")])
    other = fx.entries(spark, dict(canonical_url="https://e.org/other"))
    lost = []

    class Contested(Library):
        def publish(self, run, **more):
            if run == "c-1" and not lost:
                lost.append(run)
                library.publish("other", entries=other)
            return super().publish(run, **more)

    state = sync(spark, Contested(spark, library.root, buckets=2), "c-1", 10, dict(source_id="f", seq=1, text=rss(("One", "1", None))))
    assert lost and {r["canonical_url"] for r in state.entries.collect()} == {"https://e.org/other", "https://e.org/1"} and library.version() == 3


def test_previews_are_the_first_batch(spark):
    library = seeded(spark, "previews", [dict(id="old", url="https://e.org/old", title="Old")], entries=fx.entries(spark, dict(canonical_url="https://e.org/p/1", id="kept", title="before")))
    verdicts = spark.createDataFrame(
        [(1, "rss", "https://e.org/feed", "F", 0.9, False, "active"), (2, "rss", "https://e.org/feed", "again", 0.9, False, "active"), (3, "generic", "https://e.org/old", "X", 0.9, False, "active"), (4, "manual", "https://m.org/", "M", 1.0, False, "active"), (5, "rss", "http://localhost:8080/f", "L", 1.0, False, "active")],
        "seq bigint, kind string, url string, title string, confidence double, requires_review boolean, initial_status string",
    )
    rows = [(1, "https://e.org/p/1", "One", 1), (1, "https://e.org/p/2", "Two", 2), (2, "https://e.org/p/3", "Three", 1), (3, "https://e.org/p/4", "Four", 1), (4, "https://m.org/a", "Saved", 1)]
    shown = spark.createDataFrame([(s, u, t, None, r) for s, u, t, r in rows], "seq bigint, url string, title string, published_at bigint, row int")
    assert ingest.confirm_previews(library, verdicts, shown, 7, "confirm-1") == 2 and ingest.confirm_previews(library, verdicts, shown, 8, "confirm-1") is None
    state = library.load()
    sources = fx.as_dicts(state.sources, "url")
    assert set(sources) == {"https://e.org/old", "https://e.org/feed", "https://m.org/", "http://localhost:8080/f"}
    assert sources["https://e.org/old"]["title"] == "Old" and sources["https://e.org/feed"]["title"] == "F" and not sources["https://m.org/"]["polling_enabled"]
    assert sources["http://localhost:8080/f"]["config_json"] == '{"allowTrustedLoopbackFeed":true}'
    entries = fx.as_dicts(state.entries, "canonical_url")
    # An entry that is stored keeps its identity and gets the new title; what known sources showed is not stored.
    assert {u: (r["title"]) for u, r in entries.items()} == {"https://e.org/p/1": "One", "https://e.org/p/2": "Two", "https://m.org/a": "Saved"} and entries["https://e.org/p/1"]["id"] == "kept"
    assert state.subscriptions.count() == 3 and {r["entry_id"] for r in state.entry_origins.collect()} >= {"kept"} and library.version() == 2


def test_registry():
    registry = ingest.Registry(*ingest.DEFAULT_CONNECTORS)
    assert registry.get("rss").connector_id == "rss"
    with pytest.raises(ValueError):
        registry.register(ingest.Connector("rss", lambda raw, _: raw))
    with pytest.raises(KeyError):
        registry.get("none")


def test_changes_and_replay(spark):
    rows = [("a", 1, "u1", 200, "e1", None, "x"), ("a", 2, "u2", 200, None, "m1", "x"), ("a", 3, "u3", 200, None, None, "body"), ("b", 4, "u4", 304, "e9", None, ""), ("b", 5, "u5", 200, "e5", None, "x")]
    raw = spark.createDataFrame(rows, "source_id string, seq bigint, url string, status int, etag string, last_modified string, text string")
    seen = changes.last_seen(raw.where("seq <> 3"), spark.createDataFrame([("u3", "old")], "url string, fingerprint string"))
    assert {r["seq"] for r in changes.changed_fetches(raw, seen).collect()} == {3}
    sources = fx.sources(spark, dict(id="a", metadata_revision=changes.FEED_REVISION), dict(id="b"))
    assert {r["seq"] for r in changes.replayed_fetches(raw, seen, sources).collect()} == {3, 5}


def test_stale_results_are_dropped(spark):
    before = fx.sources(spark, *[dict(id=n, kind="generic", extraction_rule='{"v":1}') for n in ("same", "rule", "kind", "gone")], dict(id="feed", extraction_rule="1"))
    after = fx.sources(spark, dict(id="same", kind="generic", extraction_rule='{"v":1}'), dict(id="rule", kind="generic"), dict(id="kind", kind="manual", extraction_rule='{"v":1}'), dict(id="feed", extraction_rule="2"))
    batch = before.select(F.col("id").alias("source_id"))
    assert {r["source_id"] for r in changes.still_current(batch, before, after).collect()} == {"same", "feed"}


def test_cursors_compare_numbers_and_move_over_filtered_posts(spark):
    posts = spark.createDataFrame([("a", "9"), ("a", "10"), ("a", "100000000000000000000"), ("b", "5")], "author_id string, post_id string")
    since = spark.createDataFrame([("a", "9"), ("c", "7")], "author_id string, since_id string")
    fresh, after = changes.increment(posts, since)
    assert {r["post_id"] for r in fresh.collect()} == {"10", "100000000000000000000", "5"}
    assert {tuple(r) for r in after.collect()} == {("a", "100000000000000000000"), ("b", "5"), ("c", "7")}
    assert changes.latest_id(after).first()[0] == "100000000000000000000"


def test_secondary_steps_fail_alone(spark):
    library = Library(spark, scratch_path(spark, "secondary"), buckets=2)
    seen = spark.createDataFrame([("t", "n", "u", None, None, 1, 1, 0)], schemas.FOLLOWEES + ", seq bigint")

    def broken(state):
        raise RuntimeError("refused, token=abc")

    steps = {"collections": broken, "followees": lambda state: {"followees": merge.merge_followees(state, seen).followees}}
    report = {r["step"]: (r["outcome"], r["message"]) for r in ingest.secondary_sync(library, "r1", steps).collect()}
    assert report == {"collections": ("failure", "refused, token=[redacted]"), "followees": ("success", None)}
    assert library.load().followees.count() == 1


def test_report_sink(spark, tmp_path):
    write_report(spark.createDataFrame([("s", ["x"])], "source string, issues array<string>"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["issues"] == ["x"]
