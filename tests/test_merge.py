import hashlib
import random

import fixtures as fx
import pytest

from contentflow import schemas
from contentflow.operators import merge, mutations
from contentflow.operators.normalize import normalize


def random_rows(seed, n=120, urls=12):
    rng = random.Random(seed)
    maybe = lambda v: v if rng.random() < 0.5 else None
    # one URL holds a third of the rows
    pick = lambda: "u0" if rng.random() < 0.33 else f"u{rng.randrange(urls)}"
    rows = []
    for seq in range(n):
        url = pick()
        rows.append(
            dict(
                canonical_url=url, canonical_identity=rng.choice([url, f"i{rng.randrange(5)}"]), source_id=f"s{rng.randrange(3)}", title=f"t{seq}", content_hash=f"h{seq}",
                author=maybe(f"a{seq}"), published_at=maybe(seq), summary=maybe(f"m{seq}"), image_url=maybe(f"g{seq}"), provider_id=rng.choice(["rss", "x"]),
                provider_label=maybe(f"l{seq}"), external_id=maybe(f"x{rng.randrange(3)}"), observed_at=seq, created_at=5, original_url=f"o{seq}", seq=seq, id=f"id:{url}",
            )
        )
    return rows


def check(state, rows, dismissed=()):
    stored, seen, _ = fx.sequential_upsert(rows, dismissed)
    got = fx.as_dicts(state.entries, "canonical_url")
    names = [c for c in schemas.columns(schemas.ENTRIES) if c not in ("id", "is_read", "is_favorite")]
    assert {u: [r[n] for n in names] for u, r in got.items()} == {u: [r[n] for n in names] for u, r in stored.items()}
    ids = {r["id"]: u for u, r in got.items()}
    origins = {(ids[r["entry_id"]], r["source_id"], r["provider_id"], r["external_id"]): (r["provider_label"], r["original_url"], r["observed_at"]) for r in fx.as_dicts(state.entry_origins)}
    assert origins == seen


def with_hashed_ids(rows):
    return [{**r, "id": hashlib.sha256(r["canonical_url"].encode()).hexdigest()} for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_row_by_row_upsert(spark, seed):
    rows = with_hashed_ids(random_rows(seed))
    dismissed = {"i1", "u3"}
    tombs = spark.createDataFrame([(d, 0) for d in dismissed], schemas.DISMISSED)
    state = schemas.state_of(spark, dismissed=tombs)
    result = merge.merge_entries(state, fx.batch(spark, *rows))
    check(result.state, rows, dismissed)
    assert result.inserted.count() == fx.sequential_upsert(rows, dismissed)[2]


def test_two_batches_equal_one_and_a_replay_changes_nothing(spark):
    rows = with_hashed_ids(random_rows(3))
    first, second = fx.batch(spark, *rows[:50]), fx.batch(spark, *rows[50:])
    one = merge.merge_entries(schemas.empty_state(spark), first).state.written("t", "entries", "entry_origins")
    two = merge.merge_entries(one, second)
    check(two.state, rows)
    state = two.state.written("t2", "entries", "entry_origins")
    again = merge.merge_entries(state, second)
    assert again.inserted.count() == 0
    check(again.state, rows)


def test_read_state_and_ids_survive(spark):
    old = fx.entries(spark, dict(canonical_url="u", id="legacy-id", is_read=True, title="old", author="A", created_at=7))
    state = schemas.state_of(spark, entries=old, entry_origins=fx.own_origins(spark, old))
    after = merge.merge_entries(state, fx.batch(spark, dict(canonical_url="u", title="new", observed_at=99, source_id="other"))).state
    row = fx.as_dicts(after.entries)[0]
    assert (row["id"], row["title"], row["author"], row["is_read"], row["created_at"], row["observed_at"], row["source_id"]) == ("legacy-id", "new", "A", True, 7, 1, "s")
    assert {(r["entry_id"], r["source_id"]) for r in fx.as_dicts(after.entry_origins)} == {("legacy-id", "s"), ("legacy-id", "other")}


def test_dismissed_stays_away(spark):
    old = fx.entries(spark, dict(canonical_url="u1"), dict(canonical_url="u2"))
    state = schemas.state_of(spark, entries=old, entry_origins=fx.own_origins(spark, old))
    actions = spark.createDataFrame([("e:u1", "dismiss", True, 1), ("e:u2", "read", True, 2), ("e:u2", "read", False, 3), ("e:u2", "favorite", True, 4)], "entry_id string, action string, value boolean, seq bigint")
    acted = mutations.apply_actions(state, actions, 50)
    row = fx.as_dicts(acted.entries)
    assert [(r["id"], r["is_read"], r["is_favorite"]) for r in row] == [("e:u2", False, True)]
    assert fx.as_dicts(acted.entry_origins)[0]["entry_id"] == "e:u2"
    later = merge.merge_entries(acted, fx.batch(spark, dict(canonical_url="u1"), dict(canonical_url="u9")))
    assert {r["canonical_url"] for r in fx.as_dicts(later.state.entries)} == {"u2", "u9"}


def test_shared_entries_survive_a_source(spark):
    old = fx.entries(spark, dict(canonical_url="shared", source_id="a"), dict(canonical_url="only-a", source_id="a"), dict(canonical_url="b", source_id="b"), dict(canonical_url="orphan", source_id="b"))
    seen = fx.origins(
        spark, dict(entry_id="e:shared", source_id="a"), dict(entry_id="e:shared", source_id="c", observed_at=9), dict(entry_id="e:shared", source_id="b", observed_at=8),
        dict(entry_id="e:only-a", source_id="a"), dict(entry_id="e:b", source_id="b"),
    )
    state = schemas.state_of(spark, sources=fx.sources(spark, dict(id="a"), dict(id="b"), dict(id="c")), entries=old, entry_origins=seen)
    after = mutations.delete_sources(state, spark.createDataFrame([("a",)], "source_id string"))
    assert {(r["id"], r["source_id"]) for r in fx.as_dicts(after.entries)} == {("e:shared", "b"), ("e:b", "b")}
    assert {r["id"] for r in fx.as_dicts(after.sources)} == {"b", "c"}
    assert after.entry_origins.count() == 3


def test_followees_go_only_with_a_qa_account(spark):
    followees = spark.createDataFrame([("t", "n", "u", None, None, 1, 1)], schemas.FOLLOWEES)
    state = schemas.state_of(spark, sources=fx.sources(spark, dict(id="a"), dict(id="q", kind="zhihu")), followees=followees)
    assert mutations.delete_sources(state, spark.createDataFrame([("a",)], "source_id string")).followees.count() == 1
    assert mutations.delete_sources(state, spark.createDataFrame([("q",)], "source_id string")).followees.count() == 0


def test_normalise_policies(spark):
    names = schemas.columns(schemas.RAW_ENTRY)
    rows = [
        dict(source_id="g", seq=1, url="https://g.example.org/?legacy=1#x", title="home", canonical_identity="https://g.example.org/?p=5"),
        dict(source_id="g", seq=2, url="https://g.example.org/", title="real home link", canonical_identity="https://g.example.org/post/1/"),
        dict(source_id="ac", seq=3, url="https://doi.org/10.1234/X", title="paper", summary="s"),
        dict(source_id="ac", seq=4, url="https://land.example.org/W/?ref=1", title="paper", external_id="W9"),
        dict(source_id="tw", seq=5, url="https://x.com/a/status/1?utm_source=z", title="post", external_id="1"),
        dict(source_id="g", seq=6, url="no url", title="dropped"),
        dict(source_id="unknown", seq=7, url="https://e.org/", title="dropped"),
    ]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.RAW_ENTRY)
    sources = fx.sources(spark, dict(id="g", kind="generic", url="https://g.example.org/"), dict(id="ac", kind="academic"), dict(id="tw", kind="x"))
    got = fx.as_dicts(normalize(raw, sources, 77), "seq")
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["canonical_url"] == "https://g.example.org/?legacy=1"
    assert (got[2]["canonical_url"], got[2]["original_url"]) == ("https://g.example.org/post/1", "https://g.example.org/post/1")
    assert (got[3]["canonical_url"], got[3]["canonical_identity"]) == ("https://doi.org/10.1234/x", "doi:10.1234/x")
    assert (got[4]["canonical_url"], got[4]["canonical_identity"]) == ("https://land.example.org/W/?ref=1", "academic:W9")
    assert (got[5]["canonical_url"], got[5]["canonical_identity"], got[5]["provider_label"]) == ("https://x.com/a/status/1?utm_source=z", "x:1", "X")
    assert got[3]["content_hash"] == hashlib.sha256(b"doi:10.1234/x\npaper\ns").hexdigest()
    assert got[2]["content_hash"] == hashlib.sha256(b"real home link\x00\x00").hexdigest()
    assert got[5]["observed_at"] == got[5]["created_at"] == 77


def test_settings(spark):
    state = schemas.state_of(
        spark,
        sources=fx.sources(spark, dict(id="a", kind="generic", etag="e", extraction_rule="{}", status="paused"), dict(id="b", kind="x", etag="e"), dict(id="c", kind="rss", etag="e")),
        maintenance=spark.createDataFrame([("a", 1, 1), ("c", 1, 1)], schemas.MAINTENANCE),
    )
    changes = spark.createDataFrame(
        [("a", " A ", "f  g", "rss", True, 60), ("b", "B", None, "rss", True, 60), ("c", "C", "x" * 61, "rss", True, None), ("zz", "Z", None, "rss", True, None)],
        "id string, title string, category string, kind string, polling_enabled boolean, refresh_interval_minutes int",
    )
    judged = {r["id"]: r["reject"] for r in fx.as_dicts(mutations.check_settings(state.sources, changes))}
    assert judged == {"a": None, "b": "kind is fixed by the connector", "c": "category too long", "zz": "unknown source"}
    after = mutations.apply_settings(state, changes, 1000)
    a, c = fx.as_dicts(after.sources, "id")["a"], fx.as_dicts(after.sources, "id")["c"]
    assert (a["title"], a["category"], a["kind"], a["connector_id"], a["etag"], a["extraction_rule"], a["status"]) == ("A", "f g", "rss", "rss", None, None, "active")
    assert 1000 + 54 * 60_000 <= a["next_check_at"] <= 1000 + 66 * 60_000
    assert c["etag"] == "e" and {r["source_id"] for r in fx.as_dicts(after.maintenance)} == {"c"}


def test_backfill_is_idempotent(spark):
    old = fx.entries(spark, dict(canonical_url="u", source_id="a", provider_id=None, canonical_identity=None, observed_at=None, created_at=4))
    made = fx.sources(spark, dict(id="a", kind="rss")).withColumn("connector_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(""))
    once = mutations.backfill(schemas.state_of(spark, sources=made, entries=old))
    row = fx.as_dicts(once.entries)[0]
    assert (row["provider_id"], row["canonical_identity"], row["observed_at"]) == ("rss", "u", 4)
    twice = mutations.backfill(once)
    assert (twice.entry_origins.count(), twice.subscriptions.count()) == (1, 1)


def test_icons_and_retired_sources(spark):
    state = schemas.state_of(
        spark, sources=fx.sources(spark, dict(id="a"), dict(id="x1", kind="x", config_json='{"mode":"public-profile"}'), dict(id="x2", kind="x", config_json='{"mode":"profile"}'))
    )
    icons = spark.createDataFrame([("a", "https://cdn.example.org/i.png"), ("x2", "http://127.0.0.1/i.png")], "source_id string, icon_url string")
    after = fx.as_dicts(mutations.update_icons(state, icons, 9).sources, "id")
    assert after["a"]["icon_url"] == "https://cdn.example.org/i.png" and after["a"]["updated_at"] == 9
    assert after["x2"]["icon_url"] is None
    from pyspark.sql import functions as F

    retired = mutations.retired_sources(state.sources)
    assert [r["source_id"] for r in fx.as_dicts(retired)] == ["x1"]
    paused = mutations.pause_sources(state, retired.withColumn("reason", F.lit("gone")), 5)
    assert mutations.retired_sources(paused.sources).count() == 0
