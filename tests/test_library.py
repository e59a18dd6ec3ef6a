import fixtures as fx
import pytest
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.operators import audit, folders, maintenance, timeline
from contentflow.operators.ranking import ranked

WRAPPED = "https://scour.ing/r/rss/https%3A%2F%2Fe.org%2Fpost"


def ids(frame):
    return [r["id"] for r in frame.collect()]


@pytest.fixture
def dated(spark):
    rows = fx.entries(
        spark, dict(canonical_url="old", id="old", published_at=100, observed_at=900), dict(canonical_url="new", id="new", published_at=500, is_read=True),
        dict(canonical_url="undated", id="undated", observed_at=1600), dict(canonical_url="later", id="later", published_at=2000, is_favorite=True),
        dict(canonical_url="bare", id="bare", observed_at=None, created_at=1500),
    )
    return rows, fx.own_origins(spark, rows)


def test_order_range_and_limit(dated):
    rows, seen = dated
    assert ids(timeline.timeline(rows, seen)) == ["later", "new", "old", "undated", "bare"]
    assert set(ids(timeline.timeline(rows, seen, start_at=1000, end_at=2000))) == {"undated", "bare"}
    assert ids(timeline.timeline(rows, seen, start_at=2000, end_at=1000)) == []
    assert len(ids(timeline.timeline(rows, seen, start_at=float("nan"), end_at=float("inf")))) == 5
    assert ids(timeline.timeline(rows, seen, limit=1.9)) == ["later"]
    assert ids(timeline.timeline(rows, seen, limit=-4)) == ["later"]
    assert timeline.whole_limit(10**9) == 10**9 and timeline.whole_limit(None) is None


def test_range_reaches_the_scan(spark, dated, tmp_path):
    rows, seen = dated
    rows.write.parquet(str(tmp_path / "e"))
    plan = timeline.timeline(spark.read.parquet(str(tmp_path / "e")), seen, start_at=1, end_at=9)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(published_at,1)" in plan


def test_by_source_sees_shared_entries_once(spark, dated):
    rows, _ = dated
    seen = fx.origins(spark, dict(entry_id="old", source_id="z", external_id="1"), dict(entry_id="old", source_id="z", external_id="2"), dict(entry_id="new", source_id="s"))
    assert ids(timeline.timeline(rows, seen, source_id="z")) == ["old"]
    assert len(ids(timeline.timeline(rows, seen, source_id="s"))) == 5


def test_views_and_counts(dated):
    rows, seen = dated
    view = lambda name, source=None: ids(timeline.library_view(rows, seen, name, source, 1_000))
    assert len(view("today")) == 5 and len(view("all")) == 5
    assert "new" not in view("unread", "nobody") and len(view("unread", "nobody")) == 4
    assert view("favorite", "s") == ["later"] and view("favorite", "nobody") == []
    row = timeline.library_counts(rows, 86_400_000 * 3).first()
    assert tuple(row) == (4, 1, 0)
    with pytest.raises(ValueError):
        view("starred")


def test_local_day_bounds():
    start, end = timeline.day_bounds(1_711_843_200_000, "Europe/Berlin")  # 2024-03-31, the clock changes
    assert end - start == 23 * 3_600_000


@pytest.mark.parametrize("bad", [dict(limit=0), dict(limit=1001), dict(limit=1.5), dict(limit=True), dict(start_at=-1), dict(end_at=float("inf")), dict(start_at=5, end_at=5)])
def test_argument_bounds(bad):
    with pytest.raises(ValueError):
        timeline.check_arguments(**bad)
    timeline.check_arguments(limit=1000, start_at=0, end_at=1)


def test_nested_origins_are_whole_for_hot_entries(spark):
    seen = fx.origins(spark, *[dict(entry_id="hot", source_id=f"s{i:03d}", observed_at=i) for i in range(95)], dict(entry_id="cold", source_id="a", observed_at=2), dict(entry_id="cold", source_id="b", observed_at=1))
    rows = fx.as_dicts(timeline.nest_origins(seen, per_row=10))
    hot = [o["source_id"] for r in rows if r["entry_id"] == "hot" for o in r["origins"]]
    assert sorted(hot) == [f"s{i:03d}" for i in range(95)]
    slices = sorted((r["part"], [o["observed_at"] for o in r["origins"]]) for r in rows if r["entry_id"] == "hot")
    assert [s for _, s in slices] == [list(range(95))[i : i + 10] for i in range(0, 95, 10)] and {r["parts"] for r in rows if r["entry_id"] == "hot"} == {10}
    assert [len(r["origins"]) for r in fx.as_dicts(timeline.nest_origins(seen)) if r["entry_id"] == "hot"] == [95]
    cold = [r for r in rows if r["entry_id"] == "cold"]
    assert [o["source_id"] for o in cold[0]["origins"]] == ["b", "a"] and len(cold) == 1
    empty = fx.as_dicts(timeline.with_origins(fx.entries(spark, dict(canonical_url="x", id="none")), seen))
    assert empty[0]["origins"] == []


def legacy(spark):
    sources = fx.sources(
        spark, dict(id="g", kind="generic", url="http://sheep.example.org/"), dict(id="r", kind="rss", url="https://scour.ing/feed"), dict(id="f", kind="zhihu_follow", url="https://www.zhihu.com/follow"), dict(id="m", kind="manual")
    )
    rows = fx.entries(
        spark,
        dict(canonical_url="http://sheep.example.org/tags/paper/1", source_id="g"),
        dict(canonical_url="http://sheep.example.org/?legacy=1", source_id="g", original_url="http://sheep.example.org/", canonical_identity="http://sheep.example.org/?p=577"),
        dict(canonical_url=f"{WRAPPED}?as=first", id="w1", source_id="r", is_read=True, is_favorite=True, summary="Short", author="A", created_at=5, observed_at=10),
        dict(canonical_url=f"{WRAPPED}?ct=second", id="w2", source_id="r", summary="A longer summary that must stay", created_at=6, observed_at=2_000_000),
        dict(canonical_url="https://www.zhihu.com/pin/1", source_id="f"),
        dict(canonical_url="https://zhuanlan.zhihu.com/p/1?spu=biz%3D0", source_id="f"),
        dict(canonical_url="https://zhuanlan.zhihu.com/p/2", source_id="f"),
        dict(canonical_url="http://m.example.org/tags/x", source_id="m"),
    )
    return schemas.state_of(spark, sources=sources, entries=rows, entry_origins=fx.own_origins(spark, rows))


def test_maintenance_runs_once(spark):
    after, report = maintenance.run_maintenance(legacy(spark), 99)
    assert report.first().asDict() == dict(
        inspected_sources=3, maintained_sources=3, skipped_sources=0, taxonomy_entries_removed=1, homepage_urls_repaired=1, wrapper_entries_merged=2, unsupported_entries_removed=1, promotions_removed=1
    )
    state = after.written("maintained", "entries", "entry_origins", "maintenance")
    got = fx.as_dicts(state.entries, "canonical_url")
    assert set(got) == {"http://sheep.example.org/?p=577", WRAPPED, "https://zhuanlan.zhihu.com/p/2", "http://m.example.org/tags/x"}
    merged = got[WRAPPED]
    assert (merged["id"], merged["is_read"], merged["is_favorite"], merged["author"], merged["summary"]) == ("w2", True, True, "A", "A longer summary that must stay")
    assert (merged["created_at"], merged["observed_at"], merged["canonical_identity"]) == (5, 2_000_000, WRAPPED)
    assert {r["entry_id"] for r in fx.as_dicts(state.entry_origins)} == {r["id"] for r in got.values()}
    again = maintenance.run_maintenance(state, 100)[1].first()
    assert (again["maintained_sources"], again["skipped_sources"], again["wrapper_entries_merged"], again["taxonomy_entries_removed"]) == (0, 3, 0, 0)


def test_wrapper_merges_into_a_direct_entry_of_another_source(spark):
    rows = fx.entries(spark, dict(canonical_url=f"{WRAPPED}?as=1", id="w", source_id="r", observed_at=9), dict(canonical_url=WRAPPED, id="d", source_id="direct", observed_at=3))
    sources = fx.sources(spark, dict(id="r", url="https://scour.ing/feed"), dict(id="direct"))
    state = schemas.state_of(spark, sources=sources, entries=rows, entry_origins=fx.own_origins(spark, rows))
    after = maintenance.merge_duplicates(state, maintenance.wrapper_repairs(rows, sources.where("id = 'r'")))
    assert [(r["id"], r["canonical_url"], r["source_id"]) for r in fx.as_dicts(after.entries)] == [("w", WRAPPED, "direct")]
    assert {(r["entry_id"], r["source_id"]) for r in fx.as_dicts(after.entry_origins)} == {("w", "r"), ("w", "direct")}


def test_homepage_targets_are_given_once(spark):
    home = "http://sheep.example.org/"
    rows = fx.entries(
        spark, *[dict(canonical_url=f"{home}?legacy={i}", id=f"h{i}", source_id="g", canonical_identity=f"{home}?p=1", created_at=i) for i in range(3)],
        dict(canonical_url=f"{home}?legacy=9", id="h9", source_id="g", canonical_identity=f"{home}?p=2"), dict(canonical_url=f"{home}?p=2", id="taken", source_id="x"),
    )
    found = maintenance.homepage_repairs(rows, fx.sources(spark, dict(id="g", kind="generic", url=home)))
    assert [(r["id"], r["target"]) for r in found.collect()] == [("h0", f"{home}?p=1")]


def test_nav_cards_go_and_shared_ones_change_owner(spark):
    home = "https://news.example.org/"
    rows = fx.entries(
        spark, dict(canonical_url=home, id="home", source_id="n", title="News"), dict(canonical_url="https://github.com/e", id="git", source_id="n", title="GitHub"),
        dict(canonical_url=f"{home}posts/real", id="real", source_id="n"), dict(canonical_url="u", original_url=home, id="described", source_id="n", summary="site text"),
    )
    sources = fx.sources(spark, dict(id="n", url=home))
    seen = fx.own_origins(spark, rows).unionByName(fx.origins(spark, dict(entry_id="home", source_id="mirror")))
    state = schemas.state_of(spark, sources=sources, entries=rows, entry_origins=seen)
    after = maintenance.prune_nav(state, sources)
    assert {(r["id"], r["source_id"]) for r in fx.as_dicts(after.entries)} == {("home", "mirror"), ("real", "n"), ("described", "n")}
    declared = sources.withColumn("remove_homepage", F.lit(True))
    assert {r["entry_id"] for r in fx.as_dicts(maintenance.nav_rows(rows, declared))} == {"home", "git", "described"}


def test_audit_samples_by_hand(spark):
    rows = fx.entries(spark, *[dict(canonical_url=f"{s}{i}", id=f"{s}{i}", source_id=s, published_at=1000 - i) for s, n in (("ab", 300), ("one", 1), ("xy", 4)) for i in range(n)])
    got = {(r["source_id"], r["sample"]): r["id"] for r in audit.audit_samples(rows).collect()}
    want = 1 + (ord("a") + ord("b")) % 299
    assert got[("ab", "newest")] == "ab0" and got[("ab", "historical")] == f"ab{want}"
    few = {(r["source_id"], r["sample"]): r["id"] for r in audit.audit_samples(rows, pool=100).collect()}
    assert few[("ab", "historical")] == f"ab{1 + (ord('a') + ord('b')) % 99}"
    assert ("one", "historical") not in got and got[("xy", "historical")] == f"xy{1 + (ord('x') + ord('y')) % 3}"
    assert audit.audit_samples(rows, all_entries=True).count() == 305


def test_ranks_within_a_hot_group(spark):
    rows = spark.range(4_000).select(F.when(F.col("id") % 8 == 0, "cold").otherwise("hot").alias("g"), F.lit(7).alias("at"), "id")
    got = ranked(rows, ["g"], [F.col("at"), F.col("id").desc()]).collect()
    for group in ("hot", "cold"):
        ids = [r["id"] for r in sorted((r for r in got if r["g"] == group), key=lambda r: r["rank"])]
        assert ids == sorted(ids, reverse=True) and sorted(r["rank"] for r in got if r["g"] == group) == list(range(1, len(ids) + 1))


def test_large_pools_keep_the_right_rows(spark):
    rows = spark.range(5_000).select((F.col("id") % 2).alias("g"), "id")
    top = audit.top_per_group(rows, ["g"], [F.col("id").desc()], 1_200)
    assert top.count() == 2_400 and top.agg(F.min("id")).first()[0] == 5_000 - 2_400


def test_article_issues(spark):
    body = "<p>" + "long enough text " * 20 + "</p>"
    columns = "source_id string, kind string, entry_id string, entry_title string, summary string, content_html string, content_mode string, render_profile string"
    rows = [
        ("s", "rss", "ok", "T", None, body, "article", "standard"),
        ("s", "rss", "short", "T", None, "<p>short</p>", "article", "standard"),
        ("s", "academic", "lenient", "T", None, "<p>short</p>", "article", "standard"),
        ("s", "rss", "feed", "T", None, "<p>short</p>", "feed_body", "standard"),
        ("s", "rss", "script", "T", None, body + '<a href=" javascript:x()">a</a>', "article", "standard"),
        ("s", "rss", "tex", "T", None, body + r"<p>\frac{1}{2} and $x_i$</p><pre>\ignored $y_i$</pre>", "article", "standard"),
        ("s", "rss", "sci", "Title here", "A lead that is not in the text at all", "<p>Title here</p>" + body, "article", "scientific"),
    ]
    judged = audit.audit_articles(spark.createDataFrame(rows, columns))
    got = {r["entry_id"]: r["issues"] for r in judged.collect()}
    assert got == {
        "ok": [], "short": [audit.ISSUE_SHORT], "lenient": [], "feed": [], "script": [audit.ISSUE_EXECUTABLE],
        "tex": [audit.ISSUE_RAW_TEX, audit.ISSUE_INLINE_TEX], "sci": [audit.ISSUE_CHROME, audit.ISSUE_LEAD],
    }
    samples = spark.createDataFrame([("s", "ok", "newest"), ("s", "gone", "historical"), ("s", "barred", "historical")], "source_id string, id string, sample string")
    report = audit.audit_report(fx.sources(spark, dict(id="s"), dict(id="empty")), samples, judged, spark.createDataFrame([("barred",)], "entry_id string"))
    assert {(r["source_id"], r["entry_id"]): r["status"] for r in report.collect()} == {("s", "ok"): "passed", ("s", "gone"): "failed", ("s", "barred"): "skipped", ("empty", None): "skipped"}


def test_folders(spark):
    rows = fx.sources(
        spark, dict(id="1", title="Zeta", kind="generic"), dict(id="2", title="知乎", kind="zhihu_follow"), dict(id="3", title="小红书博主", kind="xiaohongshu"), dict(id="4", title="论文", kind="academic"),
        dict(id="5", title="Alpha", category=" 机器学习 "), dict(id="6", title="b", category="Lab", created_at=1), dict(id="7", title="a", category="LAB", created_at=2), dict(id="8", title="Bridge", config_json='{"sourceProvider":"rsshub"}'),
    )
    got = [(r["folder_title"], r["source_title"]) for r in folders.folder_groups(rows).collect()]
    default = [g for g in got if g[0] in ("网页与订阅", "平台动态", "学术追踪")]
    assert default == [("网页与订阅", "Zeta"), ("平台动态", "小红书博主"), ("平台动态", "知乎"), ("平台动态", "Bridge"), ("学术追踪", "论文")]
    assert got[len(default):].count(("Lab", "a")) == 1 and ("机器学习", "Alpha") in got
    sizes = {r["folder_title"]: r["sources"] for r in folders.folder_sizes(folders.folder_groups(rows)).collect()}
    assert sizes["Lab"] == 2 and sizes["平台动态"] == 3
