"""The pipeline, stage by stage against plain versions, and the queries against their SQL."""

import os
import sys

import duckdb
import pytest
from llm_support import jaccard_components, words
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import corpus_pipeline  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from contentflow.llm import classifier, mixing, pii  # noqa: E402
from contentflow.llm.oracles import ORACLES  # noqa: E402
from contentflow.llm.queries import QUERIES  # noqa: E402
from contentflow.llm.tables import table, written  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SMALL, "documents")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test")
        made.append(docs)
    return [{r["doc_id"]: r.asDict() for r in d.collect()} for d in made]


def test_each_stage_keeps_columns_and_ids(stages):
    for before, after in zip(stages, stages[1:], strict=False):
        assert set(after) <= set(before) and after
    assert all(list(next(iter(s.values()))) == DOCUMENTS for s in stages[:-1])


def test_quality_stage(spark, stages):
    net = classifier.fitted(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    texts = list(stages[0])
    score = classifier.scores(net, [(stages[0][i]["text"] or "").encode() for i in texts])
    assert set(stages[1]) == {i for i, s in zip(texts, score, strict=True) if s >= classifier.THRESHOLD}


def test_near_copies_stage(stages):
    rows = [(i, r["text"]) for i, r in stages[1].items()]
    roots = jaccard_components(rows)
    assert set(stages[2]) == {i for n, (i, _) in enumerate(rows) if roots[n] == i}


def test_benchmark_stage(stages):
    items = [t.lower() for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall() if len(t) >= 24]
    gone = set(stages[2]) - set(stages[3])
    exact = {i for i, r in stages[2].items() if any(t in r["text"].lower() for t in items)}
    assert exact <= gone
    # Nothing goes that shares no thirty characters in a row with an item.
    pieces = {t[a : a + 30] for t in items for a in range(len(t) - 29)}
    assert all(any(stages[2][i]["text"].lower()[a : a + 30] in pieces for a in range(len(stages[2][i]["text"]))) for i in gone)


def test_personal_data_stage(stages):
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[4].items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        if not pii.base_spans(stages[3][i]["text"]):
            assert r["text"] == stages[3][i]["text"]


def test_mixing_stage(spark, stages):
    rows = spark.createDataFrame([tuple(r.values()) for r in stages[4].values()], table(spark, SMALL, "documents").schema)
    chance = {r["doc_id"]: r for r in mixing.probabilities(rows, keep=corpus_pipeline.MIX_KEEP).collect()}
    assert set(stages[5]) == {i for i, r in chance.items() if r["sampled"]}
    assert all(r["mix_probability"] == pytest.approx(chance[i]["probability"]) for i, r in stages[5].items())
    assert sum(len(words(r["text"])) for r in stages[5].values()) > 0.5 * sum(len(words(r["text"])) for r in stages[4].values())


def test_run_is_all_stages(spark, stages):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == set(stages[5])


def test_stages_on_empty_and_wider_tables(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    wide = docs.limit(40).withColumns({"score": F.lit("x"), "_tokens_": F.lit(1), "component_id": F.lit(2), "n": F.lit(3)})
    nulls = wide.withColumns({c: F.when(F.col("doc_id") % 3 == 0, F.col(c)) for c in ("text", "lang", "source", "n_chars")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nulls, SMALL).columns == nulls.columns
    assert corpus_pipeline.STAGES[-1][1](spark, nulls, SMALL).columns[: len(nulls.columns)] == nulls.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(spark, duck(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None
