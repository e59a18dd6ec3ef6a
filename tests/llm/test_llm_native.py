"""Chat formatting, quality rules and mixing."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from llm_support import SCHEMA, awkward, frame, prose, repeat_words, words
from pyspark.sql import functions as F

from contentflow.llm import chat, mixing, quality_rules


def _no_python(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return not any(name in plan for name in ("Python", "Pandas", "Arrow"))


# --- chat ---------------------------------------------------------------------

TALK = [
    (1, 1, "assistant", "b </s> <|turn|>user\nx<|end|>\n", "z"),
    (1, 0, "user", "a &amp; &lt; [INST]\n\n", "z"),
    (2, None, "system", None, "z"),
    (2, 0, None, "two\nlines", "z"),
    (2, 0, "assistant", "tie", "z"),
    (2, 0, "assistant", "tie", "z"),
    (None, 0, "assistant", "", "z"),
    (3, 0, "odd\nrole<|", "é \U0001f600 [x]", "z"),
    (3, 5, "assistant", "long " * 40000, "z"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TALK, "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.formatted(chat.canonical_turns(rows.drop("formatted")))
    assert _no_python(made)
    got = {r["conv_id"]: r for r in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in TALK if r[0] == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [r[2:] for r in own]
        assert got[conv]["loss"] == [r[3] for r in own if r[2] == "assistant"]
    # No control string of a text survives as one.
    assert got[1]["formatted"].count(chat.OPEN) == 2 and "[INST]" not in got[1]["formatted"] and "</s>" not in got[1]["formatted"]


def test_chat_empty_and_unknown(spark):
    rows = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted(chat.canonical_turns(rows)).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, body string"))


RECORDS = [
    (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]}, [("user", "hi"), ("assistant", "")]),
    (3, {"prompt": "p", "response": "r", "source": "ignored"}, [("user", "p"), ("assistant", "r")]),
    (4, {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (5, {"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    (6, {"system": "s", "instruction": "i", "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
    (7, {"prompt": [{"role": "user", "content": "hi"}]}, [("user", "hi")]),
    (8, {"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    (9, {"body": "unknown"}, None),
    (10, None, None),
]


def test_chat_layouts_of_json_records(spark):
    rows = spark.createDataFrame([(i, json.dumps(r) if r else None) for i, r, _ in RECORDS] + [(11, "not json")], "conv_id bigint, record string")
    turns = chat.canonical_json(rows, "record")
    assert _no_python(turns)
    got = defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {i: want for i, _, want in RECORDS if want}
    assert sorted(r["conv_id"] for r in chat.unrecognised(rows, "record").collect()) == [9, 10, 11]


def test_chat_layouts_of_frames(spark):
    for i, record, want in RECORDS:
        if want:
            rows = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": i, **record})]))
            assert [(r["role"], r["text"]) for r in chat.canonical_turns(rows).orderBy("turn").collect()] == want


def test_chat_fingerprint_is_of_sorted_paths():
    assert chat.fingerprint(["b", "a"]) == hashlib.sha256(b"a\nb").hexdigest()


# --- quality rules --------------------------------------------------------------


def test_rules_against_plain_counts(spark):
    docs, rows = awkward(spark)
    made = quality_rules.host_verdicts(docs)
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in made.collect())))
    want = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if words(x)]
        n = repeat_words(t)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)))
    assert got == sorted(map(str, want))
    assert _no_python(quality_rules.measured(docs)) and _no_python(made)


def test_host_verdicts_shrink(spark):
    good, bad = prose(3, 80), "short"
    rows = [(i, bad if i % 10 else good, "en", "bad.example", 0) for i in range(200)]
    rows += [(1000 + i, good, "en", f"h{i % 20}.example", 0) for i in range(400)]
    # One failing document of one is not evidence enough against its host's prior; nor has a null host a verdict.
    rows += [(5000, bad, "en", "single.example", 0), (5001, good, "en", None, 0), (5002, good, "en", "single.example", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in quality_rules.host_verdicts(docs).collect()}
    assert got[0]["host_failed"] and not got[0]["base_failed"] and not got[0]["kept"]
    assert got[1000]["kept"] and got[5001]["kept"] and got[5002]["kept"] and not got[5000]["kept"]


def test_rules_on_an_empty_table(spark):
    assert quality_rules.host_verdicts(frame(spark, [])).count() == 0


# --- mixing -----------------------------------------------------------------------


def _plain_rake(cells, targets, rounds=300):
    w = dict.fromkeys(cells, 1.0)
    whole = sum(cells.values())
    for _ in range(rounds):
        for axis, want in enumerate(targets):
            held = defaultdict(float)
            for k, n in cells.items():
                held[k[axis]] += n * w[k]
            for k in cells:
                w[k] *= whole * want[k[axis]] / held[k[axis]]
    return w


def _mix_rows(n=600):
    hosts = ["hot"] * 4 + ["a", "b", None, "c"]
    langs = ["en"] * 4 + ["de", None]
    extra = [" license", " | x", " 2024 ", "", "", ""]
    pick = random.Random(4)
    return [(i, prose(i, 5 + i % 40) + pick.choice(extra), pick.choice(langs), pick.choice(hosts), 0) for i in range(n)]


def test_raking_against_a_plain_one(spark):
    docs = spark.createDataFrame(_mix_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made = mixing.probabilities(docs)
    assert _no_python(made)
    got = made.collect()
    cells = defaultdict(float)
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    targets = []
    for axis, name in enumerate(("source", "lang", "topic")):
        sums = defaultdict(float)
        for k, n in cells.items():
            sums[k[axis]] += n
        raised = {k: v ** mixing.TEMPER[name] for k, v in sums.items()}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    want = _plain_rake(cells, targets)
    for r in got:
        assert r["weight"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], rel=1e-3)
    whole = sum(cells.values())
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(mixing.KEEP * whole, rel=1e-4)
    kept = sum(r["n_tokens"] for r in got if r["sampled"])
    assert kept == pytest.approx(mixing.KEEP * whole, rel=0.15)
    # The same documents again, in other partitions.
    again = {r["doc_id"]: r["sampled"] for r in mixing.probabilities(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["sampled"] for r in got}


def test_mixing_awkward_rows(spark):
    docs, rows = awkward(spark)
    made = mixing.sampled(docs)
    assert made.columns == docs.columns + ["mix_weight", "mix_probability"]
    ids = [r["doc_id"] for r in made.collect()]
    assert set(ids) <= {r[0] for r in rows}
    assert ids.count(9) in (0, 2)
    clash = mixing.sampled(docs.withColumn("mix_weight", F.lit("x")))
    assert clash.columns == docs.columns + ["mix_weight", "mix_probability"]
    assert mixing.sampled(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.probabilities(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing_given_targets(spark):
    docs = spark.createDataFrame(_mix_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shares = spark.createDataFrame([("hot", 0.25), ("a", 0.25), ("b", 0.25), ("c", 0.25)], "source string, share double")
    got = mixing.probabilities(docs, targets={"source": shares, "lang": {"en": 0.5, "de": 0.5}}).collect()
    held = defaultdict(float)
    for r in got:
        held[r["source"]] += r["n_tokens"] * r["weight"]
        held[r["lang"], "lang"] += r["n_tokens"] * r["weight"]
    whole = sum(r["n_tokens"] for r in got)
    assert held["hot"] / whole == pytest.approx(0.25, abs=1e-3) and held[None] == 0
    assert held["en", "lang"] / whole == pytest.approx(0.5, abs=1e-3) and held[None, "lang"] == 0
