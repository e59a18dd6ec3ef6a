"""Hard negatives, spelling variants and language identification against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from llm_support import awkward, frame, rows_of
from pyspark.sql import functions as F

from contentflow.llm import hard_negatives, language_id, spelling
from contentflow.llm.tables import table

# --- hard negatives -------------------------------------------------------------


def _plain_mined(rows, is_anchor):
    """Rows (id, label, vector) as they come; every row is one of its own."""
    used = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x) > 1 << 17 for x in vector):
            continue
        used.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, (anchor, label, a) in enumerate(used):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, q)), vec_id, k) for k, (vec_id, _, q) in enumerate(used) if k != i)
        for minus, positive, _ in [s for s in scored if used[s[2]][1] == label][:5]:
            fits = [s for s in scored if used[s[2]][1] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:5]
            out += [(anchor, positive, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def _vectors(spark, rows):
    data = [(*r, "id", 1, "w") for r in rows]
    return spark.createDataFrame(data, "vec_id bigint, label int, embedding array<float>, id string, row int, windows string").select("windows", "id", "vec_id", "embedding", "label", "row")


def test_mined_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 17)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    pick = random.Random(4)
    few = [0.0, 0.25, 0.5, -0.25, 1.0]
    rows = [(i, pick.randrange(3), [pick.choice(few) for _ in range(20)]) for i in range(90)]
    rows += [(200 + i, pick.randrange(3), [float(np.float32(pick.gauss(0.1, 0.3))) for _ in range(20)]) for i in range(60)]
    hot = [0.5, 0.25] * 10
    rows += [(300 + i, i % 3, hot) for i in range(40)]
    # Repeated rows, one id twice, other lengths, extreme ids and everything that takes no part.
    rows += [rows[0], rows[100], (10, 1, hot), (400, 0, []), (410, 1, [0.5] * 23), (420, 1, [0.5]), (9007199254740993, 0, hot), (-10, 1, hot)]
    rows += [(None, 1, hot), (430, None, hot), (440, 1, None), (450, 1, [None] + hot[1:]), (460, 1, [math.nan] + hot[1:]), (470, 2, [math.inf] + hot[1:]), (480, 2, [1e9] + hot[1:])]
    got = hard_negatives.mined(_vectors(spark, rows), F.col("id") % 10 == 0).collect()
    want = _plain_mined(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got) == want and len(want) > 100


def test_mined_of_little(spark):
    schema = hard_negatives.mined(_vectors(spark, []), F.col("id") % 100 == 0)
    assert schema.count() == 0
    one = _vectors(spark, [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [1.0])])
    # The only positive scores below zero, where no window is open.
    assert hard_negatives.mined(one, F.col("id") % 100 == 0).count() == 0


def test_scan_strikes_rows_and_keeps_the_right_ones():
    pick = np.random.default_rng(2)
    values = pick.integers(-200, 200, (48, 300)).astype(np.int32)
    packed = pd.Series({"n": 300, "rows": np.arange(300).tobytes(), "ids": np.arange(300).tobytes(), "labels": np.zeros(300, np.int64).tobytes(),
                        "values": values.tobytes(), "windows": np.full((300, 5), -1).tobytes()})
    block = hard_negatives.Block(packed)
    anchor = np.array([900, 500, 300] + [1] * 45)
    exact = anchor @ values.astype(np.int64)
    looked = []

    def possible(low, high):
        looked.append(len(low))
        return hard_negatives.among_first(low, high, 5)

    found, scores = hard_negatives.scanned(anchor, block, np.arange(300), possible)
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(found) and (exact[found] == scores).all()
    # The first columns decide: few rows are left for the others.
    assert looked[0] == 300 and looked[1] < 60


# --- spelling -------------------------------------------------------------------


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_variants(rows):
    import re

    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def _typed(seed, n):
    """Texts of a small vocabulary with many misspellings."""
    pick = random.Random(seed)
    words = ["receive", "colour", "écoleß", "straße", "Address", "addresses", "banana", "maintenance"]
    out = []
    for _ in range(n):
        w = pick.choice(words[: 1 + pick.randrange(len(words))])
        if pick.random() < 0.5:
            i, c = pick.randrange(len(w)), pick.choice("aexé")
            w = pick.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        out.append(w)
    return "-".join(out)


@pytest.mark.parametrize("symbols", [None, 4, 16])
def test_variants_equal_brute_force(spark, symbols):
    docs, rows = awkward(spark)
    more = [(1000 + i, _typed(i, 400)) for i in range(30)] + [(None, _typed(50, 100)), (5, None), (2**60 + 1, "word" * 2000)]
    more += [(2000, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["baabbb"] * 48 + ["abbbb"] * 24))] * 2
    docs = docs.unionAll(frame(spark, [(i, t, None, None, None, None, None, None, None, None) for i, t in more]))
    got = spelling.variants(docs, symbols=symbols).collect()
    want = _plain_variants([(r[0], r[1]) for r in rows] + more)
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in got) == want
    # Some chain of forms is longer than one step.
    assert any(r["form"] and r["root"] != r["form"] for r in got)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, rows_of([None, "", "tiny one two"]))).count() == 0


def test_neighbourhood_is_full(spark):
    words = ["abca", "a", "", "aabb"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.neighbourhood(F.col("w"), 4).alias("near"))
    for w, near in got.collect():
        full = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + s + w[i + 1 :] for i in range(len(w)) for s in "abcd"}
        full |= {w[:i] + s + w[i:] for i in range(len(w) + 1) for s in "abcd"}
        hashes = spark.createDataFrame([(x,) for x in full], "x string").select(F.xxhash64("x")).collect()
        assert sorted(near) == sorted(r[0] for r in hashes)


# --- languages ------------------------------------------------------------------

ENGLISH = "the quick brown fox thinks that nothing should ever be wasted on such weather with others there"
GERMAN = "der schnelle braune Fuchs denkt dass nichts verschwendet werden sollte und auch nicht zwischen großen Häusern"
RUSSIAN = "быстрая лиса думает о погоде"


def _taught(spark):
    pick = random.Random(1)
    rows = []
    for i in range(60):
        lang, base = [("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN)][i % 3]
        words = base.split()
        rows.append((i, " ".join(pick.choice(words) for _ in range(40)), lang, "s", 0, "", "", "", "", ""))
    return rows


def test_viterbi_is_the_best_sequence():
    pick = np.random.default_rng(1)
    for n in range(1, 8):
        for _ in range(80):
            scores, switch = pick.normal(0, 2, (n, 3)), float(pick.uniform(0.2, 5))
            scores[:, 1] += pick.choice([0, 1, 2])
            value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
            best = max(map(value, itertools.product(range(3), repeat=n)))
            assert value(language_id.viterbi(scores, switch)) == pytest.approx(best)
            assert value(language_id.best_labels(scores, switch)) == pytest.approx(best)


def test_long_texts_are_labelled_in_stretches():
    pick = np.random.default_rng(2)
    for _ in range(20):
        scores = pick.normal(0, 1, (2000, 4))
        scores[:, 2] += 2.5
        for _ in range(6):
            at = pick.integers(0, 1980)
            scores[at : at + pick.integers(1, 20), pick.integers(4)] += 4
        assert (language_id.best_labels(scores, 6.0) == language_id.viterbi(scores, 6.0)).all()


def test_word_scores_by_hand(spark):
    model = language_id.fitted(frame(spark, _taught(spark)))
    texts = ["", "Nothing, und ́ nicht4me", None or "\U0001f600", RUSSIAN]
    words = language_id.words_of(texts)
    cut = [texts[t][a:b] for t, a, b in zip(words.text, words.start, words.end, strict=True)]
    assert cut == ["Nothing", "und", "nicht", "me", *RUSSIAN.split()]
    got = language_id.word_scores(model, words)
    plain = np.zeros_like(got)
    for i, w in enumerate(cut):
        codes = [0, 0, *[ord(c.lower()) + 1 for c in w], 0]
        for j in range(2, len(codes)):
            pair = codes[j] * 0x9E3779B1 + codes[j - 1] * 0x85EBCA77
            for x in (pair, pair + (codes[j - 2] if j > 2 else 0) * 0xC2B2AE3D + 1):
                plain[i] += model.weights[(x * 0x9E3779B97F4A7C15 % 2**64) >> 49] / 2
        scripts = {"ru": i > 3, "en": i <= 3, "de": i <= 3}
        plain[i] += [0 if scripts[lang] else language_id.CLOSED for lang in model.languages]
    assert np.allclose(got, plain, rtol=1e-5)


def test_spans_of_mixed_texts(spark):
    model = language_id.fitted(frame(spark, _taught(spark)))
    text = f"{ENGLISH}. {GERMAN}! {RUSSIAN}"
    [found] = language_id.found_in(model, [text])
    assert [lang for *_, lang in found.spans] == ["en", "de", "ru"] and found.language == "de"
    assert text[found.spans[0][0] : found.spans[0][1]].split()[:3] == ["the", "quick", "brown"] and 0 < found.score < 0.7
    # One foreign word does not pay for two changes; a script that only one language uses does.
    [found] = language_id.found_in(model, [f"{ENGLISH} und {ENGLISH}"])
    assert len(found.spans) == 1 and found.score > 0.99
    [found] = language_id.found_in(model, [f"{ENGLISH} лиса {ENGLISH}"])
    assert [lang for *_, lang in found.spans] == ["en", "ru", "en"]
    # A script that was never seen narrows nothing.
    [found] = language_id.found_in(model, ["αβγ"])
    assert found.language in model.languages and found.score > 0


def test_pieces_do_not_change_scores(spark, monkeypatch):
    model = language_id.fitted(frame(spark, _taught(spark)))
    texts = [f"{ENGLISH} {GERMAN} " * 40, "x" * 30000, RUSSIAN * 300, "a"]
    whole = list(language_id.found_in(model, texts))
    monkeypatch.setattr(language_id, "PIECE", 1 << 10)
    assert list(language_id.in_groups(model, texts)) == whole


def test_languages_of_awkward_tables(spark):
    big = 9007199254740993
    rows = _taught(spark) + rows_of([None, "", "12 !?", "́", "x" * 200000], start=500)
    rows += [(big, ENGLISH, None, "s", 0, "k", "n", "c", "p", "st"), (None, GERMAN, "de", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)] * 2
    docs = frame(spark, rows)
    got = language_id.predicted(docs).collect()
    assert len(got) == len(rows) and {type(r["doc_id"]) for r in got} == {int, type(None)}
    found = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (500, 501, 502, 503)) and found[504]["lang_pred"] != "und"
    assert found[big]["lang_pred"] == "en" and found[big]["held_out"] == (zlib.crc32(str(big).encode()) % 5 == 0)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["de", "de", "und", "und"]
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    named = docs.withColumnsRenamed({"kept": "found", "start": "language"})
    kept = language_id.labelled(named, language_id.fitted(docs), into="spans_of")
    assert kept.columns == [*named.columns, "spans_of"] and kept.drop("spans_of").exceptAll(named).count() == 0
    assert language_id.fitted(frame(spark, [])) is None and language_id.predicted(frame(spark, [])).count() == 0
    unknown = language_id.predicted(frame(spark, rows_of(["some text"])).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in unknown] == [("und", 0.0)]


def test_sample_is_bounded(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", 0, "", "", "", "", "") for i in range(3000)]
    got = [tuple(r) for r in language_id.learned_rows(frame(spark, rows + rows[:500]), per_language=40).collect()]
    ids = {int(t[1:]) for _, t in got}
    assert {lang: len({t for k, t in got if k == lang}) for lang in ("de", "en")} == {"de": 40, "en": 40}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
