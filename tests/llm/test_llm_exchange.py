"""Operators on packed exchanges, against plain versions: copies, near copies, repeats, language model."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from llm_support import awkward, covered_twice, frame, jaccard_components, prose, repeats_removed, rows_of, shingle_set, words

from contentflow.llm import components, exchange, hashing, jaccard, language_model, substrings, suffixes
from contentflow.session import shared_dir


# --- hashing ----------------------------------------------------------------------


@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0cé\x85\xa0", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_are_the_same_as_by_pattern(texts):
    hashes, first = hashing.word_hashes([t.encode() for t in texts])
    assert list(np.diff(first)) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(flat)) == len(set(hashes.tolist()))
    assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = (prose(1, 300) + " " + "y" * 500 + "  ").encode()
    whole = hashing.word_hashes([text, b"a", text])
    monkeypatch.setattr(hashing, "PIECE", 64)
    cut = hashing.word_hashes([text, b"a", text])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True))
@settings(max_examples=100, deadline=None)
def test_packing(values):
    array = np.array(sorted(values), np.uint64)
    assert (hashing.unpacked(hashing.packed(array)) == array).all()
    small = (array >> np.uint64(40)).astype(np.int64)
    assert (language_model.unplaned(language_model.planes(small)) == small).all()


# --- components -------------------------------------------------------------------


def test_components_of_paths_stars_and_rings(spark):
    pick = random.Random(3)
    ids = pick.sample(range(100000), 400)
    edges = [*zip(ids[:100], ids[1:101], strict=False)] + [(ids[150], x) for x in ids[151:250]] + [(ids[300 + i], ids[300 + (i + 1) % 50]) for i in range(50)] + [(7, 7)]
    pick.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for group in (ids[:101], ids[150:250], ids[300:350]):
        want |= {x: min(group) for x in group if x != min(group)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- Jaccard join -------------------------------------------------------------------


def _near_copies(seed, n, size):
    """Copies of one text with some words changed, about as many as the limit allows, and others like nothing."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        if i % 7 == 0:
            base = prose(pick.random(), pick.randrange(1, size), 5000).split()
        w = list(base)
        for _ in range(pick.randrange(0, 1 + max(1, len(w) // 20))):
            w[pick.randrange(len(w))] = f"z{pick.randrange(10**6)}"
        if pick.random() < 0.3:
            w = w[: max(1, int(len(w) * pick.uniform(0.75, 1)))]
        out.append(" ".join(w))
    return out


def _check_join(spark, rows):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(frame(spark, rows)).collect())
    roots = jaccard_components(rows)
    assert got == Counter((r[0], len(shingle_set(r[1])), roots[i]) for i, r in enumerate(rows))


def test_join_awkward_rows(spark):
    _check_join(spark, awkward(spark)[1])


@pytest.mark.parametrize("size", [12, 60, 400])
def test_join_near_the_limit(spark, size):
    _check_join(spark, rows_of(_near_copies(size, 120, size)))


def test_join_of_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 10)
    monkeypatch.setattr(jaccard, "MANY", 4)
    base = prose(5, 150, 5000).split()
    texts = [" ".join(base[:i] + [f"q{i}"] + base[i + 1 :]) for i in range(60)] + _near_copies(8, 60, 90)
    # A passage in every text makes cells that many share without linking them.
    texts += [prose(1000 + i, 60, 5000) + " " + prose(77, 25) for i in range(60)]
    _check_join(spark, rows_of(texts))


def _size(folder):
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*.parquet"))


def test_join_of_copies_writes_no_more_for_each(spark):
    folder, texts, sizes = shared_dir(spark), [prose(400 + i, 600, 9000) for i in range(40)], []
    for copies in (1, 8):
        before = _size(folder)
        _check_join(spark, rows_of(texts * copies))
        sizes.append(_size(folder) - before)
    # A copy adds a few numbers, not its shingles: seven of them less than their text once.
    assert sizes[1] - sizes[0] < sum(map(len, texts))


def test_join_over_texts_without_an_id(spark):
    rows = []
    for i in range(12):
        base = prose(700 + i, 150, 9000).split()
        rows += rows_of([" ".join(base), " ".join([*base[:-1], "x"])], 2 * i)
        # Its nearest copy has no id, and may not come between the two that have.
        rows += [(None, *rows_of([" ".join([*base[:-1], "y"])])[0][1:])] * 2
    _check_join(spark, rows)


def test_pairs_within_the_bound_share_a_cell():
    pick = random.Random(9)
    for _ in range(400):
        n = pick.randrange(4, 300)
        a = {pick.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(pick.randrange(0, n // 4 + 2)):
            pick.random() < 0.6 and b and b.remove(pick.choice(sorted(b)))
            pick.random() < 0.5 and b.add(pick.getrandbits(64))
        if not b or a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        key, who, *_ = jaccard.cells(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
        assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


def test_tree_bound_loses_nothing():
    pick = random.Random(11)
    base = [{pick.getrandbits(64) for _ in range(pick.randrange(5, 80))} for _ in range(60)]
    sets = []
    for s in base:
        for _ in range(5):
            t = set(s)
            for x in pick.sample(sorted(t), pick.randrange(0, 1 + len(t) // 10)):
                t.remove(x)
                pick.random() < 0.5 and t.add(pick.getrandbits(64))
            sets.append(np.array(sorted(t), np.uint64))
    sets.sort(key=len)
    points = jaccard.Points(sets)
    assert points.levels
    for i, a in enumerate(sets):
        near = set(points.near(i).tolist())
        assert near >= {j for j in range(i + 1, len(sets)) if jaccard.linked(a, sets[j])}


# --- substrings -----------------------------------------------------------------------


def test_substrings_awkward_rows(spark):
    docs, rows = awkward(spark)
    kept = repeats_removed(rows)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.removals(docs).collect())
    want = Counter()
    # Rows without an id are ordered among each other by bucket: here only one of them has words.
    for i, r in enumerate(rows):
        n = len(words(r[1]))
        want[r[0], n, n - len(kept[i]), " ".join(kept[i])] += 1
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_stitched_texts(spark, seed):
    pick = random.Random(seed)
    parts = [prose(1000 + i, pick.choice([9, 10, 11, 19, 20, 21, 35]), 50) for i in range(12)]
    rows = rows_of([" ".join(pick.choice(parts) for _ in range(pick.randrange(1, 8))) for _ in range(80)])
    kept = repeats_removed(rows)
    for r in substrings.removals(frame(spark, rows)).collect():
        assert r["kept"].split() == kept[r["doc_id"]]
        gone = {j for s in r["removed"] for j in range(s["start"], s["end"])}
        assert [w for j, w in enumerate(words(rows[r["doc_id"]][1])) if j not in gone] == kept[r["doc_id"]]


def test_substrings_empty(spark):
    assert substrings.removals(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.removals(frame(spark, []), window=10)


# --- suffix array -----------------------------------------------------------------------


def _covered(rows):
    out = {}
    for r in rows:
        assert r["end_word"] - r["start_word"] == r["n_words"] >= 50
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_suffixes_awkward_rows(spark):
    docs, rows = awkward(spark)
    want = {}
    for i, places in covered_twice(rows).items():
        want.setdefault(rows[i][0], set()).update(places)
    assert _covered(suffixes.passages(docs).collect()) == want


@pytest.mark.parametrize("group", [1024, 8])
def test_suffixes_of_planted_passages(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    pick = random.Random(6)
    planted = [prose(2000 + i, pick.choice([49, 50, 51, 70, 200]), 5000) for i in range(10)]
    texts = []
    for i in range(150):
        body = prose(3000 + i, pick.randrange(0, 120), 5000)
        # One passage is in most texts, so in small groups its suffixes are dealt out.
        texts.append(f"{body} {planted[3 if i % 3 else pick.randrange(10)]} {prose(4000 + i, pick.randrange(0, 60), 5000)}")
    rows = rows_of(texts)
    want = {rows[i][0]: places for i, places in covered_twice(rows).items()}
    rows = suffixes.passages(frame(spark, rows)).collect()
    got = _covered(rows)
    assert all(r["match_doc_id"] is not None for r in rows)
    if group == 1024:
        assert got == want
    else:
        # Dealt out, a passage is found in all its documents; a word beside it that two of them share may not be.
        assert got.keys() == want.keys() and all(got[k] <= want[k] and len(want[k] - got[k]) <= 2 for k in want)


def test_suffixes_of_a_hot_head(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", 8)
    notice, passage = prose(71, 34, 5000), prose(72, 60, 5000)
    # A notice in all texts, with endings that two or three of them share; a text that stammers and one that quotes it once.
    endings = [prose(7300 + i // 2, 22, 5000) for i in range(60)]
    texts = [f"{prose(7400 + i, 20, 5000)} {notice} {e} {prose(7500 + i, 20, 5000)}" for i, e in enumerate(endings)]
    texts += [" ".join(f"{passage} {prose(7600 + i, 3, 5000)}" for i in range(100))]
    texts += [f"{prose(7700 + i, 30, 5000)} {passage} {prose(7800 + i, 30, 5000)}" for i in range(6)]
    rows = rows_of(texts)
    want = {rows[i][0]: places for i, places in covered_twice(rows).items()}
    got = suffixes.passages(frame(spark, rows)).collect()
    assert len(want) == len(texts) and _covered(got) == want
    # Only the stammering text may name itself, for a word beside the passage.
    assert all(r["match_doc_id"] != r["doc_id"] for r in got if r["doc_id"] != 60)


def test_suffixes_of_one_template(spark):
    # Variants share different parts around the same suffixes, so that others lie between two in any one order.
    texts = []
    for t in range(12):
        template = prose(8100 + t, 110, 5000).split()
        pick = random.Random(8200 + t)
        for v in range(60):
            a = pick.randrange(0, 62)
            b = min(110, a + pick.randrange(36, 58))
            texts.append(" ".join([prose(10000 + 100 * t + v, 9, 5000), *template[a:b], prose(20000 + 100 * t + v, 9, 5000)]))
    rows = rows_of(texts)
    want = {rows[i][0]: places for i, places in covered_twice(rows).items()}
    assert _covered(suffixes.passages(frame(spark, rows)).collect()) == want


def test_suffixes_empty(spark):
    assert suffixes.passages(frame(spark, [])).count() == 0


# --- language model ---------------------------------------------------------------------


def _plain_scores(rows, alpha=0.4, order=3):
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in (words(r[1]) for r in rows)]
    total = sum(own, Counter())
    whole = sum(len(words(r[1])) for r in rows)
    out = []
    for r, mine in zip(rows, own, strict=True):
        w, logs = words(r[1]), []
        for i in range(len(w)):
            log, n = 0.0, min(order, i + 1)
            while n > 1:
                gram = tuple(w[i - n + 1 : i + 1])
                if total[gram] > mine[gram]:
                    log += math.log((total[gram] - mine[gram]) / (total[gram[:-1]] - mine[gram[:-1]]))
                    break
                log, n = log + math.log(alpha), n - 1
            else:
                log += math.log(max(total[(w[i],)] - mine[(w[i],)], 1) / max(whole - len(w), 1))
            logs.append(log)
        out.append((r[0], len(w), sum(logs) / len(w) if w else None))
    return out


def test_language_model_awkward_rows(spark):
    docs, rows = awkward(spark)

    got = sorted((str(r["doc_id"]), r["n_words"], r["lm_score"] or 0.0) for r in language_model.scored(docs).collect())
    want = sorted((str(a), b, c or 0.0) for a, b, c in _plain_scores(rows))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_language_model_orders(spark, order):
    rows = rows_of([prose(i, 30, 8) for i in range(12)] + ["w1 w2 w3 w4 w5", "w1 w2 w3 w4 w6"])
    got = {r["doc_id"]: r["lm_score"] for r in language_model.scored(frame(spark, rows), order=order).collect()}
    for doc, _, want in _plain_scores(rows, order=order):
        assert got[doc] == pytest.approx(want, abs=2e-6)


def test_even_labels_fill_every_partition_alike(spark):
    labels = exchange.even_labels(spark, 3)
    count = exchange.partitions(spark)
    rows = spark.createDataFrame([(x,) for x in labels], "bucket int").repartition(count, "bucket").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == count and {r["count"] for r in rows} == {3}


def test_language_model_alone_and_empty(spark):
    assert language_model.scored(frame(spark, [])).count() == 0
    only = rows_of(["a b a"])
    got = language_model.scored(frame(spark, only)).first()
    assert got["lm_score"] == pytest.approx(_plain_scores(only)[0][2], abs=1e-5)
