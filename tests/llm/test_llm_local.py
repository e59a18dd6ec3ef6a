"""Classifier, decontamination and personal data: plain versions, round trips and held-out accuracy."""

import random
import re
import tracemalloc
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import awkward, frame, prose, rows_of

from contentflow.llm import classifier, decontaminate, jaccard, mixing, pii
from contentflow.llm.tables import table

SMALL = "/root/testdata/sf0.01"

# --- classifier -------------------------------------------------------------------


def test_scores_do_not_depend_on_grouping(monkeypatch):
    net = classifier.fresh(5)
    texts = [b"", b"a", b"word " * 90, b"x" * 511, b"y" * 512, b"z1" * 3000, prose(1, 900).encode()]
    alone = [classifier.scores(net, [t])[0] for t in texts]
    assert np.allclose(classifier.scores(net, texts), alone, atol=1e-6)
    monkeypatch.setattr(classifier, "PIECE", 2000)
    assert np.allclose(classifier.scores(net, texts)[:5], alone[:5], atol=1e-6)


def test_long_texts_are_scored_whole(monkeypatch):
    net, text = classifier.fresh(5), prose(2, 4000).encode()
    whole = classifier.scores(net, [text])[0]
    changed = classifier.scores(net, [text[:-400] + b"#$%&*" * 80])[0]
    assert whole != changed
    monkeypatch.setattr(classifier, "PIECE", 6000)
    assert classifier.scores(net, [text])[0] != classifier.scores(net, [text[:-400] + b"#$%&*" * 80])[0]


def test_gradients_against_differences():
    texts, labels = [prose(i, 30).encode() for i in range(4)], np.array([0.0, 1, 1, 0])
    net = classifier.Net(*[p.astype(np.float64) for p in classifier.fresh(2).parts()])
    grads, _ = classifier._gradients(net, texts, labels)
    pick = np.random.default_rng(0)
    for part, grad in zip(net.parts(), grads, strict=True):
        flat = part.reshape(-1)
        for i in pick.integers(0, len(flat), 6):
            if not grad.reshape(-1)[i]:
                continue
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = classifier._gradients(net, texts, labels)[1]
            flat[i] = old - step
            down = classifier._gradients(net, texts, labels)[1]
            flat[i] = old
            assert abs((up - down) / (2 * step) - grad.reshape(-1)[i]) < 1e-5 + 1e-2 * abs(grad.reshape(-1)[i])


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    made = classifier.quality(docs, labels)
    rows = {r["doc_id"]: r for r in made.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert sum(b for a, b in held if a == 1) / sum(a for a, _ in held) > 0.95


def test_classifier_edge_tables(spark):
    docs, rows = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert {round(r["score"], 3) for r in classifier.quality(docs, none).collect()} == {0.5}
    assert {r["predicted"] for r in classifier.quality(docs, one).collect()} == {1}
    kept = classifier.accepted(docs, one)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert classifier.quality(frame(spark, []), one).count() == 0


# --- decontamination -----------------------------------------------------------------


def _edited(text, edits, seed):
    pick, s = random.Random(seed), list(text)
    for _ in range(edits):
        p, kind = pick.randrange(len(s)), pick.randrange(3)
        if kind == 0:
            s[p] = pick.choice("abc")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, pick.choice("xyz "))
    return "".join(s)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edited_passages_are_found_and_placed():
    items = [(i, prose(100 + i, 18 + i % 30, 5000)) for i in range(40)]
    index = decontaminate.Benchmark(items)
    for edits in (0, 2, 6):
        texts = [prose(i, 50, 5000) + " " + _edited(t, edits, i).upper() + " é " + prose(i + 500, 50, 5000) for i, t in items]
        found = list(decontaminate.found_in(index, texts))
        assert {(r, item) for r, item, *_ in found} == {(i, i) for i, _ in items}
        for row, _, start, end, k in found:
            # The place is that of an item's piece, within the edits that were counted.
            part = texts[row][start:end].lower()
            assert min(_distance(p.decode(), part) for p, i in zip(index.passages, index.items, strict=True) if i == row) <= k <= edits + 1


def test_truncated_passages_at_the_edges_of_texts():
    items = [(i, prose(800 + i, 20, 5000)) for i in range(20)]
    index = decontaminate.Benchmark(items)
    first = prose(1, 30, 5000)
    for cut in range(1, 6):
        for i, item in items:
            # The same document as the first text of a group and as a later one.
            for text in (item[cut:] + " " + first, first + " " + item[:-cut], item[cut:]):
                alone = list(decontaminate.found_in(index, [text]))
                after = list(decontaminate.found_in(index, [first, text, first]))
                assert {(r, x) for r, x, *_ in alone} == {(0, i)} and {(r, x) for r, x, *_ in after} == {(1, i)}
                assert all(0 <= a < b <= len(text) for _, _, a, b, _ in alone + after)


def test_lemma_filter_loses_no_alignment():
    pick = random.Random(4)
    items = [(i, prose(i, 12, 5000)) for i in range(20)]
    index = decontaminate.Benchmark(items)
    for seed in range(200):
        i = pick.randrange(20)
        body, k = index.passages[i], int(index.edits[i])
        text = (prose(seed + 900, 5, 5000) + " " + _edited(body.decode(), k, seed) + " tail").encode()
        assert any(p == i for p, *_ in index.regions(text))


def test_clean_documents_are_left_alone(spark):
    docs, rows = awkward(spark)
    items = [(0, prose(700, 40, 5000)), (1, None), (2, ""), (3, "short"), (4, "the " * 30), (0, prose(700, 40, 5000)), (None, prose(1, 120))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    stammer = next(r[0] for r in rows if r[1] and r[1].startswith("the the"))
    assert got == {(stammer, 4)}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(r[0] == stammer for r in rows)
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(docs, nothing).count() == 0 and decontaminate.clean(docs, nothing).count() == len(rows)
    assert decontaminate.matches(frame(spark, []), benchmark).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    items = [(i, prose(200 + i, 40, 5000)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows_of([prose(i, 30, 5000) + " " + items[i][1] for i in range(12)] + [prose(99, 80, 5000)]))
    whole = sorted(map(tuple, decontaminate.matches(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert len(list(decontaminate.blocks(benchmark))) > 2
    assert sorted(map(tuple, decontaminate.matches(docs, benchmark).collect())) == whole
    assert [r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()] == [12]


# --- personal data --------------------------------------------------------------------


def _plain_spans(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == 2:
                total = sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@given(st.lists(st.sampled_from(["12", "1", "255", "256", ".", "@", "a.b", "+1", " ", "4111111111111111", "-", "x", "(", "١", "\n", "0"]), max_size=25).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == _plain_spans(text)


def test_base_spans_of_long_runs():
    for text in ("1" * 200_000, "1." * 50_000, "a" * 200_000 + "@", "@a" * 50_000, "+1 " * 50_000, "9 " * 50_000):
        pii.base_spans(text)


def _model():
    pick = random.Random(5)
    fields = []
    for i in range(200):
        card = "4111111111111111"
        text = f"{prose(i, 5)} {card} {prose(i, 3)} {pick.randrange(1000, 9999)} and {card} mail a{i}@b{i}.org {pick.randrange(10**6)} then 10.0.{i % 250}.7 call +1 ({pick.randrange(100, 999)}) 555-{pick.randrange(1000, 9999)}"
        fields.append(pii.field_of(text, pii.base_spans(text)))
    return pii.fitted_on(fields)


def test_skip_chain_spreads_and_base_stays():
    model = _model()
    text = "pay +1 (678) 555-5272 or 4111111111111111 today 1999 words or call (678) 555-5272 later 77"
    base, every = pii.all_spans(text, model)
    assert base == _plain_spans(text) and set(base) <= set(every)
    more = [text[a:b] for k, a, b in every if (k, a, b) not in base]
    assert any("555-5272" in m for m in more) and not any("1999" in m or "77" == m for m in more)
    # Without evidence nothing is added, whatever the words look like.
    assert pii.all_spans("call (678) 555-5272 later", model) == ([], [])


def test_field_runs_without_base_spans(spark):
    model = _model()
    # One digit is wrong, so no pattern marks the number.
    text = "pay with 4111111111111112 or later with 4111111111111112 please"
    assert pii.base_spans(text) == []
    docs = frame(spark, rows_of([text, "no numbers here", None]))
    found = {r["doc_id"]: r for r in pii.spans(docs, model).collect()}
    assert found[0]["base"] == "" and found[0]["spans"] == "card:9:25,card:40:56" and found[1]["spans"] == found[2]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redacted(docs, model).collect()}[0] == "pay with <card> or later with <card> please"
    assert {r["spans"] for r in pii.spans(docs, model, everywhere=False).collect()} == {""}


def test_belief_propagation_is_exact_on_a_tree():
    pick = np.random.default_rng(3)
    labels = len(pii.KINDS) + 1
    model = pii.Potentials(pick.normal(size=(pii.SHAPES, labels)), pick.normal(size=labels), pick.normal(size=(labels, labels)), (s := pick.normal(size=(labels, labels))) + s.T)
    field = pii.Field(np.zeros(4), np.zeros(4), np.array([1, 2, 3, 4]), np.array([-1, -1, 2, -1]), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    got = pii.marginals(field, model)
    want = np.zeros((4, labels))
    for index in np.ndindex(*[labels] * 4):
        if index[2] == 2:
            score = sum(model.shape[field.shape[i], index[i]] + model.bias[index[i]] for i in (0, 1, 3))
            score += model.chain[index[0], index[1]] + model.chain[index[1], index[2]] + model.skip[index[1], index[3]]
            for i in range(4):
                want[i, index[i]] += np.exp(score)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-2)


def test_pii_tables(spark):
    docs, rows = awkward(spark)
    more = frame(spark, [(900, "mail a@b.example now a@b.example", "en", "s", 1, "", "", "", "", ""), (901, "é 10.1.2.3", None, None, None, None, None, None, None, None)])
    docs = docs.unionAll(more)
    found = {r["doc_id"]: r for r in pii.spans(docs, pii.fitted(docs)).collect()}
    assert found[900]["n_email"] == 2 and found[900]["base"] == "email:5:16,email:21:32" and found[901]["base"] == "ip:2:10"
    assert found[0]["spans"] == "" and len(found) == len({r[0] for r in rows}) + 2
    clean = pii.redacted(docs, None)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[900] == "mail <email> now <email>" and texts[901] == "é <ip>" and texts[0] is None
    assert pii.fitted(frame(spark, [])) is None and pii.spans(frame(spark, []), None).count() == 0


# --- ids, nulls and names -------------------------------------------------------

BIG = 9007199254740993
NAMES = ["_score", "score", "_gone", "gone", "_source", "_lang", "_topic", "_tokens", "_p", "_draw", "_row", "_weight", "found", "match"]


def _odd(spark):
    """Ids above 2**53 beside null ones, nullable integers and columns named like the operators' own."""
    item = prose(70, 30)
    texts = [(BIG, f"mail a@b.example {item}"), (None, f"mail c@d.example {item}"), (None, None), (BIG + 2, prose(71, 40)), (BIG + 4, prose(71, 40)), (BIG + 6, "")]
    rows = [(i, t, "en", "s", BIG if t else None, *[BIG + n if t else None for n in range(len(NAMES))]) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} bigint" for n in NAMES)).coalesce(1)
    return docs, rows, item


def _same(got, want):
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_ids_nulls_and_names_stay(spark):
    docs, rows, item = _odd(spark)
    benchmark = spark.createDataFrame([(BIG + 8, item)], "item_id bigint, text string")
    found = decontaminate.matches(docs, benchmark).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"]) for r in found) == [(False, BIG, BIG + 8), (True, 0, BIG + 8)]
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns
    _same(clean.collect(), [r for r in rows if not r[1] or item not in r[1]])

    labels = spark.createDataFrame([(BIG, 1, 0), (BIG + 2, 1, 0)], "doc_id bigint, quality int, toxic int")
    scores = classifier.quality(docs, labels).collect()
    _same([(r["doc_id"],) for r in scores], [(r[0],) for r in rows])
    kept = classifier.accepted(docs, labels)
    assert kept.columns == docs.columns
    _same(kept.collect(), rows)

    spans = pii.spans(docs, None).collect()
    _same([(r["doc_id"], r["n_email"]) for r in spans], [(r[0], int("mail" in (r[1] or ""))) for r in rows])
    clear = pii.redacted(docs, None)
    assert clear.columns == docs.columns
    _same(clear.collect(), [(r[0], r[1] and r[1].replace("a@b.example", "<email>").replace("c@d.example", "<email>"), *r[2:]) for r in rows])

    first = jaccard.first_of_each(docs)
    assert first.columns == docs.columns
    _same(first.collect(), [r for r in rows if r[0] != BIG + 4])

    every = mixing.sampled(docs, keep=1.0)
    assert every.columns == [*docs.columns, "mix_weight", "mix_probability"]
    assert {tuple(r)[: len(docs.columns)] for r in every.collect()} <= set(rows) and every.count() >= 1


def test_many_nodes_pass_messages_in_little_memory():
    model = pii.Potentials(np.zeros((pii.SHAPES, 5)), np.zeros(5), np.zeros((5, 5)), np.zeros((5, 5)))
    text = " ".join(str(i % 5000) for i in range(300_000))
    tracemalloc.start()
    pii.marginals(pii.field_of(text, []), model)
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
