"""Small tables with the awkward cases, and plain versions of the operators to compare with."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words string, score string, spans string, start string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def awkward_texts():
    """Texts by id: nulls, blanks, copies, near copies, shared passages, stammers, one very long text, odd blanks."""
    shared = prose(99, 70)
    base = prose(1, 120).split()
    near = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in (3, 40, 60, 61, 118)]
    texts = [
        None, "", "  \n\t ", "one", "One", "two words", "four words are here", "five words are here now", "Five words ARE here now",
        " ".join(base), " ".join(base), " ".join(base).upper(), *near,
        prose(2, 60) + " " + shared + " " + prose(3, 40), shared + "\n" + prose(4, 90), prose(5, 30) + "\t" + shared,
        shared + " " + prose(6, 10) + " " + shared,
        "the " * 200, "a b c " * 60, prose(7, 3000), prose(7, 3000)[200:], "x" * 5000, "line one\nline one\n\nline two\nline one\n " + prose(8, 55),
        "sym #*$%&|<> " * 20, prose(9, 19), prose(9, 20), prose(9, 21), "a\x0bb\x0cc\rd e  f \U0001f600 é",
    ]
    return texts


def rows_of(texts, start=0):
    return [(i + start, t, ["en", "de", None][i % 3], ["hot", "hot", None, f"s{i}"][i % 4], len(t or ""), "k", "n", "s", "p", "st") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, repeated=True):
    """The awkward texts, with repeated rows of one id and two rows without an id."""
    rows = rows_of(awkward_texts())
    if repeated:
        rows += [rows[9], rows[20], (None, prose(50, 40), None, None, None, None, None, None, None, None), (None, None, "en", "hot", 0, "", "", "", "", "")]
    return frame(spark, rows), rows


def repeat_words(text):
    w = words(text)
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """{row number: smallest id}; rows of one id are one node."""
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: None if a is None else root(a) for i, (a, _) in enumerate(sets)}


def repeats_removed(rows, n=20):
    """Per row, in order of (id, text): kept words."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    seen, kept = set(), {}
    for i in order:
        w = words(rows[i][1])
        gone = set()
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in seen:
                gone.update(range(s, s + n))
            seen.add(g)
        kept[i] = [x for j, x in enumerate(w) if j not in gone]
    return kept


def covered_twice(rows, n=50):
    """{(id, text): words covered by a passage of n words that occurs at least twice}."""
    places = defaultdict(list)
    for i, r in enumerate(rows):
        w = words(r[1])
        for s in range(len(w) - n + 1):
            places[tuple(w[s : s + n])].append((i, s))
    covered = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                covered[i].update(range(s, s + n))
    return covered
