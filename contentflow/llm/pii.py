"""Personal data: fixed patterns, and a skip-chain conditional random field that extends them.

The patterns give the base spans, which are evidence and stay. The words of a
document that hold a digit or an at sign are the nodes of a random field with
labels none, email, ip, card and phone; words that base spans cover are observed.
Neighbouring nodes share a chain potential, and words that repeat or resemble
one another, however far apart (equal letters and digits, or the same last
seven digits), share a skip potential. Potentials are fitted by pseudo-likelihood
on a bounded sample of documents with base spans; loopy belief propagation
gives the marginals, and runs of words whose marginal for a label passes a limit
become further spans: a card number written once in full and once with a slip is
found both times.

The field runs on every document that has a node, with or without base spans,
unless ``everywhere`` is turned off.

Occurrences of one word are tied in a chain from each to the next, so a word
repeated ten thousand times costs ten thousand edges. Documents are independent:
one pass over the rows without a shuffle.

Defined results: null and empty texts have no spans; texts are handled whole;
rows of one id, and rows without one, are handled each; other columns are kept by
``redacted`` as they are and left out by ``spans``; without documents with base spans in the sample nothing is
added; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents the potentials are fitted on, and nodes of each that are looked at.
SAMPLE, SAMPLE_NODES = 1500, 400
SHAPES, ROUNDS, SURE = 512, 12, 0.6

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number's digits are never a later start: what fails from its first digit fails from the others.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[Span]:
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield 0, start, domain.end()
            after = domain.end()
        at = text.find("@", max(at + 1, after))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-1][::2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; ends exclusive, in code points."""
    found = list(_emails(text)) if "@" in text else []
    if _ACTIVE.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@dataclass
class Field:
    """Nodes of one document: word places, shape features, observed labels (-1: none), and edges of both sorts."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    seen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def shape_of(word: str) -> int:
    """Letters become a, digits 9 by number, the rest stays: +1-555 is +9-999."""
    plain = re.sub(r"[^\W\d_]+", "a", word)
    plain = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 20), plain)
    return zlib.crc32(plain.encode("utf-8", "surrogatepass")) % SHAPES


def field_of(text: str, base: list[Span], limit: int | None = None) -> Field | None:
    """The random field of a text, or None if no word holds a digit or an at sign."""
    words, index = [], []
    at, number = -1, -1
    # Only stretches around digits and at signs are cut into words.
    for m in _ACTIVE.finditer(text):
        if m.start() < at:
            continue
        start = m.start()
        while start > 0 and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        word = _WORD.match(text, start)
        # Consecutive numbers mean that only blanks are between two nodes.
        adjacent = bool(words) and not text[at:start].strip(" \t\n\x0b\x0c\r")
        number += 1 if adjacent else 2
        words.append((start, word.end(), word[0]))
        index.append(number)
        at = word.end()
        if limit and len(words) == limit:
            break
    if not words:
        return None
    start, end = np.array([w[0] for w in words]), np.array([w[1] for w in words])
    seen = np.full(len(words), -1)
    for kind, a, b in base:
        seen[np.searchsorted(end, a, side="right") : np.searchsorted(start, b)] = kind + 1
    shape = np.array([shape_of(w[2]) for w in words])
    index = np.array(index)
    near = np.flatnonzero(np.diff(index) == 1)
    ties: dict[str, int] = {}
    skips = set()
    for i, (_, _, word) in enumerate(words):
        core = re.sub(r"[\W_]+", "", word).lower()
        digits = re.sub(r"[^0-9]", "", word)
        for name in (core, "~" + digits[-7:] if len(digits) >= 7 else ""):
            if len(name) >= 4:
                if name in ties:
                    skips.add((ties[name], i))
                ties[name] = i
    return Field(start, end, shape, seen, np.stack([near, near + 1], axis=1), np.array(sorted(skips), np.int64).reshape(-1, 2))


@dataclass
class Potentials:
    shape: np.ndarray  # SHAPES x labels
    bias: np.ndarray  # labels
    chain: np.ndarray  # labels x labels, earlier by later
    skip: np.ndarray  # labels x labels, symmetric


def fitted_on(fields: list[Field], steps: int = 150, rate: float = 0.3, weight: float = 1e-3) -> Potentials | None:
    """Maximum pseudo-likelihood: each node's label given its shape and its neighbours' labels; unmarked nodes are none."""
    if not fields:
        return None
    n = len(KINDS) + 1
    offset = np.cumsum([0] + [len(f.seen) for f in fields])
    label = np.concatenate([np.maximum(f.seen, 0) for f in fields])
    shape = np.concatenate([f.shape for f in fields])
    chain = np.concatenate([f.chain + o for f, o in zip(fields, offset, strict=False)])
    skip = np.concatenate([f.skip + o for f, o in zip(fields, offset, strict=False)])
    own = np.eye(n)[label]

    def gathered(edges: np.ndarray, to: int) -> np.ndarray:
        out = np.zeros((len(label), n))
        np.add.at(out, edges[:, to], own[edges[:, 1 - to]])
        return out

    before, after = gathered(chain, 1), gathered(chain, 0)
    tied = gathered(skip, 0) + gathered(skip, 1)
    parts = [np.zeros((SHAPES, n)), np.zeros(n), np.zeros((n, n)), np.zeros((n, n))]
    squares = [np.full_like(p, 1e-8) for p in parts]
    for _ in range(steps):
        s, b, c, k = parts
        logit = s[shape] + b + before @ c + after @ c.T + tied @ k
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        wrong = (own - p / p.sum(axis=1, keepdims=True)) / len(label)
        by_shape = np.zeros_like(s)
        np.add.at(by_shape, shape, wrong)
        pull = tied.T @ wrong
        grads = [by_shape - weight * s / 10, wrong.sum(axis=0), before.T @ wrong + (after.T @ wrong).T - weight * c, (pull + pull.T) / 2 - weight * k]
        for part, grad, square in zip(parts, grads, squares, strict=True):
            square += grad * grad
            part += rate * grad / np.sqrt(square)
    return Potentials(*parts)


def marginals(field: Field, model: Potentials) -> np.ndarray:
    """Label marginals of every node by loopy belief propagation over chain and skip edges."""
    unary = model.shape[field.shape] + model.bias
    observed = field.seen >= 0
    unary[observed] = -30.0
    unary[observed, field.seen[observed]] = 0.0
    edges = np.concatenate([field.chain, field.skip])
    if not len(edges):
        return _softmax(unary)
    # All chain edges share one potential and all skip edges another: an edge holds two messages, no matrix.
    own = [(slice(0, len(field.chain)), np.exp(model.chain)), (slice(len(field.chain), len(edges)), np.exp(model.skip))]
    forth, back = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, edges[:, 1], forth)
        np.add.at(belief, edges[:, 0], back)
        change = 0.0
        to, fro = belief[edges[:, 0]] - back, belief[edges[:, 1]] - forth
        for part, kernel in own:
            for messages, cavity, through in ((forth, to, kernel), (back, fro, kernel.T)):
                new = _passed(cavity[part], through)
                change = max(change, np.abs(new - messages[part]).max(initial=0.0))
                messages[part] = (messages[part] + new) / 2
        if change < 1e-3:
            break
    belief = unary.copy()
    np.add.at(belief, edges[:, 1], forth)
    np.add.at(belief, edges[:, 0], back)
    return _softmax(belief)


def _passed(cavity: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Messages, as logarithms with largest 0, from what the senders believe through a shared potential."""
    cavity = cavity - cavity.max(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        out = np.maximum(np.log(np.exp(cavity) @ kernel), -700.0)
    return out - out.max(axis=1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, model: Potentials | None, everywhere: bool = False) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the added ones are runs of words with one sure label that no base span touches.

    The field is run on texts with base spans, or ``everywhere`` there are nodes.
    """
    base = base_spans(text)
    field = field_of(text, base) if model is not None and (base or everywhere) else None
    if field is None:
        return base, base
    sure = marginals(field, model)
    label = np.where(sure[:, 1:].max(axis=1) >= SURE, sure[:, 1:].argmax(axis=1) + 1, 0)
    label[field.seen >= 0] = 0
    adjacent = set(field.chain[:, 0].tolist())
    more, i = [], 0
    while i < len(label):
        if label[i]:
            j = i
            while j in adjacent and label[j + 1] == label[i]:
                j += 1
            start, end = int(field.start[i]), int(field.end[j])
            body = text[start:end]
            start += len(body) - len(body.lstrip(".,;:!?\"'([{<"))
            end -= len(body) - len(body.rstrip(".,;:!?\"')]}>"))
            if start < end:
                more.append((int(label[i]) - 1, start, end))
            i = j
        i += 1
    return base, sorted(base + more)


def fitted(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Potentials | None:
    """Potentials from the first so many documents, in hash order of their texts, that have base spans."""

    def marked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in b["text"]:
                base = base_spans(t) if isinstance(t, str) else []
                if base:
                    # Cut for fitting only; scoring reads whole texts.
                    f = field_of(t, base, SAMPLE_NODES)
                    found.append((zlib.crc32(t.encode("utf-8", "surrogatepass")), *[x.astype(np.int32).tobytes() for x in (f.shape, f.seen, f.chain, f.skip)]))
            yield pd.DataFrame(found, columns=["place", "shape", "seen", "chain", "skip"])

    rows = docs.select(F.col(text).cast("string").alias("text")).where("text rlike '[0-9@]'")
    marks = rows.mapInPandas(marked, "place bigint, shape binary, seen binary, chain binary, skip binary")
    fields = []
    for r in marks.orderBy("place", "shape", "seen", "chain", "skip").limit(sample).collect():
        shape, seen, chain, skip = (np.frombuffer(r[c], np.int32).astype(np.int64) for c in ("shape", "seen", "chain", "skip"))
        fields.append(Field(np.zeros(0), np.zeros(0), shape, seen, chain.reshape(-1, 2), skip.reshape(-1, 2)))
    return fitted_on(fields)


def written_out(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def spans(docs: DataFrame, model: Potentials | None, key: str = "doc_id", text: str = "text", everywhere: bool = True) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row; base and spans as kind:start:end lists."""

    kind = f"{', '.join(f'n_{k} bigint' for k in KINDS)}, base string, spans string"

    # Only the text goes to Python, so ids stay what they are.
    @F.pandas_udf(kind)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                base, every = all_spans(t, model, everywhere) if isinstance(t, str) else ([], [])
                kinds = [k for k, _, _ in base]
                out.append((*map(kinds.count, range(len(KINDS))), written_out(base), written_out(every)))
            yield pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base", "spans"])

    return docs.select(F.col(key).alias("doc_id"), find(F.col(text).cast("string")).alias("found")).select("doc_id", "found.*")


def redacted(docs: DataFrame, model: Potentials | None, text: str = "text", everywhere: bool = True) -> DataFrame:
    """The documents with every span replaced by the name of its kind in angle brackets; overlapping spans are one."""

    def replace(t):
        if not isinstance(t, str):
            return t
        found = sorted((a, b, k) for k, a, b in all_spans(t, model, everywhere)[1])
        out, at = [], 0
        for a, b, k in found:
            if a >= at:
                out += [t[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, t[at:]]) if found else t

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([replace(t) for t in batch], dtype=object)

    return docs.withColumn(text, run(F.col(text)))
