"""Words and word n-grams of many texts as 64-bit hashes, by whole-array arithmetic.

A word is a maximal run of bytes outside space and 0x09-0x0D of the UTF-8 text,
which are the same words as of the text itself. Hashes are fixed by the content
alone, so every task and every run computes the same ones.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at once; texts longer than this are cut between words.
PIECE = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < size:
        n = max(size, 1 << 16)
        n = 1 << (n - 1).bit_length()
        up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        held = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return held


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a byte array that starts and ends with a blank."""
    word = ~_BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = powers(0x9E3779B97F4A7C17, len(data))
    total = np.cumsum(_BYTE[data] * up[: len(data)])
    return mixed((total[end - 1] - total[start - 1]) * down[start]), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text (with the total at the end)."""
    found, counts = [], []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            flat = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
            hashes, start = _hash_words(flat)
            edges = np.cumsum([0] + [len(t) + 1 for t in group])
            counts.extend(np.diff(np.searchsorted(start, edges + 1)))
            found.append(hashes)
            group.clear()
            size = 0

    for text in texts:
        if len(text) > PIECE:
            flush()
            n = 0
            for piece in pieces(text):
                hashes, _ = _hash_words(np.frombuffer(b" " + piece + b" ", np.uint8))
                found.append(hashes)
                n += len(hashes)
            counts.append(n)
            continue
        if size + len(text) > PIECE:
            flush()
        group.append(text)
        size += len(text)
    flush()
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, U)), first


def pieces(text: bytes):
    """A long text cut at blanks; a single word longer than a piece stays whole."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def ngrams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 entries are shorter ones and not for use."""
    up, down = powers((0xD1342543DE82EF95 + 8 * seed) | 1, len(words) + 1)
    total = np.concatenate([[U(0)], np.cumsum(words * up[: len(words)])])
    end = np.minimum(np.arange(len(words)) + n, len(words))
    return mixed((total[end] - total[:-1]) * down[: len(words)] + U(n) + U(0x632BE59BD9B4E019) * U(seed))


def starts(first: np.ndarray, n: int) -> np.ndarray:
    """Places at which n words of one text start."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(first[-1])
    return place[place + n <= first[1:][text]]


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, without planes that are zero."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(U), prepend=U(0))
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return np.cumsum(out.view(U)[:, 0], dtype=U)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values
