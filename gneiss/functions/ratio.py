"""Matching blocks of many pairs of texts at once."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Texts from this length on, as the second of a pair, go to difflib itself, which leaves out their frequent characters.
POPULAR_FROM = 200
#: Bytes of the table of a run of pairs, small enough for a core's own cache.
TABLE_BYTES = 64 << 10
#: Characters of the first texts of a run of pairs, blanks at their ends included.
WIDE = 1 << 20


def flat_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts as numbers from 2, where each text begins, its length)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.unique(chars, return_inverse=True)[1] + 2
    return codes.astype(np.uint8 if len(codes) == 0 or codes.max() < 256 else np.uint32), np.cumsum(length) - length, length


def _longest(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, begin in a, begin in b) of the longest common block of each of ``at`` = (a from, a to, b from, b to).

    Of equally long ones that which begins first in a, and then in b, as in difflib.
    """
    m, n = at[1] - at[0], at[3] - at[2]
    rows, columns = np.arange(m.max())[:, None], np.arange(n.max())[:, None]
    a = np.where(rows < m, codes[np.minimum(at[0] + rows, len(codes) - 1)], 0)
    b = np.where(columns < n, codes[np.minimum(at[2] + columns, len(codes) - 1)], 1)
    run = np.zeros((len(b) + 1, len(m)), np.uint8)  # length of the block that ends here, a row below its place
    before = np.empty((len(b), len(m)), np.uint8)
    size, i, j = np.zeros(len(m), np.uint8), np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    for k in range(len(a)):
        np.add(run[:-1], 1, out=before)
        np.multiply(before, (b == a[k]).view(np.uint8), out=run[1:])
        top = run[1:].max(axis=0)
        longer = np.flatnonzero(top > size)
        if len(longer):
            size[longer], i[longer], j[longer] = top[longer], k, run[1:, longer].argmax(axis=0)
    size = size.astype(np.int64)
    return size, at[0] + i + 1 - size, at[2] + j + 1 - size


def matched(codes: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Characters in matching blocks of each pair of texts ``a``, ``b`` (places in ``start``), as difflib finds them.

    A pair is given up, with fewer than it has, as soon as what is left can't bring its ratio to ``least``.
    """
    total, needed = np.zeros(len(a), np.int64), (length[a] + length[b]) * least / 2 - 1e-6
    pair = np.flatnonzero((length[a] > 0) & (length[b] > 0))
    a, b = a[pair], b[pair]
    at = np.stack([start[a], start[a] + length[a], start[b], start[b] + length[b]])
    while len(pair):
        m, n = at[1] - at[0], at[3] - at[2]
        order = np.lexsort((m, n))
        pair, at, n, most_rows = pair[order], at[:, order], n[order], WIDE // int(m.max())
        rest = []
        first = 0
        while first < len(pair):
            last = min(len(pair), first + max(1, min(most_rows, max(256, TABLE_BYTES // int(n[first])))))
            own = at[:, first:last]
            size, i, j = _longest(codes, own)
            np.add.at(total, pair[first:last], size)
            for part in (np.stack([own[0], i, own[2], j]), np.stack([i + size, own[1], j + size, own[3]])):
                left = (size > 0) & (part[0] < part[1]) & (part[2] < part[3])
                rest.append((pair[first:last][left], part[:, left]))
            first = last
        pair, at = np.concatenate([p for p, _ in rest]), np.concatenate([x for _, x in rest], axis=1)
        most = total + np.bincount(pair, np.minimum(at[1] - at[0], at[3] - at[2]), len(total))
        hopeful = most[pair] >= needed[pair]
        pair, at = pair[hopeful], at[:, hopeful]
    return total


def ratios(texts: list[str], a: np.ndarray, b: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, least: float = 0.0) -> np.ndarray:
    """``SequenceMatcher(None, texts[a], texts[b]).ratio()`` of each pair of places ``a``, ``b``; less than that for some below ``least``."""
    flat, start, length = codes or flat_codes(texts)
    out = np.ones(len(a))
    long = length[b] >= POPULAR_FROM
    out[long] = [SequenceMatcher(None, texts[x], texts[y]).ratio() for x, y in zip(a[long], b[long])]
    a, b = a[~long], b[~long]
    both = length[a] + length[b]
    out[~long] = np.divide(2.0 * matched(flat, start, length, a, b, least), both, out=np.ones(len(a)), where=both > 0)
    return out


def bounds(codes: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The most that ``ratios`` can be of each of the first ``n`` texts (rows) and each of the others: by the characters that both have."""
    flat, start, length = codes
    text = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((flat, text))
    own, who = flat[order].astype(np.int64), text[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (who[1:] != who[:-1])])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
    letter, column = np.unique(own * (int(length.max(initial=0)) + 1) + nth, return_inverse=True)
    shared = np.zeros((n, len(length) - n), np.float32)
    for first in range(0, len(letter), 1024):  # a matrix of a thousand numbered characters at a time
        here = (column >= first) & (column < first + 1024)
        bags = np.zeros((len(length), min(1024, len(letter) - first)), np.float32)
        bags[who[here], column[here] - first] = 1
        shared += bags[:n] @ bags[n:].T
    both = length[:n, None] + length[None, n:]
    return np.divide(2.0 * shared, both, out=np.ones(shared.shape), where=both > 0)
