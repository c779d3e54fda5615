"""Suffix arrays of byte blocks by two-stage sorting, and adjacent common prefixes.

A suffix is of type B if it is smaller than the suffix one to its right, else
of type A. Only the B suffixes are sorted directly. Scanning the buckets of
first bytes in order then induces the A suffixes: the one to the left of each
scanned suffix, if of type A, is the next of its own bucket. Everything is
done on whole arrays: a bucket is scanned at once, in rounds only for runs of
its own byte.

Order is exact up to ``depth`` bytes; suffixes that agree further keep any
order among themselves, side by side.
"""

from __future__ import annotations

import numpy as np

WORD = 8
#: Bytes in which tied suffixes are first looked at, and pairs of suffixes that are compared at once.
STRIDE, PAIRS = 64, 4096


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(WORD, np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | padded[k:k + len(text)]
    return out


def b_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbours; the end of the text is smallest."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # of each run of one byte
    up = np.append(text[ends[:-1] + 1] > text[ends[:-1]], False)
    return np.repeat(up, np.diff(np.append(-1, ends)))


def _rows(text: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each position on, as a view; zeros beyond the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(width, np.uint8))), width)


def _ties(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in groups of two or more, and the number of each one's group; groups begin where ``starts`` is set."""
    where = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    return where, np.cumsum(starts[where]) - 1


def _mixed(differ: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where the groups ``owner`` are that have a member which differs from the one before it."""
    some = np.zeros(owner[-1] + 1 if len(owner) else 0, bool)
    some[owner[1:][differ & (owner[1:] == owner[:-1])]] = True
    return np.flatnonzero(some[owner])


def _direct(at: np.ndarray, text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by up to ``depth`` bytes.

    Tied groups are looked at ``STRIDE`` bytes at a time, and only those that
    are not all equal there are sorted, eight bytes at a time.
    """
    n = len(text)
    words = np.append(words, np.uint64(0))
    at = at[np.argsort(words[at])]
    key = words[at]
    starts = np.concatenate(([True], key[1:] != key[:-1]))[:len(at)]
    rows = _rows(text, STRIDE)
    for offset in range(WORD, depth, STRIDE):
        where, owner = _ties(starts)
        if not len(where):
            break
        ahead = rows[np.minimum(at[where] + offset, n)].view(np.uint64)
        chosen = _mixed((ahead[1:] != ahead[:-1]).any(axis=1), owner)
        where, owner = where[chosen], owner[chosen]
        for word in range(offset, offset + STRIDE, WORD):
            part = at[where]
            key = words[np.minimum(part + word, n)]
            chosen = _mixed(key[1:] != key[:-1], owner)
            if not len(chosen):
                continue
            places, key = where[chosen], key[chosen]
            order = np.lexsort((key, owner[chosen]))
            at[places], key = part[chosen[order]], key[order]
            starts[places[1:]] |= key[1:] != key[:-1]
            left, owner = _ties(starts[where])
            where = where[left]
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``text`` (bytes) in the order of their suffixes' first ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    is_b = b_types(text)
    sorted_b = _direct(np.flatnonzero(is_b), text, _words(text), depth)
    edges = np.searchsorted(text[sorted_b], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))  # follows the empty suffix, the smallest
    out = []

    def left_of(at: np.ndarray) -> np.ndarray:
        left = at[at > 0] - 1
        return left[~is_b[left]]

    def deal(left: np.ndarray, bucket: int) -> np.ndarray:
        """Append to the buckets above; returns what belongs to this one."""
        byte = text[left]
        own = left[byte == bucket]
        left, byte = left[byte > bucket], byte[byte > bucket]
        order = np.argsort(byte, kind="stable")
        left, byte = left[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(left, cuts) if len(left) else ():
            induced[text[part[0]]].append(part)
        return own

    for bucket in range(256):
        now = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = deal(left_of(now), bucket)
        own_b = sorted_b[edges[bucket]:edges[bucket + 1]]
        if len(own_b):
            out.append(own_b)
            deal(left_of(own_b), bucket)
        induced[bucket] = []
    return np.concatenate(out)


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have a common prefix of ``depth`` bytes, all of them in the text."""
    words, rows = _words(text), np.lib.stride_tricks.sliding_window_view(text, depth)
    # Most pairs part early; the others are compared whole.
    same, left = np.zeros(len(a), bool), np.arange(len(a))
    for offset in (o for o in (0, 8, 32, 128) if o + WORD <= depth):
        left = left[words[a[left] + offset] == words[b[left] + offset]]
    for at in range(0, len(left), PAIRS):
        part = left[at:at + PAIRS]
        same[part] = (rows[a[part]] == rows[b[part]]).all(axis=1)
    return same


def repeated(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Those of the positions ``starts`` whose ``depth`` bytes also start at another of them."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text, depth)
    order = order[wanted[order]]
    same = agree(text, order[:-1], order[1:], depth)
    found = np.zeros(len(order), bool)
    found[:-1] |= same
    found[1:] |= same
    return np.sort(order[found])
