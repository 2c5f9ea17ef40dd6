"""Suffix arrays over arrays of small numbers."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int, top: int) -> np.ndarray:
    """The positions ``at``, sorted by the ``depth`` numbers of ``text`` that follow each.

    ``text`` needs ``depth`` zeros at its end; its numbers are ``top`` at most. Several numbers go
    into one machine word; past the first such word, only ties are sorted on.
    """
    bits = max(1, int(top).bit_length())
    per = max(1, min(depth, 63 // bits))
    small = np.int32 if len(text) < 2**31 else np.int64
    order = at.astype(small)
    group = np.zeros(len(order), small)
    open_ = np.arange(len(order), dtype=small)
    for d in range(0, depth, per):
        if not len(open_):
            break
        key = np.zeros(len(open_), np.int64)
        for i in range(per):
            key = key << bits | (text[order[open_] + d + i] if d + i < depth else 0)
        by = np.lexsort((key, group[open_])) if d else np.argsort(key, kind="stable")
        order[open_] = order[open_[by]]
        key, own = key[by], group[open_]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        first = np.nonzero(new)[0]
        group[open_] = open_[first[np.cumsum(new) - 1]]
        del by, own
        size = np.diff(np.append(first, len(open_)))
        open_ = open_[np.repeat(size, size) > 1]
    return order


def two_stage(text: np.ndarray, depth: int, top: int) -> np.ndarray:
    """All positions of ``text`` but its zeros, sorted by the ``depth`` numbers that follow each.

    Numbers are 1 to ``top``; a zero ends a string, and what follows it has no say. ``text`` ends
    with a zero. Only suffixes smaller than their successors are sorted directly. The rest are
    induced: buckets of one first number are scanned upwards, and each suffix puts the one before
    it, if larger, next in its bucket; that is done for a whole bucket at a time.
    """
    n = len(text)
    if n < 2:
        return np.empty(0, np.int64)
    # A suffix is as its first change of number goes: smaller than its successor before a rise.
    change = np.append(np.nonzero(text[1:] != text[:-1])[0], n - 1)
    upward = np.append(text[1:], 0) > text
    smaller = np.repeat(upward[change], np.diff(change, prepend=-1))
    padded = np.concatenate([text, np.zeros(depth, text.dtype)])
    stops = np.nonzero(text == 0)[0]
    direct = suffix_array(padded, np.nonzero(smaller & (text > 0))[0], depth, top)
    first = text[direct]
    border = np.searchsorted(first, np.arange(top + 2))
    pending: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
    out = []

    def induce(bucket: np.ndarray, number: int) -> None:
        before = bucket[bucket > 0] - 1
        head = text[before]
        larger = head > number
        before, head = before[larger], head[larger]
        by = np.argsort(head, kind="stable")
        before, head = before[by], head[by]
        edge = np.nonzero(np.concatenate([[True], head[1:] != head[:-1]]))[0] if len(head) else []
        for a, b in zip(edge, [*edge[1:], len(head)]):
            pending[head[a]].append(before[a:b])

    induce(stops, 0)
    for number in range(1, top + 1):
        waves = [np.concatenate(pending[number])] if pending[number] else []
        pending[number] = []
        while waves and len(waves[-1]):
            before = waves[-1][waves[-1] > 0] - 1
            waves.append(before[text[before] == number])
        bucket = np.concatenate([*waves, direct[border[number] : border[number + 1]]])
        if len(bucket):
            out.append(bucket)
            induce(bucket, number)
    return np.concatenate(out) if out else np.empty(0, np.int64)
