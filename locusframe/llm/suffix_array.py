"""Suffix arrays of many strings by two-stage sorting, vectorised.

Stage one sorts directly only the suffixes that are smaller than their successors.  Stage two scans the buckets of first
letters in order; a suffix that is larger than its successor is put at the front of its bucket when its successor is
scanned.  All of a bucket is scanned at once: what it induces within itself (runs of one letter) comes in waves.
"""

from __future__ import annotations

import numpy as np


class Strings:
    """Strings one after another, each followed by a letter 0 that is smaller than all others.

    The letters are the bytes plus 1; byte 255, which UTF-8 has not, is not allowed.
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.ends = self.starts + lengths
        n = int(lengths.sum()) + len(strings)
        raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        self.n, self.letters = n, np.zeros(n + 256, np.uint8)
        self.letters[:n] = raw + np.uint8(1)  # 255 becomes 0
        self.words = self.letters.astype(np.uint64)
        for width in (1, 2, 4):  # the 8 letters from each place on
            longer = self.words[:-width] << np.uint64(8 * width)
            longer |= self.words[width:]
            self.words = longer
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)


def _sorted_directly(s: Strings, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` letters from them on (a little more, to whole words of 8)."""
    if not len(places):
        return places
    first = s.words[places]
    order = np.argsort(first)
    places, first = places[order], first[order]
    open_, group = _ties(np.arange(len(places)), first[1:] != first[:-1])
    for at in range(8, depth, 8):
        if not len(open_):
            break
        key, same = s.words[places[open_] + at], group[1:] == group[:-1]
        # Only groups in which the next 8 letters differ need sorting; a group stays where it is.
        mixed = np.zeros(len(places), bool)
        mixed[group[1:][same & (key[1:] != key[:-1])]] = True
        some = np.flatnonzero(mixed[group])
        order = some[np.lexsort((key[some], group[some]))]
        places[open_[some]], key[some] = places[open_[order]], key[order]
        open_, group = _ties(open_, ~same | (key[1:] != key[:-1]))
    return places


def _ties(rows: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are tied with a neighbour, each with the first row of its group.  ``differs``: whether a row differs from the one before."""
    new = np.concatenate(([True], differs))
    group = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    tied = ~(new & np.append(differs, True))
    return rows[tied], group[tied]


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor."""
    step = np.sign(np.diff(t, append=np.int16(-1)))
    # Equal neighbours are of the kind of the next unequal pair.
    following = np.where(step != 0, np.arange(len(t), dtype=np.int32), np.int32(len(t)))
    np.minimum.accumulate(following[::-1], out=following[::-1])
    smaller = step[following] > 0
    smaller[t == 0] = True  # the ends of strings are sorted directly, too
    return smaller


def _needed(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Wanted places and those they are put in order from: a larger place needs its successor, and so on up to the next smaller one."""
    places = np.arange(len(smaller), dtype=np.int32)
    stop = np.maximum.accumulate(np.where(smaller, places, np.int32(-1)))
    needed = wanted.copy()
    needed[1:] = np.maximum.accumulate(np.where(wanted, places, np.int32(-1)))[1:] > stop[:-1]
    return needed


def suffix_array(s: Strings, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All places in the order of their suffixes, exact to ``depth`` letters.

    ``wanted``: whether each place is wanted; of the others, only those stay that wanted ones are put in order from.
    """
    t = s.letters[: s.n].astype(np.int16)
    smaller = _smaller(t)
    needed = np.ones(s.n, bool) if wanted is None else _needed(wanted, smaller)
    direct = _sorted_directly(s, np.flatnonzero(smaller & needed), depth)
    letters = t[direct]
    buckets: dict[int, list[np.ndarray]] = {}
    found = [np.empty(0, np.int64)]
    for c in np.flatnonzero(np.bincount(t, minlength=257)):
        front = buckets.pop(int(c), [])
        wave = np.concatenate(front) if front else np.empty(0, np.int64)
        while c and len(wave):
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & needed[before]]
            front.append(wave)
        low, high = np.searchsorted(letters, [c, c + 1])
        bucket = np.concatenate([*front, direct[low:high]])
        found.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & needed[before]]
        head = t[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cuts = np.flatnonzero(np.diff(head)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            buckets.setdefault(int(t[part[0]]), []).append(part)
    return np.concatenate(found)


def common_prefixes(s: Strings, order: np.ndarray, length: int) -> np.ndarray:
    """Letters that each suffix has in common with the one before it in ``order``, counted in words of 8 up to ``length``."""
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), length - 8]:
        same = s.words[order[open_] + at] == s.words[order[open_ - 1] + at]
        open_ = open_[same]
        common[open_] = at + 8
    return common
