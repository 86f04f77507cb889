"""Indexes of BAM files that are sorted by position: which stretches of a file may overlap a region."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: the magic, the bits of a window of the linear index, and the bins of each level.
MAGIC, WINDOW_BITS = b"BAI\x01", 14
LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))


class IndexBuilder:
    """Takes records in the order of the file; ``sorted`` tells whether they were sorted by position."""

    def __init__(self, n_refs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_refs)]
        self.windows = [np.zeros(0, np.int64) for _ in range(n_refs)]
        self.sorted, self._last = True, (-1, -1)

    def add(self, refs: np.ndarray, pos: np.ndarray, end0: np.ndarray, bins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """``starts``, ``ends``: virtual offsets of each record and of what follows it."""
        if not len(refs):
            return
        # Records without a place come last.
        rank = np.where(refs < 0, 1 << 40, refs)
        order = np.concatenate(([self._last[0]], rank)), np.concatenate(([self._last[1]], pos))
        later = (order[0][1:] > order[0][:-1]) | (order[0][1:] == order[0][:-1]) & ((order[1][1:] >= order[1][:-1]) | (refs < 0))
        self.sorted &= bool(later.all())
        self._last = (int(rank[-1]), int(pos[-1]))
        keep = refs >= 0
        refs, pos, end0, bins, starts, ends = (x[keep] for x in (refs, pos, end0, bins, starts, ends))
        if not len(refs):
            return
        new = np.ones(len(refs), bool)
        new[1:] = (refs[1:] != refs[:-1]) | (bins[1:] != bins[:-1]) | (starts[1:] != ends[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(refs)) - 1
        for ref, bin_, start, end in zip(refs[first].tolist(), bins[first].tolist(), starts[first].tolist(), ends[last].tolist()):
            chunks = self.bins[ref].setdefault(bin_, [])
            if chunks and chunks[-1][1] >> 16 >= start >> 16:  # in the same block: one stretch
                chunks[-1][1] = end
            else:
                chunks.append([start, end])
        low, high = pos >> WINDOW_BITS, (end0 - 1) >> WINDOW_BITS
        for ref in np.unique(refs).tolist():
            mine = refs == ref
            held = self.windows[ref]
            if (need := int(high[mine].max()) + 1) > len(held):
                held = np.concatenate((held, np.full(need - len(held), np.iinfo(np.int64).max)))
            n = high[mine] - low[mine] + 1
            windows = np.arange(int(n.sum())) + np.repeat(low[mine] - (np.cumsum(n) - n), n)
            np.minimum.at(held, windows, np.repeat(starts[mine], n))
            self.windows[ref] = held

    def encoded(self) -> bytes:
        out = [MAGIC, struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows):
            out.append(struct.pack("<i", len(bins)))
            for bin_, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", bin_, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            # A window without records has the offset of the one before.
            filled, at = windows.copy(), 0
            for k, value in enumerate(filled.tolist()):
                at = at if value == np.iinfo(np.int64).max else value
                filled[k] = at
            out.append(struct.pack("<i", len(filled)) + filled.astype("<u8").tobytes())
        return b"".join(out)


class Index:
    """What is needed of an index file: bins and windows of each reference."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not an index of a BAM file")
        n_refs, at = struct.unpack_from("<i", data, 4)[0], 8
        self.refs: list[tuple[dict[int, list[tuple[int, int]]], np.ndarray]] = []
        for _ in range(n_refs):
            n_bins, at, bins = struct.unpack_from("<i", data, at)[0], at + 4, {}
            for _ in range(n_bins):
                bin_, n = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                bins[bin_] = list(zip(flat[::2], flat[1::2]))
                at += 8 + 16 * n
            n = struct.unpack_from("<i", data, at)[0]
            self.refs.append((bins, np.frombuffer(data, "<u8", n, at + 4)))
            at += 4 + 8 * n

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches of virtual offsets that hold all records which overlap [start, end) of a reference."""
        if not 0 <= ref < len(self.refs) or start >= end:
            return []
        bins, windows = self.refs[ref]
        last = (len(windows) << WINDOW_BITS) - 1
        if start > last:
            return []
        end = min(end, last + 1)
        least = int(windows[start >> WINDOW_BITS])
        near = {0} | {first + k for shift, first in LEVELS for k in range(start >> shift, ((end - 1) >> shift) + 1)}
        found = sorted((max(a, least), b) for bin_ in near & bins.keys() for a, b in bins[bin_] if b > least)
        return merged(found)


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches with those joined that touch or share a block."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
