"""Packing documents into sequences: dominance reduction, then best fit.

Only the number of pieces of each length matters for a packing, and there are no more lengths than a sequence has tokens.  So
the plan is made on that histogram: first Martello and Toth's dominance criterion fixes small sets of pieces that provably do
at least as well as anything else their sequence could hold, which shrinks the instance; best fit in decreasing order packs the
rest.  Both work on counts, so the plan costs the same for a thousand documents and for a trillion.

A plan is a list of runs: "the pieces of length s with ranks a..b go to sequences n, n+1, .. at offset o".  A piece finds its
run by its rank among the pieces of its length.  Ranks are made without gathering a length in one place: each task numbers its
own pieces, and a prefix sum over the tasks' counts makes those numbers global.

Special cases: null text counts as empty, its only token is the separator; documents longer than a sequence are cut into full
pieces and a rest, and a text of any length is encoded as a whole, by itself if it is long; pieces of equal length are placed in
the order of their tasks; rows that repeat are packed each for itself; null ids are packed as well; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import id_and_text, slices, stored
from locusframe.llm.tokens import MEMORY_BYTES, TEXT_BYTES, WordEncoder

#: (first rank, pieces, first sequence, pieces of one sequence, offset of the first of them)
Run = tuple[int, int, int, int, int]


class _Counts:
    """How many pieces of each length are left, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.n)

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``; 0 if there is none."""
        k = bisect.bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.remove(size)

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest lengths left, one piece of ``without`` set aside."""
        found: list[int] = []
        for s in self.sizes:
            found += [s] * min(n - len(found), self.n[s] - (s == without))
            if len(found) >= n:
                break
        return found


def _dominating(left: _Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``size`` that dominates all others that hold it; None if the criterion finds none.

    With room for one more piece at most, the largest that fits; a piece that fills the room exactly; with room for two at
    most, the largest single piece if no two together are larger, or the largest pair if its larger piece is also the largest
    single one and no other pair could beat it.
    """
    room = capacity - size
    one_less = _Counts({**left.n, size: left.n[size] - 1})
    best = one_less.largest(room)
    if not best or best == room:
        return (best,) if best else ()
    three = one_less.smallest(3, 0)
    if len(three) < 2 or three[0] + three[1] > room:
        return (best,)
    if len(three) == 3 and sum(three) <= room:
        return None
    # At most two more pieces fit: the fullest pair.
    pair = (0, 0, 0)
    for a in reversed(one_less.sizes):
        if 2 * a < pair[0]:
            break
        b = one_less.largest(min(a, room - a))
        if b == a and one_less.n[a] < 2:
            k = one_less.sizes.index(a)
            b = one_less.sizes[k - 1] if k else 0
        if b and a + b <= room:
            pair = max(pair, (a + b, a, b))
    if best >= pair[0]:
        return (best,)
    if pair[1] == best and pair[0] == room:
        return pair[1:]
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[Run]], int]:
    """Runs by length for pieces counted by length, and the number of sequences."""
    left = _Counts(counts)
    patterns: list[tuple[tuple[int, ...], int]] = []  # lengths in one sequence, and how many such sequences

    def fixed(sizes: tuple[int, ...]) -> None:
        need = {s: sizes.count(s) for s in sizes}
        n = min(left.n[s] // k for s, k in need.items())
        patterns.append((sizes, n))
        for s, k in need.items():
            left.take(s, n * k)

    reducing = True
    while reducing:
        reducing = False
        for size in sorted(left.n, reverse=True):
            while left.n.get(size) and (others := _dominating(left, size, capacity)) is not None:
                fixed((size, *others))
                reducing = True
    # Best fit, decreasing: open sequences by the room that is left in them.
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def keep(pattern: tuple[int, ...], n: int, room: int) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append([pattern, n])

    for size in sorted(left.n, reverse=True):
        n = left.n[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.remove(room)
            else:
                room, pattern, m = capacity, (), n
            each = room // size  # best fit fills the tightest sequence until nothing of this length fits
            full = min(m, n // each)
            keep((*pattern, *[size] * each), full, room - each * size)
            n -= full * each
            if full < m and n:
                keep((*pattern, *[size] * n), 1, room - n * size)
                n = 0
                full += 1
            if pattern:
                keep(pattern, m - full, room)
    for groups in open_.values():
        patterns += [(p, m) for p, m in groups]
    runs: dict[int, list[Run]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for sizes, n in patterns:
        offset = 0
        for size in dict.fromkeys(sizes):
            each = sizes.count(size)
            at = ranks.get(size, 0)
            runs.setdefault(size, []).append((at, n * each, sequence, each, offset))
            ranks[size] = at + n * each
            offset += each * size
        sequence += n
    return runs, sequence


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    memory_bytes: int = MEMORY_BYTES, text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, block, in_block``: the pieces, numbered by task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, memory_bytes=memory_bytes)
        end = np.array([end_id], "<u4")
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in (p for batch in batches for p in slices(batch, "text", text_bytes)):
            out = []
            texts = encoder.encode_all([t.as_buffer().to_pybytes() for t in part.column("text")])
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                ids = np.concatenate([text, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    mine = ids[start : start + capacity]
                    out.append((doc_id, piece, start, len(mine), zlib.crc32(mine.tobytes()), block, int(seen[len(mine)])))
                    seen[len(mine)] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "in_block"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, in_block long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    memory_bytes: int = MEMORY_BYTES, text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A task remembers words of ``memory_bytes`` and splits ``text_bytes`` of text at once: less memory, more time.
    """
    rows = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, memory_bytes, text_bytes), "pieces")
    by_block = stored(rows.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # by length
    runs, _ = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(
        {s: np.array(r, np.int64).T for s, r in runs.items()}  # bounded by the capacity, not by the rows
    )

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        where = np.zeros((2, len(sizes)), np.int64)
        for s in np.unique(sizes):
            here = sizes == s
            first, _, sequence, each, offset = shared.value[int(s)]
            k = np.searchsorted(first, ranks[here], "right") - 1
            n = ranks[here] - first[k]
            where[0, here] = sequence[k] + n // each[k]
            where[1, here] = offset[k] + n % each[k] * s
        return pd.DataFrame({"sequence_id": where[0], "offset": where[1]})

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (
        rows.join(first, ["length", "block"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", placed("length", F.col("first") + F.col("in_block")).alias("at"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
    )
