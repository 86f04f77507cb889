"""Removal of passages that repeat, byte for byte, by suffix arrays.

Every byte goes that a string of ``length`` bytes covers which also starts earlier (smaller id, or the same document further
left).  Sorting all suffixes of the corpus would move each text a hundred times, so the suffixes are dealt out first:

1. Cut.  Each document is cut into segments: runs of windows of ``length`` bytes that have the same smallest hash of
   ``ANCHOR`` bytes.  Equal windows have the same smallest hash, so a window can only repeat in segments of its own hash.
   A segment is shipped as the anchor's hash, a hash of its content of 128 bits and its place; its text stays.
2. Meet.  Segments are dealt out by ranges of (anchor hash, content hash, id), so that a hash or a content which a third of
   all documents has is spread over tasks as well, and sorted.  Of equal segments all but the first are repeats throughout.  The first ones of
   an anchor with several contents are candidates; so are those at the borders of a range, where the neighbour isn't seen.
3. Sort.  The texts of candidates go to tasks by anchor.  Each task builds the suffix array of a block of whole anchors by
   two-stage sorting and compares neighbours: of suffixes with ``length`` bytes in common all but the earliest repeat.  An
   anchor with more than ``MOST_SEGMENTS`` contents is dealt out window by window, by the windows' own hash.  A window that
   stands in more than ``MOST_WINDOWS`` places is counted first, by its hash and combined before the shuffle; then its places are
   dealt out in chunks, each with the earliest one, so the bytes still decide and no task gets all of them.
4. Remove.  The repeated runs of each document are merged and cut out.

Equal segments, unlike all others, are equal by their hashes: 128 bits of content and 64 of the anchor, not compared byte by byte.

Special cases: null text is empty; texts shorter than ``length`` keep all; very long texts are cut in overlapping parts of 4 MB;
of places that tie in a document the leftmost is the earliest; documents that repeat an id, and those without one,
are ordered by id (null first) and are then told apart by a number of their own, for which the table is stored once; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import BROADCAST_CLASSES, BROADCAST_ROWS, id_and_text, shuffle_partitions, stored
from locusframe.llm.suffix_array import Strings, common_prefixes, suffix_array

LENGTH, ANCHOR = 100, 32
MOST_SEGMENTS, MOST_WINDOWS = 4096, 20_000
#: Bits of a packed place: bytes of the segment, and above them whether it is periodic.
SIZE_BITS = 10
_PERIODIC, _PLACE = 1 << SIZE_BITS, SIZE_BITS + 1
#: Bytes that are hashed, and bytes that are sorted, at once.
CUT_BYTES, SORT_BYTES = 1 << 20, 2 << 20
SAMPLE_DOCUMENTS = 2000


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < ANCHOR:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % 2**64
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def segments(
    data: np.ndarray, first: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, bytes, anchor hash, periodic)`` of the segments of texts that stand one after another, each beginning at
    ``first``.  A segment is periodic if its anchor stands in it more than once: only then can it hold a window twice."""
    n = len(data) - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    hashes = _anchor_hashes(data)
    low, width = hashes, 1
    span = length - ANCHOR + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n]) if width < span else low[:n]
    new = np.ones(n, bool)
    new[1:] = low[1:] != low[:-1]
    new[first[first < n]] = True
    ends = np.append(first[1:], len(data))
    for a, b in zip(first, ends):  # no window crosses the end of a text
        new[max(a, b - length + 1) : b] = False
    starts = np.flatnonzero(new)
    text = np.searchsorted(first, starts, "right") - 1
    stops = np.minimum(np.append(starts[1:], n), ends[text] - length + 1)
    windows = stops - starts
    # Runs of one hash are longer only in periodic text; cut into pieces of a fixed number of windows.
    pieces = -(-windows // span)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(starts, pieces) + k * span
    count = np.minimum(np.repeat(stops, pieces) - at, span)
    periodic = np.arange(len(at))
    for kind in (np.uint16, np.uint64):  # two bytes of the hashes rule out nearly all
        padded = np.concatenate([hashes.astype(kind), np.zeros(2 * span, kind)])
        seen = np.lib.stride_tricks.sliding_window_view(padded, 2 * span - 1)[at[periodic]] == low[at[periodic]].astype(kind)[:, None]
        seen &= np.arange(2 * span - 1) < (count[periodic] + span - 1)[:, None]
        periodic = periodic[np.count_nonzero(seen, axis=1) > 1]
    return at, count + length - 1, low[at].view(np.int64), np.isin(np.arange(len(at)), periodic)


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Keys, offsets and bytes of texts, gathered to CUT_BYTES; longer texts in parts that overlap by a window less one."""
    keys, offsets, texts, size = [], [], [], 0
    for key, value in zip(batch.column("key").to_pylist(), batch.column("text")):
        data = value.as_buffer().to_pybytes()
        if len(data) < length:
            continue
        step = 4 * CUT_BYTES
        for at in range(0, max(1, len(data) - length + 1), step):
            part = data[at : at + step + length - 1]
            keys.append(key)
            offsets.append(at)
            texts.append(part)
            size += len(part)
            if size >= CUT_BYTES:
                yield keys, offsets, texts
                keys, offsets, texts, size = [], [], [], 0
    if texts:
        yield keys, offsets, texts


def _cut(length: int, borders: tuple[np.ndarray, ...] | None):
    """Mapper: segments of texts, with the range that each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, offsets, texts in _parts(batch, length):
                whole = b"".join(texts)
                sizes = [len(t) for t in texts]
                first = np.cumsum([0, *sizes[:-1]])
                at, size, anchor, periodic = segments(np.frombuffer(whole, np.uint8), first, length)
                text = np.searchsorted(first, at, "right") - 1
                digest = xxhash.xxh3_128_digest
                content = b"".join([digest(whole[a : a + n]) for a, n in zip(at.tolist(), size.tolist())])
                content = np.frombuffer(content, "<i8").reshape(-1, 2)
                content, content2 = np.ascontiguousarray(content[:, 0]), np.ascontiguousarray(content[:, 1])
                key = np.array(keys, np.int64)[text]
                if borders is None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, key)], ["anchor", "content", "key"])
                    continue
                part = range_of(borders, (anchor, content, key))
                place = np.array(offsets, np.int64)[text] + at - first[text]
                columns = [
                    pa.array(part.astype(np.int32)), pa.array(anchor), pa.array(content), pa.array(content2),
                    pa.array(key), pa.array((place << _PLACE) + periodic * _PERIODIC + size),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "anchor", "content", "content2", "key", "place"])

    return run


def range_of(borders: tuple[np.ndarray, ...], columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many borders each row is not before, in the order of the columns, the first one first."""
    low, high = (np.searchsorted(borders[0], columns[0], side) for side in ("left", "right"))
    if len(borders) == 1:
        return high
    found = low.copy()
    tied = np.flatnonzero(high > low)
    for a, b in set(zip(low[tied].tolist(), high[tied].tolist())):
        rows = tied[(low[tied] == a) & (high[tied] == b)]
        found[rows] = a + range_of(tuple(x[a:b] for x in borders[1:]), tuple(x[rows] for x in columns[1:]))
    return found


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments: the repeats (anchor null) and the candidates.

    A segment that equals the one before it repeats.  Of the others, the firsts, one is a candidate if the first before or
    after it has the same anchor, if there is none in its range, or if it may repeat itself.
    """
    names = ("part", "anchor", "content", "content2", "key", "place")
    outside = {k: np.array([-1], np.int64) for k in names}

    def candidates(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of all rows of ``c`` but the first and the last, which are there to look at."""
        range_ends = c["part"][1:] != c["part"][:-1]
        close = range_ends | (c["anchor"][1:] == c["anchor"][:-1])
        periodic = c["place"][1:-1] & _PERIODIC > 0
        some = np.flatnonzero(close[:-1] | close[1:] | periodic) + 1
        return _found(c["anchor"][some], c["key"][some], c["place"][some])

    tail, before = outside, outside
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: np.concatenate([before[k], batch.column(k).to_numpy()]) for k in names}
        new = np.zeros(len(c["part"]), bool)
        for k in ("part", "anchor", "content", "content2"):
            new[1:] |= c[k][1:] != c[k][:-1]
        again = np.flatnonzero(~new[1:]) + 1
        if len(again):
            yield _found(None, c["key"][again], c["place"][again])
        tail = {k: np.concatenate([tail[k], c[k][new]]) for k in names}
        before = {k: c[k][-1:] for k in names}
        if len(tail["part"]) > 2:
            yield candidates(tail)
            tail = {k: v[-2:] for k, v in tail.items()}
    tail = {k: np.concatenate([tail[k], outside[k]]) for k in names}
    if len(tail["part"]) > 2:
        yield candidates(tail)


def _found(anchor: np.ndarray | None, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    anchors = pa.nulls(len(key), pa.int64()) if anchor is None else pa.array(anchor, pa.int64())
    return pa.RecordBatch.from_arrays([anchors, pa.array(key, pa.int64()), pa.array(place, pa.int64())], ["anchor", "key", "place"])


def _texts(length: int, chunks=None):
    """Mapper over documents with their candidates: the bytes of each, under the hash that it is sorted by.

    ``chunks``: of windows with very many places how many chunks they are dealt out in, and the earliest place, which goes into
    each of them.
    """

    def windows(data: bytes, key: int, at: int, size: int, dealt: dict) -> Iterator[tuple[int, int, int, bytes]]:
        for k in range(at, at + size - length + 1):
            window = data[k : k + length]
            group = xxhash.xxh3_64_intdigest(window) - 2**63
            in_groups = [group]
            if group in dealt:
                n, *first = dealt[group]
                which = range(n) if [key, k] == first else [hash((key, k)) % n]
                in_groups = [xxhash.xxh3_64_intdigest(window, 1 + j) - 2**63 for j in which]
            for group in in_groups:
                yield group, key, k, window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = chunks.value if chunks is not None else {}
        for batch in batches:
            groups, keys, places, parts = [], [], [], []
            mine = batch.column("mine")
            of, ends = mine.flatten(), np.cumsum(mine.value_lengths().to_numpy()).tolist()
            anchors, place, often = (of.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "place", "often"))
            ats, sizes = place >> _PLACE, place & (_PERIODIC - 1)
            anchors, ats, sizes, often = anchors.tolist(), ats.tolist(), sizes.tolist(), often.tolist()
            for key, text, low, high in zip(batch.column("key").to_pylist(), batch.column("text"), [0, *ends], ends):
                data = text.as_buffer().to_pybytes()
                for k in range(low, high):
                    if often[k]:
                        rows = windows(data, key, ats[k], sizes[k], dealt)
                    else:
                        rows = ((anchors[k], key, ats[k], data[ats[k] : ats[k] + sizes[k]]),)
                    for group, _, at, part in rows:
                        groups.append(group)
                        keys.append(key)
                        places.append(at)
                        parts.append(part)
                    if len(parts) >= 20_000:
                        yield _part_rows(groups, keys, places, parts)
                        groups, keys, places, parts = [], [], [], []
            yield _part_rows(groups, keys, places, parts)

    return run


def _windows(length: int):
    """Mapper over documents with their candidates: hash and place of the windows of those that are dealt out by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, keys, places = [], [], []
            for key, text, mine in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("mine").to_pylist()):
                data = text.as_buffer().to_pybytes()
                for c in mine:
                    if c["often"]:
                        at, size = c["place"] >> _PLACE, c["place"] & (_PERIODIC - 1)
                        stops = range(at, at + size - length + 1)
                        groups += [xxhash.xxh3_64_intdigest(data[k : k + length]) - 2**63 for k in stops]
                        keys += [key] * len(stops)
                        places += stops
            columns = [pa.array(x, pa.int64()) for x in (groups, keys, places)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "key", "place"])

    return run


def _chunks(candidates: DataFrame, length: int, most_windows: int):
    """Windows with more than ``most_windows`` places: into how many chunks they are dealt out, and the earliest place."""
    seen = candidates.mapInArrow(_windows(length), "group long, key long, place long")
    counted = stored(
        seen.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("first")).where(F.col("n") > most_windows),
        "windows",
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(most_windows, total // BROADCAST_CLASSES)  # so no more than BROADCAST_CLASSES windows are collected
    found = counted.where(F.col("n") > least).select("group", "n", "first.*").collect()
    dealt = {r["group"]: (-(-r["n"] // least), r["key"], r["place"]) for r in found}
    return candidates.sparkSession.sparkContext.broadcast(dealt) if dealt else None


def _part_rows(groups: list, keys: list, places: list, parts: list) -> pa.RecordBatch:
    columns = [pa.array(groups, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["group", "key", "place", "part"])


def repeats(parts: list[bytes], keys: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, place, bytes)`` of the runs of bytes in ``parts`` that repeat a window which starts earlier."""
    s = Strings(parts)
    whole = np.arange(s.n) + length <= s.ends[s.owner]  # windows that end within their string
    order = suffix_array(s, length, whole)
    order = order[whole[order]]
    reach = common_prefixes(s, order, length) >= length
    group = np.cumsum(~reach)
    several = np.append(reach[1:], False) | reach
    at, group = order[several], group[several]
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    owner = s.owner[at]
    place = places[owner] + at - s.starts[owner]
    rank = np.lexsort((place, keys[owner], group))
    first = np.concatenate(([True], group[rank][1:] != group[rank][:-1]))
    # The earliest place may be there several times, once for each chunk.
    earliest = rank[first][np.cumsum(first) - 1]
    again = (keys[owner[rank]] != keys[owner[earliest]]) | (place[rank] != place[earliest])
    gone = np.sort(at[rank[again]])
    if not len(gone):
        none = np.empty(0, np.int64)
        return none, none, none
    run = np.flatnonzero(np.concatenate(([True], (gone[1:] != gone[:-1] + 1))))
    size = np.diff(np.append(run, len(gone))) + length - 1
    starts = gone[run]
    owner = s.owner[starts]
    return keys[owner], places[owner] + starts - s.starts[owner], size


def _sort_blocks(length: int):
    """Mapper over parts sorted by group: suffix arrays of blocks of whole groups."""

    def block(groups: np.ndarray, keys: np.ndarray, places: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
        key, place, size = repeats(parts, keys, places, length)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(size)], ["key", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, keys, places, parts, total = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                some = batch.slice(low, 2000)
                new = some.column("part").to_pylist()
                groups = np.concatenate([groups, some.column("group").to_numpy()])
                keys = np.concatenate([keys, some.column("key").to_numpy()])
                places = np.concatenate([places, some.column("place").to_numpy()])
                parts += new
                total += sum(map(len, new))
                cut = int(np.searchsorted(groups, groups[-1])) if total >= SORT_BYTES else 0
                if cut:
                    yield block(groups[:cut], keys[:cut], places[:cut], parts[:cut])
                    groups, keys, places, parts = groups[cut:], keys[cut:], places[cut:], parts[cut:]
                    total = sum(map(len, parts))
        if parts:
            yield block(groups, keys, places, parts)

    return run


def _spans(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, from, to)`` of the runs of each row, merged where they overlap or touch."""
    of = runs.flatten()
    row = np.repeat(np.arange(len(runs)), pc.fill_null(runs.value_lengths(), 0).to_numpy())
    at, size = of.field("at").to_numpy(), of.field("size").to_numpy()
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    # A row's places stand behind all those of the rows before, so one running maximum does for all rows.
    base = row << 32
    reach = np.maximum.accumulate(base + at + size[order])
    new = np.append(True, base[1:] + at[1:] > reach[:-1])[: len(row)]
    last = np.append(new[1:], True)[: len(row)]
    return row[new], at[new], (reach - base)[last]


def _remove(with_text: bool):
    """Mapper over documents with their runs of repeated bytes: what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, stop = _spans(batch.column("runs"))
            n_spans = np.bincount(row, minlength=batch.num_rows)
            ends = np.cumsum(n_spans).tolist()
            starts, stops = start.tolist(), stop.tolist()
            sizes, digests, texts = [], [], []
            for text, low, high in zip(batch.column("text"), [0, *ends], ends):
                data = text.as_buffer().to_pybytes()
                rest = b"".join([data[a:b] for a, b in zip([0, *stops[low:high]], [*starts[low:high], len(data)])])
                sizes.append((len(data), len(data) - len(rest)))
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    texts.append(rest)
            n_bytes, n_removed = np.array(sizes, np.int64).reshape(-1, 2).T
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes), "n_removed": pa.array(n_removed),
                "n_spans": pa.array(n_spans.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string()),
            }
            if with_text:
                borders = pa.array(np.column_stack([start, stop]).astype(np.int64).ravel())
                columns["kept"] = pa.array(texts, pa.binary())
                columns["spans"] = pa.ListArray.from_arrays(pa.array(np.array([0, *ends]) * 2, pa.int32()), borders)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text``: the key orders the documents and is their id where that tells them apart."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        return docs.withColumn("key", F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("key", F.monotonically_increasing_id())
    return stored(ordered, "documents")


def _borders(docs: DataFrame, length: int, parts: int) -> tuple[np.ndarray, ...]:
    """Where the ranges of (anchor, content, key) end, by the segments of about SAMPLE_DOCUMENTS documents.

    They only say how evenly the work is dealt out; the result is the same with any.
    """
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit("borders"), "key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    seen = some.select("key", "text").mapInArrow(_cut(length, None), "anchor long, content long, key long")
    rows = seen.where(F.pmod(F.xxhash64("anchor", "content", "key"), F.lit(16)) == 0).toArrow()
    columns = [rows.column(k).to_numpy() for k in ("anchor", "content", "key")]
    order = np.lexsort(columns[::-1])
    at = order[np.linspace(0, len(order), parts + 1).astype(int)[1:-1]] if len(order) else order
    return tuple(c[at] for c in columns)


def repeated_runs(
    docs: DataFrame, length: int = LENGTH, most_segments: int = MOST_SEGMENTS, dealt: DataFrame | None = None,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """``key, at, size``: runs of bytes of the documents (``key, text``) that repeat earlier windows; they may overlap.

    ``dealt``: the same documents dealt out by ``key``, if the caller has them so; candidates are joined with these.
    """
    if not ANCHOR <= length <= 160:
        raise ValueError(f"length must be {ANCHOR} to 160 bytes")
    n = shuffle_partitions(docs.sparkSession)
    cut = docs.select("key", "text").mapInArrow(
        _cut(length, _borders(docs, length, n)), "part int, anchor long, content long, content2 long, key long, place long"
    )
    met = (
        cut.repartitionById(n, "part")
        # A partition is one part.  By the anchor, which differs early, Spark compares most rows by their prefix alone.
        .sortWithinPartitions("anchor", "content", "content2", "key", "place")
        .mapInArrow(_meet, "anchor long, key long, place long")
    )
    met = stored(met, "segments")
    size = F.col("place").bitwiseAND(F.lit(_PERIODIC - 1))
    known = met.where("anchor is null").select("key", F.shiftright("place", _PLACE).alias("at"), size.alias("size"))
    candidates = met.where("anchor is not null")
    often = stored(candidates.groupBy("anchor").count().where(F.col("count") > most_segments), "often")
    n_often = often.count()
    often = often.select("anchor", F.lit(True).alias("often"))
    marked = candidates.join(F.broadcast(often) if n_often <= BROADCAST_ROWS else often, "anchor", "left").select(
        "key", F.struct("anchor", "place", F.coalesce("often", F.lit(False)).alias("often")).alias("one")
    )
    listed = F.collect_list("one").alias("mine")
    chunks = None
    if n_often:
        by_window = stored(marked.where("one.often"), "often-segments")
        few = by_window.count() <= BROADCAST_ROWS  # then no text moves for the counts
        by_window = by_window.groupBy("key").agg(listed)
        chunks = _chunks(docs.join(F.broadcast(by_window) if few else by_window, "key").select("key", "text", "mine"), length, most_windows)
    sorted_ = (
        (docs if dealt is None else dealt)
        .join(marked.groupBy("key").agg(listed), "key")
        .select("key", "text", "mine")
        .mapInArrow(_texts(length, chunks), "group long, key long, place long, part binary")
        .repartition(n, "group")
        .sortWithinPartitions("group")
        .mapInArrow(_sort_blocks(length), "key long, at long, size long")
    )
    return known.union(sorted_)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
    most_segments: int = MOST_SEGMENTS, with_text: bool = True, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``with_text``, ``kept`` (the bytes
    that are left) and ``spans`` (from, to, from, to, ..)."""
    texts = _keyed(id_and_text(docs, id_col, text_col))
    n = shuffle_partitions(docs.sparkSession)
    dealt = texts.select("key", "doc_id", "text").repartition(n, "key")  # used twice; Spark reuses the exchange
    runs = repeated_runs(texts, length, most_segments, dealt, most_windows)
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("at", "size")).alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = dealt.join(runs, "key", "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_remove(with_text), schema + (", kept binary, spans array<long>" if with_text else ""))
