"""Alignment records between their binary form and Arrow columns, many at once."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = (
    "path string, split long, in_split long, voffset long, qname string, flag int, rname string, pos0 long, end0 long, mapq int, "
    "cigar array<struct<op:string,len:bigint>>, rnext string, pnext long, tlen long, seq string, qual string, tags binary"
)
#: Fixed values of the format: letters of operations and of bases by their codes, those that go along the reference, the magic.
OPS, BASES, ALONG, MAGIC = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", "MDN=X", b"BAM\x01"
#: No record is larger; records in a row that must look right where one is said to begin.
MOST_RECORD_BYTES, IN_A_ROW = 1 << 26, 8

_FIXED = np.dtype(
    [
        ("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"),
        ("n_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4"),
    ]
)
_BASES, _ALONG = np.frombuffer(BASES.encode(), np.uint8), np.array([c in ALONG for c in OPS] + [False] * 7)
_CODES = np.full(256, 255, np.uint8)
_CODES[_BASES] = np.arange(16)
_CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int64())]))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


def _strings(data: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None, kind=pa.string()) -> pa.Array:
    offsets = pa.array(_offsets(sizes), pa.int32())
    buffers = [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data, np.uint8))]
    found = pa.Array.from_buffers(kind, len(sizes), buffers)
    if null is None or not null.any():
        return found
    return pc.if_else(pa.array(null), pa.scalar(None, kind), found)


def record_starts(data: bytes) -> tuple[list[int], int]:
    """Where the whole records of ``data`` begin, and where the first one that is cut off does."""
    starts, at, n = [], 0, len(data)
    size_at = struct.Struct("<i").unpack_from
    while at + 4 <= n:
        size = size_at(data, at)[0]
        if size < 32:
            raise ValueError(f"a record of {size} bytes")
        if at + 4 + size > n:
            break
        starts.append(at)
        at += 4 + size
    return starts, at


def fixed_fields(data: bytes, starts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    rows = raw[np.asarray(starts, np.int64)[:, None] + np.arange(_FIXED.itemsize)]
    return rows.reshape(-1).view(_FIXED)


def spans(data: bytes, starts: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations' codes and lengths of all records, and the end on the reference (at least one base after the start)."""
    n_ops = fixed["n_ops"].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    bytes_ = raw[spread(starts + 36 + fixed["n_name"], 4 * n_ops)]
    ops = bytes_.view("<u4") if len(bytes_) else np.empty(0, "<u4")
    codes, lengths = (ops & 15).astype(np.int64), (ops >> 4).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(np.where(_ALONG[codes], lengths, 0))))
    ends = np.cumsum(n_ops)
    span = sums[ends] - sums[ends - n_ops]
    return codes, lengths, np.where(fixed["pos"] >= 0, fixed["pos"].astype(np.int64) + np.maximum(span, 1), fixed["pos"])


def columns(data: bytes, starts: np.ndarray, names: list[str]) -> list[pa.Array]:
    """``qname`` to ``tags`` of the records."""
    raw, fixed = np.frombuffer(data, np.uint8), fixed_fields(data, starts)
    n_name, n_ops, n_seq = (fixed[c].astype(np.int64) for c in ("n_name", "n_ops", "n_seq"))
    at = starts + 36
    qname = _strings(raw[spread(at, n_name - 1)], n_name - 1)
    codes, lengths, end0 = spans(data, starts, fixed)
    letters = pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(list(OPS))).dictionary_decode()
    pairs = pa.StructArray.from_arrays([letters, pa.array(lengths)], names=["op", "len"])
    cigar = pa.ListArray.from_arrays(pa.array(_offsets(n_ops), pa.int32()), pairs)
    at = at + n_name + 4 * n_ops
    within = spread(np.zeros(len(starts), np.int64), n_seq)
    both = raw[np.repeat(at, n_seq) + (within >> 1)]
    seq = _strings(_BASES[np.where(within & 1, both & 15, both >> 4)], n_seq, n_seq == 0)
    at = at + (n_seq + 1) // 2
    quality = raw[spread(at, n_seq)]
    first = raw[np.minimum(at, len(raw) - 1)]
    absent = (n_seq == 0) | (first == 255)
    qual = _strings(quality[np.repeat(~absent, n_seq)] + np.uint8(33), np.where(absent, 0, n_seq), absent)
    at = at + n_seq
    n_tags = starts + 4 + fixed["size"] - at
    tags = _strings(raw[spread(at, n_tags)], n_tags, kind=pa.binary())
    known = pa.array(names, pa.string())
    name = lambda c: known.take(pa.array(fixed[c], mask=fixed[c] < 0)) if names else pa.nulls(len(fixed), pa.string())
    long = lambda c: pa.array(fixed[c].astype(np.int64))
    return [
        qname, pa.array(fixed["flag"].astype(np.int32)), name("ref"), long("pos"), pa.array(end0), pa.array(fixed["mapq"].astype(np.int32)), cigar.cast(_CIGAR),
        name("next_ref"), long("next_pos"), long("tlen"), seq, qual, tags,
    ]


# Where records begin ------------------------------------------------------------------------------------------------------------


def _looks_right(data: bytes, at: int, lengths: list[int]) -> int | None:
    """The size of what may be a record there, None if it is none."""
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    n = len(lengths)
    if not (32 <= size <= MOST_RECORD_BYTES and -1 <= ref < n and -1 <= next_ref < n and pos >= -1 and next_pos >= -1 and n_name and n_seq >= 0):
        return None
    if 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size or ref >= 0 and pos > lengths[ref] or next_ref >= 0 and next_pos > lengths[next_ref]:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops : 4]
    return None if any(c & 15 > 8 for c in ops) else size


def first_record(stretch, end: int, lengths: list[int]) -> int | None:
    """The virtual offset of the first record that begins in a block before ``end``; ``stretch`` starts at a block.

    A record begins where IN_A_ROW records, or all up to the end of the file, look right one after the other.
    """
    tried = 0
    while True:
        ended = not stretch.more() if tried or not stretch.data else False
        data = stretch.data
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        n = len(raw) - 36
        if n > tried:
            # All places at once by what is cheap to see.
            word = lambda k: (raw[tried + k : n + k] | raw[tried + k + 1 : n + k + 1] << 8 | raw[tried + k + 2 : n + k + 2] << 16 | raw[tried + k + 3 : n + k + 3] << 24)  # noqa: E731,B023
            size, ref = word(0), word(4)
            near = (size >= 32) & (size <= MOST_RECORD_BYTES) & ((ref < len(lengths)) | (ref == 0xFFFFFFFF)) & (raw[tried + 12 : n + 12] > 0)
            for at in (np.flatnonzero(near) + tried).tolist():
                place = int(stretch.offsets(np.array([at]))[0])
                if place >> 16 >= end:
                    return None
                if _row_of_records(stretch, at, lengths):
                    return place
            tried = n
            if int(stretch.offsets(np.array([n]))[0]) >> 16 >= end:
                return None
        if ended or not len(data):
            return None


def _row_of_records(stretch, at: int, lengths: list[int]) -> bool:
    for _ in range(IN_A_ROW):
        while at + 36 > len(stretch.data):
            if not stretch.more():
                return at == len(stretch.data)
        size = _looks_right(stretch.data, at, lengths)
        if size is None:
            return False
        at += 4 + size
    return True


# Records to bytes ---------------------------------------------------------------------------------------------------------------


def bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin of the index that holds [start, end): 5 levels, each 8 times as fine as the one above."""
    found = np.zeros(len(start), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        same = start >> shift == (end - 1) >> shift
        found[same] = first + (start[same] >> shift)
    found[start < 0] = 4680
    return found


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the size of each; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, np.diff(offsets)


def encoded(batch: pa.RecordBatch, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All records one after the other, where each begins, and their reference, start and end."""
    n = batch.num_rows
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    number = lambda c, empty: column(c).cast(pa.int64()).fill_null(empty).to_numpy(zero_copy_only=False)

    def ref(c: str) -> np.ndarray:
        names = column(c).dictionary_encode()
        table = np.array([ids.get(x, -1) for x in names.dictionary.to_pylist()] + [-1], np.int64)
        return table[names.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]

    names, n_name = _bytes_of(column("qname"))
    if n and n_name.max() > 254:
        raise ValueError("a read name is longer than 254 bytes")
    seq, n_seq = _bytes_of(column("seq"))
    qual, n_qual = _bytes_of(column("qual"))
    if ((n_qual > 0) & (n_qual != n_seq)).any():
        raise ValueError("a read has other than one quality per base")
    tags, n_tags = _bytes_of(column("tags"))
    lists = column("cigar").fill_null([])
    n_ops = np.diff(lists.offsets.to_numpy())
    if n and n_ops.max() > 65535:
        raise ValueError("an alignment has more than 65535 operations")
    pairs = lists.flatten()
    op = pairs.field("op").dictionary_encode()
    codes = np.array([OPS.index(x) for x in op.dictionary.to_pylist()], np.int64)[op.indices.to_numpy(zero_copy_only=False)]
    lengths = pairs.field("len").to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(np.where(_ALONG[codes], lengths, 0))))
    ends = np.cumsum(n_ops)
    pos = number("pos0", -1)
    end0 = np.where(pos >= 0, pos + np.maximum(sums[ends] - sums[ends - n_ops], 1), pos)
    half = (n_seq + 1) // 2
    size = 36 + n_name + 1 + 4 * n_ops + half + n_seq + n_tags
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    fixed = np.zeros(n, _FIXED)
    refs = ref("rname")
    for c, v in {
        "size": size - 4, "ref": refs, "pos": pos, "n_name": n_name + 1, "mapq": number("mapq", 255), "bin": bins(pos, end0), "n_ops": n_ops,
        "flag": number("flag", 4), "n_seq": n_seq, "next_ref": ref("rnext"), "next_pos": number("pnext", -1), "tlen": number("tlen", 0),
    }.items():
        fixed[c] = v
    out[starts[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = starts + 36
    out[spread(at, n_name)] = names
    at = at + n_name + 1
    out[spread(at, 4 * n_ops)] = (lengths << 4 | codes).astype("<u4").view(np.uint8)
    at = at + 4 * n_ops
    bases = _CODES[seq]
    if (bases == 255).any():
        raise ValueError("a base has no code")
    within = spread(np.zeros(n, np.int64), n_seq)
    place, odd = np.repeat(at, n_seq) + (within >> 1), (within & 1).astype(bool)
    out[place[~odd]] = bases[~odd] << 4
    out[place[odd]] |= bases[odd]
    at = at + half
    out[spread(at, n_seq)] = 255
    out[spread(at, n_qual)] = qual - np.uint8(33)
    out[spread(at + n_seq, n_tags)] = tags
    return out, starts, refs, pos, end0
