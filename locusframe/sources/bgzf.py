"""Files of compressed blocks: gzip members that say how long they are, so that a reader may begin at any of them.

A place in what they hold is a virtual offset: the block's place in the file, times 65536, plus the place within its data.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: Fixed values of the format: the beginning of a block and the empty last block.
SIGNATURE = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of data in a block that is written, of a file that are fetched at once, and blocks that must follow a block's start.
BLOCK_BYTES, FETCH_BYTES, CHAIN = 60_000, 1 << 20, 4


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A store that Python can read, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, of the visible files in a folder with that suffix, or of those that match the last part of a path."""
    store, inner = file_system(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, name = inner.rstrip("/").rpartition("/")
    if not any(c in name for c in "*?["):
        found = store.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found.type == fs.FileType.File:
            return [(path, found.size)]
        folder, name = inner.rstrip("/"), "*" + suffix
    files = store.get_file_info(fs.FileSelector(folder))
    fits = [f for f in files if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name) and f.base_name[0] not in "_."]
    return sorted((head + f.path, f.size) for f in fits if not f.base_name.endswith(".bai"))


class BlockFile:
    """Reads blocks of an open file at given places."""

    def __init__(self, file, size: int):
        self.file, self.size, self.held, self.at = file, size, b"", 0

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.held, self.at = self.file.read(max(n, FETCH_BYTES)), at
        return self.held[at - self.at : at - self.at + n]

    def block_size(self, at: int) -> int | None:
        """Bytes of the block that begins there; None if none does."""
        head = self.bytes_at(at, 18)
        if len(head) < 18 or head[:4] != SIGNATURE:
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, k = self.bytes_at(at + 12, extra), 0
        while k + 4 <= len(fields):
            n = struct.unpack_from("<H", fields, k + 2)[0]
            if fields[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(fields):
                return struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + n
        return None

    def block(self, at: int) -> tuple[bytes, int]:
        """The data of the block there and where the next one begins."""
        size = self.block_size(at)
        if size is None:
            raise ValueError(f"no compressed block begins at {at}")
        packed = self.bytes_at(at, size)
        if len(packed) < size:
            raise ValueError("the file ends within a compressed block")
        start = 12 + struct.unpack_from("<H", packed, 10)[0]
        data = zlib.decompress(packed[start:-8], -15)
        if struct.unpack_from("<II", packed, size - 8) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at {at} is damaged")
        return data, at + size

    def first_block(self, at: int) -> int | None:
        """Where the first block at or after a place begins: a signature from which a chain of blocks follows."""
        while at < self.size:
            piece = self.bytes_at(at, FETCH_BYTES)
            k = piece.find(SIGNATURE)
            while k >= 0:
                if self._chains(at + k):
                    return at + k
                piece = self.bytes_at(at, FETCH_BYTES)
                k = piece.find(SIGNATURE, k + 1)
            at += max(1, len(piece) - len(SIGNATURE) + 1)
        return None

    def _chains(self, at: int) -> bool:
        for _ in range(CHAIN):
            size = self.block_size(at)
            if size is None or at + size > self.size:
                return False
            at += size
            if at == self.size:
                return True
        return True


class Stretch:
    """Data from a virtual offset on, in pieces that know where each of their bytes is."""

    def __init__(self, blocks: BlockFile, start: int):
        self.blocks, self.next, skip = blocks, start >> 16, start & 0xFFFF
        self.data, self.firsts, self.places = b"", [], []
        if self.next < blocks.size:
            self.more()
            self.drop(skip)

    def more(self, least: int = 1, stop: int | None = None) -> bool:
        """Another ``least`` bytes or more, but of blocks that begin at or after ``stop`` one at most; False if the file has none."""
        parts, n = [self.data], 0
        while self.next < self.blocks.size and (not n or n < least and (stop is None or self.next << 16 < stop)):
            place = self.next
            data, self.next = self.blocks.block(place)
            if data:
                self.firsts.append(len(self.data) + n)
                self.places.append(place << 16)
                parts.append(data)
                n += len(data)
        self.data = b"".join(parts)
        return n > 0

    def drop(self, n: int) -> None:
        """Forget the first ``n`` bytes."""
        while len(self.firsts) > 1 and self.firsts[1] <= n:
            del self.firsts[0], self.places[0]
        self.data = self.data[n:]
        self.firsts = [k - n for k in self.firsts]
        if self.firsts and not self.data and self.firsts[0] <= 0:
            self.firsts, self.places = [], []

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Virtual offsets of places in ``data``; the place behind its last byte is the next block."""
        firsts, places = np.array([*self.firsts, len(self.data)], np.int64), np.array([*self.places, self.next << 16], np.int64)
        k = np.searchsorted(firsts, at, "right") - 1
        return places[k] + (at - firsts[k])


def packed_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def unpacked_members(file) -> Iterator[bytes]:
    """What a gzip file of any number of members holds, unpacked only as far as it is taken."""
    member = None
    while piece := file.read(1 << 16):
        while piece:
            if member is None:
                piece = piece.lstrip(b"\0")  # padding between members
                if not piece:
                    break
                member = zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = None
    if member is not None:
        raise ValueError("the file ends within a compressed block")
