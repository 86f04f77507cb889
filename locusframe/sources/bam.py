"""BAM files as a data source of Spark: ``spark.read.format("bam")`` and ``df.write.format("bam")``.

Reading.  A file of any size is read in splits of ``split_bytes``.  A task finds the first compressed block of its split by
signature, from which a chain of blocks must follow, and in it the first record, from which several records in a row must look
right; it reads all records that begin in its blocks.  Of a file of more than MOST_TASKS splits a task reads several in a row.
``read_bam`` counts the records of each split to give them their ordinal in
the file, and checks on the way that each split begins where the one before ends: a split that does not (a record may hold others
in its tags) is read from there instead.  A header is read from the first bytes.  A gzip file that is no file of blocks is one task's work.

Regions.  Where an index lies beside a file (``x.bam.bai``), filters on ``rname``, ``pos0`` and ``end0`` or the regions of
``read_regions`` become stretches of the file, and only these are read, in pieces of ``split_bytes``.

Writing.  Each task writes one file, with header and, if its records are sorted by position, index, into a hidden folder; the
driver moves all of them into place when all tasks are done.  If a task fails it is removed, and nothing is left.  ``join_files``
makes one file of many, each piece by a task of its own.

The stores are those that pyarrow reaches (local and shared folders, HDFS, S3, Google Cloud Storage).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from locusframe.sources.bam_index import Index, IndexBuilder, merged
from locusframe.sources.bam_records import MAGIC, SCHEMA, bins, columns, encoded, first_record, record_starts
from locusframe.sources.bgzf import BLOCK_BYTES, LAST_BLOCK, BlockFile, Stretch, file_system, listed, packed_block, unpacked_members

SPLIT_BYTES = 64 << 20
#: Tasks that read one file, as long as none reads more than SPLIT_BYTES.
MOST_TASKS = 1024
#: Bytes of unpacked data that are made into rows at once.
BATCH_BYTES = 4 << 20
COUNTS = "path string, split long, stop long, records long, first long, next long"
HEADERS = "path string, text string, refs array<struct<name:string,len:bigint>>"
_REFS = pa.list_(pa.struct([("name", pa.string()), ("len", pa.int64())]))


class _Bytes:
    """Takes from an iterator of pieces what is asked for."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data, self.at = pieces, b"", 0

    def more(self) -> bool:
        part = next(self.pieces, None)
        if part is not None:
            self.data, self.at = self.data[self.at :] + part, 0
        return part is not None

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            if not self.more():
                raise ValueError("the file ends within its header")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _header(source: _Bytes) -> tuple[str, list[tuple[str, int]]]:
    if not (source.data or source.more()) or source.take(4) != MAGIC:
        raise ValueError("not a BAM file")
    text, refs = source.take(source.number()).rstrip(b"\0").decode(), []
    for _ in range(source.number()):
        name = source.take(source.number())[:-1].decode()
        refs.append((name, source.number()))
    return text, refs


class _File:
    """An open file with its header; ``blocks`` is None for a gzip file that is no file of blocks."""

    def __init__(self, path: str):
        store, inner = file_system(path)
        self.size = store.get_file_info(inner).size
        self.file = store.open_input_file(inner)
        self.blocks: BlockFile | None = BlockFile(self.file, self.size)
        if self.blocks.block_size(0) is None:
            self.blocks = None
            self.file.seek(0)
            self.rest = _Bytes(unpacked_members(self.file))
            self.text, self.refs = _header(self.rest)
            return
        stretch = Stretch(self.blocks, 0)

        def pieces() -> Iterator[bytes]:
            yield stretch.data
            seen = len(stretch.data)
            while stretch.more():
                yield stretch.data[seen:]
                seen = len(stretch.data)

        source = _Bytes(pieces())
        self.text, self.refs = _header(source)
        used = len(stretch.data) - (len(source.data) - source.at)
        self.first = int(stretch.offsets(np.array([used]))[0])

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def start_of(self, start: int, end: int) -> int | None:
        """The virtual offset of the first record that begins in blocks of [start, end)."""
        if self.first >> 16 >= start:
            return self.first if self.first >> 16 < end else None
        at = self.blocks.first_block(start)
        if at is None or at >= end:
            return None
        return first_record(Stretch(self.blocks, at << 16), end, [n for _, n in self.refs])

    def pieces(self, start: int, stop: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """``data, starts, offsets``: the records that begin at virtual offsets of [start, stop); offsets has one more, what follows."""
        stretch = Stretch(self.blocks, start)
        while True:
            starts, at = record_starts(stretch.data)
            offsets = stretch.offsets(np.array([*starts, at], np.int64))
            mine = int(np.searchsorted(offsets[:-1], stop))
            if mine:
                yield stretch.data, np.array(starts[:mine], np.int64), offsets[: mine + 1]
            if mine < len(starts) or offsets[-1] >= stop:
                return
            stretch.drop(at)
            if not stretch.more(BATCH_BYTES, stop):
                if stretch.data:
                    raise ValueError("the file ends within a record")
                return

    def all_pieces(self) -> Iterator[tuple[bytes, np.ndarray, None]]:
        """The records of a gzip file that is no file of blocks."""
        source = self.rest
        while True:
            data = source.data[source.at :]
            starts, at = record_starts(data)
            if starts:
                yield data, np.array(starts, np.int64), None
            source.at += at
            while len(source.data) - source.at < BATCH_BYTES:
                if not source.more():
                    break
            if len(source.data) - source.at == len(data) - at:
                if len(data) > at:
                    raise ValueError("the file ends within a record")
                return


@dataclass
class _Part(InputPartition):
    """``split``: records that begin in blocks of [start, end) of the file; else records at virtual offsets of [start, end).

    ``first``: where the first record of a split is known to be; -1: no record begins in it.
    """

    path: str
    start: int
    end: int
    split: bool
    first: int | None = None


def task_bytes(size: int, split_bytes: int) -> int:
    """Bytes of a file that a task reads: one split, or several in a row where there are more than MOST_TASKS of them."""
    most = max(1, SPLIT_BYTES // split_bytes)
    return split_bytes * min(most, max(1, -(-size // (split_bytes * MOST_TASKS))))


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "records")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        regions = options.get("regions")
        self.firsts, self.only = json.loads(options.get("firsts", "{}")), options.get("only_firsts") == "true"
        self.regions: list[tuple[str, int, int]] | None = [tuple(r) for r in json.loads(regions)] if regions else None

    def pushFilters(self, filters):
        """Bounds of one region per reference; the filters hold afterwards as well, since a stretch holds other records too."""
        names, low, high = None, 0, 1 << 40
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "rname" and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                names = found if names is None else names & found
            elif column == "pos0" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                high = min(high, f.value + (not isinstance(f, LessThan)))
            if column == "end0" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value - isinstance(f, GreaterThanOrEqual))
            elif column == "pos0" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                low = max(low, f.value)
            yield f
        if names is not None and self.regions is None:
            self.regions = [(n, low, high) for n in sorted(names) if n is not None]

    def partitions(self):
        files = listed(self.path, ".bam")
        if self.mode == "headers":
            return [_Part(path, 0, 0, True) for path, _ in files]
        parts = []
        for path, size in files:
            chunks = self._chunks(path, size) if self.regions is not None else None
            if chunks is None:
                step = task_bytes(size, self.split_bytes)
                known = self.firsts.get(path, {})
                splits = (int(k) for k in known) if self.only else range(0, size, step)
                parts += [_Part(path, k, min(k + step, size), True, known.get(str(k))) for k in splits]
            else:
                parts += [_Part(path, a, b, False) for a, b in chunks]
        return parts or [None]

    def _chunks(self, path: str, size: int) -> list[tuple[int, int]] | None:
        """Stretches of a file that may have records of the regions; None without an index."""
        store, inner = file_system(path + ".bai")
        if store.get_file_info(inner).type != fs.FileType.File:
            return None
        with store.open_input_file(inner) as file:
            index = Index(file.read())
        with _File(path) as file:
            ids = {name: k for k, (name, _) in enumerate(file.refs)}
        chunks = merged([c for name, start, end in self.regions for c in index.chunks(ids.get(name, -1), max(start, 0), end)])
        pieces = []
        for a, b in chunks:
            # Long stretches are cut at blocks: each piece but the first finds its own first record.
            step = task_bytes(size, self.split_bytes)
            cuts = list(range((a >> 16) + step, b >> 16, step))
            pieces += zip([a, *[c << 16 for c in cuts]], [*[c << 16 for c in cuts], b])
        return pieces

    def read(self, partition):
        if partition is None:
            return
        with _File(partition.path) as file:
            if self.mode == "headers":
                refs = pa.array([[{"name": n, "len": k} for n, k in file.refs]], _REFS)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([file.text]), refs], ["path", "text", "refs"])
                return
            pieces, start, stop = iter(()), None, None
            if file.blocks is None:
                if partition.start == 0:
                    pieces = file.all_pieces()
            elif partition.split:
                start, stop = partition.first, partition.end << 16
                if start is None:
                    start = file.start_of(partition.start, partition.end)
                elif start < 0:
                    start = None
            else:
                start, stop = partition.start, partition.end
                if start & 0xFFFF == 0 and file.blocks.block_size(start >> 16) is None:
                    start = file.start_of(start >> 16, -(-stop >> 16))  # a cut within a stretch
            if start is not None:
                pieces = file.pieces(start, stop)
            if self.mode == "counts":
                records, after = 0, start
                for _, starts, offsets in pieces:
                    records += len(starts)
                    after = None if offsets is None else int(offsets[-1])
                first = start if records else None
                row = [[partition.path], [partition.start], [partition.end], [records], [first], [after if records else None]]
                names = ["path", "split", "stop", "records", "first", "next"]
                yield pa.RecordBatch.from_arrays([pa.array(row[0])] + [pa.array(c, pa.int64()) for c in row[1:]], names)
                return
            names, k = [n for n, _ in file.refs], 0
            schema = [c.split()[0] for c in SCHEMA.replace("array<struct<op:string,len:bigint>>", "x").split(", ")]
            for data, starts, offsets in pieces:
                n = len(starts)
                place = [
                    pa.array([partition.path] * n, pa.string()), pa.array(np.full(n, partition.start)), pa.array(np.arange(k, k + n)),
                    pa.nulls(n, pa.int64()) if offsets is None else pa.array(offsets[:-1]),
                ]
                k += n
                yield pa.RecordBatch.from_arrays([*place, *columns(data, starts, names)], schema)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class BamWriter(DataSourceArrowWriter):
    """Two-phase: tasks write into a hidden folder, the driver moves what they wrote, or removes it."""

    def __init__(self, options, overwrite: bool):
        self.path, self.text, self.refs = options["path"].rstrip("/"), options.get("text", ""), json.loads(options["refs"])
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        store, inner = file_system(self.path)
        if not overwrite and store.get_file_info(inner).type == fs.FileType.Directory and listed(self.path, ".bam"):
            self.prefix = f"part-{self.job[:8]}-"  # appended
        else:
            self.prefix = "part-"
        # Made by the driver, so that a task that is late finds it gone.
        self.hidden = f"{inner}/_temporary-{self.job}"
        store.create_dir(self.hidden, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        store, _ = file_system(self.path)
        # Attempts of a task write files of their own; only the one whose message arrives is moved.
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.bam"
        header = MAGIC + struct.pack("<i", len(self.text.encode())) + self.text.encode() + struct.pack("<i", len(self.refs))
        for ref, length in self.refs:
            header += struct.pack("<i", len(ref.encode()) + 1) + ref.encode() + b"\0" + struct.pack("<i", length)
        index, ids = IndexBuilder(len(self.refs)), {ref: k for k, (ref, _) in enumerate(self.refs)}
        with store.open_output_stream(f"{self.hidden}/{name}") as out:
            at, held = 0, b""
            for k in range(0, len(header), BLOCK_BYTES):
                at += out.write(packed_block(header[k : k + BLOCK_BYTES]))
            for batch in iterator:
                if not batch.num_rows:
                    continue
                data, starts, refs, pos, end0 = encoded(batch, ids)
                stream, before, places = held + data.tobytes(), len(held), []
                whole = len(stream) - len(stream) % BLOCK_BYTES
                for k in range(0, whole, BLOCK_BYTES):
                    places.append(at)
                    at += out.write(packed_block(stream[k : k + BLOCK_BYTES]))
                places.append(at)
                held = stream[whole:]
                edges = np.append(starts, len(data)) + before
                offsets = (np.array(places, np.int64)[edges // BLOCK_BYTES] << 16) + edges % BLOCK_BYTES
                index.add(refs, pos, end0, bins(pos, end0), offsets[:-1], offsets[1:])
            if held:
                out.write(packed_block(held))
            out.write(LAST_BLOCK)
        names = [name]
        if index.sorted:
            with store.open_output_stream(f"{self.hidden}/{name}.bai") as out:
                out.write(index.encoded())
            names.append(name + ".bai")
        return _Written(names)

    def commit(self, messages):
        store, inner = file_system(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(inner)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for message in messages:
            for name in message.names if message else ():
                task, rest = name.split("-", 1)
                store.move(f"{self.hidden}/{name}", f"{inner}/{self.prefix}{task}{rest[rest.index('.'):]}")
        self._forget(store)

    def abort(self, messages):
        self._forget(file_system(self.path)[0])

    def _forget(self, store) -> None:
        if store.get_file_info(self.hidden).type == fs.FileType.Directory:
            store.delete_dir(self.hidden)


class BamSource(DataSource):
    """Options: ``path``; reading: ``split_bytes``, ``regions``, ``mode``; writing: ``text`` and ``refs`` of the header."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return {"records": SCHEMA, "counts": COUNTS, "headers": HEADERS}[self.options.get("mode", "records")]

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``bam`` known, and lets filters reach it."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _source(spark: SparkSession, path: str, **options):
    register(spark)
    reader = spark.read.format("bam")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, ordinals: bool = True) -> DataFrame:
    """Records of BAM files.  ``rec_idx``: the ordinal of each in its file, for which the splits are counted first.

    Without ordinals, as with ``spark.read.format("bam")``, nothing is counted, and that splits begin at true records is not checked:
    for files whose tags hold no whole records.
    """
    found = _source(spark, path, split_bytes=split_bytes)
    if not ordinals:
        return found.drop("split", "in_split")
    counts = _source(spark, path, split_bytes=split_bytes, mode="counts").collect()  # one row per task
    by_file: dict[str, list] = {}
    for r in counts:
        by_file.setdefault(r["path"], []).append(r)
    rows, firsts = [], {}
    for name, splits in by_file.items():
        before, after = 0, None
        for r in sorted(splits, key=lambda r: r["split"]):
            want = r["first"] if after is None else after if after >> 16 < r["stop"] else None
            if r["first"] != want and (want is not None or r["records"]):
                # Not where the split before ends: from there, or nothing.
                known = {name: {str(r["split"]): -1 if want is None else want}}
                firsts.setdefault(name, {}).update(known[name])
                again = _source(spark, r["path"], split_bytes=split_bytes, mode="counts", firsts=json.dumps(known), only_firsts="true")
                r = again.first()
            rows.append((name, r["split"], before))
            if r["records"]:
                before, after = before + r["records"], r["next"]
    if firsts:
        found = _source(spark, path, split_bytes=split_bytes, firsts=json.dumps(firsts))
    offsets = spark.createDataFrame(rows, "path string, split long, before long")
    whole = found.join(F.broadcast(offsets), ["path", "split"])  # some 60 bytes per task
    kept = [c for c in found.columns if c not in ("path", "split", "in_split", "voffset")]
    return whole.select("path", (F.col("before") + F.col("in_split")).alias("rec_idx"), *kept, "voffset")


def read_regions(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Mapped records that overlap any of the regions (name, start, end: 0-based, half-open), each once.

    Files with an index beside them are read where the regions may be, others whole.
    """
    found = _source(spark, path, split_bytes=split_bytes, regions=json.dumps(regions)).drop("split", "in_split")
    inside = F.lit(False)
    for name, start, end in regions:
        inside |= (F.col("rname") == name) & (F.col("pos0") < end) & (F.col("end0") > start)
    return found.where(inside)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, refs``: one row per file, from its first bytes."""
    return _source(spark, path, mode="headers")


def write_bam(records: DataFrame, path: str, text: str, refs: list[tuple[str, int]], mode: str = "errorifexists") -> None:
    """A file per partition, in the order of the rows (``orderBy("rec_idx")`` for that of their file, or by reference and position,
    in the order of ``refs``, for files with an index)."""
    register(records.sparkSession)
    store, inner = file_system(path)
    if mode == "errorifexists" and store.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    names = ["qname", "flag", "rname", "pos0", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
    rows = records.select(*names)
    rows.write.format("bam").option("text", text).option("refs", json.dumps(refs)).mode("overwrite" if mode == "overwrite" else "append").save(path)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """One file of all files in a folder, in the order of their names; each is copied to its place by a task of its own.

    Their headers are left out but for the first, and so are their last blocks.  For folders that are mounted everywhere, since a
    task writes into the middle of a file.
    """
    files = listed(folder, ".bam")
    places = []
    at = 0
    for k, (name, size) in enumerate(files):
        with _File(name) as file:
            # Headers end with a block, as ``write_bam`` makes them.
            start = 0 if k == 0 else file.first >> 16
            if k and file.first & 0xFFFF:
                raise ValueError(f"{name}: the header does not end with a block")
        end = size if k == len(files) - 1 else size - len(LAST_BLOCK)
        places.append((k, name, start, end, at))
        at += end - start
    target = file_system(path)[1]
    with open(target, "xb") as out:
        out.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = file_system(row["name"])
                with store.open_input_file(inner) as source, open(target, "r+b") as out:
                    source.seek(row["start"])
                    out.seek(row["place"])
                    left = row["end"] - row["start"]
                    while left:
                        piece = source.read(min(left, 8 << 20))
                        out.write(piece)
                        left -= len(piece)
            yield batch

    if places:
        rows = spark.createDataFrame(places, "k int, name string, start long, end long, place long").repartitionById(len(places), "k")
        rows.mapInArrow(copy, rows.schema).write.format("noop").mode("overwrite").save()
