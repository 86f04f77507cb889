"""Token counts of documents in flat token files.

A flat token file is nothing but ids of a fixed width (2 or 4 bytes), each document followed by the end-of-document id: no
lengths, no index.  Spark cuts files of any size into blocks (its splits) and reads each block in a task of its own, from any
store: its line reader, with the bytes of the end id as line separator, hands over whole stretches of bytes.  (An end id whose
bytes begin as they end, such as 0, leaves it open where a run of them is to be cut; then a byte that is not in it separates
lines.)  Where that found the pattern, it may stand across two ids.  So a block's bytes are put together again and searched with
one vectorised comparison for each alignment of ids that the block may have; nothing but the bytes before a block tells which of
them is the right one.

How many bytes and how many end ids precede a block are prefix sums over the blocks of its file.  The first gives the alignment,
the second the number of the document that a part at the border of a block belongs to.  Parts of a document are then added: two
rows for each block and alignment, whatever the size of the documents.

Special cases: null text counts as empty and has 0 tokens; a text of any length is encoded and counted as a whole, but no
document's ids may need 2 GB, which is Spark's limit for a value; ids after the last end id of a file are a document of their
own, marked ``ended = false``; a file that ends within an id is an error; an empty file has no document; texts that are equal,
and rows that repeat, are documents of their own; null ids stay null; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm._common import id_and_text, make_folders, new_path, slices, stored
from locusframe.llm.tokens import TEXT_BYTES, WordEncoder

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_DIGITS = "0123456789-,"


def _separator(end_id: int, dtype: str) -> str:
    """The bytes of the end id, as Latin-1."""
    return np.array([end_id], dtype).tobytes().decode("latin-1")


def _line_separator(separator: str) -> str:
    """The end id if no two of its places can overlap, else a byte that isn't in it."""
    if any(separator.startswith(separator[-k:]) for k in range(1, len(separator))):
        return next(chr(c) for c in range(1, 256) if chr(c) not in separator)
    return separator


def _letters(separator: str) -> str:
    """Letters for the digits of an order file, none of which is in the separator."""
    return "".join([c for c in "abcdefghijklmnopqrstuvwxyz" if c not in separator][: len(_DIGITS)])


def _file(path: Column) -> Column:
    """``17.c000`` of ``part-00017-...c000.txt``: the task that wrote the file, and which of its files it is."""
    return F.concat_ws(".", F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), F.regexp_extract(path, r"(c\d+)\.txt$", 1))


def id_width(tokenizer_path: str) -> str:
    """The narrowest type that holds all ids of a vocabulary."""
    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    dtype: str = "<u2",
) -> None:
    """Write the ids of all texts, of type ``dtype``, and ``end_id`` after each document, one file per partition in ``kind=ids``.

    The same tasks write in ``kind=order`` which documents these are and how many tokens they have, under the same number and
    in the same order.
    """
    spark = docs.sparkSession
    separator = _separator(end_id, dtype)
    written = str.maketrans(_DIGITS, _letters(separator))
    most = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, ordinary_special=True)
        for part in (p for batch in batches for p in slices(batch, "text", TEXT_BYTES)):
            rows = encoder.encode_all([t.as_buffer().to_pybytes() for t in part.column("text")])
            for r in rows:
                if len(r) and (int(r.max()) > most or end_id in r):
                    raise ValueError(f"an id is over {most} or equals the end id")
            keys = part.column("doc_id").to_pylist()
            order = [f"{'' if k is None else k},{len(r)}".translate(written).encode() for k, r in zip(keys, rows)]
            for kind, values in (("ids", [r.astype(dtype).tobytes() for r in rows]), ("order", order)):
                columns = [pa.array(values, pa.binary()), pa.array([kind] * len(values), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["value", "kind"])

    ids = id_and_text(docs, id_col, text_col).mapInArrow(run, "value binary, kind string")
    # With a writer open for each kind the rows are not sorted by it: they stay in order.
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "4")
    try:
        # The writer of text puts the bytes of a row and then the line separator, here the end id.
        ids.select(F.col("value").cast("string"), "kind").write.partitionBy("kind").option("encoding", "ISO-8859-1").option(
            "lineSep", separator
        ).text(path)
    finally:
        spark.conf.set(_WRITERS, before)
    make_folders(spark, [f"{path}/kind=ids", f"{path}/kind=order"])


def _stretches(spark: SparkSession, path: str, line_separator: str, files: str) -> DataFrame:
    """``path, block, file_size, value``: the bytes between separators; block: where the split starts that they were read in."""
    found = (
        spark.read.option("lineSep", line_separator)
        .option("encoding", "ISO-8859-1")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", files)
        .text(path)
    )
    place = found.metadataColumn("_metadata")
    return found.select(
        place["file_path"].alias("path"), place["file_block_start"].alias("block"), place["file_size"].alias("file_size"), "value"
    )


def _order(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``doc_id, file, document, written`` of what ``write_token_files`` wrote; written: the tokens of the document."""
    lines = _stretches(spark, f"{path}/kind=order", separator, "*.txt").withColumn("id", F.monotonically_increasing_id())
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    fields = F.split(F.translate("value", _letters(separator), _DIGITS), ",")
    return lines.join(sizes, ["path", "block"]).select(
        fields[0].try_cast("long").alias("doc_id"),
        _file(F.col("path")).alias("file"),
        (F.col("id") - F.col("first") + F.col("before")).alias("document"),
        fields[1].cast("long").alias("written"),
    )


_FOUND = "path string, block long, size long, file_size long, phase int, ends long, place long, n_bytes long, ended boolean"


def _scan(end_id: int, dtype: str, block_bytes: int):
    """Mapper: the bytes between end ids of each block, for every alignment (``phase``: bytes of a block before its first whole
    id)."""
    width = np.dtype(dtype).itemsize
    separator = _line_separator(_separator(end_id, dtype)).encode("latin-1")

    def rows(head: tuple, size: int, ends: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for phase in range(width):
            at = np.concatenate([np.array([-width], np.int64), *ends[phase], np.array([size], np.int64)])
            counts = np.diff(at) - width
            n = len(counts)
            for low in range(0, n, 65536):
                k = np.arange(low, min(n, low + 65536))
                columns = [pa.array([head[0]] * len(k), pa.string())]
                columns += [pa.array(np.full(len(k), x), pa.int64()) for x in (head[1], size, head[2])]
                columns += [pa.array(np.full(len(k), phase), pa.int32()), pa.array(np.full(len(k), n - 1), pa.int64())]
                columns += [pa.array(k, pa.int64()), pa.array(counts[k], pa.int64()), pa.array(k < n - 1, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ends, rest, at = None, [], b"", 0  # at: bytes of the block before ``rest``

        def search(data: bytes) -> bytes:
            """Look for end ids, and return the bytes that may be the beginning of one."""
            for k in range(min(width, len(data))):  # the phase of an end id at byte k
                ids = np.frombuffer(data, dtype, (len(data) - k) // width, k)
                ends[(at + k) % width].append(np.flatnonzero(ids == end_id) * width + at + k)
            return data[max(0, len(data) - width + 1) :]

        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("path", "block", "file_size")]
            parts: list[bytes] = []
            held = 0
            for key, value in zip(zip(*keys), batch.column("value")):
                if key != head:
                    if head is not None:
                        data = rest + b"".join(parts)
                        rest = search(data)
                        yield from rows(head, at + len(data), ends)
                    head, ends, rest, at, parts, held = key, [[] for _ in range(width)], b"", 0, [], 0
                parts += (value.as_buffer().to_pybytes(), separator)
                held += len(parts[-2]) + len(separator)
                if held >= block_bytes:
                    data = rest + b"".join(parts)
                    rest = search(data)
                    at, parts, held = at + len(data) - len(rest), [], 0
            if parts:
                data = rest + b"".join(parts)
                rest = search(data)
                at += len(data) - len(rest)
        if head is not None:
            yield from rows(head, at + len(rest), ends)

    return run


def count_tokens(
    spark: SparkSession, path: str, end_id: int, dtype: str = "<u2", block_bytes: int = 1 << 20, files: str = "*.txt"
) -> DataFrame:
    """One row per document of the token files at ``path``: ``path, document, n_tokens, ended``; document is its place in the
    file, from 0.  ``block_bytes``: what is searched at once; ``files``: a pattern of their names."""
    width, line_separator = np.dtype(dtype).itemsize, _line_separator(_separator(end_id, dtype))
    stretches = _stretches(spark, path, line_separator, files).withColumn("value", F.col("value").cast("binary"))
    found = stored(stretches.mapInArrow(_scan(end_id, dtype, block_bytes), _FOUND), "token-blocks")
    heads = found.where("place = 0").select("path", "block", "size", "file_size", "phase", "ends")
    by_file = Window.partitionBy("path")
    before = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The bytes before a block say how its ids are aligned; more bytes than the file has, that its last separator isn't there.
    sizes = heads.where("phase = 0").select(
        "path", "block", F.pmod(-F.coalesce(F.sum("size").over(before), F.lit(0)), F.lit(width)).alias("phase"),
        (F.sum("size").over(by_file) > F.col("file_size")).alias("open"),
        (F.max("block").over(by_file) == F.col("block")).alias("last"),
    )
    is_end = line_separator == _separator(end_id, dtype)
    blocks = heads.join(sizes, ["path", "block", "phase"]).select(
        "path", "block", "phase", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("before"),
        F.when(F.col("open") & F.lit(is_end), F.sum("ends").over(by_file) - 1).alias("open"),
        F.when(F.col("open") & F.col("last") & F.lit(not is_end), F.lit(len(line_separator))).otherwise(F.lit(0)).alias("surplus"),
    )
    document, tail = F.col("before") + F.col("place"), F.col("place") == F.col("ends")
    at = found.join(blocks, ["path", "block", "phase"]).select(
        "path", document.alias("document"), (F.col("n_bytes") - F.when(tail, F.col("surplus")).otherwise(F.lit(0))).alias("n_bytes"),
        (F.col("ended") & ~document.eqNullSafe(F.col("open"))).alias("ended"), "place", "ends",
    )
    inside = (F.col("place") > 0) & (F.col("place") < F.col("ends"))
    whole = at.where(inside).select("path", "document", "n_bytes", "ended")
    parts = (
        at.where(~inside)
        .groupBy("path", "document")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.max("ended").alias("ended"))
        .where("ended or n_bytes > 0")
    )
    cut = F.raise_error(F.concat(F.lit("a token file ends within an id: "), "path")).cast("long")
    tokens = F.when(F.col("n_bytes") % width == 0, (F.col("n_bytes") / width).cast("long")).otherwise(cut)
    return whole.union(parts).select("path", "document", tokens.alias("n_tokens"), "ended")


def document_token_counts(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20
) -> DataFrame:
    """Write the token files of a table, scan them and give each count its ``doc_id``: ``doc_id, file, document, n_tokens``.

    The table is read once: the tasks that write the token files also write which document is at which place, and the counts
    are held against that.  A count without a document, a document without a count or one that differs is an error.
    """
    spark = docs.sparkSession
    path, dtype = new_path(spark, "token-files"), id_width(tokenizer_path)
    write_token_files(docs, path, tokenizer_path, end_id, id_col, text_col, dtype)
    counts = count_tokens(spark, f"{path}/kind=ids", end_id, dtype, block_bytes).select(
        _file(F.col("path")).alias("file"), "document", "n_tokens"
    )
    wrong = F.raise_error(F.lit("the token files and the order of their documents differ")).cast("long")
    return _order(spark, path, _separator(end_id, dtype)).join(counts, ["file", "document"], "full").select(
        "doc_id", "file", "document", F.when(F.col("n_tokens") == F.col("written"), F.col("n_tokens")).otherwise(wrong).alias("n_tokens")
    )
