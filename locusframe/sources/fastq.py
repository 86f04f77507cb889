"""FASTQ files, plain or gzip, as tables and as streams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.operators._cut import cut


def header_id(header: Column) -> Column:
    """The header up to the first ASCII white space, its ``@`` included."""
    return F.regexp_extract(header, r"^[^ \t\n\x0B\f\r]*", 0)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, value``: lines with their file and the place in it where their split begins."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """A batch in stretches of one split."""
    file, split = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("split").to_numpy()
    borders = np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1
    for a, b in itertools.pairwise([0, *borders.tolist(), batch.num_rows]):
        if a < b:
            yield (batch.column("file")[a].as_py(), int(split[a])), batch.slice(a, b - a)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its number of lines and its outermost ones: three at each end are all that another split can need."""

    def row() -> pa.RecordBatch:
        ends = {**dict(enumerate(head)), **{n - len(tail) + k: v for k, v in enumerate(tail)}}
        lines = [{"at": k, "value": v} for k, v in ends.items()]
        return pa.RecordBatch.from_pylist([{"file": key[0], "split": key[1], "n": n, "lines": lines}], _SUMMARY)

    key, n, head, tail = None, 0, [], []
    for batch in batches:
        for where, run in _runs(batch):
            if where != key:
                if key:
                    yield row()
                key, n, head, tail = where, 0, [], []
            values = run.column("value").cast(pa.binary())  # whatever bytes they are
            head += values.slice(0, 3 - len(head)).to_pylist()
            tail = [*tail, *values.slice(max(0, len(values) - 3)).to_pylist()][-3:]
            n += len(values)
    if key:
        yield row()


_SUMMARY = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("n", pa.int64()),
        ("lines", pa.list_(pa.struct([("at", pa.int64()), ("value", pa.binary())]))),
    ]
)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one split as a whole."""
    key, rest, at = None, pa.array([], pa.string()), 0
    for batch in batches:
        for where, run in _runs(batch):
            values = run.column("value")
            if where != key:
                key, at = where, run.column("before")[0].as_py()
                skip = min(-at % 4, len(values))
                values, at, rest = values.slice(skip), at + skip, values.slice(0, 0)
            elif at % 4:  # lines of a record that began in an earlier split go on
                skip = min(-at % 4, len(values))
                values, at = values.slice(skip), at + skip
            values = pa.concat_arrays([rest, values])
            whole = len(values) // 4
            if whole:
                first = np.arange(whole) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(where[0], whole), pa.array(at // 4 + np.arange(whole)), *(values.take(pa.array(first + k)) for k in range(4))],
                    ["file", "rec", *_PARTS],
                )
            rest, at = values.slice(4 * whole), at + 4 * whole


_PARTS = ["header", "sequence", "plus", "quality"]


def _splits(spark: SparkSession, path: str | list[str], as_one: bool) -> DataFrame:
    """``file, split, n, lines, before``: each split's lines, their outermost, and how many lines stand before it.

    A row per split, which the driver plans one by one in any case.
    """
    found = cut(_lines(spark, path).mapInArrow(_summaries, "file string, split long, n long, lines array<struct<at: long, value: binary>>"))
    before = Window.partitionBy(*([] if as_one else ["file"])).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    return cut(found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))


def read_fastq(
    spark: SparkSession, path: str | list[str], strict: bool = False, strip_cr: bool = False, as_one: bool = False
) -> DataFrame:
    """``file, rec, header, sequence, plus, quality``; raises where a file ends within a record.

    Records are put together within splits.  A first pass counts the lines of each split, so that it is known where a record
    begins; only lines of records across borders are shuffled.  ``as_one`` counts records through all files in the order of their
    names, as in one file of all; ``file`` is then where a record begins.  Lines are taken as they are, so a carriage return stays
    unless ``strip_cr``.  ``strict`` also wants ``@``, ``+`` and a quality per base.
    """
    splits = _splits(spark, path, as_one)
    places = F.broadcast(splits.select("file", "split", "before"))
    # Within a task lines keep their order: a broadcast join streams them.
    lines = _lines(spark, path).join(places, ["file", "split"]).select("file", "split", "before", "value")
    within = lines.mapInArrow(_within, "file string, rec long, header string, sequence string, plus string, quality string")
    line, end = F.col("before") + F.col("line.at"), F.col("before") + F.col("n")
    rec = F.floor(line / 4)
    borders = splits.select("*", F.explode("lines").alias("line")).where((rec * 4 < F.col("before")) | (rec * 4 + 4 > end))
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    across = (
        borders.select("file", line.alias("line"), rec.alias("rec"), F.col("line.value").cast("string").alias("value"))
        .groupBy(*([] if as_one else ["file"]), "rec")
        .agg(*([F.min("file").alias("file")] if as_one else []), *[at(k).alias(c) for k, c in enumerate(_PARTS)], F.count("*").alias("n"))
    )
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    whole = F.when(F.col("n") < 4, fail("Unexpected EOF in fastq.")).otherwise(F.col("quality")).alias("quality")
    rows = within.unionByName(across.select("file", "rec", *_PARTS[:3], whole))
    if strip_cr:
        rows = rows.select("file", "rec", *[F.regexp_replace(c, "\r$", "").alias(c) for c in _PARTS])
    if not strict:
        return rows
    checked = (
        F.when(~F.col("header").startswith("@"), fail("A FASTQ header must start with @."))
        .when(~F.col("plus").startswith("+"), fail("The third line of a FASTQ record must start with +."))
        .when(F.length("sequence") != F.length("quality"), fail("Sequence and quality differ in length."))
    )
    return rows.select("file", "rec", *_PARTS[:3], checked.otherwise(F.col("quality")).alias("quality"))


def read_pairs(spark: SparkSession, r1: str, r2: str, **options) -> DataFrame:
    """The n-th records of two files, or of two folders of files in the order of their names: ``rec, r1, r2``."""
    from locusframe.operators.pairing import zip_mates

    return zip_mates(*[read_fastq(spark, path, as_one=True, **options).drop("file") for path in (r1, r2)])


def write_fastq(records: DataFrame, path: str, order: str = "rec", files: int | None = None) -> None:
    """Records in their order, as text files; a path that ends in ``.gz`` is compressed.  ``files=1``: as one file."""
    text = F.concat_ws("\n", "header", "sequence", "plus", "quality").alias("value")
    rows = records.orderBy(order)
    rows = (rows.coalesce(files) if files else rows).select(text)
    rows.write.option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
