"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds in words or other objects at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows whose keys are broadcast at most; beyond that rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session gets a folder of this machine, which is all that driver and executors have; on a
    cluster it is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, what operators wrote into the shared folder within it.

    Their results are read from there, so write these out first.  What is taken off the list that it gives stays.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        remove(spark, made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def make_folders(spark: SparkSession, paths: list[str]) -> None:
    """Folders that a partitioned write leaves out where no row belongs to them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage, so that a lost executor costs no recomputation beyond its own tasks, and fixes the rows, so that ids
    made from partitions stay what they were.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Columns ``doc_id`` and ``text`` and those asked for; null text becomes empty; all others are left out, so none can clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of one column, a row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def decoded(column: pa.Array) -> Iterator[str]:
    """Texts one by one; null is empty, and bytes that are no UTF-8 become replacement characters."""
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


# Rows by their place -----------------------------------------------------------------------------------------------------------

#: A row's file (as a hash of its path) and its place in the file.  Ids may be null or repeat; these never do.
ROW_KEY = ("row_file", "row_index")


def addressable(docs: DataFrame) -> DataFrame:
    """``docs`` as a scan of Parquet files, whose rows can be named by their place; written to the shared folder unless it is one."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower():
        return docs
    return stored(docs, "documents")


def row_key(docs: DataFrame) -> list[Column]:
    """Columns ``row_file, row_index`` of a scan; they stay the same however often it is read."""
    place = docs.metadataColumn("_metadata")
    return [F.xxhash64(place["file_path"]).alias(ROW_KEY[0]), place["row_index"].alias(ROW_KEY[1])]


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a scan that are not in ``gone`` (a stored table of row keys), with all their columns.

    The keys are broadcast up to BROADCAST_ROWS of them, so that no text moves; more are joined by a shuffle.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs))
    gone = gone.select(*ROW_KEY)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return whole.join(gone, list(ROW_KEY), "left_anti").select("row.*")


#: Classes that are broadcast at most.
BROADCAST_CLASSES = 200_000


def joined_to_classes(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with their classes (stored; one row each, ``members``: its rows), where a class may hold a third of all.

    Classes of ``least`` rows or more are broadcast.  There are no more than BROADCAST_CLASSES of these, since that many would
    hold all rows; and no other is a hot key of the shuffle.
    """
    total = classes.agg(F.sum("members").alias("n")).first()["n"] or 0
    least = max(1000, -(-total // BROADCAST_CLASSES))
    large = F.broadcast(classes.where(F.col("members") >= least))
    rest = rows.join(large.select(*keys), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(classes.where(F.col("members") < least), keys))
