"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input makes one sorted run of digests: for each digest the smallest row and the number of rows.  The
runs are then exchanged in rounds.  With ``fan_in`` f and P = f**R nodes, a run starts at the node of the partition that made
it; in round r each node sends a digest on to the one of f partners whose r-th digit equals the r-th digit of the digest's
own target node, and every node merges the f sorted runs it gets, keeping the smallest row of each digest.  After R rounds a
digest has met all its occurrences.  A digest crosses the network R times at most and is at every level already reduced to one
row for each run, so a group of copies of any size never gathers in a task.

Spark's sorter merges the runs that it finds (TimSort), so the sort after an exchange is the multiway merge of what came in.

Digests are verified: rows are equal only if SHA-256, a second 64-bit hash with another seed and the length in bytes agree.

Special cases: null text counts as empty; a text of any length is hashed as a whole; of rows that tie on the smallest ``doc_id``
exactly one is kept, the first one stored; a null ``doc_id`` is larger than any other; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import addressable, id_and_text, joined_to_classes, row_key, shuffle_partitions, stored, without_rows

_KEY = ["sha", "check", "n_bytes"]
_RUN = "node int, target int, sha binary, check long, n_bytes int, no_id boolean, doc_id long, row_id long, rows long"
_SCHEMA = pa.schema(
    [
        ("node", pa.int32()), ("target", pa.int32()), ("sha", pa.binary()), ("check", pa.int64()), ("n_bytes", pa.int32()),
        ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("row_id", pa.int64()), ("rows", pa.int64()),
    ]
)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per document: ``doc_id, row_id, origin, sha, check, n_bytes`` of the normalised text, and the columns asked for.

    Normalised: each run of ASCII white space is one space.
    """
    rows = id_and_text(docs, id_col, text_col, *more)
    names = rows.columns[2:]
    text = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    return (
        rows.select("doc_id", text.alias("text"), *names)
        .select(
            "doc_id",
            *names,
            F.monotonically_increasing_id().alias("row_id"),
            F.spark_partition_id().alias("origin"),
            F.unhex(F.sha2("text", 256)).alias("sha"),
            F.xxhash64(F.lit("second"), "text").alias("check"),
            F.octet_length("text").alias("n_bytes"),
        )
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal neighbours of sorted runs; the first of them is the smallest."""
    held = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_SCHEMA)
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in ("node", *_KEY)]
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            same = np.ones(batch.num_rows - 1, bool)
            for c in columns:
                same &= pc.equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        first = np.flatnonzero(new)
        rows = np.add.reduceat(batch.column("rows").to_numpy(), first)
        kept = batch.take(pa.array(first)).columns[:-1]
        merged = pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.int64())], schema=_SCHEMA)
        held = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def tree_merge(run: DataFrame, fan_in: int = 8) -> DataFrame:
    """Merge the digest runs of all partitions: ``sha, check, n_bytes, no_id, doc_id, row_id, rows``, one row per digest."""
    n = shuffle_partitions(run.sparkSession)
    rounds = 1
    while fan_in**rounds < n:
        rounds += 1
    nodes = fan_in**rounds
    state = run.select(
        F.pmod("origin", F.lit(nodes)).cast("int").alias("node"),
        F.pmod(F.conv(F.substring(F.hex("sha"), 1, 7), 16, 10).cast("long"), F.lit(nodes)).cast("int").alias("target"),
        *_KEY,
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        "row_id",
        F.lit(1).cast("long").alias("rows"),
    )
    order = ["node", *_KEY, "no_id", "doc_id", "row_id"]
    state = state.sortWithinPartitions(*order).mapInArrow(_merge, _RUN)
    for r in range(1, rounds + 1):
        low = fan_in**r
        node = (F.floor(F.col("node") / low) * low + F.pmod("target", F.lit(low))).cast("int")
        state = (
            state.withColumn("node", node)
            .repartition(n, "node")
            .sortWithinPartitions(*order)
            .mapInArrow(_merge, _RUN)
        )
    return state.drop("node", "target")


def _marked(docs: DataFrame, id_col: str, text_col: str, fan_in: int, *more: Column) -> DataFrame:
    rows = stored(digests(docs, id_col, text_col, *more), "digests")
    merged = tree_merge(rows, fan_in).select(
        *_KEY,
        F.when(~F.col("no_id"), F.col("doc_id")).alias("keep_id"),
        F.col("row_id").alias("keep_row"),
        F.col("rows").alias("members"),
    )
    return joined_to_classes(rows, stored(merged, "merged"), _KEY).withColumn("kept", F.col("row_id") == F.col("keep_row"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return _marked(docs, id_col, text_col, fan_in).select(
        "doc_id",
        "keep_id",
        F.col("members").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The documents that stay, with all their columns: of each group of equal texts one row, whatever the ids.

    Rows are told apart by their place in the files; no text is shuffled.
    """
    docs = addressable(docs)
    marked = _marked(docs, id_col, text_col, fan_in, *row_key(docs))
    return without_rows(docs, stored(marked.where(~F.col("kept")).select("row_file", "row_index"), "copies"))
