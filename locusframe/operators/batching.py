"""Greedy batching of coordinates and regions in their given order.

A batch is anchored at its first row; a row stays in it as long as it is on the same contig and ends less than ``window``
after the anchor.  Where a batch starts depends on where the one before it started, so this is a fold.  But a row that ends
``window`` or more after all starts of its contig run so far begins a batch whatever the anchor is.  Rows are cut there and where
the contig changes, and the pieces are folded in parallel, each in a stream of its sorted rows.  Only rows without such a gap
between them, however many, are one piece.

What is needed from all rows before (sums, maxima, the last contig) comes in two levels: within blocks of the order, whose
borders are quantiles of the order found once for the table, and across one row per block.  The order is a unique number per row
and never null: a null is an error.  It is taken as a double for the borders only; rows are compared by the order itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from locusframe.operators._cut import cut

#: Blocks of an order at most.
MOST_BLOCKS = 4096


def _blocked(rows: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Rows with ``__block``: numbers that rise with the order, of about as many rows each."""
    n = min(blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_BLOCKS)
    borders = rows.approxQuantile(order, [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    splits = [-float("inf"), *sorted(set(borders)), float("inf")]
    known = F.coalesce(F.col(order).cast("double"), F.raise_error(F.lit(f"the order '{order}' is null in a row")).cast("double"))
    if len(splits) == 2:
        return rows.withColumn("__block", F.when(known.isNotNull(), 0.0))
    return Bucketizer(splits=splits, inputCol="__order", outputCol="__block").transform(rows.withColumn("__order", known)).drop("__order")


def _total(blocked: DataFrame, value: Column, name: str, order: str) -> DataFrame:
    local = blocked.withColumn(name, F.sum(value).over(Window.partitionBy("__block").orderBy(order)))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    base = (
        blocked.groupBy("__block")
        .agg(F.sum(value).alias("__sum"))
        .select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    )
    return local.join(base, "__block").withColumn(name, F.col(name) + F.col("__base")).drop("__base")


def running_total(rows: DataFrame, value: Column, name: str, order: str, blocks: int | None = None) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` over all rows up to this one in a numeric order."""
    return _total(_blocked(rows, order, blocks), value, name, order).select(*rows.columns, name)


def _runs(blocked: DataFrame, contig: str, order: str) -> DataFrame:
    """Rows with ``run``: how many times the contig changed before."""
    in_block = Window.partitionBy("__block").orderBy(order)
    # The row before the first one of a block is the last one of the block before that has rows.
    last = blocked.groupBy("__block").agg(F.max_by(contig, order).alias("__contig"))
    last = last.select("__block", F.lag("__contig").over(Window.orderBy("__block")).alias("__last"))
    marked = blocked.withColumns({"__before": F.lag(contig).over(in_block), "__first": F.row_number().over(in_block) == 1})
    marked = marked.join(last, "__block")
    previous = F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__before"))
    marked = marked.withColumn("__changed", F.coalesce(F.col(contig) != previous, F.lit(False)).cast("long"))
    return _total(marked.drop("__before", "__first", "__last"), F.col("__changed"), "run", order)


def contig_runs(rows: DataFrame, contig: str = "contig", order: str = "ord", blocks: int | None = None) -> DataFrame:
    """Rows with ``run``: how many times the contig changed before, counted from 0.  The order is a number per row, unique."""
    return _runs(_blocked(rows, order, blocks), contig, order).select(*rows.columns, "run")


def _pieces(runs: DataFrame, start: Column, end: Column, window: int, order: str) -> DataFrame:
    """Rows with ``__piece``: a new one where a batch begins in any case."""
    in_block = Window.partitionBy("__block", "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("run").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block and run
    carried = runs.groupBy("__block", "run").agg(F.max(start).alias("__most"))
    carried = carried.select("__block", "run", F.max("__most").over(before).alias("__carried"))
    seen = runs.withColumn("__seen", F.max(start).over(in_block)).join(carried, ["__block", "run"])
    furthest = F.greatest("__seen", "__carried")  # null for the first row of a run
    certain = F.coalesce(end - furthest >= window, F.lit(True)).cast("long")
    return _total(seen.withColumn("__certain", certain).drop("__seen", "__carried"), F.col("__certain"), "__piece", order)


def _starts(pieces: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, anchor: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows begin a batch, and the piece and anchor at the end.  Where ends rise each batch is found by one search."""
    marks = np.zeros(len(pieces), bool)
    first = np.flatnonzero(np.concatenate(([True], pieces[1:] != pieces[:-1])))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pieces)]):
        k = a
        if anchor is None or anchor[0] != pieces[a]:
            marks[a], anchor, k = True, (pieces[a], starts[a]), a + 1
        rising = bool((np.diff(ends[a:b]) >= 0).all())
        while k < b:
            if rising:
                k += int(np.searchsorted(ends[k:b], anchor[1] + window))
            else:
                out = ends[k:b] - anchor[1] >= window
                k = k + int(out.argmax()) if out.any() else b
            if k < b:
                marks[k], anchor, k = True, (pieces[a], starts[k]), k + 1
    return marks, anchor


def _folded(rows: DataFrame, contig: str, start: str, end: str, window: int, order: str, blocks: int | None) -> DataFrame:
    """Rows with ``batch``: numbers from 0 in the order of rows."""
    names = rows.columns
    pieces = _pieces(cut(_runs(_blocked(rows, order, blocks), contig, order)), F.col(start), F.col(end), window, order)
    given = pieces.select(*names, "__block", "__piece", F.col(start).alias("__start"), F.col(end).alias("__end"))
    kept = given.drop("__piece", "__start", "__end").schema
    size = len(kept)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = None
        for batch in batches:
            if batch.num_rows:
                # Only these three are looked at; all other columns pass as they are.
                columns = batch.columns[-3:]
                if any(c.null_count for c in columns):
                    raise ValueError("a position is null")
                marks, anchor = _starts(*[c.to_numpy() for c in columns], window, anchor)
                new = pa.array(marks.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:size], new], [*kept.names, "__new"])

    marked = given.repartition("__piece").sortWithinPartitions("__piece", order).mapInArrow(fold, StructType([*kept, StructField("__new", LongType())]))
    return _total(cut(marked), F.col("__new"), "__batch", order).select(*names, (F.col("__batch") - 1).alias("batch"))


def batch_coordinates(
    rows: DataFrame, window: int, contig: str = "contig", pos: str = "pos", order: str = "ord", blocks: int | None = None
) -> DataFrame:
    """Rows with ``batch``: same contig as the row before and ``pos - anchor < window``, else a new batch."""
    return _folded(rows, contig, pos, pos, window, order, blocks)


def batch_regions(
    rows: DataFrame, window: int, contig: str = "contig", start: str = "start", end: str = "end", order: str = "ord",
    blocks: int | None = None,
) -> DataFrame:
    """As ``batch_coordinates``, but a region's end is compared with the start of the batch's first region."""
    return _folded(rows, contig, start, end, window, order, blocks)
