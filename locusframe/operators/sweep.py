"""Pileups made where a user's function takes them: only reads and targets are shuffled, never their pairs.

Targets and the reads that may cover them meet in bins of the contig, sorted by position.  A task goes along them and holds the reads
that have begun and not yet ended, which at a target are its pileup.  A read goes into all bins that it overlaps; bins are some four
times as wide as the mean read, so on average there are 1.25 of these, or fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from locusframe.operators.pileup import LEAST_LEVEL, SKIPPED_FLAGS, aligned_blocks, first_of_duplicates, used_reads

#: Rows that a task looks at together, unless it holds more reads.
STEP_ROWS = 50_000
#: The columns by which rows are dealt out.
GROUP = ("contig", "__bin", "__salt")

Locus = tuple[str, int, pa.RecordBatch]


def _groups(batch: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
    """``key, first, end`` of the runs of rows of one bin."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in GROUP]
    codes = [columns[0].dictionary_encode().indices.to_numpy(), *(c.to_numpy() for c in columns[1:])]
    new = np.zeros(batch.num_rows, bool)
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    return [(tuple(c[a].as_py() for c in columns), a, b) for a, b in zip(edges, edges[1:])]


def _steps(batches: Iterator[pa.RecordBatch], most: Callable[[], int]) -> Iterator[pa.RecordBatch]:
    """The batches put together to ``most()`` rows or more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most():
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _loci(batches: Iterator[pa.RecordBatch], start: str, end: str, offset: str | None, of_target: list[str], of_read: list[str], step_rows: int) -> Iterator[Locus]:
    """``contig, pos`` and the pileup there, for each target that reads cover; rows come sorted by bin, start and kind."""
    at, held = None, None
    for step in _steps(batches, lambda: max(step_rows, held.num_rows if held is not None else 0)):
        kinds = step.column(step.schema.get_field_index("__kind")).to_numpy()
        starts = step.column(step.schema.get_field_index(start)).to_numpy()
        for key, a, b in _groups(step):
            if key != at:
                at, held = key, None
            is_read = kinds[a:b] == 0
            reads = step.slice(a, b - a).filter(pa.array(is_read))
            before = held.num_rows if held is not None else 0
            if before:
                reads = pa.concat_batches([held, reads])
            first, last = (reads.column(reads.schema.get_field_index(c)).to_numpy() for c in (start, end))
            furthest = np.maximum.accumulate(last)
            targets = np.flatnonzero(~is_read)
            begun = before + np.cumsum(is_read)[targets]
            for k, m in zip((a + targets).tolist(), begun.tolist()):
                place = int(starts[k])
                low = int(np.searchsorted(furthest[:m], place, "right"))  # what is before has ended
                found = low + np.flatnonzero(last[low:m] > place)
                if not len(found):
                    continue
                rows = reads.take(pa.array(found))
                n, qpos = len(found), place - first[found]
                if offset is not None:
                    q0 = rows.column(rows.schema.get_field_index(offset))
                    qpos = pa.array(qpos + q0.fill_null(0).to_numpy(), mask=q0.is_null().to_numpy(zero_copy_only=False))
                more = [pa.repeat(step.column(step.schema.get_field_index(c))[k], n) for c in of_target]
                mine = [rows.column(rows.schema.get_field_index(c)) for c in of_read]
                columns = [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(pa.scalar(place + 1, pa.int64()), n), *more, *mine, pa.array(qpos)]
                yield key[0], place + 1, pa.RecordBatch.from_arrays(columns, ["contig", "pos", *of_target, *of_read, "qpos"])
            held = reads.filter(pa.array(last > starts[b - 1]))


def swept(
    reads: DataFrame, targets: DataFrame, each: Callable[[Iterator[Locus]], Iterator[pa.RecordBatch]], schema: StructType,
    flag_mask: int = SKIPPED_FLAGS, width: int | None = None, most_rows: int | None = None, step_rows: int = STEP_ROWS,
) -> DataFrame:
    """What ``each`` makes of the pileups of its task: ``contig, pos`` and a batch with the columns that ``pileup`` gives.

    ``width``: of the bins; it does not change the result.  ``most_rows``: the reads of a bin that has more are dealt out over several
    tasks, so ``each`` gets a locus in parts; without it a locus comes whole.  ``step_rows``: rows that a task looks at together.
    """
    used, points = used_reads(reads, flag_mask), first_of_duplicates(targets)
    start, end, offset = "pos0", "end0", None
    columns = [c for c in used.columns if c != "contig"]
    if "cigar" in reads.columns:
        start, end, offset = "__b0", "__b1", "__q0"
        used = used.withColumn("__block", F.explode(aligned_blocks(F.col("pos0"), F.col("cigar"))))
        used = used.select("contig", *columns, F.col("__block.b0").alias("__b0"), F.col("__block.b1").alias("__b1"), F.col("__block.q0").alias("__q0"))
    used = used.withColumns({start: F.col(start).cast("long"), end: F.col(end).cast("long")}).where(F.col(end) > F.col(start)).where("contig is not null")
    points = points.where("contig is not null and pos is not null")
    of_target = [c for c in points.columns if c not in ("contig", "pos")]
    if set(of_target) & set(columns):
        raise ValueError(f"columns of targets and of reads clash: {sorted(set(of_target) & set(columns))}")
    if width is None:
        mean = used.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1.0
        width = 4 << max(LEAST_LEVEL, int(np.ceil(np.log2(mean))))
    number = lambda p: F.call_function("div", p - F.pmod(p, F.lit(width)), F.lit(width))
    spans = used.withColumn("__bin", F.explode(F.sequence(number(F.col(start)), number(F.col(end) - 1))))
    points = points.withColumn(start, (F.col("pos") - 1).cast("long")).withColumn("__bin", number(F.col(start))).drop("pos")
    if most_rows is None:
        spans, points = spans.withColumn("__salt", F.lit(0)), points.withColumn("__salt", F.lit(0))
    else:
        # One row for each bin of more than most_rows reads: there are few of these.
        deep = spans.groupBy("contig", "__bin").agg(F.ceil(F.count("*") / most_rows).cast("int").alias("__tasks")).where("__tasks > 1")
        kept = [f.name for f in used.schema if not isinstance(f.dataType, MapType)]
        spans = spans.join(F.broadcast(deep), ["contig", "__bin"], "left")
        spans = spans.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*kept), F.col("__tasks")).cast("int"), F.lit(0))).drop("__tasks")
        points = points.join(F.broadcast(deep), ["contig", "__bin"], "left")
        points = points.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))).drop("__tasks")
    rows = spans.withColumn("__kind", F.lit(0)).unionByName(points.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, start, "__kind")
    return rows.mapInArrow(lambda batches: each(_loci(batches, start, end, offset, of_target, columns, step_rows)), schema)
