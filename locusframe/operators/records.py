"""Records: read, change or drop, keep their order, write."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from locusframe.operators.sweep import Locus, swept

#: Rows of results that are sent on together.
BATCH_ROWS = 10_000
_NUMBERS = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.float32(): pd.Float32Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype(),
}


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as pandas columns with nulls of their own, so that a long beside a null stays a long.

    Texts are objects; what is no number or text is Arrow's.
    """
    kinds = lambda t: _NUMBERS.get(t) or (None if pa.types.is_string(t) or pa.types.is_binary(t) else pd.ArrowDtype(t))
    return pa.Table.from_batches([batch]).to_pandas(types_mapper=kinds)


def _schema(spark: SparkSession, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def modify_records(records: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema=None) -> DataFrame:
    """Each batch of records goes through ``fn``, which returns the rows to keep, changed or not.

    Its columns have nulls of their own (``Int64``, Arrow types), so what ``fn`` leaves alone comes back as it was, whatever its type.
    """
    spark = records.sparkSession
    made = _schema(spark, schema or records.schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_pandas(fn(_frame(batch)), schema=arrow, preserve_index=False).to_batches()

    return records.mapInArrow(run, made)


def keep(records: DataFrame, condition: Column) -> DataFrame:
    """Records for which the condition holds; where it is null the record is dropped."""
    return records.where(condition)


def odd_position(pos0: Column) -> Column:
    """Whether the 1-based position is odd; false for unmapped records (``pos0 = -1``)."""
    return F.pmod(pos0 + 1, F.lit(2)) != 0


def drop_errors(records: DataFrame, value: Column, name: str, counter: Observation | None = None) -> DataFrame:
    """Records with ``name`` = ``value``, without those for which it is null (the result of a ``try_`` function).

    ``counter`` gets ``records`` and ``dropped`` when the query runs.
    """
    rows = records.withColumn(name, value)
    if counter is not None:
        rows = rows.observe(counter, F.count(F.lit(1)).alias("records"), F.count_if(F.col(name).isNull()).alias("dropped"))
    return rows.where(F.col(name).isNotNull())


def counted(records: DataFrame, counter: Observation) -> DataFrame:
    """Counts the records that pass, without another pass."""
    return records.observe(counter, F.count(F.lit(1)).alias("records"))


def members(rows: DataFrame, key: str, allowed: DataFrame | Iterable[str]) -> DataFrame:
    """Rows whose key is in a list or in the column of the same name of a table."""
    if isinstance(allowed, DataFrame):
        return rows.join(allowed.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(list(allowed)))


def in_order(records: DataFrame, order: str = "rec_idx", files: int | None = None) -> DataFrame:
    """Records by their ordinal, ready to be written; ``files=1`` gives one file."""
    rows = records.orderBy(order)
    return rows.coalesce(files) if files else rows


def first_n(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def accumulated(rows: DataFrame, keys: list[str], fn: Callable[[pd.Series], float], value: str, name: str) -> DataFrame:
    """A user's accumulator per group: ``fn`` sees all values of a group at once, so a group must fit in memory.

    What built-in aggregates can say is better said with them: they are combined before the shuffle.
    """

    @F.pandas_udf("double")
    def accumulate(values: pd.Series) -> float:
        return fn(values)

    return rows.groupBy(*keys).agg(accumulate(value).alias(name))


def accumulate(
    rows: DataFrame, keys: list[str], start: Callable[[], object], process: Callable[[object, pd.DataFrame], object],
    merge: Callable[[object, object], object], finish: Callable[[object], tuple], schema: str, held: int = 50_000,
) -> DataFrame:
    """A user's accumulator per group: ``keys`` and the columns of ``schema`` that ``finish`` gives.

    Each task processes its rows into a state per group (``held`` of them at most, then they are sent on); only states are
    shuffled, and merged as they come, so neither a group's rows nor its states are gathered.
    """
    of_keys = rows.select(*keys).schema
    states_schema = StructType([*of_keys, *_schema(rows.sparkSession, "__state binary")])
    states_arrow = to_arrow_schema(states_schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}
        for batch in batches:
            numbers: dict[tuple, int] = {}
            code = np.array([numbers.setdefault(k, len(numbers)) for k in _key_rows(batch, keys)], np.int64)
            order, frame = np.argsort(code, kind="stable"), _frame(batch)
            ends = np.cumsum(np.bincount(code, minlength=len(numbers)))
            for key, start_at, end_at in zip(numbers, [0, *ends.tolist()], ends.tolist()):
                part = frame.iloc[order[start_at:end_at]]
                states[key] = process(states[key] if key in states else start(), part)
            if len(states) >= held:
                yield _batch_of([(*k, pickle.dumps(v)) for k, v in states.items()], states_arrow)
                states = {}
        yield _batch_of([(*k, pickle.dumps(v)) for k, v in states.items()], states_arrow)

    return _merged(rows.mapInArrow(partial, states_schema), keys, merge, finish, schema)


def _key_rows(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple]:
    """The key of each row: exact values, null as None, and one object for all NaN."""
    columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
    return zip(*[[x if x == x else math.nan for x in c] for c in columns])


def _batch_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _merged(
    states: DataFrame, keys: list[str], merge: Callable[[object, object], object], finish: Callable[[object], tuple], schema: str
) -> DataFrame:
    """The results of states (the keys, then the state), which are shuffled and merged as they come."""
    made = StructType([*states.select(*keys).schema, *_schema(states.sparkSession, schema)])
    made_arrow = to_arrow_schema(made)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for key, data in zip(_key_rows(batch, keys), batch.column(batch.num_columns - 1).to_pylist()):
                if at is None or key != at:
                    if at is not None:
                        done.append((*at, *finish(state)))
                    at, state = key, pickle.loads(data)
                else:
                    state = merge(state, pickle.loads(data))
            yield _batch_of(done, made_arrow)
        if at is not None:
            yield _batch_of([(*at, *finish(state))], made_arrow)

    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, made)


def process_loci(
    reads: DataFrame, targets: DataFrame, fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, **options
) -> DataFrame:
    """Pile the reads up at the targets and call ``fn`` once per target that has reads, with all rows of its pileup.

    Reads are shuffled, not their pairs with targets; a task holds one pileup at a time, which must fit in memory.
    """
    made = _schema(reads.sparkSession, schema)
    arrow = to_arrow_schema(made)

    def each(loci: Iterator[Locus]) -> Iterator[pa.RecordBatch]:
        done, n = [], 0
        for contig, pos, rows in loci:
            done.append(pa.Table.from_pandas(fn((contig, pos), rows.to_pandas()), schema=arrow, preserve_index=False))
            n += done[-1].num_rows
            if n >= BATCH_ROWS or len(done) >= BATCH_ROWS:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, n = [], 0
        yield from pa.concat_tables(done or [arrow.empty_table()]).combine_chunks().to_batches()

    return swept(reads, targets, each, made, **options)


def fold_reads(
    reads: DataFrame, targets: DataFrame, start: Callable[[], object], process: Callable[[object, pd.DataFrame], object],
    merge: Callable[[object, object], object], finish: Callable[[object], tuple], schema: str, held: int = 50_000, most_rows: int = 1_000_000, **options,
) -> DataFrame:
    """``contig, pos`` and the user's columns: pileups of any depth, folded where the reads are.

    As ``fold_loci``, but reads are shuffled and their pairs with targets never leave a task.  Where more than ``most_rows`` of them
    meet they are dealt out over several tasks, whose states are merged.  ``held``: states that are sent on together.
    """
    made = _schema(reads.sparkSession, "contig string, pos long, __state binary")
    arrow = to_arrow_schema(made)

    def each(loci: Iterator[Locus]) -> Iterator[pa.RecordBatch]:
        done = []
        for contig, pos, rows in loci:
            done.append((contig, pos, pickle.dumps(process(start(), _frame(rows)))))
            if len(done) >= held:
                yield _batch_of(done, arrow)
                done = []
        yield _batch_of(done, arrow)

    states = swept(reads, targets, each, made, most_rows=most_rows, **options)
    return _merged(states, ["contig", "pos"], merge, finish, schema)


def locus_apply(piled: DataFrame, fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` once per target, with all rows of its pileup, which must fit in memory; ``fold_loci`` has no such bound."""
    return piled.groupBy("contig", "pos").applyInPandas(fn, schema)


def fold_loci(
    piled: DataFrame, start: Callable[[], object], process: Callable[[object, pd.DataFrame], object],
    merge: Callable[[object, object], object], finish: Callable[[object], tuple], schema: str, held: int = 50_000,
) -> DataFrame:
    """``contig, pos`` and the user's columns: a pileup of any depth, folded where its rows are, so only states are gathered.

    ``process`` sees a locus's rows in parts of any size and order; ``schema`` is of the columns that ``finish`` gives.
    """
    return accumulate(piled, ["contig", "pos"], start, process, merge, finish, schema, held)


def process_records(
    records: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, order: str = "rec_idx", format: str = "parquet",
    **options,
) -> None:
    """Read, change, restore the order, write.  A source that isn't there is an error before anything is written."""
    in_order(change(records), order).write.format(format).options(**options).save(path)
