"""User functions on pileups that are made in the tasks: the same rows as those of the join, only reads are shuffled."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.operators import pileup, records
from tests.unit.test_pileup import READS, mixed_reads


def rows_of(key, pdf):
    assert set(pdf["contig"]) == {key[0]} and set(pdf["pos"]) == {key[1]}
    return pdf.assign(n=len(pdf))


def tuples(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("width, step_rows", [(None, 50_000), (None, 3), (1000, 7), (1 << 18, 11)])
def test_pileups_in_tasks_equal_the_join(spark, width, step_rows):
    reads = [*mixed_reads(3, 300), ("c", 5, 5, 1), ("c", 9, 2, 2), (None, 0, 900, 3), ("c", None, 900, 4), ("e", -5, 3, 5)]
    targets = [("c", p, p % 7) for p in range(1, 200_000, 1500)] + [("d", p, 0) for p in range(700, 200_000, 1700)]
    targets += [("d", 700, 0), (None, 1, 0), ("c", None, 0), ("e", -3, 1), ("e", 3, 1), ("e", 4, 1)]
    left = spark.createDataFrame(reads, READS).repartition(5)
    right = spark.createDataFrame(targets, "contig string, pos long, mark int").repartition(3)
    want = pileup.pileup(left, right)
    depth = want.groupBy("contig", "pos").agg(F.count("*").alias("n"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in want.schema) + ", n long"
    got = records.process_loci(left, right, rows_of, schema, width=width, step_rows=step_rows)
    assert got.columns == [*want.columns, "n"]
    found = tuples(got.collect())
    assert found and found == tuples(want.join(depth, ["contig", "pos"]).select(*got.columns).collect())


def test_cigars_in_tasks_equal_the_join(spark):
    rnd = random.Random(5)
    reads = [("c", rnd.randrange(300), [(rnd.choice("MIDNSHP=X"), rnd.choice([0, 1, 2, 5, 30])) for _ in range(rnd.randint(0, 8))], rnd.choice([0, 4, 16]), k) for k in range(150)]
    df = spark.createDataFrame(reads, "contig string, pos0 long, cigar array<struct<op:string,len:long>>, flag int, k long")
    targets = spark.createDataFrame([("c", p) for p in range(1, 400, 3)], "contig string, pos long")

    def fn(key, pdf):
        return pdf[["pos", "k", "qpos"]].astype("Int64").assign(ops=pdf["cigar"].map(len))

    want = pileup.pileup(df, targets).select("pos", "k", "qpos", F.size("cigar").cast("long").alias("ops"))
    got = records.process_loci(df, targets, fn, "pos long, k long, qpos long, ops long", step_rows=20)
    assert tuples(got.collect()) == tuples(want.collect())


@pytest.mark.parametrize("most_rows", [9, 1_000_000])
def test_folds_in_tasks_whatever_the_depth(spark, most_rows):
    """Reads of deep bins are dealt out, and their states merged."""
    reads = [*mixed_reads(6, 200), *[("c", 100 + k % 3, 130, k) for k in range(400)]]
    df = spark.createDataFrame(reads, READS).repartition(6)
    targets = spark.createDataFrame([("c", p) for p in [*range(95, 140), 5000, 5000]] + [("d", 77), ("x", 1)], "contig string, pos long")
    got = records.fold_reads(
        df, targets, lambda: (0, 0), lambda s, rows: (s[0] + len(rows), s[1] + int(rows["k"].sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), tuple,
        "n long, total long", held=5, most_rows=most_rows, width=64,
    )
    want = pileup.pileup(df, targets).groupBy("contig", "pos").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    found = tuples(got.collect())
    assert len(found) >= 40 and found == tuples(want.collect())
    none = records.fold_reads(df.limit(0), targets, lambda: 0, lambda s, rows: s, lambda a, b: a, lambda s: (s,), "n long")
    assert none.count() == 0


def test_pairs_are_not_shuffled(spark, sf_dir):
    """User functions on loci: no join of reads with targets, whose rows would be grouped by locus afterwards."""
    from locusframe import catalog

    plan = lambda name: catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan("locus_user_function") and "SortMergeJoin" not in plan("locus_user_fold")
    with pytest.raises(ValueError, match="clash"):
        reads = spark.createDataFrame([("c", 0, 9, 1)], READS)
        records.process_loci(reads, spark.createDataFrame([("c", 1, 2)], "contig string, pos long, k long"), lambda key, pdf: pd.DataFrame(), "k long")
