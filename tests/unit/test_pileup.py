"""Pileups against brute force: levels of length, blocks of CIGARs, depth from events, overlapping mates."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import pileup


def mixed_reads(seed, n):
    """Short reads, long ones and a few that span almost everything, on two contigs."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        size = rnd.choice([1, 2, 30, 100, 100, 100, 3000, 40_000]) if k % 50 else 190_000
        rows.append((rnd.choice(["c", "d"]), rnd.randrange(200_000 - size), size, k))
    return [(c, p, p + size, k) for c, p, size, k in rows]


READS = "contig string, pos0 long, end0 long, k long"


def test_mixed_lengths_meet_few_candidates(spark):
    reads = [r for r in mixed_reads(1, 400)] + [("c", 0, 200_000_000, 999)]
    targets = [("c", p) for p in range(1, 200_000, 1500)] + [("d", p) for p in range(700, 200_000, 1700)]
    left, right = spark.createDataFrame(reads, READS), spark.createDataFrame(targets, "contig string, pos long")
    got = pileup.covered(left, right)
    want = {(c, p, k) for c, a, b, k in reads for d, p in targets if c == d and a < p <= b}
    rows = [(r["contig"], r["pos"], r["k"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    # Candidates: pairs in one bin, by the same arithmetic written out.
    candidates = 0
    for c, a, b, _ in reads:
        level = max(4, (b - a - 1).bit_length())
        candidates += sum(c == d and a >> level <= p - 1 >> level <= b - 1 >> level for d, p in targets)
    assert candidates <= 4 * len(want)


def test_blocks_against_a_walk(spark):
    rnd = random.Random(4)
    reads, targets = [], [("c", p) for p in range(1, 400, 3)]
    for k in range(150):
        reads.append(("c", rnd.randrange(300), [(rnd.choice("MIDNSHP=X"), rnd.choice([0, 1, 2, 5, 30])) for _ in range(rnd.randint(0, 8))], k))
    df = spark.createDataFrame(reads, "contig string, pos0 long, cigar array<struct<op:string,len:long>>, k long")
    want = set()
    for _, pos0, cigar, k in reads:
        at, q = pos0, 0
        for op, n in cigar:
            for _ in range(n):
                if op in "MDN=X":
                    want.add((at + 1, k, q if op in "M=X" else None))
                    at += 1
                q += op in "MIS=X"
    places = {p for _, p in targets}
    want = {w for w in want if w[0] in places}
    got = pileup.pileup(df, spark.createDataFrame(targets, "contig string, pos long"))
    assert {"contig", "pos", "pos0", "end0", "cigar", "k", "qpos"} == set(got.columns)
    rows = [(r["pos"], r["k"], r["qpos"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    for width in (1, 64):
        again = pileup.pileup(df, spark.createDataFrame(targets, "contig string, pos long"), width=width)
        assert {(r["pos"], r["k"], r["qpos"]) for r in again.collect()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_depth_from_events(spark, seed):
    reads = [*mixed_reads(seed, 200), ("c", 5, 5, 1), ("e", 0, 3, 2), ("e", 3, 6, 3), ("e", 9, 10, 4)]
    targets = [(c, p) for c in "cdef" for p in range(1, 200_000, 997)] + [("e", p) for p in range(1, 13)] * 2
    df = spark.createDataFrame(reads, READS).repartition(5)
    depth = lambda c, p: sum(c == d and a < p <= b for d, a, b, _ in reads)
    want = {(c, p): depth(c, p) for c, p in targets if depth(c, p)}
    rows = pileup.depth_at(df, spark.createDataFrame(targets, "contig string, pos long").repartition(3)).collect()
    assert len(rows) == len(want) and {(r["contig"], r["pos"]): r["depth"] for r in rows} == want
    runs = pileup.depth_runs(df).collect()
    for c in "cde":
        mine = sorted((r["start"], r["end"], r["depth"]) for r in runs if r["contig"] == c)
        assert sum((b - a) * n for a, b, n in mine) == sum(b - a for d, a, b, _ in reads if d == c)
        assert all(x[1] < y[0] or x[1] == y[0] and x[2] != y[2] for x, y in zip(mine, mine[1:]))  # longest, and apart
        assert all(depth(c, a + 1) == n == depth(c, b) for a, b, n in mine)
    assert [(r["start"], r["end"], r["depth"]) for r in sorted(runs) if r["contig"] == "e"] == [(0, 6, 1), (9, 10, 1)]


def test_depth_leaves_flagged_reads_out_and_takes_cigars(spark):
    rows = [("c", 0, [("M", 5), ("D", 2), ("M", 3)], 0), ("c", 0, [("M", 5)], 4), ("c", 2, [("S", 4), ("M", 2)], 16)]
    df = spark.createDataFrame(rows, "contig string, pos0 long, cigar array<struct<op:string,len:long>>, flag int")
    targets = spark.createDataFrame([("c", p) for p in range(1, 13)], "contig string, pos long")
    got = {r["pos"]: r["depth"] for r in pileup.depth_at(df, targets).collect()}
    assert got == {p: 1 + (p in (3, 4)) for p in range(1, 11)}
    none = df.limit(0)
    assert pileup.depth_at(none, targets).count() == 0 and pileup.depth_runs(none).count() == 0


MATES = "contig string, pos long, qname string, pos0 long, base string, q int, k int"


def test_overlapping_mates_count_once(spark):
    rows = [
        ("c", 1, "agree", 0, "A", 30, 1), ("c", 1, "agree", 1, "A", 20, 2),
        ("c", 2, "agree", 0, "A", 150, 3), ("c", 2, "agree", 1, "A", 90, 4),  # 200 at most
        ("c", 1, "first", 0, "A", 30, 5), ("c", 1, "first", 1, "C", 20, 6),
        ("c", 1, "second", 0, "A", 19, 7), ("c", 1, "second", 1, "C", 37, 8),
        ("c", 1, "tie", 0, "A", 33, 9), ("c", 1, "tie", 1, "C", 33, 10),
        ("c", 1, "alone", 0, "A", 33, 11),
        ("c", 1, "gap", 0, None, None, 12), ("c", 1, "gap", 1, "C", 33, 13),  # a deletion is no mate
        ("c", 1, None, 0, "A", 33, 14), ("c", 1, None, 1, "A", 33, 15),  # no name, no mate
        ("c", 1, "three", 0, "A", 10, 16), ("c", 1, "three", 1, "A", 11, 17), ("c", 1, "three", 2, "A", 12, 18),
        ("d", 1, "agree", 0, "G", 7, 19),  # another place
    ]
    df = spark.createDataFrame(rows, MATES).repartition(4)
    got = pileup.overlapping_mates(df, F.col("base"), F.col("q"))
    assert got.columns == [*df.columns, "bq"]
    told = {r["k"]: r["bq"] for r in got.collect()}
    assert told == {
        1: 50, 2: 0, 3: 200, 4: 0, 5: 24, 6: 0, 7: 0, 8: 29, 9: 26, 10: 0, 11: 33, 12: None, 13: 33, 14: 33, 15: 33, 16: 21, 17: 0, 18: 12, 19: 7,
    }
    # Both mates stay in the depth.
    means = {(r["contig"], r["pos"]): (r["depth"], r["sum_bq"]) for r in pileup.mean_quality(got, F.col("bq")).collect()}
    assert means[("c", 2)] == (2, 200) and means[("d", 1)] == (1, 7)
    assert pileup.overlapping_mates(df.limit(0), F.col("base"), F.col("q")).count() == 0


def test_only_reads_that_meet_a_mate_are_brought_together(spark):
    rnd = random.Random(8)
    reads = [("c" if k % 3 else "d", rnd.randrange(400), rnd.choice([0, 1, 9, 40]), rnd.choice([None, *range(60)]), rnd.randint(0, 40), k) for k in range(500)]
    reads = [(c, p, p + n, name, q, k) for c, p, n, name, q, k in reads]
    df = spark.createDataFrame(reads, "contig string, pos0 long, end0 long, qname long, q int, k long").repartition(5)
    marked = pileup.marked_mates(df)
    assert marked.columns == [*df.columns, "meets"]
    meets = {
        k for c, a, b, name, _, k in reads
        if name is not None and any(j != k and (c, name) == (d, n) and max(a, x) < min(b, y) for d, x, y, n, _, j in reads)
    }
    assert 20 < len(meets) < 300 and {r["k"]: r["meets"] for r in marked.collect()} == {r[-1]: r[-1] in meets for r in reads}
    targets = spark.createDataFrame([(c, p) for c in "cd" for p in range(1, 440, 2)], "contig string, pos long")
    base, order = F.substring(F.lit("ACG"), (F.col("k") % 3 + 1).cast("int"), F.lit(1)), ("pos0", "k")
    rows = lambda d: sorted((tuple(r) for r in d.drop("meets").collect()), key=repr)
    plain, split = pileup.pileup(df, targets), pileup.pileup(marked, targets)
    assert rows(pileup.overlapping_mates(split, base, F.col("q"), "qname", order, "meets")) == rows(pileup.overlapping_mates(plain, base, F.col("q"), "qname", order))
    best = lambda d, **more: pileup.one_of_overlapping(d, "qname", "q", "k", **more).select(*plain.columns)
    assert rows(best(split, meets="meets")) == rows(best(plain))
    # The same rows by CIGARs, whose ends count.
    cigars = df.withColumn("cigar", F.array(F.struct(F.lit("M").alias("op"), (F.col("end0") - F.col("pos0")).alias("len")))).drop("end0")
    assert {r["k"] for r in pileup.marked_mates(cigars).where("meets").collect()} == meets
