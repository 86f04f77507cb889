import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from locusframe.operators import batching, binning, pairing, pileup, records


def batches(df):
    found = {}
    for r in df.orderBy("ord").collect():
        found.setdefault(r["batch"], []).append(r)
    return [found[k] for k in sorted(found)]


def coordinates(spark, rows):
    return spark.createDataFrame([(c, p, k) for k, (c, p) in enumerate(rows)], "contig string, pos long, ord long")


@pytest.mark.parametrize(
    "rows, window, sizes",
    [
        ([("chr1", 100), ("chr1", 200), ("chr1", 10000), ("chr1", 10100)], 1000, [2, 2]),
        ([("chr1", 100), ("chr1", 1099), ("chr1", 1100)], 1000, [2, 1]),
        ([("chr1", 100), ("chr1", 200), ("chr2", 150), ("chr2", 250)], 1000, [2, 2]),
        ([("chr1", 1), ("chr2", 1), ("chr1", 2)], 1000, [1, 1, 1]),
        ([("chr1", 5)], 1000, [1]),
        ([], 1000, []),
    ],
)
def test_batch_coordinates(spark, rows, window, sizes):
    assert [len(b) for b in batches(batching.batch_coordinates(coordinates(spark, rows), window))] == sizes


def test_batch_regions(spark):
    schema = "contig string, start long, end long, ord long"
    df = spark.createDataFrame([("chr1", 5 * i, 5 * i + 3, i) for i in range(100)], schema)
    assert [len(b) for b in batches(batching.batch_regions(df, 20))] == [4] * 25
    df = spark.createDataFrame([("chr1", 0, 40, 0), ("chr1", 45, 60, 1), ("chr1", 70, 110, 2)], schema)
    assert [len(b) for b in batches(batching.batch_regions(df, 100))] == [2, 1]


def test_contig_runs_across_blocks(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), ("b", 1), ("b", 1), ("a", 1), ("c", 1)]
    for blocks in (1, 2, 3, 100):
        got = batching.contig_runs(coordinates(spark, rows), blocks=blocks).orderBy("ord").collect()
        assert [r["run"] for r in got] == [0, 0, 1, 1, 1, 2, 3]


@pytest.mark.parametrize("blocks, window", [(1, 30), (5, 30), (40, 3), (7, 0)])
def test_batches_equal_a_fold(spark, blocks, window):
    """Regions that neither start nor end in order, in runs of few contigs."""
    rnd = random.Random(blocks)
    rows, at = [], 0
    for k in range(300):
        at += rnd.choice([0, 1, 5, 60, -20])
        rows.append((rnd.choice("ab") if k % 40 == 0 else rows[-1][0], at, at + rnd.randint(0, 25), k * k))
    want, anchor = [-1], None
    for contig, start, end, _ in rows:
        new = anchor is None or contig != anchor[0] or end - anchor[1] >= window
        anchor = (contig, start) if new else anchor
        want.append(want[-1] + new)
    df = spark.createDataFrame(rows, "contig string, start long, end long, ord long").repartition(4)
    got = batching.batch_regions(df, window, blocks=blocks).orderBy("ord").collect()
    assert [r["batch"] for r in got] == want[1:]


def test_overlapping_mates(spark):
    rows = [("c", 1, "t", 30, 64), ("c", 1, "t", 20, 128), ("c", 2, "t", 5, 64), ("c", 1, None, 1, 0), ("c", 1, None, 1, 0)]
    df = spark.createDataFrame(rows, "contig string, pos long, qname string, bq int, flag int")
    got = pileup.one_of_overlapping(df, "qname", "bq", "flag")
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


@pytest.mark.parametrize("width", [None, 1, 7, 4096])
def test_width_of_bins_does_not_matter(spark, width):
    rnd = random.Random(2)
    reads = [("c", p, p + rnd.choice([0, 1, 9, 300]), k) for k, p in enumerate(rnd.randrange(500) for _ in range(80))]
    targets = [("c", p) for p in range(1, 900, 13)]
    got = pileup.covered(spark.createDataFrame(reads, "contig string, pos0 long, end0 long, k long"), spark.createDataFrame(targets, "contig string, pos long"), width)
    assert {(r["pos"], r["k"]) for r in got.collect()} == {(p, k) for _, a, b, k in reads for _, p in targets if a <= p - 1 < b}


def test_width_without_reads(spark):
    none = spark.createDataFrame([], "contig string, pos0 long, end0 long")
    assert pileup.covered(none, spark.createDataFrame([("c", 1)], "contig string, pos long")).count() == 0


@pytest.mark.parametrize(
    "s, e, w, n, last",
    [(0, 100, 10, 10, (90, 100)), (0, 105, 10, 11, (100, 105)), (10, 15, 10, 1, (10, 15)), (50, 50, 10, 0, None),
     (0, 5, 10, 1, (0, 5)), (100, 1000, 25, 36, (975, 1000)), (5, 27, 10, 3, (25, 27)), (100, 50, 10, 0, None)],
)
def test_bins(spark, s, e, w, n, last):
    lit = lambda x: F.lit(x).cast("long")
    got = spark.range(1).select(binning.bins(lit(s), lit(e), lit(w)).alias("b")).first()["b"]
    assert len(got) == n and (tuple(got[-1]) if got else None) == last


def test_bins_reject_width_zero(spark):
    with pytest.raises(Exception, match="bin width"):
        spark.range(1).select(binning.bins(F.lit(0).cast("long"), F.col("id") + 5, F.col("id"))).collect()


READS = "contig string, pos0 long, end0 long, bq int"


def test_mean_quality_counts_deletions(spark):
    reads = spark.createDataFrame([("c", 0, 10, 30), ("c", 5, 10, None), ("c", 5, 6, None)], READS)
    targets = spark.createDataFrame([("c", 1), ("c", 6), ("c", 7), ("c", 6), ("c", 50), ("d", 1)], "contig string, pos long")
    got = {r["pos"]: (r["depth"], r["mean_bq"]) for r in pileup.mean_quality(pileup.pileup(reads, targets), F.col("bq")).collect()}
    assert got == {1: (1, 30.0), 6: (3, 10.0), 7: (2, 15.0)}


def test_all_deletions_give_zero(spark):
    reads = spark.createDataFrame([("c", 0, 10, None)], READS)
    targets = spark.createDataFrame([("c", 3)], "contig string, pos long")
    assert pileup.mean_quality(pileup.pileup(reads, targets), F.col("bq")).first()["mean_bq"] == 0.0


def walk(pos0, cigar, target):
    r, q = pos0, 0
    for n, op in cigar:
        if op in "M=X" and r <= target < r + n:
            return q + target - r
        r += n if op in "MDN=X" else 0
        q += n if op in "MIS=X" else 0
    return None


def test_cigar(spark):
    import random

    rnd = random.Random(7)
    cases = [[(rnd.randint(1, 9), rnd.choice("MIDNSHP=X")) for _ in range(rnd.randint(1, 6))] for _ in range(60)]
    rows = [("".join(f"{n}{o}" for n, o in c), 100, 100 + t) for c in cases for t in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "text string, pos0 long, target long")
    cigar = pileup.parse_cigar(F.col("text"))
    got = df.select("text", "target", pileup.query_offset(F.col("pos0"), cigar, F.col("target")).alias("q")).collect()
    want = {("".join(f"{n}{o}" for n, o in c), 100 + t): walk(100, c, 100 + t) for c in cases for t in range(0, 40, 3)}
    assert {(r["text"], r["target"]): r["q"] for r in got} == want
    assert spark.createDataFrame([("*",)], "t string").select(F.size(pileup.parse_cigar(F.col("t")))).first()[0] == 0


def test_base_counts(spark):
    df = spark.createDataFrame([(b,) for b in "ATCGNatcgnXZP"], "b string")
    got = pileup.base_counts(df, F.col("b")).first()
    assert tuple(got) == (2, 2, 2, 2, 2, 3)
    with pytest.raises(Exception, match="Unsupported base: X"):
        df.select(pileup.checked_base(F.col("b"))).collect()


def test_records(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([-1, 0, 1, 2, 3])], "rec_idx long, pos0 long")
    assert [r["pos0"] for r in records.keep(df, records.odd_position(F.col("pos0"))).collect()] == [0, 2]
    seen = Observation()
    kept = records.drop_errors(df, F.when(F.col("pos0") >= 0, F.col("pos0")), "pos", seen)
    assert kept.count() == 4 and seen.get == {"records": 5, "dropped": 1}
    assert [r["rec_idx"] for r in records.in_order(df.orderBy(F.desc("rec_idx")), files=1).collect()] == [0, 1, 2, 3, 4]
    assert records.members(df, "pos0", [1, 3]).count() == 2
    assert records.modify_records(df, lambda p: p[p.pos0 > 1]).count() == 2


def test_process_records(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "rec_idx").write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    records.process_records(source, lambda d: d.where("rec_idx % 2 = 0"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    with pytest.raises(Exception):
        records.process_records(spark.read.parquet(str(tmp_path / "none")), lambda d: d, str(tmp_path / "o2"))


def test_zip_unequal(spark):
    schema = "rec long, header string, sequence string"
    a = spark.createDataFrame([(0, "a", "ACG"), (1, "b", "A")], schema)
    b = spark.createDataFrame([(0, "x", "AC")], schema)
    pairs = pairing.zip_mates(a, b)
    assert tuple(pairing.mate_totals(pairs).first()) == (2, 1, 4, 2)
    assert pairs.where("r2 is null").first()["rec"] == 1


def test_hash_lookup_last_target_wins(spark):
    sites = spark.createDataFrame([(9, "s1", 0), (9, "s2", 1)], "pos0 long, name string, site_ord long")
    targets = spark.createDataFrame([("c", 10, 1), ("d", 10, 2)], "contig string, pos long, ord long")
    got = pileup.hash_lookup(sites, targets, "ord").collect()
    assert [(r["name"], r["target"]["contig"]) for r in got] == [("s1", "d")]


def test_user_functions(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["top"] for r in records.accumulated(df, ["k"], lambda s: float(s.max()), "v", "top").collect()}
    assert got == {"a": 4.0, "b": 2.0}
    reads = spark.createDataFrame([("c", 0, 10, 30), ("c", 5, 10, None)], READS)
    targets = spark.createDataFrame([("c", 6), ("c", 60)], "contig string, pos long")
    fn = lambda key, pdf: pd.DataFrame({"pos": [key[1]], "n": [len(pdf)]})
    assert [tuple(r) for r in records.process_loci(reads, targets, fn, "pos long, n long").collect()] == [(6, 2)]


@pytest.mark.parametrize("held", [1, 50_000])
def test_accumulators_are_merged(spark, held):
    rows = [(k % 5 or None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = records.accumulate(
        df, ["k"], lambda: (0, 0), lambda s, pdf: (s[0] + len(pdf), s[1] + int(pdf["v"].sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]),
        lambda s: s, "n long, total long", held,
    )
    want = {k or None: (40, sum(v for v in range(200) if v % 5 == k)) for k in range(5)}
    assert {r["k"]: (r["n"], r["total"]) for r in got.collect()} == want


BIG = 2**53 + 1


def big_rows(spark):
    schema = "ord long, contig string, pos long, big long, price decimal(20, 2), at timestamp, list array<long>"
    rows = [
        (k, "chr1" if k < 5 else "chr2", 10 * k, None if k % 3 == 0 else BIG + k, None if k == 1 else Decimal(f"{BIG}.0{k}"), datetime(2020, 1, 1, k), [BIG, None])
        for k in range(9)
    ]
    return spark.createDataFrame(rows, schema)


def test_columns_that_are_not_looked_at_stay_exact(spark):
    rows = big_rows(spark)
    want = rows.orderBy("ord").collect()
    for got in (batching.batch_coordinates(rows, 25), batching.batch_regions(rows.withColumn("start", F.col("pos")).withColumn("end", F.col("pos")), 25)):
        assert got.select(*rows.columns).orderBy("ord").collect() == want
    same = records.modify_records(rows, lambda pdf: pdf)
    assert same.schema == rows.schema and same.orderBy("ord").collect() == want
    some = records.modify_records(rows.select("ord", "big"), lambda pdf: pdf[pdf["ord"] % 2 == 1].assign(big=pdf["big"] + 1))
    assert {r.ord: r.big for r in some.collect()} == {k: None if k % 3 == 0 else BIG + k + 1 for k in (1, 3, 5, 7)}


def test_null_orders_and_positions_are_errors(spark):
    rows = big_rows(spark).withColumn("ord", F.when(F.col("ord") != 4, F.col("ord")))
    for blocks in (1, 3):
        for make in (lambda: batching.contig_runs(rows, blocks=blocks), lambda: batching.running_total(rows, F.col("pos"), "sum", "ord", blocks)):  # noqa: B023
            with pytest.raises(Exception, match="is null in a row"):
                make().collect()
    with pytest.raises(Exception, match="a position is null"):
        batching.batch_coordinates(big_rows(spark).withColumn("pos", F.when(F.col("ord") != 4, F.col("pos"))), 25).collect()


def test_accumulated_keys_are_exact(spark):
    """Longs over 2^53 beside null, decimals, timestamps, NaN and null, in several partitions and states sent on early."""
    rows = spark.createDataFrame(
        [(BIG, 1), (BIG, 2), (BIG - 1, 3), (None, 4), (None, 5)], "key long, x long"
    ).repartition(3)
    count = (lambda: [0, 0], lambda s, pdf: [s[0] + len(pdf), s[1] + int(pdf["x"].sum())], lambda a, b: [a[0] + b[0], a[1] + b[1]], tuple)
    got = records.accumulate(rows, ["key"], *count, "n long, total decimal(10, 0)", held=1)
    assert {tuple(r) for r in got.collect()} == {(BIG, 2, 3), (BIG - 1, 1, 3), (None, 2, 9)}
    many = spark.createDataFrame(
        [(Decimal("1.10"), datetime(2020, 1, 1), float("nan"), 1), (Decimal("1.10"), datetime(2020, 1, 1), float("nan"), 2), (None, None, None, 3), (None, None, float("nan"), 4)],
        "a decimal(10, 2), b timestamp, c double, x long",
    ).repartition(2)
    got = records.accumulate(many, ["a", "b", "c"], *count, "n long, total long").collect()
    assert sorted((r.a is None, r.c is None, r.n, r.total) for r in got) == [(False, False, 2, 3), (True, False, 1, 4), (True, True, 1, 3)]
    assert all(r.a is None or (r.a == Decimal("1.10") and r.b == datetime(2020, 1, 1)) for r in got)
    assert records.accumulate(rows.limit(0), ["key"], *count, "n long, total long").count() == 0


def test_stepped_positions(spark):
    df = spark.createDataFrame(
        [("a", 5, 12, 0), ("a", 5, 5, 1), ("b", None, 9, 2), ("b", 0, 30_001, 3), ("c", 9, 3, 4)], "contig string, start long, end long, k long"
    )
    got = {}
    for r in binning.stepped(df, 3, "k").collect():
        got.setdefault(r["k"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [5, 8, 11], 3: list(range(0, 30_001, 3))}
    with pytest.raises(ValueError, match="at least 1"):
        binning.stepped(df, 0)


def test_fold_of_a_deep_locus(spark):
    """A locus over all tasks, states sent on after every batch: the same as with all its rows at once."""
    depth = 5000
    piled = spark.range(depth).selectExpr("'a' AS contig", "if(id % 10 < 9, 7L, id) AS pos", "id % 97 AS q").repartition(8)
    fold = records.fold_loci(
        piled, lambda: (0, 0), lambda s, rows: (s[0] + len(rows), s[1] + int(rows["q"].sum())),
        lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s, "n long, total long", held=1,
    )
    want = piled.groupBy("contig", "pos").agg(F.count("*").alias("n"), F.sum("q").alias("total"))
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, want.collect()))
