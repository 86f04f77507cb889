import gzip

import pytest
from pyspark.sql import functions as F

from locusframe.sources import fai, fastq, raw

RECORDS = "".join(f"@r{k} x\n{'ACGT' * (k + 1)}\n+\n{'IIII' * (k + 1)}\n" for k in range(50))


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(RECORDS)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(RECORDS)
    for name in ("a.fastq", "b.fastq.gz"):
        got = fastq.read_fastq(spark, str(tmp_path / name), strict=True).orderBy("rec").collect()
        assert [r["header"] for r in got] == [f"@r{k} x" for k in range(50)]
        assert all(len(r["sequence"]) == 4 * (k + 1) for k, r in enumerate(got))
    ids = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).select(fastq.header_id(F.col("header")).alias("i"), "rec")
    assert ids.where("rec = 3").first()["i"] == "@r3"


@pytest.fixture
def split_bytes(spark):
    """Sets the size of splits."""
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 150, 4096])
def test_fastq_over_splits(spark, tmp_path, split_bytes, size):
    """Splits of less than a line, of one to seven lines, of many records; files with records of their own."""
    text = RECORDS * (1 if size < 4096 else 20)
    if size == 7:
        text = text[: text.index("@r5 ")]
    for name in ("a.fastq", "b.fastq"):
        (tmp_path / name).write_text(text)
    split_bytes(size)
    want = text.splitlines()
    got = fastq.read_fastq(spark, str(tmp_path), strict=True).orderBy("file", "rec").collect()
    assert [r["rec"] for r in got] == 2 * list(range(len(want) // 4))
    assert [x for r in got for x in r[2:]] == 2 * want
    as_one = fastq.read_fastq(spark, str(tmp_path), as_one=True).orderBy("rec").collect()
    assert [r["rec"] for r in as_one] == list(range(len(want) // 2)) and [x for r in as_one for x in r[2:]] == 2 * want


def test_fastq_batches_and_bytes(spark, tmp_path):
    """Records over borders of Arrow batches, and bytes that are no UTF-8."""
    (tmp_path / "a.fastq").write_bytes(RECORDS.encode().replace(b"@r0 x", b"@r0 \xff"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("rec").select(F.hex("header").alias("h")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [bytes.fromhex(r["h"]) for r in got] == [b"@r0 \xff"] + [f"@r{k} x".encode() for k in range(1, 50)]


def test_fastq_text_is_not_shuffled(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(RECORDS)
    plan = fastq.read_fastq(spark, str(tmp_path / "a.fastq"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("FileScan text")]
    assert "Exchange" not in scan[scan.rindex("MapInArrow") :] and "BroadcastHashJoin" in scan


def test_fastq_pairs(spark, tmp_path):
    (tmp_path / "1.fastq").write_text(RECORDS)
    (tmp_path / "2.fastq").write_text(RECORDS[: RECORDS.index("@r10")])
    pairs = fastq.read_pairs(spark, str(tmp_path / "1.fastq"), str(tmp_path / "2.fastq"))
    assert pairs.count() == 50 and pairs.where("r2 is null").count() == 40


def test_fastq_errors(spark, tmp_path):
    (tmp_path / "cut.fastq").write_text("@a\nACG\n+\nIII\n@b\nAC\n")
    with pytest.raises(Exception, match="Unexpected EOF in fastq."):
        fastq.read_fastq(spark, str(tmp_path / "cut.fastq")).collect()
    (tmp_path / "odd.fastq").write_text("a\nACG\n+\nII\n")
    assert fastq.read_fastq(spark, str(tmp_path / "odd.fastq")).count() == 1
    with pytest.raises(Exception, match="must start with @"):
        fastq.read_fastq(spark, str(tmp_path / "odd.fastq"), strict=True).collect()
    (tmp_path / "crlf.fastq").write_bytes(b"@a\r\nAC\r\n+\r\nII\r\n")
    assert fastq.read_fastq(spark, str(tmp_path / "crlf.fastq")).first()["sequence"] == "AC\r"
    assert fastq.read_fastq(spark, str(tmp_path / "crlf.fastq"), strip_cr=True).first()["sequence"] == "AC"


def test_fastq_write(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(RECORDS)
    read = fastq.read_fastq(spark, str(tmp_path / "a.fastq"))
    fastq.write_fastq(read, str(tmp_path / "out.gz"))
    rows = fastq.read_fastq(spark, str(tmp_path / "out.gz"), as_one=True).orderBy("rec").collect()
    assert [r["rec"] for r in rows] == list(range(50))
    again = "".join(f"{r['header']}\n{r['sequence']}\n{r['plus']}\n{r['quality']}\n" for r in rows)
    assert again == RECORDS


def test_bins_from_fasta(spark, tmp_path):
    (tmp_path / "g.fa.fai").write_text("chr1\t12\t6\t12\t13\nchrM\t5\t25\t5\t6\n")
    got = {r["chrom"]: [tuple(b) for b in r["bins"]] for r in fai.bins_from_fasta(spark, str(tmp_path / "g.fa"), 10).collect()}
    assert got == {"chr1": [(0, 10), (10, 12)], "chrM": [(0, 5)]}


def test_raw(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    assert raw.total_bytes(spark, str(tmp_path / "x.bin")).first()["n_bytes"] == 5
    copy = raw.in_memory(spark.range(5))
    assert copy.count() == 5 and copy.storageLevel.useMemory and not copy.storageLevel.useDisk
    copy.unpersist()
