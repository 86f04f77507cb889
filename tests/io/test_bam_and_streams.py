import gzip
import io
import logging
import struct

import pytest
from pyspark.sql import functions as F

from locusframe import logs
from locusframe.functions.dna import reverse_complement
from locusframe.operators.records import odd_position
from locusframe.sources import bam
from locusframe.sources.bgzf import LAST_BLOCK, unpacked_members
from locusframe.streaming import fastq_stream

REFS = [("chr1", 1000), ("chr2", 500)]


def plain_bam():
    """A BAM file made by hand: two records, one mapped and one not."""
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2)
    for name, length in REFS:
        data += struct.pack("<i", 5) + name.encode() + b"\0" + struct.pack("<i", length)
    one = struct.pack("<iiBBHHHiiii", 1, 99, 3, 60, 4681, 2, 16, 5, 0, 10, -7) + b"r1\0" + struct.pack("<II", 3 << 4, 2 << 4 | 4)
    one += bytes([0x12, 0x48, 0xF0]) + bytes([30, 31, 32, 33, 34]) + b"NMC\x01"
    two = struct.pack("<iiBBHHHiiii", -1, -1, 3, 0, 4680, 0, 4, 0, -1, -1, 0) + b"r2\0"
    for r in (one, two):
        data += struct.pack("<i", len(r)) + r
    return data


def test_read_bam(spark, tmp_path):
    data = plain_bam()
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]) + LAST_BLOCK)
    one, two = bam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("rec_idx").collect()
    assert (one.qname, one.flag, one.rname, one.pos0, one.mapq, one.rnext, one.pnext, one.tlen) == ("r1", 16, "chr2", 99, 60, "chr1", 10, -7)
    assert [tuple(c) for c in one.cigar] == [("M", 3), ("S", 2)] and one.seq == "ACGTN" and one.qual == "?@ABC" and bytes(one.tags) == b"NMC\x01"
    assert (two.rname, two.pos0, two.seq, two.qual, two.cigar) == (None, -1, None, None, [])
    head = bam.read_header(spark, str(tmp_path / "a.bam")).first()
    assert head.text == "@HD\tVN:1.6\n" and [tuple(r) for r in head.refs] == REFS


def test_bam_round_trip(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(gzip.compress(plain_bam()))
    records = bam.read_bam(spark, str(tmp_path / "a.bam"))
    many = records.crossJoin(spark.range(3000)).withColumn("rec_idx", F.col("id") * 2 + F.col("rec_idx")).drop("id")
    changed = many.withColumn("seq", reverse_complement(F.col("seq"))).orderBy("rec_idx")
    bam.write_bam(changed.coalesce(1), str(tmp_path / "out"), "@HD\tVN:1.6\n", REFS)
    again = bam.read_bam(spark, f"{tmp_path}/out/part-*").drop("path", "rec_idx", "voffset").collect()
    assert again == changed.drop("path", "rec_idx", "voffset").collect()
    kept = many.where(odd_position(F.col("pos0")))
    assert kept.count() == 0 and many.where(~odd_position(F.col("pos0"))).count() == 6000


def test_bam_errors(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(gzip.compress(plain_bam()[:-3]))
    with pytest.raises(Exception, match="ends within a record"):
        bam.read_bam(spark, str(tmp_path / "a.bam")).collect()
    (tmp_path / "b.bam").write_bytes(gzip.compress(b"SAM?"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "b.bam")).collect()


def test_fastq_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fastq").write_text("".join(f"@r{k}-{n}\nACGTN\n+\nIIIII\n" for n in range(5)))
    stream = fastq_stream.read_fastq_stream(spark, str(tmp_path / "in"), 1)
    assert stream.isStreaming
    change = lambda d: d.withColumn("sequence", reverse_complement(F.col("sequence"))).where("rec <> 4")
    for _ in range(2):  # the second run finds nothing new
        query = fastq_stream.process_stream(stream, change, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(got) == 12 and {r["sequence"] for r in got} == {"NACGT"}
    cut = spark.createDataFrame([("f", "@a\nAC\n")], "file string, value string")
    with pytest.raises(Exception, match="Unexpected EOF"):
        fastq_stream.fastq_records(cut).collect()
    assert fastq_stream.fastq_records(spark.createDataFrame([("f", "")], "file string, value string")).count() == 0


def test_logs(tmp_path, spark):
    path = tmp_path / "x.log"
    logs.to_stderr_and_file(str(path), "WARNING")
    log = logging.getLogger("locusframe.test")
    log.info("quiet")
    logs.modify_handler("file", "INFO")
    log.info("heard")
    logs.to_stderr_and_daily_file(str(tmp_path), "d.log", "INFO")
    log.warning(logs.lines([1, 2]))
    text = path.read_text()
    assert "heard" in text and "quiet" not in text and "1\n2" in (tmp_path / "d.log").read_text()
    with pytest.raises(KeyError):
        logs.modify_handler("none", "INFO")
    logs.spark_level(spark, "ERROR")
    assert logs.log_folder()


def test_bam_is_unpacked_as_far_as_it_is_taken(spark, tmp_path):
    data = plain_bam()
    small = b"".join(gzip.compress(data[k : k + 7]) for k in range(0, len(data), 7)) + b"\0" * 9
    assert b"".join(unpacked_members(io.BytesIO(small))) == data
    with pytest.raises(ValueError, match="within a compressed block"):
        list(unpacked_members(io.BytesIO(gzip.compress(data)[:-12])))
    unread = unpacked_members(io.BytesIO(small + b"\x1f\x8b broken"))
    assert next(unread) == data[:7]
    (tmp_path / "s.bam").write_bytes(small)
    assert bam.read_bam(spark, str(tmp_path / "s.bam")).count() == 2
    (tmp_path / "h.bam").write_bytes(gzip.compress(data) + b"no more of this file is read")
    assert bam.read_header(spark, str(tmp_path / "h.bam")).count() == 1
