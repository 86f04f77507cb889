"""The data source for BAM files: splits, indexes and the two phases of writing."""

import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusframe.sources import bam
from locusframe.sources.bam_index import Index
from locusframe.sources.bgzf import LAST_BLOCK, BlockFile

REFS = [("chr1", 40_000_000), ("chr2", 500_000), ("empty", 10)]


def block(data, level=6):
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def records(seed, n):
    """Random records as (plain fields, bytes), some of them longer than a split, with bytes in the tags that look like others."""
    rnd = random.Random(seed)
    made = []
    for k in range(n):
        name = f"r{k}".encode()
        ops = [(rnd.choice("MIDNSHP=X"), rnd.randint(1, 300)) for _ in range(rnd.choice([0, 1, 3, 40]))]
        seq = "".join(rnd.choice("ACGTN=") for _ in range(rnd.choice([0, 1, 2, 7, 150, 3000])))
        qual = None if not seq or rnd.random() < 0.2 else "".join(chr(33 + rnd.randint(0, 60)) for _ in seq)
        ref, pos = rnd.choice([(-1, -1), (0, rnd.randrange(30_000_000)), (1, rnd.randrange(400_000))])
        tags = rnd.choice([b"", b"NMC\x01", rnd.randbytes(rnd.choice([10, 5000])), b"", made[-1][1] if made else b""])
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, rnd.randrange(256), 0, len(ops), rnd.randrange(4096), len(seq), -1, -1, rnd.randint(-9, 9))
        body += name + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for op, n in ops)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body += (bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)) + tags
        end = pos + max(1, sum(n for op, n in ops if op in "MDN=X")) if pos >= 0 else pos
        row = (f"r{k}", REFS[ref][0] if ref >= 0 else None, pos, end, ops, seq or None, qual, tags)
        made.append((row, struct.pack("<i", len(body)) + body))
    return made


def written(path, made, refs=REFS, size=700, text=b"@HD\n"):
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, length in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    data += b"".join(m[1] for m in made)
    path.write_bytes(b"".join(block(data[k : k + size]) for k in range(0, len(data), size)) + LAST_BLOCK)


def rows_of(df):
    return [
        (r.qname, r.rname, r.pos0, r.end0, [tuple(c) for c in r.cigar], r.seq, r.qual, bytes(r.tags))
        for r in df.orderBy("path", "rec_idx").collect()
    ]


@pytest.mark.parametrize("seed, split", [(0, 997), (1, 5000), (2, 64 << 20)])
def test_one_file_in_splits(spark, tmp_path, seed, split):
    made = records(seed, 120)
    written(tmp_path / "a.bam", made)
    found = bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=split)
    assert split > 5000 or found.rdd.getNumPartitions() >= 8
    assert rows_of(found) == [m[0] for m in made]
    assert [r.rec_idx for r in found.select("rec_idx").orderBy("rec_idx").collect()] == list(range(120))
    offsets = [r.voffset for r in found.select("voffset").orderBy("rec_idx").collect()]
    assert offsets == sorted(set(offsets))


def test_a_task_reads_several_of_very_many_splits(tmp_path):
    made = records(0, 120)
    written(tmp_path / "a.bam", made)
    size = os.path.getsize(tmp_path / "a.bam")
    assert size > 4000
    reader = bam.BamReader({"path": str(tmp_path / "a.bam"), "split_bytes": "3"})
    parts = reader.partitions()
    assert size > 3 * bam.MOST_TASKS and bam.MOST_TASKS // 4 < len(parts) <= bam.MOST_TASKS
    assert all(a.end == b.start for a, b in zip(parts, parts[1:])) and (parts[0].start, parts[-1].end) == (0, size)
    names = {x for part in parts for batch in reader.read(part) for x in batch.column("qname").to_pylist()}
    assert names == {m[0][0] for m in made}  # nothing is checked here, so records within others may come as well
    # Splits are kept while there are few of them, and no task reads more than SPLIT_BYTES.
    assert bam.task_bytes(1000 * 997, 997) == 997 and bam.task_bytes(1 << 50, 1 << 14) == bam.SPLIT_BYTES == bam.task_bytes(1 << 50, bam.SPLIT_BYTES)
    assert bam.task_bytes(1 << 31, 1 << 14) == 2 << 20 and bam.task_bytes(1 << 31, 100 << 20) == 100 << 20 and bam.task_bytes(0, 5) == 5


def test_large_header_and_empty_file(spark, tmp_path):
    """A header that spans many splits; a file without records; a folder of files."""
    refs = [(f"contig{k}", 1000 + k) for k in range(800)]
    made = records(5, 20)
    written(tmp_path / "a.bam", made, refs[:3] + refs, text=b"@CO\tx\n" * 3000)
    written(tmp_path / "b.bam", [])
    found = bam.read_bam(spark, str(tmp_path), split_bytes=500)
    assert [r[0] for r in rows_of(found)] == [m[0][0] for m in made]
    heads = {os.path.basename(r.path): r for r in bam.read_header(spark, str(tmp_path)).collect()}
    assert len(heads["a.bam"].refs) == 803 and len(heads["a.bam"].text) == 18_000 and [tuple(r) for r in heads["b.bam"].refs] == REFS


def test_wrong_guesses_are_put_right_and_damage_is_an_error(spark, tmp_path):
    """Records that end with a copy of the one before: a split may take the copy for a record."""
    made = [m for m in records(3, 60) if m[0][1]]
    nested = []
    for row, raw in made:
        inner = nested[-1][1] if nested and len(nested) % 6 else b""
        nested.append(((*row[:-1], row[-1] + inner), struct.pack("<i", len(raw) - 4 + len(inner)) + raw[4:] + inner))
    written(tmp_path / "a.bam", nested)
    found = bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=800)
    assert rows_of(found) == [m[0] for m in nested]
    plain = bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=800, ordinals=False)
    assert plain.count() != len(nested)  # so there were wrong guesses
    data = bytearray((tmp_path / "a.bam").read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "a.bam").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|no compressed block|invalid|Error -3|record"):
        bam.read_bam(spark, str(tmp_path / "a.bam"), split_bytes=2000).count()


def table(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        name, length = rnd.choice(REFS[:2])
        span = rnd.choice([1, 50, 100, 20_000, 300_000])
        rows.append((f"r{k}", 0, name, rnd.randrange(length - 400_000), 60, [("M", span)], None, -1, 0, "ACGTA", "IIII#", None))
    rows += [(f"u{k}", 4, None, -1, 0, [], None, -1, 0, None, None, None) for k in range(50)]
    schema = "qname string, flag int, rname string, pos0 long, mapq int, cigar array<struct<op:string,len:bigint>>, rnext string, pnext long, tlen long, seq string, qual string, tags binary"
    return spark.createDataFrame(rows, schema)


def sorted_rows(df):
    return df.withColumn("unmapped", F.col("rname").isNull()).orderBy("unmapped", "rname", "pos0").drop("unmapped")


REGIONS = [("chr1", 1_000_000, 1_050_000), ("chr1", 1_040_000, 1_040_001), ("chr2", 0, 5000), ("chr2", 99_000, 99_001), ("none", 0, 10), ("empty", 0, 10)]


def test_regions_read_their_chunks_only(spark, tmp_path):
    df = table(spark)
    out = str(tmp_path / "out")
    bam.write_bam(sorted_rows(df).coalesce(1), out, "@HD\n", REFS)
    (name,) = [f for f in os.listdir(out) if f.endswith(".bam")]
    want = {
        (r.qname, r.rname, r.pos0)
        for r in df.collect()
        if any(r.rname == n and r.pos0 < b and r.pos0 + r.cigar[0].len > a for n, a, b in REGIONS)
    }
    assert 20 < len(want) < 2000
    found = bam.read_regions(spark, out, REGIONS).collect()
    assert len(found) == len(want) and {(r.qname, r.rname, r.pos0) for r in found} == want
    # All blocks outside the header and the chunks are overwritten: what is not read cannot harm.
    path = os.path.join(out, name)
    size = os.path.getsize(path)
    with open(path + ".bai", "rb") as file:
        index = Index(file.read())
    chunks = [c for n, a, b in REGIONS for c in index.chunks({"chr1": 0, "chr2": 1, "empty": 2}.get(n, -1), a, b)]
    with open(path, "r+b") as file:
        blocks, at, places = BlockFile(file, size), 0, []
        while at < size:
            places.append(at)
            at = blocks.block(at)[1]
        read = {p for p in places if p == 0 or any(a >> 16 <= p <= b >> 16 for a, b in chunks)}
        assert len(read) < len(places)
        for p, end in zip(places, [*places[1:], size]):
            if p not in read:
                file.seek(p)
                file.write(b"\x55" * (end - p))
    again = bam.read_regions(spark, out, REGIONS).collect()
    assert {(r.qname, r.rname, r.pos0) for r in again} == want
    with pytest.raises(Exception):
        bam.read_bam(spark, out).count()


def test_index_against_brute_force():
    """Every record that overlaps a region begins in one of its chunks."""
    import numpy as np

    from locusframe.sources.bam_index import IndexBuilder
    from locusframe.sources.bam_records import bins

    rnd = random.Random(2)
    pos = np.array(sorted(rnd.randrange(3_000_000) for _ in range(3000)))
    end = pos + np.array([rnd.choice([1, 100, 40_000, 900_000]) for _ in pos])
    offsets = np.array([(k // 9 * 20_000 << 16) + k % 9 * 5000 for k in range(len(pos) + 1)])
    made = IndexBuilder(1)
    for k in range(0, len(pos), 700):
        part = slice(k, k + 700)
        made.add(np.zeros(len(pos[part]), int), pos[part], end[part], bins(pos[part], end[part]), offsets[:-1][part], offsets[1:][part])
    assert made.sorted
    index = Index(made.encoded())
    for _ in range(300):
        a = rnd.randrange(3_500_000)
        b = a + rnd.choice([1, 500, 100_000])
        chunks = index.chunks(0, a, b)
        for k in np.flatnonzero((pos < b) & (end > a)):
            assert any(x <= offsets[k] < y for x, y in chunks)
    made.add(np.array([0]), pos[:1], end[:1], bins(pos[:1], end[:1]), offsets[:1], offsets[1:2])
    assert not made.sorted


def test_filters_reach_the_source(spark, tmp_path):
    out = str(tmp_path / "out")
    bam.write_bam(sorted_rows(table(spark)).repartitionByRange(3, F.col("rname").isNull(), "rname", "pos0").sortWithinPartitions(F.col("rname").isNull(), "rname", "pos0"), out, "@HD\n", REFS)
    whole = spark.read.format("bam").load(out)
    near = whole.where("rname = 'chr2' AND pos0 < 5000 AND end0 > 4000")
    assert "rname" in near._jdf.queryExecution().executedPlan().toString()
    reader = bam.BamReader({"path": out})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    assert len(list(reader.pushFilters([EqualTo(("rname",), "chr2"), LessThan(("pos0",), 5000), GreaterThan(("end0",), 4000)]))) == 3
    assert reader.regions == [("chr2", 4000, 5000)] and all(not p.split for p in reader.partitions())
    assert near.count() == sum(r.rname == "chr2" and r.pos0 < 5000 and r.end0 > 4000 for r in whole.collect())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = table(spark, 500).withColumn("seq", F.when(F.col("qname") == "r400", "A?C").otherwise(F.col("seq"))).withColumn("qual", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="a base has no code"):
        bam.write_bam(bad.repartition(4), out, "@HD\n", REFS)
    assert not os.path.exists(out) or os.listdir(out) == []
    good = table(spark, 500).repartition(3)
    bam.write_bam(good, out, "@HD\n", REFS, mode="append")
    names = sorted(os.listdir(out))
    assert [n for n in names if n.endswith(".bam")] == [f"part-{k:05d}.bam" for k in range(3)] and not any(n.startswith("_") for n in names)
    with pytest.raises(FileExistsError):
        bam.write_bam(good, out, "@HD\n", REFS)
    bam.write_bam(good, out, "@HD\n", REFS, mode="append")
    assert bam.read_bam(spark, out).count() == 1100
    bam.write_bam(good.limit(7), out, "@HD\n", REFS, mode="overwrite")
    assert bam.read_bam(spark, out).count() == 7


def test_pieces_become_one_file(spark, tmp_path):
    df = table(spark, 3000)
    out = str(tmp_path / "out")
    bam.write_bam(df.repartition(5).sortWithinPartitions("pos0"), out, "@HD\n", REFS)
    want = [r.qname for r in bam.read_bam(spark, out).orderBy("path", "rec_idx").collect()]
    bam.join_files(spark, out, str(tmp_path / "one.bam"))
    found = bam.read_bam(spark, str(tmp_path / "one.bam"), split_bytes=4000)
    assert found.rdd.getNumPartitions() > 5
    assert [r.qname for r in found.orderBy("rec_idx").collect()] == want
    # No header or empty block is left in the middle: plain gzip reads it as well.
    import gzip

    data = gzip.open(tmp_path / "one.bam").read()
    assert data.count(b"BAM\x01") == 1


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    df = table(spark, 5).withColumn("path", F.lit("x")).withColumn("split", F.lit(1)).withColumn("rec_idx", F.lit(9))
    bam.write_bam(df.coalesce(1), str(tmp_path / "a"), "", REFS)
    assert bam.read_bam(spark, str(tmp_path / "a")).count() == 55
    bam.write_bam(df.limit(0), str(tmp_path / "b"), "", REFS)
    assert bam.read_bam(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        bam.read_bam(spark, str(tmp_path / "nowhere.bam")).count()
