import hashlib

import pytest
from pyspark.sql import functions as F

from locusframe.functions import arrays, chrom, dna, packed, pos, rounding, variant

MAX = 2**63 - 1


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize(
    "text, want",
    [("chr1", "chr1"), ("1", "chr1"), ("chrX", "chrX"), ("X", "chrX"), ("M", "chrM"), ("chrEBV", "chrEBV"), ("EBV", "chrEBV"),
     ("GL000218.1", "chrGL000218.1"), ("", "chr"), ("chr", "chr"), ("chr0", "chr0"), ("MT", "chrMT"), ("ChrEBV", "chrChrEBV")],
)
def test_chrom(spark, text, want):
    c = F.col("s")
    got = one(spark, chrom.chrom(c), chrom.to_prefixed(c), chrom.to_unprefixed(chrom.chrom(c)), s=text)
    assert got == (want, want, want[3:])


def test_chrom_lists(spark):
    assert len(chrom.STANDARD) == 25 and len(chrom.TYPICAL) == 24 and "chrM" not in chrom.TYPICAL
    rank = [one(spark, chrom.chrom_rank(F.col("s")), s=s)[0] for s in ("chr2", "chr10", "chrX", "chrM", "chrEBV")]
    assert rank == [2, 10, 23, 25, 26]
    assert one(spark, chrom.is_standard(F.col("s")), chrom.is_typical(F.col("s")), s="chrM") == (True, False)


def test_positions(spark):
    p = F.col("p")
    assert one(spark, pos.from_0based(p), pos.one_based(p), p=110234) == (110234, 110235)
    assert one(spark, pos.from_1based(p), p=110235) == (110234,)
    errors = {
        (pos.try_from_0based, -1): "0-based position must be >= 0, got -1",
        (pos.try_from_0based, MAX): f"cannot represent 1-based position for 0-based value {MAX}",
        (pos.try_from_1based, 0): "1-based position must be > 0, got 0",
        (pos.try_from_1based, -5): "1-based position must be > 0, got -5",
        (pos.try_zero_based_u32, 2**32): "position 4294967296 cannot be represented as u32",
        (pos.try_one_based_u32, 2**32 - 1): "position 4294967296 cannot be represented as u32",
    }
    for (fn, value), text in errors.items():
        assert one(spark, fn(p)["error"], fn(p)["pos"], p=value) == (text, None)
    with pytest.raises(Exception, match="must be >= 0, got -1"):
        one(spark, pos.from_0based(p), p=-1)


def test_position_arithmetic(spark):
    p, d = F.col("p"), F.col("d")
    assert one(spark, pos.checked_add(p, d), pos.checked_sub(p, d), p=10, d=5) == (15, 5)
    assert one(spark, pos.try_checked_sub(p, d)["error"], p=10, d=20) == ("0-based position must be >= 0, got -10",)
    assert one(spark, pos.try_checked_add(p, d)["error"], p=10, d=MAX)[0].endswith("value 10")
    assert one(spark, pos.try_checked_sub(p, d)["error"], p=-10, d=MAX)[0].endswith("got -10")


def test_variants(spark):
    k = F.col("k")
    assert one(spark, variant.variant(k), k="chrX_12341_AA_GG")[0] == ("chrX", 12341, "AA", "GG")
    assert one(spark, variant.variant(k), k="chr1_1234111_ACA_TGG")[0] == ("chr1", 1234111, "ACA", "TGG")
    assert one(spark, variant.variant(k), k="1_5__")[0] == ("chr1", 5, "", "")
    for bad in ("chrX_12341_AA_GG_", "_chrX_12341_AA_GG", "chrX_12341_AA", "chrX_ 12_A_C", ""):
        error = one(spark, variant.try_variant(k)["error"], k=bad)[0]
        assert error.endswith(f" Input variant key: {bad}")
        with pytest.raises(Exception, match="Input variant key"):
            one(spark, variant.variant(k), k=bad)
    assert tuple(one(spark, variant.region_1bp(variant.variant(k)), k="7_9_A_C")[0]) == ("chr7", 9, 10)


def test_complement(spark):
    s = F.col("s")
    assert one(spark, dna.complement(s), dna.reverse_complement(s), s="ACGTNacgtnWQ-") == ("TGCANTGCANNNN", "NNNNACGTNACGT"[0:0] + "NNNNACGTNACGT")
    assert one(spark, dna.complement(s), dna.reverse_complement(s), s="") == ("", "")
    for n in (1, 15, 31, 32, 33, 64, 65, 127, 128, 129, 150, 256, 1000):
        seq = ("ACGTN" * 200)[:n]
        assert one(spark, dna.reverse_complement(dna.reverse_complement(s)), s=seq) == (seq,)


@pytest.mark.parametrize("bits", [64, 16])
def test_packed_round_trip(spark, bits):
    s = F.col("s")
    for seq in ("", "A", "ATCGN", "A" * 21, "ATCGN" * 5, "GATTACANNN" * 4):
        p = packed.pack(s, bits)
        assert one(spark, packed.bases(p, bits=bits), s=seq) == (seq,)
        assert one(spark, packed.get(p, F.lit(len(seq)), bits), s=seq) == (None,)
        if seq:
            assert one(spark, packed.get(p, F.lit(0), bits), packed.get(p, F.lit(len(seq) - 1), bits), s=seq) == (seq[0], seq[-1])
    assert one(spark, packed.bases(packed.pack(s, bits), F.lit(3), F.lit(1000), bits), s="ATCGNATC") == ("GNATC",)
    assert one(spark, packed.get(packed.pack(s, bits), F.lit(10_000), bits), s="A") == (None,)


def test_packed_errors(spark):
    s = F.col("s")
    cases = {
        "ATWWQT": "Invalid base 'W' at position 2",
        "ACGT_Z": "Invalid base '_' at position 4",
        "A" * 200: "Input slice is too long: 200 bases, max is 168",
        "a": "Invalid base 'a' at position 0",
    }
    for seq, text in cases.items():
        assert one(spark, packed.pack_error(s), packed.try_pack(s), s=seq) == (text, None)
    assert one(spark, packed.pack_error(s, from_iter=True), s="A" * 200) == ("Input iterator is too long, max is 168",)
    assert one(spark, packed.pack_error(s, from_iter=True), s="A" * 168 + "W") == ("Input iterator is too long, max is 168",)
    assert one(spark, packed.pack_error(s, from_iter=True), s="W" + "A" * 200) == ("Invalid base 'W' at position 0",)
    with pytest.raises(Exception, match="Invalid base 'W'"):
        one(spark, packed.pack(s), s="ATW")


def test_packed_set(spark):
    s, p = F.col("s"), packed.pack(F.col("s"))
    assert one(spark, packed.bases(packed.set_base(p, F.lit(20), F.lit("T"))), s="A" * 21) == ("A" * 20 + "T",)
    hole = packed.set_base(p, F.lit(5), F.lit("G"))
    assert one(spark, packed.bases(hole), packed.get(hole, F.lit(5)), s="ATC") == ("ATC", "G")
    with pytest.raises(Exception, match="Index out of bounds"):
        one(spark, packed.set_base(p, F.lit(168), F.lit("G")), s="ATC")
    assert s is not None


@pytest.mark.parametrize(
    "v, nd", [(2.5, 0), (3.5, 0), (2.675, 2), (2.685, 2), (1.25, 1), (1.35, 1), (1250.0, -2), (1350.0, -2), (46.55, 1), (-0.5, 0),
              (1e308, 2), (0.1, 400), (5.0, -400)],
)
def test_rounding(spark, v, nd):
    want = v if nd < -308 else round(v, nd)
    assert one(spark, rounding.py_round(F.col("v"), nd), v=v) == (want,)


def test_rounding_not_finite(spark):
    for nd in (-1, 0, 2):
        got = one(spark, *[rounding.py_round(F.lit(float(x)), nd) for x in ("inf", "-inf", "nan")], v=0)
        assert got[:2] == (float("inf"), float("-inf")) and got[2] != got[2]


def test_slices(spark):
    a = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50)])
    cases = [(1, 4, [20, 30, 40]), (-3, -1, [30, 40]), (1, -1, [20, 30, 40]), (2, None, [30, 40, 50]), (-2, None, [40, 50]),
             (0, 0, []), (5, None, []), (-4, 3, [20, 30])]
    for s, e, want in cases:
        assert one(spark, arrays.signed_slice(a, F.lit(s), None if e is None else F.lit(e)), v=0) == (want,)
    for s, e in ((0, 6), (-6, None), (3, 1)):
        assert one(spark, arrays.try_signed_slice(a, F.lit(s), None if e is None else F.lit(e)), v=0) == (None,)
        with pytest.raises(Exception, match="Indexing failed"):
            one(spark, arrays.signed_slice(a, F.lit(s), None if e is None else F.lit(e)), v=0)


def test_checked_access(spark):
    a, m = F.array(F.lit(1), F.lit(2)), F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, arrays.item(a, F.lit(1)), arrays.try_item(a, F.lit(7)), arrays.value_of(m, F.lit("a")), v=0) == (2, None, 1)
    with pytest.raises(Exception, match="Slicing failed. index: 2"):
        one(spark, arrays.item(a, F.lit(2)), v=0)
    with pytest.raises(Exception, match="Key b not found"):
        one(spark, arrays.value_of(m, F.lit("b")), v=0)
    with pytest.raises(Exception, match="gone"):
        one(spark, arrays.present(F.lit(None).cast("int"), "gone"), v=0)
    assert one(spark, arrays.try_utf8(F.unhex(F.lit("C3"))), arrays.try_utf8(F.unhex(F.lit("41"))), v=0) == (None, "A")
    assert one(spark, arrays.with_index(F.lit("x"), F.lit(3)), arrays.tagged("k", F.lit(1)), v=0) == ((3, "x"), ("k", 1))


def test_regions_and_bases(spark):
    assert tuple(one(spark, pos.region(F.lit("7"), F.lit(5), F.lit(9)), v=0)[0]) == ("chr7", 5, 9)
    assert tuple(one(spark, pos.as_fetch(pos.region(F.lit("7"), F.lit(5), F.lit(9))), v=0)[0]) == ("chr7", 5, 9)
    assert [one(spark, packed.code(F.lit(b)), v=0)[0] for b in "ATCGNat-"] == [1, 2, 3, 4, 5, 0, 0, 0]
    assert one(spark, packed.base(F.lit("A")), packed.letter(F.lit(0)), v=0) == ("A", None)
    with pytest.raises(Exception, match="Invalid base: x"):
        one(spark, packed.base(F.lit("x")), v=0)


def test_generated_dna_depends_on_its_seed(spark):
    got = [r["s"] for r in spark.range(20).select(dna.generated(F.col("id"), 40).alias("s")).collect()]
    assert len(set(got)) == 20 and all(len(s) == 40 and set(s) <= set("ACGTN") for s in got)


@pytest.mark.parametrize("length, alphabet", [(1, "ACGTN"), (7, "ACGTN"), (8, "ACG"), (9, "ACGTN"), (150, "ACGTN"), (33, "ACDEFGHIKLMNPQRSTVWY")])
def test_generated_dna_is_four_digits_of_md5_a_letter(spark, length, alphabet):
    def slow(seed):
        digits = "".join(hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in range((length + 7) // 8))
        return "".join(alphabet[int(digits[4 * i : 4 * i + 4], 16) % len(alphabet)] for i in range(length))

    seeds = [0, 1, 1, 7, -5, MAX, None]
    df = spark.createDataFrame([(s,) for s in seeds], "id long").coalesce(1).select(dna.generated(F.col("id"), length, alphabet).alias("s"))
    assert [r["s"] for r in df.collect()] == ["" if s is None else slow(s) for s in seeds]


def test_generated_dna_makes_each_md5_once(spark):
    plan = spark.range(1).select(dna.generated(F.col("id"), 40).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    # Letters are read from a variable that has one MD5, not from an expression that makes all of them again.
    assert plan.count("md5(") == 1 and "conv(substring(lambda " in plan


@pytest.mark.parametrize("bits", [64, 16])
def test_packed_chunks_are_three_bits_a_base(spark, bits):
    each, most = packed.BASES_IN[bits], packed.capacity(bits)

    def slow(seq):
        if seq is None or len(seq) > most or set(seq) - set("ATCGN"):
            return None
        return [sum("ATCGN".index(b) + 1 << 3 * i for i, b in enumerate(seq[c * each : (c + 1) * each])) for c in range(packed.CHUNKS)]

    texts = ["GATTACAN" * 30, None, "AT-", "a", "é" * 3, "A" * 5 + "x"]
    texts = [texts[0][k : k + n] for n in (0, 1, each - 1, each, each + 1, 3 * each, most - 1, most, most + 1) for k in (0, 3)] + texts[1:] + ["", "", "N" * most]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    assert [r["p"] for r in df.select(packed.try_pack(F.col("s"), bits).alias("p")).collect()] == [slow(t) for t in texts]
    good = df.where(F.col("s").isNull() | packed.pack_error(F.col("s"), bits).isNull())
    got = good.select("s", packed.pack(F.col("s"), bits).alias("p")).select("s", "p", packed.bases(F.col("p"), bits=bits).alias("t")).collect()
    assert len(got) > 15 and all(r["p"] == slow(r["s"]) and r["t"] == r["s"] for r in got)


def test_packing_changes_each_letter_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(packed.try_pack(F.col("s")).alias("p"))
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    # A chunk changes its own letters, once, and not the whole text.
    assert plan.count("translate(") == plan.count("translate(substring(") == 1
