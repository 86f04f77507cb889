"""Pileups: what stands at a reference position, over all reads that cover it.

Reads have ``contig, pos0, cigar`` (an array of op and len) or ``end0``; targets have a 1-based ``pos``.  The join of
positions with spans is an equi-join: each read goes to the level of its own length, whose bins are as wide as the next power of
two, so it overlaps two of them at most; each target looks into its one bin of every level that occurs.  No pair comes twice, and
the containment test that follows keeps every third candidate or more, however short and long reads are mixed.  A hot locus is one
bin; Spark's adaptive skew join splits it, since neither side is bound to one partition.

A read with a CIGAR is taken apart once into its blocks along the reference, which the join takes as spans; where a target stands
in the read is then plain arithmetic.

Depth needs no pairs: reads are +1 where they start and -1 where they end, and a depth is a sum of all events before.  Such sums
come in two levels, within ranges of positions and across one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators._cut import cut

#: CIGAR letters that move along the reference, along the read, and along both.
ON_REFERENCE, ON_READ, ON_BOTH = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X")
#: Fixed value: flags of reads that a pileup leaves out (unmapped, secondary, failed quality check, duplicate).
SKIPPED_FLAGS = 0x4 | 0x100 | 0x200 | 0x400
#: The lowest level: bins of 16 bases.
LEAST_LEVEL = 4
#: Fixed values of the rule for mates that overlap: the most that two qualities add up to, and tenths that the better one keeps.
MOST_QUALITY, KEPT_TENTHS = 200, 8


def parse_cigar(text: Column) -> Column:
    """``array<struct<op, len>>`` of a CIGAR text; empty for ``*``."""
    return F.transform(
        F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)),
        lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.expr("0L").alias("_"), F.regexp_extract(x, "^[0-9]+", 0).cast("long").alias("len")).dropFields("_"),
    )


def reference_end(pos0: Column, cigar: Column) -> Column:
    """The 0-based position after the last one that a read covers."""
    return F.aggregate(cigar, pos0, lambda at, c: at + F.when(c["op"].isin(*ON_REFERENCE), c["len"]).otherwise(F.lit(0)))


def query_offset(pos0: Column, cigar: Column, target0: Column) -> Column:
    """Offset in the read of a reference position; null in a deletion or a skip, and outside of the read."""
    none = F.lit(None).cast("long")
    start = F.struct(pos0.alias("r"), F.lit(0).cast("long").alias("q"), none.alias("hit"))

    def step(a: Column, c: Column) -> Column:
        inside = c["op"].isin(*ON_BOTH) & (target0 >= a["r"]) & (target0 < a["r"] + c["len"])
        return F.struct(
            (a["r"] + F.when(c["op"].isin(*ON_REFERENCE), c["len"]).otherwise(F.lit(0))).alias("r"),
            (a["q"] + F.when(c["op"].isin(*ON_READ), c["len"]).otherwise(F.lit(0))).alias("q"),
            F.when(inside, a["q"] + target0 - a["r"]).otherwise(a["hit"]).alias("hit"),
        )

    return F.aggregate(cigar, start, step, lambda a: a["hit"])


def aligned_blocks(pos0: Column, cigar: Column) -> Column:
    """``array<struct<b0, b1, q0>>``: the stretches [b0, b1) of the reference that a read covers, one for each letter that moves
    along it, and the offset in the read of the first; null where the read has no base there."""
    none = F.lit(None).cast("long")
    blocks = F.array().cast("array<struct<b0:bigint,b1:bigint,q0:bigint>>")
    start = F.struct(pos0.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), blocks.alias("blocks"))

    def step(a: Column, c: Column) -> Column:
        along, read = c["op"].isin(*ON_REFERENCE) & (c["len"] > 0), c["op"].isin(*ON_READ)
        block = F.struct(a["r"].alias("b0"), (a["r"] + c["len"]).alias("b1"), F.when(read, a["q"]).otherwise(none).alias("q0"))
        return F.struct(
            (a["r"] + F.when(along, c["len"]).otherwise(F.lit(0))).alias("r"),
            (a["q"] + F.when(read, c["len"]).otherwise(F.lit(0))).alias("q"),
            F.when(along, F.concat(a["blocks"], F.array(block))).otherwise(a["blocks"]).alias("blocks"),
        )

    return F.aggregate(cigar, start, step, lambda a: a["blocks"])


def first_of_duplicates(targets: DataFrame, order: str | None = None) -> DataFrame:
    """One target per position: the first by ``order``.  Duplicates are combined before they are shuffled."""
    if order is None:
        return targets.dropDuplicates(["contig", "pos"])
    rest = [c for c in targets.columns if c not in ("contig", "pos")]
    first = targets.groupBy("contig", "pos").agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return first.select(*[f"__first.{c}" if c in rest else c for c in targets.columns])


def covered(reads: DataFrame, targets: DataFrame, width: int | None = None, start: str = "pos0", end: str = "end0") -> DataFrame:
    """Inner join of targets with the reads that cover them: ``contig, pos``, the further columns of the targets, and those of
    each read, whose span is [start, end).  ``width``: one width of bins for all reads; it does not change the result."""
    reads = reads.where(F.col(end) > F.col(start))
    size = F.col(end) - F.col(start)
    if width is None:
        level = F.greatest(F.length(F.bin(size - 1)), F.lit(LEAST_LEVEL))
        reads = reads.withColumn("__level", level)
        levels = sorted(r[0] for r in reads.select("__level").distinct().collect())  # 63 at most
        number = lambda p: F.call_function("shiftright", p, F.col("__level"))
        points = targets.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    else:
        reads, points = reads.withColumn("__level", F.lit(0)), targets.withColumn("__level", F.lit(0))
        number = lambda p: F.call_function("div", p - F.pmod(p, F.lit(width)), F.lit(width))
    spans = reads.withColumn("__bin", F.explode(F.sequence(number(F.col(start)), number(F.col(end) - 1))))
    points = points.withColumn("__bin", number(F.col("pos") - 1))
    inside = (F.col("pos") - 1 >= F.col(start)) & (F.col("pos") - 1 < F.col(end))
    return points.join(spans, ["contig", "__level", "__bin"]).where(inside).drop("__level", "__bin")


def used_reads(reads: DataFrame, flag_mask: int) -> DataFrame:
    used = reads.where(F.col("flag").bitwiseAND(F.lit(flag_mask)) == 0) if "flag" in reads.columns else reads
    return used.withColumn("end0", reference_end(F.col("pos0"), F.col("cigar"))) if "cigar" in reads.columns else used


def pileup(reads: DataFrame, targets: DataFrame, flag_mask: int = SKIPPED_FLAGS, width: int | None = None) -> DataFrame:
    """One row per target and covering read with ``qpos`` (null: deletion or skip).

    Targets that repeat count once, in whatever order they come; positions without a read have no row.  ``flag_mask``: reads
    with one of these flags are left out, if reads have a ``flag``.
    """
    used, points = used_reads(reads, flag_mask), first_of_duplicates(targets)
    offset = F.col("pos") - 1
    if "cigar" not in reads.columns:
        return covered(used, points, width).withColumn("qpos", offset - F.col("pos0"))
    # Blocks of a read do not overlap, so a target meets one of them.
    blocks = used.withColumn("__block", F.explode(aligned_blocks(F.col("pos0"), F.col("cigar"))))
    blocks = blocks.select(*used.columns, F.col("__block.b0").alias("__b0"), F.col("__block.b1").alias("__b1"), F.col("__block.q0").alias("__q0"))
    rows = covered(blocks, points, width, "__b0", "__b1")
    return rows.withColumn("qpos", F.col("__q0") + offset - F.col("__b0")).drop("__b0", "__b1", "__q0")


# Depth from events ----------------------------------------------------------------------------------------------------------------


def _events(reads: DataFrame) -> DataFrame:
    """``contig, at, delta``: by how much the depth changes at a position; combined before the shuffle."""
    ends = F.array(F.struct(F.col("pos0").cast("long").alias("at"), F.lit(1).cast("long").alias("delta")),
                   F.struct(F.col("end0").cast("long").alias("at"), F.lit(-1).cast("long").alias("delta")))
    both = reads.where("end0 > pos0").select("contig", F.inline(ends))
    return both.groupBy("contig", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def _summed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows (``contig``, ``delta`` and the order) with ``depth``: the sum of delta up to the row along its contig; and ``range``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, "contig", *order).withColumn("range", F.spark_partition_id()))
    # One row per range, and one more for each contig that begins in it.
    totals = ranged.groupBy("contig", "range").agg(F.sum("delta").alias("total"))
    earlier = Window.partitionBy("contig").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("contig", "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("contig", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("depth", F.sum("delta").over(within)).join(totals, ["contig", "range"]).withColumn("depth", F.col("depth") + F.col("before")).drop("before")


def depth_at(reads: DataFrame, targets: DataFrame, flag_mask: int = SKIPPED_FLAGS) -> DataFrame:
    """``contig, pos, depth`` of the targets that reads cover, each once; the cost is that of sorting reads and targets."""
    points = first_of_duplicates(targets.select("contig", "pos")).select(
        "contig", (F.col("pos") - 1).cast("long").alias("at"), F.lit(0).cast("long").alias("delta"), F.lit(1).alias("kind")
    )
    rows = _events(used_reads(reads, flag_mask)).withColumn("kind", F.lit(0)).unionByName(points)
    summed = _summed(rows, "at", "kind")  # events at a position count at it
    return summed.where("kind = 1 AND depth > 0").select("contig", (F.col("at") + 1).alias("pos"), "depth")


def depth_runs(reads: DataFrame, flag_mask: int = SKIPPED_FLAGS) -> DataFrame:
    """``contig, start, end, depth``: the longest stretches [start, end) of equal depth, where any read is."""
    summed = cut(_summed(_events(used_reads(reads, flag_mask)), "at"))
    within = Window.partitionBy("contig", "range").orderBy("at")
    first = summed.groupBy("contig", "range").agg(F.min("at").alias("first"))
    first = first.select("contig", "range", F.lead("first").over(Window.partitionBy("contig").orderBy("range")).alias("after"))
    runs = summed.withColumn("end", F.lead("at").over(within)).join(first, ["contig", "range"])
    return runs.where("depth > 0").select("contig", F.col("at").alias("start"), F.coalesce("end", "after").alias("end"), "depth")


# Mates that overlap ----------------------------------------------------------------------------------------------------------------


def marked_mates(reads: DataFrame, name: str = "qname", meets: str = "meets") -> DataFrame:
    """Reads with ``meets``: whether a read overlaps another one of its name on its contig; false without a name.

    Only reads are shuffled for it.  In a pileup, rows of a read that meets none need not be brought together with any others.
    """
    rows = reads.withColumn("__end", reference_end(F.col("pos0"), F.col("cigar")) if "cigar" in reads.columns else F.col("end0"))
    # Reads without a name are spread; those that cover nothing meet none.
    none = F.col(name).isNull() | F.coalesce(F.col("__end") <= F.col("pos0"), F.lit(True))
    together = Window.partitionBy("contig", name, F.when(none, F.xxhash64("pos0", "__end"))).orderBy("pos0")
    before = F.max("__end").over(together.rowsBetween(Window.unboundedPreceding, -1)) > F.col("pos0")
    after = F.lead("pos0").over(together) < F.col("__end")
    found = ~none & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    return rows.withColumn(meets, found).drop("__end")


def overlapping_mates(
    piled: DataFrame, base: Column, quality: Column, name: str = "qname", order: tuple[str, ...] = ("pos0",), meets: str | None = None
) -> DataFrame:
    """Rows of a pileup with ``bq``: qualities where both mates of a template stand at a target count once, and both stay.

    If their bases agree, the first one (by ``order``) gets the sum of both qualities, 200 at most, and the second one 0; if not,
    the better one (the first of equals) keeps eight tenths of its quality, rounded down, and the other one gets 0.  Rows without a
    base or a quality (deletions), without a name or without a mate there keep what they have; of more than two rows with one name
    the first two that have a base are mates.  ``meets``: the column of ``marked_mates``; rows for which it is false are not shuffled.
    """
    if meets is not None:
        alone = piled.where(~F.col(meets)).withColumn("bq", quality.cast("long"))
        return overlapping_mates(piled.where(F.col(meets)), base, quality, name, order).unionByName(alone)
    rows = piled.withColumns({"__base": base, "bq": quality.cast("long")})
    live = F.col("bq").isNotNull() & F.col("__base").isNotNull() & F.col(name).isNotNull()
    rows = rows.withColumn("__live", live.cast("int"))
    mates = Window.partitionBy("contig", "pos", name, "__live").orderBy(*order)
    rows = rows.withColumns({
        "__k": F.when(F.col("__live") == 1, F.row_number().over(mates)),
        "__before": F.struct(F.lag("__base").over(mates).alias("base"), F.lag("bq").over(mates).alias("bq")),
        "__after": F.struct(F.lead("__base").over(mates).alias("base"), F.lead("bq").over(mates).alias("bq")),
    })
    mine, kept = F.col("bq"), F.call_function("div", F.col("bq") * KEPT_TENTHS, F.lit(10))
    after, before = F.col("__after"), F.col("__before")
    as_first = F.when(F.col("__base") == after["base"], F.least(mine + after["bq"], F.lit(MOST_QUALITY))).when(mine >= after["bq"], kept).otherwise(0)
    as_second = F.when((F.col("__base") != before["base"]) & (mine > before["bq"]), kept).otherwise(0)
    told = F.when((F.col("__k") == 1) & after["bq"].isNotNull(), as_first).when(F.col("__k") == 2, as_second).otherwise(mine)
    return rows.withColumn("bq", told.cast("long")).drop("__base", "__live", "__k", "__before", "__after")


def one_of_overlapping(piled: DataFrame, name: str = "qname", *best: Column | str, meets: str | None = None) -> DataFrame:
    """Where both mates of a template cover a target, the row that is greatest by ``best`` (say quality, then flag); rows
    without a name all stay.  Mates are combined before they are shuffled.  ``meets``: the column of ``marked_mates``; rows for which
    it is false are not shuffled."""
    if meets is not None:
        return one_of_overlapping(piled.where(F.col(meets)), name, *best).unionByName(piled.where(~F.col(meets)))
    named = piled.where(F.col(name).isNotNull())
    rest = [c for c in piled.columns if c not in ("contig", "pos", name)]
    first = named.groupBy("contig", "pos", name).agg(F.max_by(F.struct(*rest), F.struct(*(best or rest))).alias("__row"))
    chosen = first.select(*[f"__row.{c}" if c in rest else c for c in piled.columns])
    return chosen.unionByName(piled.where(F.col(name).isNull()))


def mean_quality(piled: DataFrame, quality: Column) -> DataFrame:
    """``contig, pos, depth, sum_bq, mean_bq``: the sum over reads that have a quality there, divided by all reads."""
    total = F.coalesce(F.sum(quality), F.lit(0)).cast("long")
    agg = piled.groupBy("contig", "pos").agg(F.count("*").alias("depth"), total.alias("sum_bq"))
    return agg.withColumn("mean_bq", F.col("sum_bq").cast("double") / F.col("depth").cast("double"))


def depth(piled: DataFrame) -> DataFrame:
    """Depth of a pileup that is there anyway; ``depth_at`` needs none."""
    return piled.groupBy("contig", "pos").agg(F.count("*").alias("depth"))


#: The bases that are counted.
NUCLEOTIDES = ("A", "T", "C", "G", "N")


def base_counts(rows: DataFrame, base: Column, *keys: str) -> DataFrame:
    """Counts of each base, in either case, by ``keys``; other letters count as ``n_other``."""
    upper = F.upper(base)
    return rows.groupBy(*keys).agg(
        *[F.sum((upper == b).cast("long")).alias(f"n_{b.lower()}") for b in NUCLEOTIDES],
        F.sum((~upper.isin(*NUCLEOTIDES)).cast("long")).alias("n_other"),
    )


def checked_base(base: Column) -> Column:
    """The base in upper case; raises for what is no base."""
    wrong = F.raise_error(F.concat(F.lit("Unsupported base: "), base)).cast("string")
    return F.when(F.upper(base).isin(*NUCLEOTIDES), F.upper(base)).otherwise(wrong)


def hash_lookup(sites: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """Sites (0-based ``pos0``) that are targets, whatever the contig: of targets that repeat the last one wins, and the first
    site at a position takes it."""
    last = targets.groupBy("pos").agg(F.max_by(F.struct(*targets.columns), order).alias("target"))
    first = sites.groupBy("pos0").agg(F.min_by(F.struct(*sites.columns), F.col("site_ord")).alias("site"))
    return first.join(last, F.col("pos0") == F.col("pos") - 1).select("site.*", F.col("target").alias("target"))
