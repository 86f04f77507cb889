"""Audit of how quality filters act together: which documents each filter removes, alone, first or in vain.

Five filters judge a document by its whole text (null: empty; words are runs of other than ASCII white space, case-sensitive).
It fails

* A with fewer than 200 words,
* B if less than half of its words are distinct,
* C if more than 3 of 100 code points are capital letters A to Z,
* D if it holds any of ``# $ % & * |``,
* E if its text is that of a smaller id in any part of the table.

Each document gets a mask of five bits.  A to D follow from the text alone, so the mask is made where the text is read, and only
the text's SHA-256 is shuffled.  Equal texts meet in a ``groupBy`` of that digest, which keeps the smallest id and how many rows
have it: those pass E, and all other rows of the group that have an id fail.  Both sums are partial before the shuffle, so a group of copies with
a third of all rows arrives as a few rows.  What is left is a histogram of 32 masks for each part (with its good and toxic
documents), and everything about the 120 orders of the filters follows from these cells, without another look at the documents.

Special cases: null and empty texts are equal to each other; a null id is neither smaller nor larger than another, so its
rows pass E and let others pass; rows that repeat an id with its text do not fail E for each other; an id counts as good or toxic if any of
its labels says so; a null part is the empty string; an empty table has no parts; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import joined_to_classes, stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
_CELLS = 1 << len(FILTERS)


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8: whether the text fails A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.when(n < LEAST_WORDS, 1).otherwise(0) + F.when(100 * distinct < LEAST_DISTINCT * n, 2).otherwise(0)

    # A lambda over one array makes the words once for both filters.
    of_words = F.transform(F.array(words), bits)[0]
    return (
        of_words
        + F.when(100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    ).cast("int")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, part, sha, bits`` (of A to D)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text_mask(text).alias("bits"),
    )


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1), which are 0 for ids without a label."""
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), "quality", "toxic")
        .where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
        .groupBy("doc_id")
        .agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    )
    # Only ids with such a label are classes; a hot one is broadcast.
    members = rows.groupBy("doc_id").agg(F.count("*").alias("members"))
    classes = stored(members.join(known, "doc_id"), "labelled-ids")
    with_label = joined_to_classes(rows, classes, ["doc_id"]).drop("members")
    without = rows.where("doc_id IS NULL").unionByName(rows.where("doc_id IS NOT NULL").join(classes.select("doc_id"), "doc_id", "left_anti"))
    return with_label.unionByName(without.select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def mask_histogram(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part and mask that occurs: ``part, mask, docs, good, toxic``."""
    rows = stored(masks(docs, id_col, text_col, part_col), "masks")
    cell = ["sha", "part", "bits", "good", "toxic"]
    # How often the same row stands there, then the smallest id of each text with that number.
    repeated = _labelled(rows, labels, id_col).groupBy(*cell, "doc_id").agg(F.count("*").alias("n"))
    groups = repeated.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    # A text has a group for each part and label at most.
    smallest = groups.groupBy("sha").agg(
        F.min("first.doc_id").alias("smallest"),
        F.collect_list(F.struct(*cell[1:], "n", "no_id", "first")).alias("groups"),
    )
    each = smallest.select("smallest", F.inline("groups"))
    passing = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(
        F.struct(F.col("bits").alias("mask"), passing.alias("docs")),
        F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - passing).alias("docs")),
    )
    return (
        each.select("part", "good", "toxic", F.inline(both))
        .groupBy("part", "mask")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum(F.col("docs") * F.col("good")).alias("good"),
            F.sum(F.col("docs") * F.col("toxic")).alias("toxic"),
        )
    )


def _steps() -> Column:
    """The 600 steps of all orders: ``filter_order, step, bit, before`` (mask of the filters applied earlier)."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), letter) - 1)

    def steps(order: Column) -> Column:
        def step(k: Column) -> Column:
            earlier = F.filter(F.split(order, ""), lambda c, i: (c != "") & (i < k - 1))
            return F.struct(
                order.alias("filter_order"),
                k.alias("step"),
                bit(F.substring(order, k, 1)).alias("bit"),
                F.aggregate(earlier, F.lit(0), lambda mask, c: mask + bit(c)).alias("before"),
            )

        return F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), step)

    return F.flatten(F.transform(orders, steps))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see the contract of op13 for the columns."""
    counts = ["docs", "good", "toxic"]
    cells = mask_histogram(docs, labels, id_col, text_col, part_col)
    # 32 rows per part at most.
    parts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*counts)))).alias("by_mask"))

    def of_all_masks(c: str) -> Column:
        count = lambda mask: F.coalesce(F.try_element_at("by_mask", mask)[c], F.lit(0)).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), count)

    parts = parts.select("part", *[of_all_masks(c).alias(c) for c in counts])
    bit, before = F.col("bit"), F.col("before")

    def total(column: str, of_mask) -> Column:
        """Sum of a count over the masks for which ``of_mask`` holds, or with the weight that it gives."""
        weighed = F.transform(F.col(column), lambda n, m: n * of_mask(m).cast("long"))
        return F.aggregate(weighed, F.lit(0).cast("long"), lambda s, x: s + x)

    fails = lambda m: m.bitwiseAND(bit) != 0
    alive = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & alive(m)
    steps = parts.select("part", *counts, F.inline(_steps()))
    # Of the k filters that a document fails each is the first in one k-th of all orders.
    share = lambda m: F.when(fails(m), F.try_divide(F.lit(120), F.bit_count(m))).otherwise(0)
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("docs", lambda m: alive(m) & ~fails(m)).alias("kept"),
        total("docs", removed).alias("removed"),
        total("docs", lambda m: fails(m) & ~alive(m)).alias("redundant"),
        total("docs", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("docs", share).alias("shapley"),
    )
