"""SimHash near-duplicates: fingerprints, links between close fingerprints, connected components.

Candidate search is an inverted index over positional bytes with count filtering.  Two 64-bit fingerprints that differ in at
most 4 bits have at least 4 of their 8 bytes in common, position by position.  Postings are keyed by three positions and
their bytes; the 20 triples of positions are such that any 4 positions contain one, so every pair that reaches the guaranteed
minimum meets in a posting list.  There the shared bytes of each pair are tallied, pairs with fewer than 4 are dropped and
the rest verified by the differing bits.

Only distinct fingerprints are indexed, so copies cost nothing.  A posting list that is longer than ``list_rows`` is not
gathered: it is split by every fourth position and its byte, since a pair needs a fourth byte in common anyway, and lists that
are still longer by blocks of the remaining bits (of five blocks of the 32 remaining bits, one is free of the at most 4
differing bits).  What is longer even then is not compared: two fingerprints within 4 bits have a midpoint that is within 2 bits
of both, and all that are within 2 bits of one midpoint are within 4 bits of each other.  So each fingerprint is linked with the
smallest one at each of its midpoints, a minimum that Spark combines before it shuffles.  Within a list links are found breadth
first: a found member is compared only with those not yet reached, and only a spanning forest leaves the task, never all pairs.

Special cases: null text counts as empty; no words give fingerprint zero, which links like any other; fewer words than a
shingle has give one shingle of all words; a bit that is set in exactly half of the hashes is 0; a text of any length is hashed
as a whole; rows that repeat a ``doc_id`` are rows of their own; a null ``doc_id`` gets a
fingerprint but no component unless a document with an id shares its class; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import ROW_KEY, addressable, id_and_text, joined_to_classes, row_key, shuffle_partitions, stored, without_rows
from locusframe.llm.components import components

#: Members of a posting list that one task compares with each other.
LIST_ROWS = 2048


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of 8 positions such that each set of 4 positions holds one (Turán's construction: 20 triples)."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for t in combinations(range(8), 3):
        count = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in count or any(count[k] == 2 and count[(k + 1) % 3] == 1 for k in range(3)):
            chosen.append(t)
    return chosen


def fingerprint(data: bytes, width: int = 4) -> int:
    """SimHash of a text in UTF-8: the majority of the bits of the XXH64 (seed 42) of all its word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], ">u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        block = hashes[k : k + 65536]
        votes += np.unpackbits(block.view(np.uint8)).reshape(len(block), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, *more: Column) -> DataFrame:
    """``doc_id, fp`` (fp: the 64 bits as a signed long), and the columns asked for, which must be longs."""
    rows = id_and_text(docs, id_col, text_col, *more)
    names = ["doc_id", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(
                [fingerprint(x.as_buffer().to_pybytes(), width) for x in batch.column("text")], np.uint64
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def forest(members: np.ndarray, max_bits: int = 4, min_bytes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints, breadth first, as positions."""
    from_, to = [], []
    left = np.arange(len(members))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            x = members[left] ^ members[at]
            tally = 8 - np.count_nonzero(x.view(np.uint8).reshape(-1, 8), axis=1)
            near = tally >= min_bytes
            near[near] = np.bitwise_count(x[near]) <= max_bits
            if near.any():
                reached = left[near]
                from_.append(np.full(len(reached), at))
                to.append(reached)
                queue.extend(reached.tolist())
                left = left[~near]
    if not from_:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(from_), np.concatenate(to)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``list``: compare the members of each list."""

    def links(lists: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        sizes = np.diff(np.append(starts, len(lists)))
        a, b = [], []
        pair = starts[sizes == 2]
        x = fps[pair] ^ fps[pair + 1]
        tally = 8 - np.count_nonzero(x.view(np.uint8).reshape(-1, 8), axis=1)
        near = (tally >= 4) & (np.bitwise_count(x) <= 4)
        a.append(fps[pair[near]])
        b.append(fps[pair[near] + 1])
        for s, k in zip(starts[sizes > 2], sizes[sizes > 2]):
            i, j = forest(fps[s : s + k])
            a.append(fps[s + i])
            b.append(fps[s + j])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp_a", "fp_b"])

    lists, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        lists = np.concatenate([lists, batch.column("list").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(lists):
            continue
        last = np.searchsorted(lists, lists[-1])  # sorted; the last list may go on in the next batch
        if last:
            yield links(lists[:last], fps[:last])
            lists, fps = lists[last:], fps[last:]
    if len(lists):
        yield links(lists, fps)


def _byte(position: int):
    return F.shiftrightunsigned("fp", 56 - 8 * position).bitwiseAND(F.lit(255))


def _posting(label: int, parts: list) -> Column:
    return F.xxhash64(F.lit(label), *parts)


def close_links(nodes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``fp_a, fp_b``: links between distinct fingerprints (column ``fp``) that connect what is within 4 bits.

    Posting lists are told apart by a 64-bit hash of positions and bytes; should two meet in one list, verification still
    decides each pair.
    """
    n = shuffle_partitions(nodes.sparkSession)
    triples = position_triples()
    postings = nodes.select(
        "fp", F.posexplode(F.array(*[_posting(k, [_byte(p) for p in t]) for k, t in enumerate(triples)])).alias("triple", "list")
    )

    def sized(p: DataFrame) -> DataFrame:
        # Never broadcast: Spark takes postings to be as few as the fingerprints that they are made of.
        return p.groupBy("list").agg(F.count("*").alias("members")).where("members > 1").hint("merge")

    def compared(p: DataFrame) -> DataFrame:
        return p.select("list", "fp").repartition(n, "list").sortWithinPartitions("list").mapInArrow(_link_lists, "fp_a long, fp_b long")

    first = postings.join(sized(postings), "list")
    links = compared(first.where(F.col("members") <= list_rows))
    # Longer lists: a fourth position that the pair must share.  The key is of the four positions in ascending order, whatever
    # triple they come from, so that repeats are equal rows.
    masks = [[sum(1 << q for q in (*t, p)) for p in range(8) if p not in t] for t in triples]
    four = F.array(*[F.array(*[F.lit(m) for m in of_triple]) for of_triple in masks])
    key_of = {m: _posting(100 + m, [_byte(q) for q in range(8) if m >> q & 1]) for m in {m for of_triple in masks for m in of_triple}}
    fourth = F.array(*[F.array(*[key_of[m] for m in of_triple]) for of_triple in masks])
    long_lists = stored(first.where(F.col("members") > list_rows).select("fp", "triple"), "long-lists")
    if long_lists.isEmpty():
        return links.distinct()
    by_four = long_lists.select(
        "fp",
        F.posexplode(F.element_at(fourth, F.col("triple") + 1)).alias("k", "list"),
        F.element_at(four, F.col("triple") + 1).alias("masks"),
    ).select("fp", F.element_at("masks", F.col("k") + 1).alias("mask"), "list")
    by_four = stored(by_four.distinct(), "four-lists")  # the same four positions come from several triples
    second = by_four.join(sized(by_four), "list")
    links = links.union(compared(second.where(F.col("members") <= list_rows)))
    # Still longer: one of five blocks of the other 32 bits is equal.
    other = [[p for p in range(8) if not m >> p & 1] for m in range(256)]
    rest = F.lit(0).cast("long")
    packed = F.array(
        *[
            sum((F.shiftleft(_byte(p), 24 - 8 * j) for j, p in enumerate(o)), rest) if len(o) == 4 else rest
            for o in other
        ]
    )
    widths = [(0, 7), (7, 7), (14, 6), (20, 6), (26, 6)]
    third = second.where(F.col("members") > list_rows).select(
        "fp", "list", "mask", F.element_at(packed, F.col("mask") + 1).alias("rest")
    )
    blocks = F.array(
        *[F.xxhash64("list", F.lit(k), F.shiftrightunsigned("rest", s).bitwiseAND(F.lit((1 << w) - 1))) for k, (s, w) in enumerate(widths)]
    )
    third = stored(third.withColumn("block", F.explode(blocks)), "block-lists")
    if third.isEmpty():
        return links.distinct()
    third = third.join(sized(third.select(F.col("block").alias("list"))).withColumnRenamed("list", "block"), "block")
    links = links.union(compared(third.where(F.col("members") <= list_rows).select("fp", F.col("block").alias("list"))))
    # Longer even then: the four bytes in common, told apart by themselves, and midpoints of the other 32 bits.
    flips = [0, *(1 << a for a in range(32)), *((1 << a) | (1 << b) for a, b in combinations(range(32), 2))]
    flips = F.from_json(F.lit(str(flips)), "array<bigint>")
    same = [F.when(F.shiftright("mask", q).bitwiseAND(F.lit(1)) == 1, _byte(q)).otherwise(F.lit(0)).alias(f"byte{q}") for q in range(8)]
    longest = third.where(F.col("members") > list_rows).select("fp", "mask", "rest", *same).distinct()
    keys = ["mask", *(f"byte{q}" for q in range(8)), "midpoint"]
    reach = longest.withColumn("midpoint", F.explode(F.transform(flips, lambda x: F.col("rest").bitwiseXOR(x)))).drop("rest")
    least = reach.groupBy(*keys).agg(F.min("fp").alias("fp_a"))
    star = reach.join(least, keys).select("fp_a", F.col("fp").alias("fp_b")).where("fp_a <> fp_b")
    return links.union(star).distinct()


def _labelled(fps: DataFrame, list_rows: int) -> DataFrame:
    """``fp, members, first`` of fingerprints (``fp, first``): how many rows have it, and the smallest ``first`` in its component."""
    nodes = stored(fps.groupBy("fp").agg(F.min("first").alias("first"), F.count("*").alias("members")), "nodes")
    links = stored(close_links(nodes.select("fp"), list_rows), "fp-links")
    labels = components(links.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    # Labels are fingerprints; the smallest row of all fingerprints with one label names the component.
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = linked.groupBy("label").agg(F.min("first").alias("of_all"))
    return linked.join(named, "label").select("fp", "members", F.col("of_all").alias("first"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, list_rows: int = LIST_ROWS
) -> DataFrame:
    """One row per document: ``doc_id, fp, fingerprint, component_id``.

    ``component_id`` is the smallest ``doc_id`` that is reachable over links, the document itself included.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = stored(_labelled(fps.select("fp", F.col("doc_id").alias("first")), list_rows), "classes")
    return joined_to_classes(fps, classes, ["fp"]).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, list_rows: int = LIST_ROWS
) -> DataFrame:
    """The documents that stay, with all their columns: of each component one row, the one with the smallest id.

    Rows without an id come after all others, and rows that share an id are taken by their place in the files, by which all rows
    are told apart; no text is shuffled.
    """
    docs = addressable(docs)
    fps = stored(fingerprints(docs, id_col, text_col, width, *row_key(docs)), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY)
    classes = stored(_labelled(fps.select("fp", place.alias("first")), list_rows), "classes")
    rest = joined_to_classes(fps.select("fp", place.alias("place")), classes, ["fp"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return without_rows(docs, stored(rest.select(*[f"place.{c}" for c in ROW_KEY]), "copies"))
