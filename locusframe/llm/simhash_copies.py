"""Near copies by SimHash: a wide fingerprint, its positional bytes in an inverted index, a count filter, exact verification.

``simhash`` links fingerprints of 64 bits that differ in at most 4.  Two texts of Jaccard 0.8 differ in some 15 % of the bits of a
SimHash however long it is, 10 of 64, so most such pairs are beyond that.  Here the fingerprint has 1024 bits, 128 positional
bytes, of which such a pair has some 34 in common and two unrelated texts one at most, as a rule.

1. Rows with equal sets of shingles are one node.  A bit of its fingerprint is 1 if set in over half of its shingles' hashes.
2. A posting is two positions and their bytes; each node has 96.  Beyond ROWS_OF_TWO nodes, where lists grow by chance alone, a posting
   takes three bytes, and then four, and there are more of them (POSTINGS).
3. In a posting list those are compared whose numbers of shingles allow the similarity; pairs of which the first 128 bits differ in
   MOST_BITS or fewer are linked.  Lists of more than ``list_rows`` members are linked as they are.  All that is connected is a cluster
   of candidates.  A member of a large group gets a link in each of its lists, so links are made stars around the smallest member and
   then moved to the smallest neighbour (``fewer_links``): about one link for each node is left to close.
4. In a cluster the shared bytes of pairs are tallied; pairs with LEAST_SHARED or more are verified by their exact Jaccard similarity, in
   parts that all meet each other (see ``near_copies``), and verified links are closed to groups.

A pair of similarity 0.8 is a candidate with a probability of 0.998 (measured over made sets; with postings of three and four bytes
0.988 and 0.98), where only four of five shingles are in common 0.96 (0.88 and 0.75); more similar ones with more.  No pair is linked
that is not verified.

Special cases: those of ``near_copies``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import addressable, shuffle_partitions, stored
from locusframe.llm.components import fewer_links, starred
from locusframe.llm.near_copies import PART_BYTES, PART_ROWS, first_of_groups, set_nodes, verified_links

#: Bytes of a fingerprint, and how many two fingerprints must share.
POSITIONS, LEAST_SHARED = 128, 12
#: Of the first 128 bits, how many two fingerprints may differ in.
MOST_BITS = 38
#: Postings of a node by the bytes of a posting, and the nodes for which two bytes do: 256 are in a list by chance then.
POSTINGS, ROWS_OF_TWO = {2: 96, 3: 400, 4: 1600}, 1 << 24
#: Members of a posting list that one task compares.
LIST_ROWS = 1024

_SEEDS = np.arange(1, POSITIONS // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def simhash(hashes: np.ndarray) -> bytes:
    """SimHash of a set of 64-bit hashes, each of which is taken to 1024 bits by SplitMix64."""
    votes = np.zeros(8 * POSITIONS, np.int64)
    for k in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[k : k + 255, None] + _SEEDS
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def posting_positions(width: int) -> list[list[int]]:
    """The positions of each posting: all positions in a random order, cut, and again in another order."""
    rnd, found = random.Random(width), []
    while len(found) < POSTINGS[width]:
        order = rnd.sample(range(POSITIONS), POSITIONS)
        found += [order[k : k + width] for k in range(0, POSITIONS - width + 1, width)]
    return found[: POSTINGS[width]]


def posting_width(nodes: int) -> int:
    """Bytes of a posting."""
    return 2 if nodes <= ROWS_OF_TWO else 3 if nodes <= ROWS_OF_TWO << 8 else 4


def close_in_lists(lists: np.ndarray, sizes: np.ndarray, heads: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that connect the close members of each list; rows are sorted by list and size.

    Each row is compared with the next in its list, then with the next but one, and so on, as long as sizes allow; rows that are
    known to be connected are not compared, so that little more than a forest is found.
    """
    a, b = [], []
    top = np.arange(len(lists))  # connected with the row by links found before
    i, step = top, 1
    while True:
        i = i[i + step < len(lists)]
        i = i[(lists[i] == lists[i + step]) & (100 * sizes[i] >= percent * sizes[i + step])]
        if not len(i):
            break
        near = i[top[i] != top[i + step]]
        near = near[np.bitwise_count(heads[near] ^ heads[near + step]).sum(axis=1, dtype=np.int64) <= MOST_BITS]
        if len(near):
            a.append(near)
            b.append(near + step)
            least = np.minimum(top[near], top[near + step])
            top[near + step] = least
            top[near] = np.minimum(top[near], least)
            while (top[top] != top).any():
                top = top[top]
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def _close(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(rows: pa.Table) -> pa.RecordBatch:
        lists, sizes, ids = (rows.column(c).to_numpy() for c in ("list", "size", "id"))
        heads = np.stack([rows.column(c).to_numpy() for c in ("head", "more")], axis=1).view(np.uint64)
        a, b = close_in_lists(lists, sizes.astype(np.int64), heads, percent)
        a, b = starred(ids[a], ids[b])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            lists = rows.column("list").to_numpy()
            last = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0  # sorted; the last list may go on in the next batch
            if last:
                yield links(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield links(held)

    return run


def candidate_links(nodes: DataFrame, percent: int = 80, list_rows: int = LIST_ROWS, width: int | None = None) -> DataFrame:
    """``a, b`` (a < b): few links that connect whatever shares a posting, has sizes that allow the similarity, and close first bits."""
    held = nodes.where("size > 0")
    positions = posting_positions(width or posting_width(held.count()))
    head = lambda at: F.conv(F.hex(F.substring("print", at, 8)), 16, -10).cast("long")
    held = held.select("id", "size", head(1).alias("head"), head(9).alias("more"), "print")
    each = held.select("*", F.posexplode(F.from_json(F.lit(str(positions)), "array<array<int>>")).alias("posting", "at"))
    key = F.xxhash64("posting", *[F.substring(F.col("print"), F.col("at")[k] + 1, F.lit(1)) for k in range(len(positions[0]))])
    postings = each.select("id", "size", "head", "more", key.alias("list"))
    sums = postings.groupBy("list").agg(F.min("id").alias("least"), F.count("*").alias("members"))
    long = stored(sums.where(F.col("members") > list_rows), "long-lists")
    if not long.isEmpty():
        # Such lists hold more than list_rows postings each, so there are few of them.
        of_long = postings.join(long, "list").where("least <> id").select(F.col("least").alias("a"), F.col("id").alias("b"))
        postings = postings.join(long, "list", "left_anti")
    dealt = postings.repartition(shuffle_partitions(nodes.sparkSession), "list").sortWithinPartitions("list", "size")
    links = dealt.mapInArrow(_close(percent), "a long, b long")
    return fewer_links(links if long.isEmpty() else links.union(of_long))


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    list_rows: int = LIST_ROWS,
    part_bytes: int = PART_BYTES,
    part_rows: int = PART_ROWS,
    posting_bytes: int | None = None,
) -> DataFrame:
    """The documents that stay, with all their columns: of each group of near copies the row with the smallest id.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``percent`` or more; groups are what links connect.
    """
    docs = addressable(docs)
    rows, nodes = set_nodes(docs, id_col, text_col, width, simhash)
    links = stored(candidate_links(nodes, percent, list_rows, posting_bytes), "candidates")
    links = verified_links(docs, nodes, links, id_col, text_col, width, percent, part_bytes, part_rows, LEAST_SHARED)
    return first_of_groups(docs, rows, nodes, stored(links, "near-links"))
