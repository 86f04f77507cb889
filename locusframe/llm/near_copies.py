"""Near copies by the similarity of their word shingles, found through positional bytes.

The index of ``simhash`` (bytes by position, shared bytes tallied for each pair, a minimum, verification) on another fingerprint.
Byte ``k`` is taken of one shingle alone, the one with the smallest hash in the ``k``-th order of all, and agrees for as many positions
as the texts have shingles in common.  The pipeline uses ``simhash_copies``, which finds its candidates by a SimHash and takes the
nodes, the verification and the groups from here.

1. Rows with equal sets of shingles are one node.  A node has POSITIONS bytes, and a posting for each five of them.
2. In a posting list the shared bytes of pairs are tallied; those with LEAST_SHARED or more are linked.  Lists of more than ``list_rows``
   members are linked as they are.  All that is connected is a cluster of candidates.
3. The shingles of a cluster's nodes are brought together and pairs that reach the minimum are verified by their exact Jaccard similarity.
   A large cluster is dealt into parts of some ``part_bytes``, and each two parts meet in a task, so that every pair meets.
4. Verified links are closed to groups.

A pair of similarity 0.8 shares a posting with probability 0.99 and reaches the minimum with 0.997; more similar ones with more.  No
pair is linked that is not verified.  Within a list or two parts links are found breadth first, so that only a forest leaves a task.

Special cases: null text counts as empty; texts without words are equal to each other; fewer words than a shingle has are one
shingle; a text of any length is taken as a whole; rows that repeat a ``doc_id`` are rows of their own and are told apart by their
place in the files; of a group the row with the smallest id stays, rows without an id come after all others; an empty table gives
an empty one; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import (
    BROADCAST_ROWS, ROW_KEY, addressable, id_and_text, joined_to_classes, row_key, shuffle_partitions, slices, stored, without_rows,
)
from locusframe.llm.components import components, fewer_links, starred

#: Bytes of a fingerprint, those of a posting, and how many two fingerprints must share.
POSITIONS, POSTING, LEAST_SHARED = 60, 5, 39
#: Members of a posting list that one task compares.
LIST_ROWS = 1024
#: Bytes of shingle hashes in one part of a cluster, and its nodes.
PART_BYTES, PART_ROWS = 4 << 20, 1024

#: An odd multiplier and an addend for each order.
_ORDERS = np.array([[xxhash.xxh64_intdigest(b"order", k) | 1, xxhash.xxh64_intdigest(b"shift", k)] for k in range(POSITIONS)], np.uint64)


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; A-Z count as lower case."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts[:last], ends[-last:])), np.uint64, last))


def positional_bytes(hashes: np.ndarray) -> bytes:
    """For each order one byte of the hash that comes first in it."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        mixed = hashes[k : k + 4096, None] * _ORDERS[:, 0] + _ORDERS[:, 1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=0))
    return (least * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.uint8).tobytes()


def linked(members: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of a relation, breadth first; ``near(a, others)`` says which of the others are related to a."""
    a, b, left = [], [], np.arange(members)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            reached = near(at, left)
            a += [at] * int(reached.sum())
            b += left[reached].tolist()
            queue += left[reached].tolist()
            left = left[~reached]
    return a, b


def _enough_shared(prints: np.ndarray, least: int = LEAST_SHARED) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda at, others: np.count_nonzero(prints[others] == prints[at], axis=1) >= least


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), np.uint8) for x in column])


def _links(ids: np.ndarray, found: tuple[list[int], list[int]]) -> pa.Table:
    a, b = starred(ids[found[0]], ids[found[1]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _of_list(table: pa.Table) -> pa.Table:
    return _links(table.column("id").to_numpy(), linked(table.num_rows, _enough_shared(_prints(table.column("print")))))


def _verified(percent: int, least_shared: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        shared_enough = _enough_shared(_prints(table.column("print")), least_shared)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(len(codes), bool)

        def similar(at: int, others: np.ndarray) -> np.ndarray:
            reached = shared_enough(at, others)
            own = codes[ends[at] - sizes[at] : ends[at]]
            held[own] = True
            for k in np.flatnonzero(reached):
                o = others[k]
                both = np.count_nonzero(held[codes[ends[o] - sizes[o] : ends[o]]])
                reached[k] = 100 * both >= percent * (sizes[at] + sizes[o] - both)
            held[own] = False
            return reached

        return _links(table.column("id").to_numpy(), linked(len(sets), similar))

    return run


def set_nodes(
    docs: DataFrame, id_col: str, text_col: str, width: int, fingerprint: Callable[[np.ndarray], bytes]
) -> tuple[DataFrame, DataFrame]:
    """Rows (``place, digest``) and nodes (``id, digest, print, size, first, members``); a print is the fingerprint of a set of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = [shingles(x.as_buffer().to_pybytes(), width) for x in batch.column("text")]
            made = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([fingerprint(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *ROW_KEY)] + made, names)

    names = ["doc_id", *ROW_KEY, "digest", "print", "size"]
    keys = "doc_id long, row_file long, row_index long"
    rows = id_and_text(docs, id_col, text_col, *row_key(docs)).mapInArrow(run, f"{keys}, digest binary, print binary, size int")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY).alias("place")
    rows = stored(rows.select(place, "digest", "print", "size"), "shingle-sets")
    nodes = rows.groupBy("digest", "size").agg(F.min("print").alias("print"), F.min("place").alias("first"), F.count("*").alias("members"))
    return rows, stored(nodes.withColumn("id", F.monotonically_increasing_id()), "set-nodes")


def candidate_links(nodes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b`` (a < b): few links that connect whatever shares a posting and enough bytes."""
    count = POSITIONS // POSTING
    key = lambda k: F.xxhash64(F.lit(k), F.substring("print", k * POSTING + 1, POSTING))
    postings = nodes.where("size > 0").select("id", F.explode(F.array(*[key(k) for k in range(count)])).alias("list"))
    lists = stored(
        postings.groupBy("list").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1"), "lists"
    )
    met = stored(joined_to_classes(postings, lists, ["list"]).select("list", "id", "least", "members"), "met")
    # Only nodes that meet another one are given their bytes.
    prints = nodes.select("id", "print")
    short = met.where(F.col("members") <= list_rows).join(prints, "id").select("list", "id", "print")
    links = short.groupBy("list").applyInArrow(_of_list, "a long, b long")
    return fewer_links(links.union(met.where(F.col("members") > list_rows).select(F.col("least"), F.col("id")).where("least <> id")))


def verified_links(
    docs: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str, text_col: str, width: int, percent: int, part_bytes: int, part_rows: int,
    least_shared: int = LEAST_SHARED,
) -> DataFrame:
    """``a, b`` (a < b): few links that connect what is similar by ``percent`` or more and was connected by candidates."""
    labels = components(links)
    held = labels.join(nodes.select(F.col("id").alias("node"), "size", "print", *[f"first.{k}" for k in ROW_KEY]), "node")
    held = stored(held, "cluster-nodes")
    sums = held.groupBy("label").agg(F.count("*").alias("members"), F.sum(F.col("size").cast("long") * 8).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("bytes") / part_bytes, F.col("members") / part_rows)).cast("int")
    held = stored(joined_to_classes(held, stored(sums, "clusters"), ["label"]).withColumn("parts", parts), "cluster-parts")
    wanted = held if held.count() > BROADCAST_ROWS else F.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = pa.array([shingles(x.as_buffer().to_pybytes(), width).tobytes() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], [*kept, "hashes"])

    kept = ["id", "label", "parts", "print"]
    texts = id_and_text(docs, id_col, text_col, *row_key(docs)).drop("doc_id").join(wanted, list(ROW_KEY))
    sets = texts.select("text", F.col("node").alias("id"), "label", "parts", "print").mapInArrow(
        run, "id long, label long, parts int, print binary, hashes binary"
    )
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(others))
    pair: list[Column] = [F.col("label"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    dealt = dealt.select(*pair, "id", "print", "hashes").repartition(shuffle_partitions(docs.sparkSession), "label", "p", "q")
    return fewer_links(dealt.groupBy("label", "p", "q").applyInArrow(_verified(percent, least_shared), "a long, b long"))


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    list_rows: int = LIST_ROWS,
    part_bytes: int = PART_BYTES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The documents that stay, with all their columns: of each group of near copies the row with the smallest id.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``percent`` or more; groups are what links connect.
    """
    docs = addressable(docs)
    rows, nodes = set_nodes(docs, id_col, text_col, width, positional_bytes)
    links = stored(candidate_links(nodes, list_rows), "candidates")
    links = stored(verified_links(docs, nodes, links, id_col, text_col, width, percent, part_bytes, part_rows), "near-links")
    return first_of_groups(docs, rows, nodes, links)


def first_of_groups(docs: DataFrame, rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The documents that stay, where links between nodes (stored) are closed to groups."""
    labels = components(links).withColumnRenamed("node", "id")
    named = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    firsts = named.groupBy("label").agg(F.min("first").alias("stays"))
    classes = stored(named.drop("first").join(firsts, "label").select("digest", "size", "members", "stays"), "set-classes")
    rest = joined_to_classes(rows, classes, ["digest", "size"]).where(~F.col("place").eqNullSafe(F.col("stays")))
    return without_rows(docs, stored(rest.select(*[f"place.{c}" for c in ROW_KEY]), "near-copies"))
