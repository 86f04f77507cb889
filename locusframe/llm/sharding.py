"""Sharding over fixed virtual slots.

A record's id is hashed into one of ``n_slots`` virtual slots; the bytes of each slot are summed; a small versioned table says
which shard each slot is on.  Rebalancing edits that table only: it moves as few slots as bring the shards to nearly equal
bytes, so records of all other slots stay where they are.  A table that exists is read, edited and gets the next version; a new
one begins with version 0, where slots are dealt out in turn.  A shard more takes slots from all others, and then the shards are
levelled.

Ids may be null or repeat, and then one slot may hold a third of all bytes.  A slot of more than twice the mean has parts, as
many as make them about as large as the mean; its records fall into them by their row, and the map holds a row for each part.
There are no more than ``n_slots`` parts beyond the first ones.  Everything that grows with the data is aggregations by slot and
one window over a part; what reaches the driver is one number per part.

The law that holds is ``bytes``: the sums of sizes of the shards are nearly equal (within the size of the smallest parts).

Special cases: null text has size 1 and the CRC of the empty text; a text of any length is one record, so a shard is as large as
its largest record at least; null ids share a slot, as rows with equal ids do; of rows of a slot with equal ids the smaller CRC,
then the smaller size comes first, and equal rows come in any order; an empty table gives an empty result and a map that is the
initial one; further columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm._common import new_path, stored

N_SLOTS = 4096
#: A part of a slot: (slot, part).
Part = tuple[int, int]


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots are dealt out in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced(slot_map: list[int], slot_bytes: list[int], n_shards: int) -> list[int]:
    """The next version of a map: slots move from the fullest shard to the emptiest, or change places, while that narrows the
    gap.  The work depends on the numbers of slots and shards only."""
    new = list(slot_map)
    on: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    load = [0] * n_shards
    for slot, shard in enumerate(new):
        on[shard].append((slot_bytes[slot], slot))
        load[shard] += slot_bytes[slot]
    for shard in on:
        shard.sort()
    for _ in range(8 * len(new)):
        high = max(range(n_shards), key=lambda k: (load[k], -k))
        low = min(range(n_shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        best = None
        # A move of x bytes, or a swap that moves x in all, leaves a gap of |gap - 2x|.
        partners = [(0, -1), *on[low]]
        for back, other in partners:
            want = back + gap // 2
            at = bisect.bisect_left(on[high], (want, -1))
            for k in (at - 1, at):
                if 0 <= k < len(on[high]):
                    moved = on[high][k][0] - back
                    if moved > 0 and (left := abs(gap - 2 * moved)) < gap and (best is None or left < best[0]):
                        best = (left, on[high][k], (back, other))
            if best is not None and best[0] <= 1:
                break
        if best is None:
            break
        _, (there, slot), (back, other) = best
        on[high].remove((there, slot))
        bisect.insort(on[low], (there, slot))
        new[slot] = low
        if other >= 0:
            on[low].remove((back, other))
            bisect.insort(on[high], (back, other))
            new[other] = high
        load[high] += back - there
        load[low] += there - back
    return new


def grown(slot_map: list[int], n_shards: int) -> list[int]:
    """The next version for one more shard: every shard gives slots to the new one, and no slot moves between old shards."""
    share = len(slot_map) // (n_shards + 1)
    new, given = list(slot_map), 0
    count = [slot_map.count(k) for k in range(n_shards)]
    for slot in range(len(new)):
        if given == share:
            break
        if count[new[slot]] > share:
            count[new[slot]] -= 1
            new[slot] = n_shards
            given += 1
    return new


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def map_table(spark: SparkSession, version: int, parts: list[Part], shards: list[int], sizes: list[int]) -> DataFrame:
    """One version of the map as rows ``version, slot, part, shard, bytes``; bytes: of the part when the version was made."""
    columns = [("slot", [s for s, _ in parts]), ("part", [p for _, p in parts]), ("shard", shards), ("bytes", sizes)]
    rows = spark.range(1).select(F.explode(F.arrays_zip(*[_numbers(v).alias(c) for c, v in columns])).alias("row"))
    return rows.select(F.lit(version).alias("version"), "row.*")


def latest_map(spark: SparkSession, path: str) -> tuple[int, dict[Part, int]]:
    """The last version of a stored map and its shard of each part."""
    stored_map = spark.read.parquet(path)
    version = stored_map.agg(F.max("version")).first()[0]
    rows = stored_map.where(F.col("version") == version).collect()  # two rows per slot at most
    return version, {(r["slot"], r["part"]): r["shard"] for r in rows}


def moved(spark: SparkSession, path: str) -> DataFrame:
    """``version, moved_slots, moved_bytes`` of each version of a stored map after the first: parts that changed their shard.

    A part that is new is not counted.
    """
    rows = spark.read.parquet(path)
    before = rows.select((F.col("version") + 1).alias("version"), "slot", "part", F.col("shard").alias("old"))
    both = rows.join(before, ["version", "slot", "part"]).where("shard <> old")
    versions = rows.select("version").distinct().where("version > 0")
    found = both.groupBy("version").agg(F.count("*").alias("moved_slots"), F.sum("bytes").alias("moved_bytes"))
    return versions.join(found, "version", "left").select(
        "version", F.coalesce("moved_slots", F.lit(0)).alias("moved_slots"), F.coalesce("moved_bytes", F.lit(0)).alias("moved_bytes")
    )


def _edited(spark: SparkSession, path: str | None, sizes: dict[Part, int], n_slots: int, n_shards: int) -> tuple[str, int, dict[Part, int]]:
    """Where the map is, its new version and the shard of each part."""
    parts = sorted(sizes)
    if path is None:
        path, version = new_path(spark, "slot-map"), 0
        old = {(slot, 0): shard for slot, shard in enumerate(initial_map(n_slots, n_shards))}
        firsts = [p for p in parts if not p[1]]
        map_table(spark, 0, firsts, [old[p] for p in firsts], [sizes[p] for p in firsts]).write.partitionBy("version").parquet(path)
    else:
        version, old = latest_map(spark, path)
        if len({slot for slot, _ in old}) != n_slots:
            raise ValueError(f"the map at {path} has other than {n_slots} slots")
        was = max(old.values()) + 1
        if was > n_shards:
            raise ValueError(f"the map at {path} has {was} shards, more than {n_shards}")
        order = sorted(old)
        shards = [old[p] for p in order]
        for k in range(was, n_shards):
            shards = grown(shards, k)
        old = dict(zip(order, shards))
    # New parts of a slot begin where its first one is.
    shards = rebalanced([old.get(p, old[p[0], 0]) for p in parts], [sizes[p] for p in parts], n_shards)
    map_table(spark, version + 1, parts, shards, [sizes[p] for p in parts]).write.mode("append").partitionBy("version").parquet(path)
    return path, version + 1, dict(zip(parts, shards))


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, part, map_version``.

    ``slot`` is the document's place in its shard, without gaps from 0; ``virtual_slot`` is what its id hashes to.  ``map_path``: a
    stored map, which is edited; without it a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)).cast("int"))
    slot_bytes = [0] * n_slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # n_slots rows at most
        slot_bytes[r["virtual_slot"]] = r["bytes"]
    mean = max(1, -(-sum(slot_bytes) // n_slots))
    in_parts = _numbers([-(-b // mean) if b > 2 * mean else 1 for b in slot_bytes])
    n_parts = F.element_at(in_parts, F.col("virtual_slot") + 1)
    sized = sized.withColumn("part", F.when(n_parts > 1, F.pmod(F.xxhash64("row"), n_parts)).otherwise(F.lit(0)).cast("int"))
    found = sized.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    rows = {(r["virtual_slot"], r["part"]): r["rows"] for r in found}  # two rows per slot at most
    sizes = {(slot, 0): 0 for slot in range(n_slots)} | {(r["virtual_slot"], r["part"]): r["bytes"] for r in found}
    path, version, shards = _edited(spark, map_path, sizes, n_slots, n_shards)
    parts, filled, first = sorted(sizes), [0] * n_shards, []
    for part in parts:
        first.append(filled[shards[part]])
        filled[shards[part]] += rows.get(part, 0)
    starts = spark.range(1).select(
        F.explode(F.arrays_zip(_numbers([s for s, _ in parts]).alias("slot"), _numbers([p for _, p in parts]).alias("part"), _numbers(first).alias("first"))).alias("r")
    )
    current = (
        spark.read.parquet(path)
        .where(F.col("version") == version)
        .join(starts.select("r.*"), ["slot", "part"])
        .select(F.col("slot").cast("int").alias("virtual_slot"), F.col("part").cast("int").alias("part"), "shard", "first")
    )
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        sized.withColumn("in_part", F.row_number().over(place) - 1)
        .join(F.broadcast(current), ["virtual_slot", "part"])  # two rows per slot at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("in_part")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "part",
            F.lit(version).alias("map_version"),
        )
    )
