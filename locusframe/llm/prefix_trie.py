"""Tries of conversation prefixes: which conversations begin alike, how far, and what sharing their beginnings saves.

A node of depth d is a distinct sequence of the first d turns (role and text) of some conversation; its members are the
conversations that begin so.  Texts stay where they are read: a turn is its SHA-256 and its number of words.

1. Turns get their places.  They are dealt out by ranges of conversation and turn, counted within each range, and a conversation
   that spans ranges gets offsets, so one with a third of all turns is many tasks' work.
2. Equal conversations are one sequence: a digest of all turns with their places, which is a sum that starts on the map side.
   From here on there is one row for each turn of each distinct sequence.
3. Sequences are dealt out by the digest of their first turn.  A first turn with more than ``most_rows`` rows below it is dealt
   out again by the next turn, and so on; nodes that are split so are put together from their children afterwards.
4. What is small enough is hashed into groups and built inside ``applyInPandas``: nodes point to their children through
   dictionaries of turns, and an iterative postorder sums up what lies below each node.
5. What is still too large after ``most_rounds`` rounds (long beginnings in common) is not built in a task.  A prefix is then a
   digest that adds up along the sequence, nodes are groups of equal digests, and both numbers of a subtree are sums over the
   sequences through its top: every node belongs to its smallest sequence, which carries sums towards its end.  It is exact too.

The conversations that end at a node are hashed in order: their ids are sorted by ranges, joined into chunks there, and the
chunks of a node are fed to SHA-256 one after the other, so no list of ids is ever whole.

Special cases: rows without a conversation id are left out; null turns come first, and turns that tie come in the order of their
digests; rows that repeat are turns that repeat; null roles and texts are empty, and a role and a text never run into each other;
texts of any length are hashed whole; a conversation without turns, which only rebuilding can bring about, ends at the root; an
empty table has no members and so no node, not even the root; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import BROADCAST_ROWS, joined_to_classes, shuffle_partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows below a node that are built in one task at most, what is worth dealing out again, and rounds of that.
MOST_ROWS, LEAST_ROWS, MOST_ROUNDS = 50_000, 1000, 8
#: Turns of a sequence that make a block where sums run along sequences.
BLOCK = 4096
#: Ids that make a chunk on their way to SHA-256.
CHUNK = 1000
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "group_key binary, top int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, end_conv long, ends long"
)
_ROW = ["group_key", "rep", "n", "weight", "place", "digest", "words"]


def turn_digests(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, digest, words``, one row per turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    return conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        # The role's length keeps the two apart.
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def placed(turns: DataFrame) -> DataFrame:
    """``conv_id, place (from 1), digest, words``: places by turn, in ranges, so that no conversation is one task's work."""
    spark = turns.sparkSession
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = stored(
        turns.repartitionByRange(shuffle_partitions(spark), F.asc("conv_id"), *order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    # Conversations that span ranges: two for each border at most.
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    spans = counts.groupBy("conv_id").agg(F.collect_list(F.struct("range", "n")).alias("parts")).where(F.size("parts") > 1)
    part = F.explode(F.transform("parts", lambda p: F.struct(
        p["range"].alias("range"),
        F.aggregate(F.filter("parts", lambda q: q["range"] < p["range"]), F.lit(0).cast("long"), lambda s, q: s + q["n"]).alias("before"),
    )))
    offsets = spans.select("conv_id", part.alias("p")).select("conv_id", "p.range", "p.before")
    within = Window.partitionBy("conv_id", "range").orderBy(*order)
    return (
        ranged.withColumn("k", F.row_number().over(within).cast("long"))
        .join(F.broadcast(offsets), ["conv_id", "range"], "left")
        .select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")
    )


def rebuilt(turns: DataFrame, base: Column, borrowed: Column, most_borrowed: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: the first ``borrowed`` turns of ``base``, then their own after as many.

    ``turns``: as of ``placed``, stored; ``base`` and ``borrowed``: of ``conv_id``, ``borrowed`` at most ``most_borrowed``.
    Gives the conversations (``conv_id, n``) and their turns (``conv_id, place, digest, words``); stored.
    """
    heads = turns.where(F.col("place") <= most_borrowed).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head")
    )
    known = turns.groupBy("conv_id").agg(F.count("*").alias("members"))
    ids = known.select("conv_id", "members", base.alias("base"), borrowed.alias("borrowed"))
    ids = ids.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "members", "borrowed", F.filter(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")), lambda t: t["place"] <= F.col("borrowed")).alias("head")
    )
    ids = stored(ids, "heads")
    first = ids.select("conv_id", F.inline("head"))
    # Places move only where the other conversation has fewer turns than are borrowed.
    shift = ids.select("conv_id", "members", "borrowed", (F.col("borrowed") - F.size("head")).alias("shift"))
    own = joined_to_classes(turns, shift, ["conv_id"]).where(F.col("place") > F.col("borrowed"))
    both = first.unionByName(own.select("conv_id", (F.col("place") - F.col("shift")).alias("place"), "digest", "words"))
    n = F.size("head") + F.greatest(F.col("members") - F.col("borrowed"), F.lit(0))
    return ids.select("conv_id", n.cast("long").alias("n")), stored(both, "turns")


def _lanes(*of: str) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(f"lane {k}"), *of) for k in (1, 2)]


def sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (``rep, n, weight``: smallest conversation, turns, conversations) and ``conv_id, rep``; stored.

    A sequence's digest is the exclusive or over its turns of two 64-bit hashes of place and SHA-256.
    """
    x, y = _lanes("place", "digest")
    sums = turns.groupBy("conv_id").agg(F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
    keyed = stored(convs.join(sums, "conv_id", "left").select("conv_id", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in "xy"]), "sequences")
    classes = stored(keyed.groupBy("n", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("members")), "classes")
    members = joined_to_classes(keyed, classes.where("members > 1"), ["n", "x", "y"]).select("conv_id", "rep")
    return classes.select("rep", "n", F.col("members").alias("weight")), members


def ends_hashed(members: DataFrame) -> DataFrame:
    """``end_conv, ends_sha256``: the hash of the ids of each class of equal conversations, ascending, with commas between."""
    spark = members.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring ids of a class joined into texts."""
        for batch in batches:
            frame = batch.to_pandas()
            part = frame.groupby("rep", sort=False).cumcount() // CHUNK
            found = frame.groupby(["rep", part.rename("part")], sort=False)["conv_id"]
            out = pd.DataFrame({"first": found.first(), "ids": found.agg(lambda ids: ",".join(map(str, ids)))}).reset_index()
            yield pa.RecordBatch.from_pandas(out[["rep", "first", "ids"]], preserve_index=False)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One hasher that runs along the chunks of a class."""
        rep, state = None, None
        named = lambda done: pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["end_conv", "ends_sha256"]
        )
        for batch in batches:
            done = []
            for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if r != rep:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield named(done)
        if state is not None:
            yield named([(rep, state.hexdigest())])

    n = shuffle_partitions(spark)
    ranged = members.repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    joined = stored(ranged.mapInArrow(chunks, "rep long, first long, ids string"), "chunks")
    return joined.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(hashed, "end_conv long, ends_sha256 string")


# Tries of groups ---------------------------------------------------------------------------------------------------------------


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes below the tops of one group.  ``rows``: columns _ROW, from the top's own turn on.

    A node is its place in these lists: ``children`` points from a turn's digest to the child.
    """
    rows = rows.sort_values(["group_key", "rep", "place"], kind="stable")
    children: list[dict] = []
    parent, depth, words, conv, convs, end, ends, key = [], [], [], [], [], [], [], []

    def node(up: int, at: int, n_words: int, of: bytes) -> int:
        children.append({})
        for column, value in ((parent, up), (depth, at), (words, n_words), (conv, None), (convs, 0), (end, None), (ends, 0), (key, of)):
            column.append(value)
        return len(children) - 1

    tops: dict[bytes, int] = {}
    last, at = None, -1
    for of, rep, n, weight, place, digest, n_words in zip(*(rows[c].to_list() for c in _ROW)):
        below = tops if last != rep else children[at]
        name = of if last != rep else digest
        if name not in below:
            below[name] = node(at if last == rep else -1, place, n_words, of)
        last, at = rep, below[name]
        conv[at] = rep if conv[at] is None else min(conv[at], rep)
        convs[at] += weight
        if place == n:
            end[at], ends[at] = rep, weight
    # Children were made after their parents: from the last node to the first is a postorder without recursion.
    leaves, saved = [0] * len(children), [0] * len(children)
    for k in range(len(children) - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        saved[k] += (convs[k] - 1) * words[k]
        if parent[k] >= 0:
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    return pd.DataFrame(
        {
            "group_key": key,
            "top": pd.array([int(p < 0) for p in parent], "int32"),
            "conv_id": conv,
            "depth": depth,
            "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"),
            "n_convs": convs,
            "n_children": [len(c) for c in children],
            "n_leaves": leaves,
            "saved_tokens": saved,
            "end_conv": pd.array(end, "Int64"),
            "ends": ends,
        }
    )


def _tries(rows: DataFrame, most_rows: int) -> DataFrame:
    """Nodes of all groups.  Groups are hashed together into buckets of ``most_rows`` rows or fewer on average."""
    n = max(4 * shuffle_partitions(rows.sparkSession), -(-rows.count() // most_rows))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(n))).groupBy("bucket").applyInPandas(build, _NODE)


# What is too large for a task ---------------------------------------------------------------------------------------------------


def _running(rows: DataFrame, values: dict[str, Column], combine, plus, backwards: bool = False) -> DataFrame:
    """Adds running totals along each sequence, the row's own value in them: within blocks of BLOCK places, then across blocks."""
    rows = rows.select("*", F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("block"), *[v.alias(f"own_{k}") for k, v in values.items()])
    order = F.desc if backwards else F.asc
    within = Window.partitionBy("rep", "block").orderBy(order("place")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("rep").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("rep", "block").agg(*[combine(f"own_{k}").alias(f"of_{k}") for k in values])
    blocks = blocks.select("rep", "block", *[F.coalesce(combine(f"of_{k}").over(across), F.lit(0)).alias(f"of_{k}") for k in values])
    rows = rows.select("*", *[combine(f"own_{k}").over(within).alias(f"in_{k}") for k in values]).join(blocks, ["rep", "block"])
    return rows.select("*", *[plus(F.col(f"in_{k}"), F.col(f"of_{k}")).alias(k) for k in values])


def _summed(rows: DataFrame) -> DataFrame:
    """Nodes of groups that no task could hold.  ``rows``: columns _ROW and level."""
    xor = lambda a, b: a.bitwiseXOR(b)
    lanes = dict(zip("xy", _lanes("place", "digest")))
    rows = _running(rows, lanes, F.bit_xor, xor)
    # A prefix without its last turn is the prefix before it.
    before = [xor(F.col(k), F.col(f"own_{k}")).alias(f"before_{k}") for k in "xy"]
    rows = stored(rows.select("group_key", "rep", "n", "weight", "place", "words", "level", "x", "y", *before), "prefixes")
    key, parent = ["group_key", "place", "x", "y"], [F.col("group_key"), F.col("place") - 1, F.col("before_x"), F.col("before_y")]
    at_end = F.col("place") == F.col("n")
    nodes = stored(
        rows.groupBy(*key).agg(
            F.min("rep").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.first("words").alias("words"),
            F.first("level").alias("level"),
            F.first("before_x").alias("before_x"),
            F.first("before_y").alias("before_y"),
            F.max(F.when(at_end, F.col("rep"))).alias("end_conv"),
            F.coalesce(F.max(F.when(at_end, F.col("weight"))), F.lit(0)).cast("long").alias("ends"),
            F.count_if(~at_end).alias("go_on"),
        ),
        "nodes",
    )
    # Each node is carried by the smallest of its sequences, towards the beginning; a leaf is a node that none goes on from.
    carried = nodes.select(
        F.col("conv_id").alias("rep"), "place", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("go_on") == 0).cast("long").alias("leaf")
    )
    along = rows.select("rep", *key).join(carried, ["rep", "place"], "left").na.fill(0, ["saved", "leaf"])
    along = along.withColumnRenamed("saved", "saves")
    sums = _running(along, {"saved": F.col("saves"), "leaves": F.col("leaf")}, F.sum, lambda a, b: a + b, backwards=True)
    below = sums.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    nodes = stored(nodes.join(below, key), "summed")
    inner = nodes.where("place > level").withColumns(dict(zip(["up_place", "up_x", "up_y"], parent[1:])))
    up = ["group_key", "up_place", "up_x", "up_y"]
    children = stored(inner.groupBy(*up).agg(F.count("*").alias("members")), "children")
    named = nodes.select("group_key", *[F.col(k).alias(u) for k, u in zip(key[1:], up[1:])], F.col("conv_id").alias("parent_conv_id"))
    inner = joined_to_classes(inner, stored(children.join(named, up), "parents"), up).drop("members", *up[1:])
    top = nodes.where("place = level").withColumn("parent_conv_id", F.lit(None).cast("long"))
    both = inner.unionByName(top).join(children.select(*[F.col(u).alias(k) for k, u in zip(key, up)], "members"), key, "left")
    return both.select(
        "group_key", (F.col("place") == F.col("level")).cast("int").alias("top"), "conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("members", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "end_conv", "ends",
    )


# All together --------------------------------------------------------------------------------------------------------------------


def _with(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join with a stored table that is broadcast up to BROADCAST_ROWS rows."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys, how)


def nodes_of(convs: DataFrame, turns: DataFrame, most_rows: int | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """One row per node of the tries of all conversations (``conv_id, n``; their turns: ``conv_id, place, digest, words``; stored).

    ``most_rows``: below a node that a task builds; by default as many as level out the tasks, MOST_ROWS at most.
    """
    spark = convs.sparkSession
    seqs, members = sequences(convs, turns)
    reps = seqs.where("n > 0").select(F.col("rep").alias("conv_id"), F.col("n").alias("members"), "weight")
    rows = stored(
        joined_to_classes(turns, stored(reps, "reps"), ["conv_id"]).select(
            F.col("conv_id").alias("rep"), F.col("members").alias("n"), "weight", "place", "digest", "words"
        ),
        "rows",
    )
    if most_rows is None:
        most_rows = min(MOST_ROWS, max(LEAST_ROWS, rows.count() // (4 * shuffle_partitions(spark))))
    # The root is always split; ``open`` are the sequences below nodes that are too large for a task.
    open_ = seqs.select("rep", "n", "weight", F.lit(b"").alias("group_key"), F.lit(0).cast("long").alias("words"))
    split, groups, closed, level = [], [], [], 0
    while True:
        at_end = F.col("n") == level
        split.append(stored(open_.groupBy("group_key").agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("words").alias("words"),
            F.max(F.when(at_end, F.col("rep"))).alias("end_conv"), F.coalesce(F.max(F.when(at_end, F.col("weight"))), F.lit(0)).cast("long").alias("ends"),
        ), "split"))
        level += 1
        step = rows.where(F.col("place") == level).select("rep", "digest", "words")
        below = stored(
            open_.where(F.col("n") >= level).drop("words").join(step, "rep").select(
                "rep", "n", "weight", F.col("group_key").alias("parent_key"), F.unhex(F.sha2(F.concat("group_key", "digest"), 256)).alias("group_key"), "words"
            ),
            "below",
        )
        found = below.groupBy("group_key").agg(F.first("parent_key").alias("parent_key"), F.count("*").alias("members"), F.sum(F.col("n") - level + 1).alias("rows"))
        groups.append(stored(found, "groups"))
        large = stored(groups[-1].where(F.col("rows") > most_rows).select("group_key"), "large")
        rest = below.drop("parent_key", "words").withColumn("level", F.lit(level).cast("long"))
        too_large = not large.isEmpty()
        closed.append(_with(rest, large, ["group_key"], "left_anti") if too_large else rest)
        open_ = _with(below.drop("parent_key"), large, ["group_key"], "left_semi")
        if not too_large or level >= most_rounds:
            break

    def turns_of(group: DataFrame) -> DataFrame:
        """The turns of sequences from the top of their group on."""
        own = group.select("rep", "group_key", "level", F.col("n").alias("members"))
        return joined_to_classes(rows, stored(own, "closed"), ["rep"]).where(F.col("place") >= F.col("level")).drop("members")

    whole = closed[0]
    for more in closed[1:]:
        whole = whole.unionByName(more)
    nodes = _tries(stored(turns_of(whole).select(*_ROW), "tries"), most_rows)
    if too_large:
        rest = open_.drop("words").withColumn("level", F.lit(level).cast("long"))
        nodes = nodes.unionByName(_summed(stored(turns_of(rest), "rest")))
    nodes = stored(nodes, "trie-nodes")
    # Nodes that were split, from the deepest to the root, from their children.
    parents = groups[0].select("group_key", "parent_key")
    for more in groups[1:]:
        parents = parents.unionByName(more.select("group_key", "parent_key"))
    tops = stored(nodes.where("top = 1").join(parents, "group_key"), "tops")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "ends"]
    made, children = [], tops
    for depth in range(len(split) - 1, -1, -1):
        sums = children.groupBy(F.col("parent_key").alias("group_key")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        here = split[depth].join(sums, "group_key", "left").select(
            "group_key", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
            "end_conv", "ends",
        )
        here = here.join(parents, "group_key", "left") if depth else here.withColumn("parent_key", F.lit(None).cast("binary"))
        made.append(stored(here, "split-nodes"))
        children = tops.select("parent_key", "n_leaves", "saved_tokens").unionByName(made[-1].select("parent_key", "n_leaves", "saved_tokens"))
    upper = made[0]
    for more in made[1:]:
        upper = upper.unionByName(more)
    named = stored(upper.select(F.col("group_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "named")
    below_split = tops.select("parent_key", *columns).unionByName(upper.select("parent_key", *columns))
    found = _with(below_split, named, ["parent_key"], "left").drop("parent_key")
    found = nodes.where("top = 0").select(*columns, "parent_conv_id").unionByName(found)
    # The ids that end at a node.
    several = found.where("ends > 1").join(ends_hashed(members), "end_conv")
    few = found.where("ends <= 1").withColumn("ends_sha256", F.when(F.col("ends") == 0, F.lit(NO_IDS)).otherwise(F.sha2(F.col("end_conv").cast("string"), 256)))
    return few.unionByName(several).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    base: Column | None = None, borrowed: Column | None = None, most_borrowed: int = 0, most_rows: int | None = None,
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``base``, ``borrowed`` (of ``conv_id``): conversations begin with as many turns of another one instead of their own.
    """
    turns = stored(placed(stored(turn_digests(conversations, conv_col, turn_col, role_col, text_col), "digests")), "places")
    if base is None:
        convs = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    else:
        convs, turns = rebuilt(turns, base, borrowed, most_borrowed)
    return nodes_of(convs, turns, most_rows, most_rounds)
