import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import exact_dedup, simhash, suffix_dedup
from locusframe.llm.components import components, fewer_links, starred
from locusframe.llm.suffix_array import Strings, common_prefixes, suffix_array
from tests.llm.common import ODD, SCHEMA, documents

WS = re.compile("[\x20\x09-\x0d]+")


# Exact -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_exact_equals_brute_force(spark, fan_in):
    rows = documents(1, 120)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(WS.sub(" ", t or ""), []).append(d)
    want = {}
    for t, ids in groups.items():
        for d in ids:
            want[d] = (min(ids), len(ids), d == min(ids), hashlib.sha256(t.encode()).hexdigest())
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df, fan_in=fan_in).collect()}
    assert got == want


def test_exact_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == len(ODD)
    twice = [r for r in got if r["group_size"] == 2 and r["doc_id"] == 7]
    assert len(twice) == 4  # null and empty are equal; the repeated row
    assert sum(r["kept"] for r in twice) == 2 and {r["keep_id"] for r in twice} == {7}
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_exact_null_id_yields_to_any_id(spark):
    df = spark.createDataFrame([(None, "a b"), (9, "a  b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()}
    assert (9, 9, True) in got and (None, 9, False) in got
    assert sum(r["kept"] for r in exact_dedup.exact_duplicates(df).collect()) == 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, rows long, node string")
    assert exact_dedup.exact_duplicates(df).where("kept").count() == 1
    assert exact_dedup.drop_exact_duplicates(df).collect()[0]["node"] == "x"


def test_rows_are_told_apart_by_their_place(spark):
    rows = [(None, "a b", 1), (5, "a  b", 2), (5, "a b", 3), (None, "c", 4), (None, "c", 5), (2**63 - 1, "d", 6), (None, "d", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long").withColumn("__sha", F.lit("x"))
    kept = exact_dedup.drop_exact_duplicates(df.coalesce(1))
    assert kept.columns == df.columns and sorted(r["__id"] for r in kept.collect()) == [2, 4, 6]
    assert {r["keep_id"] for r in exact_dedup.exact_duplicates(df).where("doc_id > 5").collect()} == {2**63 - 1}


def test_large_classes(spark, monkeypatch):
    from locusframe.llm import _common

    monkeypatch.setattr(_common, "BROADCAST_CLASSES", 3)
    rows = [(k, "hot") for k in range(1200)] + [(2000 + k, f"t{k % 500}") for k in range(1500)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 501
    assert {r["group_size"] for r in got if r["doc_id"] < 1200} == {1200} and {r["group_size"] for r in got if r["doc_id"] >= 2000} == {3}


# SimHash -----------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(items):
    """Smallest id reachable over fingerprints within 4 bits."""
    label = {d: d for d, _ in items}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x ^ y).bit_count() <= 4:
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {d: root(d) for d, _ in items}


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_equals_brute_force(spark, seed):
    rows = documents(seed, 150) + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(["ONE two", "one TWO", "É x y z", "é x y z", "a b c d"])]
    items = [(d, slow_fingerprint(t)) for d, t, *_ in rows]
    want = {d: (f"{x:016x}", slow_components(items)[d]) for d, x in items}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_spark_hash_is_the_fingerprints_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("some words of a")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"some words of a", 42)


def test_triples_meet_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("list_rows", [2, 5, 40, 10_000])
def test_links_connect_what_is_close_at_any_list_size(spark, list_rows):
    rnd = random.Random(list_rows)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = set()
    for k in range(220):
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 9)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.close_links(df, list_rows).collect()
    assert all((r["fp_a"] ^ r["fp_b"]).bit_count() <= 4 or ((r["fp_a"] ^ r["fp_b"]) % 2**64).bit_count() <= 4 for r in links)
    label = slow_components([(x, x % 2**64) for x in sorted(signed)])
    found = {x: x for x in signed}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for r in links:
        a, b = sorted((root(r["fp_a"]), root(r["fp_b"])))
        found[b] = a
    assert {x: root(x) for x in signed} == label


def test_long_lists_do_not_depend_on_the_order_of_triples(spark, monkeypatch):
    def turned(df, label, real=simhash.stored):
        if label == "long-lists":  # every other fingerprint has its triples in descending order
            df = df.orderBy("fp", F.when(F.col("fp") % 2 == 0, F.col("triple")).otherwise(-F.col("triple"))).coalesce(1)
        return real(df, label)

    monkeypatch.setattr(simhash, "stored", turned)
    # Byte k from the left is position k; each pair shares the bytes of four positions and no other.
    rnd, pairs = random.Random(9), []
    for mask in [(0, 1, 3, 4), (0, 1, 3, 6), (0, 1, 2, 3), (3, 4, 5, 6)]:
        x = rnd.getrandbits(62) & ~1
        y = x
        for p in set(range(8)) - set(mask):
            y ^= 1 << (56 - 8 * p)
        pairs.append((x, y))
    df = spark.createDataFrame([(x,) for pair in pairs for x in pair], "fp long")
    got = {frozenset((r["fp_a"], r["fp_b"])) for r in simhash.close_links(df, 1).collect()}
    assert {frozenset(p) for p in pairs} <= got


@pytest.mark.parametrize("rows, want", [
    ([(5, "X"), (None, "X"), (None, "Y")], [(5, "X"), (None, "Y")]),
    ([(3, "X"), (7, "X"), (7, "Y")], [(3, "X"), (7, "Y")]),
    ([(7, "X"), (7, "X"), (None, "Y"), (None, "Y")], [(7, "X"), (None, "Y")]),
])
def test_one_row_of_each_stays_whatever_the_ids(spark, rows, want):
    text = {"X": "one two three four five six", "Y": "quite other words stand here now"}
    df = spark.createDataFrame([(d, text[t], t) for d, t in rows], "doc_id long, text string, __id string")
    got = [(r["doc_id"], r["__id"]) for r in simhash.keep_one_of_each(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dense_lists_are_linked_by_midpoints(spark):
    """Fingerprints that share five bytes and more, so that no split makes their lists short."""
    rnd = random.Random(4)
    fps = sorted({rnd.getrandbits(9) | rnd.choice([0, 0b111111 << 12]) for _ in range(300)} | {1 << 40})
    links = [(r["fp_a"], r["fp_b"]) for r in simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    assert {x: root(x) for x in fps} == slow_components([(x, x) for x in fps])


def test_sizes_of_lists_are_not_broadcast(spark):
    """20 lists for each fingerprint, which Spark takes to be as few as the fingerprints."""
    nodes = spark.range(2000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.close_links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_forest_is_whole_and_small():
    members = np.array([1 << k for k in range(60)], np.uint64)
    a, b = simhash.forest(members)
    assert len(a) == 59 and set(b.tolist()) | {0} == set(range(60))


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    assert {r["fingerprint"] for r in got if r["doc_id"] == 7} >= {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1 and kept.count() == 5
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_stars_and_fewer_links_connect_the_same(spark, seed):
    rnd = random.Random(seed)

    def groups(links):
        of = {x: x for link in links for x in link}
        for _ in of:
            for a, b in links:
                of[a] = of[b] = min(of[a], of[b])
        return of

    nodes = [rnd.randrange(-(2**62), 2**62) for _ in range(60)]
    links = [tuple(sorted(rnd.sample(nodes, 2))) for _ in range(10 * seed)] + [(nodes[0], nodes[1])] * 2
    links = [tuple(sorted(x)) for x in links]
    want = groups(links)
    a, b = starred(*(np.array([x[k] for x in links], np.int64) for k in (0, 1)))
    assert sorted(zip(b.tolist(), a.tolist())) == sorted((x, top) for x, top in want.items() if x != top)
    few = [tuple(r) for r in fewer_links(spark.createDataFrame(links, "a long, b long")).collect()]
    assert groups(few) == want and all(x < y for x, y in few) and len(few) == len(set(few)) <= len(set(links))
    assert not len(starred(*2 * [np.empty(0, np.int64)])[0]) and fewer_links(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix arrays -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "a", "abcdefgh"])
    strings = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))).encode() for _ in range(rnd.randint(1, 12))]
    depth = rnd.choice([8, 16, 24])
    s = Strings(strings)
    order = suffix_array(s, depth)
    text = bytes(s.letters[: s.n]) + b"\0" * 64
    assert sorted(order.tolist()) == list(range(s.n))
    keys = [text[i : i + depth] for i in order if text[i]]
    assert keys == sorted(keys)
    common = common_prefixes(s, order, depth)
    for k in range(1, len(order)):
        assert (common[k] >= depth) == (text[order[k] : order[k] + depth] == text[order[k - 1] : order[k - 1] + depth])


def slow_removal(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = t.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        rest = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest)
    return out


@pytest.mark.parametrize("most, seed", [(4096, 3), (1, 4)])
def test_removal_equals_brute_force(spark, most, seed):
    rows = documents(seed, 90)
    rows += [(200, "ab" * 300, 0, 0, 0), (201, "b" + "ab" * 90, 0, 0, 0), (202, "abc" * 100 + "x" * 150, 0, 0, 0), (203, "x" * 99, 0, 0, 0)]
    df = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, most_segments=most).collect()}
    assert got == slow_removal([(d, t or "") for d, t, *_ in rows])


def test_removal_frequent_passage(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = [(k, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for most, windows in ((4, 20_000), (4, 7), (4096, 20_000)):
        found = suffix_dedup.remove_repeats(df, most_segments=most, with_text=False, most_windows=windows)
        assert {r["doc_id"]: tuple(r)[1:5] for r in found.collect()} == {d: v[:4] for d, v in slow_removal(rows).items()}


@pytest.mark.parametrize("length", [40, 143, 160])
def test_removal_at_other_lengths(spark, length):
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (length - 1, length, length + 1, 3 * length, 900)]
    noise = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 1500)))
    rows = [(k, noise() + rnd.choice(passages) + noise() + rnd.choice(passages)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, length, with_text=False).collect()}
    assert got == {d: v[:4] for d, v in slow_removal(rows, length).items()}


def test_removal_odd_rows(spark):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(got) == len(ODD)
    long = [r for r in got if r["doc_id"] == 2**62][0]
    assert long["n_bytes"] == 100_000 and long["n_removed"] == 100_000 - 5 and long["n_spans"] == 1
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "z" * 10 + "abcdefghij" * 12)] * 2, "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(twice).collect()) == [110, 130]


def test_removal_over_long_text_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 64)
    rows = [(1, "".join(chr(97 + (k * k + k // 7) % 23) for k in range(3000))), (2, "".join(chr(97 + (k * k + k // 7) % 23) for k in range(500, 2100)))]
    want = slow_removal(rows)
    batch = [(d, list(suffix_dedup._parts(_batch(d, t), 100))) for d, t in rows]
    for (d, parts), (_, t) in zip(batch, rows):
        covered = {o + i for _, offsets, texts in parts for o, x in zip(offsets, texts) for i in range(len(x) - 99)}
        assert covered == set(range(len(t) - 99))
    assert want[2][1] > 0


def _batch(d, t):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([t])], ["key", "text"])


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_of_wanted_places(seed):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "a", "abcdefgh"])
    strings = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))).encode() for _ in range(rnd.randint(1, 12))]
    s, depth = Strings(strings), 16
    text = bytes(s.letters[: s.n]) + b"\0" * 64
    for wanted in (np.arange(s.n) + depth <= s.ends[s.owner], np.array([rnd.random() < 0.1 for _ in range(s.n)]), np.zeros(s.n, bool)):
        order = suffix_array(s, depth, wanted)
        assert len(set(order.tolist())) == len(order) and set(np.flatnonzero(wanted).tolist()) <= set(order.tolist())
        keys = [text[i : i + depth] for i in order if wanted[i]]
        assert keys == sorted(keys)


def test_few_more_places_are_sorted_than_windows_begin_at():
    rnd = random.Random(1)
    s = Strings(["".join(rnd.choice("abcdefgh") for _ in range(130)).encode() for _ in range(50)])
    whole = np.arange(s.n) + 100 <= s.ends[s.owner]
    assert 50 * 31 <= len(suffix_array(s, 100, whole)) < 50 * 36 < s.n / 3


def test_runs_are_merged_where_they_touch():
    import pyarrow as pa

    rnd = random.Random(2)
    texts = ["x" * 5, "", "abcdefghij" * 20, "é" * 30, "y"] + ["".join(rnd.choice("abc") for _ in range(80)) for _ in range(40)]
    runs = [None, [], [(150, 20), (0, 10), (10, 5), (100, 60), (110, 3)], [(0, 60)], [(0, 1)]]
    runs += [[(a, rnd.randint(1, 80 - a)) for a in rnd.sample(range(79), rnd.randint(0, 4))] for _ in range(40)]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))
    rows = pa.array([r and [{"at": a, "size": n} for a, n in r] for r in runs], kind)
    whole = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts), rows], ["doc_id", "text", "runs"])
    for batch in (whole, whole.slice(2, 20), whole.slice(0, 2), whole.slice(0, 0)):
        [got] = suffix_dedup._remove(True)(iter([batch]))
        [digests] = suffix_dedup._remove(False)(iter([batch]))
        assert digests.to_pylist() == got.select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).to_pylist()
        for row, was in zip(got.to_pylist(), batch.to_pylist()):
            data = was["text"].encode()
            gone = {k for r in was["runs"] or () for k in range(r["at"], r["at"] + r["size"])}
            borders = [k for k in range(len(data) + 1) if (k in gone) != (k - 1 in gone)]
            rest = bytes(x for k, x in enumerate(data) if k not in gone)
            want = (len(data), len(gone), len(borders) // 2, hashlib.sha256(rest).hexdigest(), rest, borders)
            assert tuple(row.values()) == (was["doc_id"], *want)
