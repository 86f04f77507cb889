import random
import re

import numpy as np
import pytest

from locusframe.llm import near_copies
from tests.llm.common import ODD, SCHEMA, documents

SF = "/root/testdata"


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def slow_pairs(texts):
    """All pairs of positions in ``texts`` of Jaccard 0.8 or more, by an exact index: a pair must share a shingle."""
    sets = [slow_shingles(t) for t in texts]
    counts = {}
    for s in sets:
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    index, pairs = {}, []
    for k, s in enumerate(sets):
        # Of sets with Jaccard 0.8, one of any fifth of the shingles and one more is shared; the rarest are looked up.
        rare = sorted(s, key=lambda x: (counts[x], x))[: len(s) // 5 + 1] if s else [()]
        for j in {j for x in rare for j in index.get(x, ())}:
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                pairs.append((j, k))
        for x in rare:
            index.setdefault(x, []).append(k)
    return pairs


def slow_groups(n, pairs):
    of = list(range(n))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        of[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = documents(seed, 150)
    texts = [r[1] for r in rows]
    sets = [slow_shingles(t) for t in texts]
    every = [(j, k) for k in range(len(sets)) for j in range(k) if similarity(sets[j], sets[k]) >= 0.8]
    assert slow_groups(len(sets), every) == slow_groups(len(sets), slow_pairs(texts))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k for k, g in enumerate(slow_groups(len(sets), every)) if g == k}
    assert {r["doc_id"] for r in near_copies.keep_one_of_each(df).collect()} == want
    # Every list is long, every cluster is dealt into many parts: the same documents.
    got = near_copies.keep_one_of_each(df, list_rows=1, part_bytes=500, part_rows=4)
    assert {r["doc_id"] for r in got.collect()} == want


def edited(rnd, words, share):
    return " ".join(rnd.choice("abcdefgh") * 9 if rnd.random() < share else w for w in words)


def test_large_group_of_near_copies(spark):
    """Copies of one text with changes of their own, beyond a list and a part; some similar to others only over a third one."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(150)]
    texts = [edited(rnd, words, 0.02) for _ in range(300)] + [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(50)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    want = {k for k, g in enumerate(slow_groups(len(texts), slow_pairs(texts))) if g == k}
    got = near_copies.keep_one_of_each(df, list_rows=50, part_rows=64)
    assert {r["doc_id"] for r in got.collect()} == want


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_tables(spark, scale):
    docs = spark.read.parquet(f"{SF}/{scale}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    groups = slow_groups(len(rows), slow_pairs([t for _, t in rows]))
    want = {rows[k][0] for k, g in enumerate(groups) if g == k}
    kept = {r["doc_id"] for r in near_copies.keep_one_of_each(docs).select("doc_id").collect()}
    assert want <= kept and len(kept - want) <= 0.1 * (len(rows) - len(want))


def test_bytes_agree_as_often_as_shingles():
    rnd = np.random.default_rng(3)
    shares = []
    for _ in range(50):
        a = rnd.integers(0, 2**63, 900).astype(np.uint64)
        b = np.concatenate([a[:800], rnd.integers(0, 2**63, 100).astype(np.uint64)])
        x, y = (np.frombuffer(near_copies.positional_bytes(np.unique(s)), np.uint8) for s in (a, b))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.8) < 0.03


def test_odd_rows(spark):
    rows = [(*r, k, "x") for k, r in enumerate([*ODD, (None, "SOME words  without an id that are long enough to count here", "", "", 1)])]
    df = spark.createDataFrame(rows, SCHEMA + ", print long, row_file string")
    out = near_copies.keep_one_of_each(df)
    assert out.columns == df.columns and df.limit(0).count() == near_copies.keep_one_of_each(df.limit(0)).count()
    got = sorted(r["print"] for r in out.collect())
    assert len(got) == 5 and set(got) & {0, 7} and set(got) & {1, 2} and set(got) & {3, 4} and {5, 6} < set(got)
