import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from locusframe.llm import near_copies, simhash_copies
from locusframe.llm._common import addressable, stored
from tests.llm.common import SCHEMA, documents
from tests.llm.test_near_copies import SF, edited, slow_groups, slow_pairs


def first_of_slow_groups(texts):
    return {k for k, g in enumerate(slow_groups(len(texts), slow_pairs(texts))) if g == k}


def test_fingerprint_is_the_majority_of_the_bits():
    rnd = random.Random(4)
    mask = 2**64 - 1

    def expanded(h):
        out = b""
        for k in range(1, 17):
            x = (h + k * 0x9E3779B97F4A7C15) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            out += (x ^ x >> 31).to_bytes(8, "little")
        return int.from_bytes(out, "big")

    for n in (0, 1, 2, 3, 254, 255, 256, 700):
        hashes = [rnd.randrange(2**64) for _ in range(n)]
        wide = [expanded(h) for h in hashes]
        bits = sum(1 << b for b in range(1024) if 2 * sum(w >> b & 1 for w in wide) > n)
        assert simhash_copies.simhash(np.array(hashes, np.uint64)) == bits.to_bytes(128, "big")


def test_the_stage_gets_its_rows_through_simhash(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words).upper(), "another text that stands by itself"]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, df, f"{SF}/sf0.001").collect()} == {0, 3}
    # Fingerprints that say nothing of their texts leave near copies where they are; only equal sets of shingles are one.
    monkeypatch.setattr(simhash_copies, "simhash", lambda s: hashlib.shake_128(s.tobytes()).digest(128))
    assert {r["doc_id"] for r in stage(spark, df, f"{SF}/sf0.001").collect()} == {0, 1, 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = documents(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    want = first_of_slow_groups([r[1] for r in rows])
    assert {r["doc_id"] for r in simhash_copies.keep_one_of_each(df).collect()} == want
    # Every list is long, every cluster is dealt into many parts: the same documents.
    got = simhash_copies.keep_one_of_each(df, list_rows=1, part_bytes=500, part_rows=4)
    assert {r["doc_id"] for r in got.collect()} == want
    # Postings of three bytes reach nearly all pairs of exactly 0.8.
    got = {r["doc_id"] for r in simhash_copies.keep_one_of_each(df, posting_bytes=3).collect()}
    assert want <= got and len(got - want) <= 1


@pytest.mark.parametrize("list_rows", [50, 1024])
def test_large_group_of_near_copies(spark, list_rows):
    """Copies of one text with changes of their own, in lists within and beyond the limit, and beyond a part."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(150)]
    texts = [edited(rnd, words, 0.02) for _ in range(300)] + [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(50)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    got = simhash_copies.keep_one_of_each(df, list_rows=list_rows, part_rows=64)
    assert {r["doc_id"] for r in got.collect()} == first_of_slow_groups(texts)


@pytest.mark.parametrize("list_rows", [50, 1024])
def test_links_of_a_large_group_are_few(spark, list_rows):
    """One group, 96 lists of each member: about a link for each member, not one for each list; the same where parts meet."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(150)]
    rows = [(k, edited(rnd, words, 0.02), "en", "s", 1) for k in range(400)]
    docs = addressable(spark.createDataFrame(rows, SCHEMA))
    _, nodes = near_copies.set_nodes(docs, "doc_id", "text", 5, simhash_copies.simhash)
    links = stored(simhash_copies.candidate_links(nodes, list_rows=list_rows), "links")
    verified = near_copies.verified_links(docs, nodes, links, "doc_id", "text", 5, 80, 1 << 20, 20, simhash_copies.LEAST_SHARED)
    members = nodes.count()
    assert members > 300 and members - 1 <= links.count() < 3 * members
    assert verified.count() < 3 * members


def test_links_in_lists_connect_what_all_pairs_connect():
    rnd = np.random.default_rng(8)
    n = 400
    lists, sizes = np.sort(rnd.integers(0, 12, n)), rnd.integers(50, 90, n)
    order = np.lexsort((sizes, lists))
    lists, sizes = lists[order], sizes[order]
    heads = rnd.integers(0, 2**63, (5, 2)).astype(np.uint64)[rnd.integers(0, 5, n)]
    for _ in range(20):
        heads = heads ^ (np.uint64(1) << rnd.integers(0, 64, (n, 2)).astype(np.uint64))
    close = lambda a, b: np.bitwise_count(heads[a] ^ heads[b]).sum() <= simhash_copies.MOST_BITS
    every = [(a, b) for b in range(n) for a in range(b) if lists[a] == lists[b] and 100 * sizes[a] >= 80 * sizes[b] and close(a, b)]
    a, b = simhash_copies.close_in_lists(lists, sizes, heads, 80)
    found = set(zip(a.tolist(), b.tolist()))
    assert 0 < len(found) < len(every) and found <= set(every)
    assert slow_groups(n, sorted(found)) == slow_groups(n, every)


def test_bits_agree_as_the_angle_between_sets_says():
    """Jaccard 0.8 is a cosine of 8/9, of which a bit in 6.6 differs; those pass the filters, unrelated sets do not."""
    rnd = np.random.default_rng(3)
    shares, passed = [], 0
    for _ in range(100):
        a = rnd.integers(0, 2**63, 900).astype(np.uint64)
        b = np.concatenate([a[:800], rnd.integers(0, 2**63, 100).astype(np.uint64)])
        x, y, z = (np.frombuffer(simhash_copies.simhash(s), np.uint8) for s in (a, b, ~a))
        shares.append(np.bitwise_count(x ^ y).sum() / 1024)
        passed += np.bitwise_count(x[:16] ^ y[:16]).sum() <= simhash_copies.MOST_BITS and (x == y).sum() >= simhash_copies.LEAST_SHARED
        assert np.bitwise_count(x[:16] ^ z[:16]).sum() > simhash_copies.MOST_BITS
    assert abs(np.mean(shares) - np.arccos(8 / 9) / np.pi) < 0.01 and passed == 100


@pytest.mark.parametrize("width", [2, 3, 4])
def test_postings_reach_similar_sets(width):
    rnd = np.random.default_rng(width)
    positions = np.array(simhash_copies.posting_positions(width))
    assert positions.shape == (simhash_copies.POSTINGS[width], width) and len({*positions.flat}) == 128
    met = 0
    for _ in range(300):
        a = rnd.integers(0, 2**63, 90).astype(np.uint64)
        x, y = (np.frombuffer(simhash_copies.simhash(s), np.uint8) for s in (a, np.concatenate([a[:80], rnd.integers(0, 2**63, 10).astype(np.uint64)])))
        met += (x == y)[positions].all(axis=1).any()
    assert met >= 0.97 * 300
    assert [simhash_copies.posting_width(n) for n in (0, 1 << 24, (1 << 24) + 1, (1 << 32) + 1)] == [2, 2, 3, 4]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_tables(spark, scale):
    docs = spark.read.parquet(f"{SF}/{scale}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = {rows[k][0] for k in first_of_slow_groups([t for _, t in rows])}
    assert {r["doc_id"] for r in simhash_copies.keep_one_of_each(docs).select("doc_id").collect()} == want
