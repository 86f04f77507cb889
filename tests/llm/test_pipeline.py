import zlib

import corpus_pipeline
from locusframe.llm import best_fit, decontaminate, toxicity
from locusframe.llm._common import id_and_text
from locusframe.llm.queries import id_remainder
from tests.llm.common import ODD, SCHEMA
from tests.llm.test_dedup import WS
from tests.llm.test_near_copies import slow_groups, slow_pairs

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, seen[-1], SF).write.parquet(out)
        seen.append(spark.read.parquet(out))
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:5]]
    assert all(d.columns == columns for d in seen[:5])
    # Toxicity: only labelled toxic documents may go here, and most of those with exact terms do.
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert not [d for d in gone if labels.get(d) == 0 and zlib.crc32(str(d).encode()) % 5]
    # All that score 0.5 or more go, and nothing else does; scores themselves are held against brute force elsewhere.
    texts, marks = id_and_text(docs, "doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(texts, marks, id_remainder(5) != 0)
    assert gone and gone == {r["doc_id"] for r in toxicity.score(texts, model).collect() if r["score"] >= 0.5}
    # Exact copies.
    best = {}
    for d, t in rows[1].items():
        key = WS.sub(" ", t or "")
        best[key] = min(d, best.get(key, d))
    assert set(rows[2]) == set(best.values())
    # Near copies.
    ids = sorted(rows[2])
    groups = slow_groups(len(ids), slow_pairs([rows[2][d] for d in ids]))
    assert set(rows[3]) == {ids[k] for k, g in enumerate(groups) if g == k} and len(rows[3]) < len(ids)
    # Benchmark items: every document is aligned with every item.
    bench = decontaminate.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 4)
    leaked = set()
    for d, t in rows[3].items():
        ids = bench.numbers(t or "")
        for words in bench.words:
            if len(ids) and len(set(words.tolist()) & set(ids.tolist())) > len(words) // 4:
                if decontaminate.align(words, ids)[0] >= 0.4 * 2 * len(words):
                    leaked.add(d)
    assert set(rows[4]) == set(rows[3]) - leaked
    # Packing: every document is there, once, in sequences that hold it.
    packed = seen[5].collect()
    assert {r["doc_id"] for r in packed} == set(rows[4])
    lengths = {}
    for r in packed:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    counts = {}
    for r in packed:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(lengths) == best_fit.plan(counts, 2048)[1]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, further columns with names used inside, no rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    text = "some words that stand in two rows without an id or with the same one"
    odd_space = (12, "words\u00a0with spaces of\u2003other kinds \u00a0", "en", "s", 1)
    rows = [(*r, k, "x") for k, r in enumerate([*ODD, (None, text, "en", "s", 1), (7, text, "en", "s", 1), (7, f"so: {item}", "en", "s", 1), (None, "clean words here", "en", "s", 1), odd_space])]
    df = spark.createDataFrame(rows, SCHEMA + ", __id long, row_file string")
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination"):
        out = stages[name](spark, df, SF)
        assert out.columns == df.columns and stages[name](spark, df.limit(0), SF).count() == 0
        got[name] = sorted(r["__id"] for r in out.collect())
    every = list(range(len(rows)))
    assert got["toxicity"] == every  # none of them is abuse
    assert got["exact dedup"] == [0, 1, 3, 5, 6, 8, 9, 10, 11] or got["exact dedup"] == [0, 2, 3, 5, 6, 8, 9, 10, 11]
    assert len(got["SimHash near-dedup"]) == 9 and {0, 5, 6, 8, 9, 10, 11} < set(got["SimHash near-dedup"])
    assert got["benchmark decontamination"] == [k for k in every if k != 9]
    packed = stages["best-fit packing"](spark, df, SF)
    assert packed.where("piece = 0").count() == len(rows)
