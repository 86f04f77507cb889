import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm import best_fit, decontaminate, language_id, sharding, token_counts, toxicity, url_filter
from locusframe.llm.queries import END_OF_TEXT, ORACLE_SQL, QUERIES, URL_RULES, id_remainder, tokenizer_path
from locusframe.llm.tokens import WordEncoder
from tests.compare import of_duckdb, of_spark
from tests.llm.common import ODD, SCHEMA, documents


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duckdb(ORACLE_SQL[name], sf_dir)


# URLs --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.org/x", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"),
        ("http://www.EXAMPLE.org/en/17?x", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"),
        ("http://badexample.org/es/1", "org/", "allow"), ("http://x.com/fr/", "com/fr/", "allow"), ("http://com/de/a", "com/de/", "block"),
        ("http://x.com/fr", None, "allow"), ("http://org", None, "allow"), ("http://x.net/de/", None, "allow"), (None, None, "allow"),
        ("x.org/", None, "allow"), ("", None, "allow"), ("a://", None, "allow"), ("a://b.org:80/", None, "allow"), ("://q.org/a\nb", "org/", "allow"),
    ],
)
def test_url_rules(spark, url, rule, verdict):
    got = url_filter.judge_urls(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string"), URL_RULES).first()
    assert (got["rule"], got["verdict"]) == (rule, verdict)


def test_urls_against_brute_force():
    rnd = random.Random(3)
    host = lambda: ".".join(rnd.choice(["a", "b", "c"]) for _ in range(rnd.randint(1, 3)))
    path = lambda: "".join(rnd.choice(["/", "x", "y", "/xy"]) for _ in range(rnd.randint(0, 4)))
    for _ in range(100):
        rules = [(rnd.choice(["allow", "block"]), host(), rnd.choice(["", "/" + path()])) for _ in range(12)]
        trie = url_filter.build_trie(rules)
        for _ in range(30):
            h, p = host(), rnd.choice(["", "/" + path()])
            fits = [(len(rh), len(rp), v == "block", v, rh + rp) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
            want = max(fits) if fits else None
            assert url_filter.match(trie, h, p) == (want and (want[4], want[3]))


def test_url_edges(spark):
    df = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(df, URL_RULES).count() == 3
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError, match="not broadcast"):
        url_filter.judge_urls(df, URL_RULES, max_rules=2)
    with pytest.raises(ValueError, match="not broadcast"):
        url_filter.judge_urls(df, URL_RULES, max_bytes=20)


# Packing and tokens ------------------------------------------------------------------------------------------------------------


def unpack(counts, capacity):
    runs, n = best_fit.plan(counts, capacity)
    bins = {k: [] for k in range(n)}
    for size, rr in runs.items():
        rank = 0
        for first, m, sequence, each, offset in rr:
            assert first == rank
            rank += m
            for k in range(m):
                bins[sequence + k // each].append((offset + k % each * size, size))
        assert rank == counts[size]
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert 0 < at <= capacity
    return n


def best_fit_decreasing(items, capacity):
    gaps = []
    for x in sorted(items, reverse=True):
        fits = [g for g in gaps if g >= x]
        g = min(fits) if fits else capacity
        if fits:
            gaps.remove(g)
        gaps.append(g - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_a_packing_and_no_worse_than_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 50, 200])
    items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 300))]
    counts = {s: items.count(s) for s in set(items)}
    assert -(-sum(items) // capacity) <= unpack(counts, capacity) <= best_fit_decreasing(items, capacity)


def test_plan_against_optimum():
    from functools import lru_cache

    rnd = random.Random(11)
    for _ in range(40):
        capacity = 12
        items = tuple(sorted((rnd.randint(1, 12) for _ in range(9)), reverse=True))

        @lru_cache(None)
        def fewest(left, gaps):
            if not left:
                return len(gaps)
            x, rest = left[0], left[1:]
            options = [fewest(rest, tuple(sorted((*gaps, capacity - x))))]
            for k in range(len(gaps)):
                if gaps[k] >= x:
                    options.append(fewest(rest, tuple(sorted((*gaps[:k], gaps[k] - x, *gaps[k + 1 :])))))
            return min(options)

        counts = {s: items.count(s) for s in set(items)}
        assert unpack(counts, capacity) <= fewest(items, ()) + 1
        left = best_fit._Counts(counts)
        first = max(items)
        fixed = best_fit._dominating(left, first, capacity)
        if fixed is not None:  # what is fixed can't cost a sequence
            rest = list(items)
            for s in (first, *fixed):
                rest.remove(s)
            assert fewest(tuple(rest), ()) + 1 == fewest(items, ())


def test_plan_does_not_depend_on_the_number_of_documents():
    rnd = random.Random(2)
    counts = {s: rnd.randint(1, 10**9) for s in range(1, 2049)}
    runs, n = best_fit.plan(counts, 2048)
    assert sum(map(len, runs.values())) < 20_000 and n >= sum(s * c for s, c in counts.items()) / 2048


def token_rows(n=80):
    rows = [(d, t) for d, t, *_ in documents(5, n)]
    special = ["A<|endoftext|>b, x", "İ. ﬁ, ẞ. it's, DON'T 1.5, a. b,", "\u00a0x\u2003y", "word " * 5000, "a\x1cb"]
    return rows + [(500 + k, t) for k, t in enumerate(special)]


def test_word_encoder_is_the_tokenizer():
    for special in (False, True):
        encoder = WordEncoder(tokenizer_path(), special)
        texts = [t or "" for _, t in token_rows(200)]
        assert encoder.by_word
        for text, ids in zip(texts, encoder.encode_all([t.encode() for t in texts])):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_read_whole_texts():
    encoder = WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not encoder.by_word
    assert encoder.encode_all([b"Two  words."])[0].tolist() == encoder.tokenizer.encode("Two  words.", add_special_tokens=False).ids


def test_pack_round_trip(spark):
    rows = token_rows()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = best_fit.pack(df, tokenizer_path(), 256).collect()
    want = {}
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            want[d, k] = (at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= best_fit_decreasing([v[1] for v in want.values()], 256)


def test_token_counts_round_trip(spark):
    rows = token_rows()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (16, 1000, 1 << 20):
        got = token_counts.document_token_counts(df, tokenizer_path(), END_OF_TEXT, block_bytes=block).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want


def test_token_counts_of_rows_in_no_order_and_of_many_small_files(spark):
    rows = [(k, "word " * (k % 90)) for k in range(500)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).orderBy(F.rand())
    most = "spark.sql.files.maxRecordsPerFile"
    for records in (0, 100):
        spark.conf.set(most, records)
        try:
            got = token_counts.document_token_counts(df, tokenizer_path(), END_OF_TEXT)
            got = [(r["doc_id"], r["n_tokens"]) for r in got.collect()]
        finally:
            spark.conf.unset(most)
        assert len(got) == 500 and dict(got) == want


@pytest.mark.parametrize("dtype, end_id", [("<u2", 0), ("<u2", 257), ("<u4", 258)])
def test_blocks_of_any_size_and_alignment(spark, tmp_path, dtype, end_id):
    """Ids from few bytes, so that the end id also stands across ids; blocks are Spark's splits, of a few bytes here."""
    rnd = np.random.default_rng(end_id)
    want = {}
    for k, n in enumerate([0, 1, 2, 30, 130]):
        ids = rnd.choice([0, 1, 2, 256, 257, 258, 512, 513, 514, 49407, 65472, end_id, end_id], n).astype(dtype)
        (tmp_path / f"part-{k:05}.bin").write_bytes(ids.tobytes())
        ends = [-1, *np.flatnonzero(ids == end_id).tolist()]
        counts = [(b - a - 1, True) for a, b in zip(ends, ends[1:])] + [(n - ends[-1] - 1, False)]
        for place, found in enumerate(counts):
            if found != (0, False):
                want[k, place] = found
    sizes = {"spark.sql.files.maxPartitionBytes": "41", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = token_counts.count_tokens(spark, str(tmp_path), end_id, dtype, 64, "*.bin").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(int(r["path"][-9:-4]), r["document"]): (r["n_tokens"], r["ended"]) for r in got} == want and len(got) == len(want)


def test_a_file_that_ends_within_an_id(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\x05\x00\x09\x00\x07")
    with pytest.raises(Exception, match="ends within an id"):
        token_counts.count_tokens(spark, str(tmp_path), 9).collect()


def test_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "id_width", lambda path: "<u4")
    rows = token_rows(20)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    got = token_counts.document_token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), END_OF_TEXT)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows}


def test_token_counts_when_the_split_changes(spark, monkeypatch):
    from locusframe.llm._common import stored

    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)

    def write(*args, real=token_counts.write_token_files):
        real(*args)
        spark.conf.set(size, "2k")  # as after the loss of executors: other splits than when the files were written

    monkeypatch.setattr(token_counts, "write_token_files", write)
    df = stored(spark.createDataFrame([(k, "word " * k) for k in range(400)], "doc_id long, text string").repartition(40), "test")
    want = {k: len(Tokenizer.from_file(tokenizer_path()).encode("word " * k, add_special_tokens=False).ids) for k in range(400)}
    try:
        got = token_counts.document_token_counts(df, tokenizer_path(), END_OF_TEXT).collect()
    finally:
        spark.conf.set(size, before)
    assert len(got) == 400 and {r["doc_id"]: r["n_tokens"] for r in got} == want


def test_flat_files_without_a_last_end(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 7, 7, 9, 1], "<u2")
    (tmp_path / "part-00000-x.txt").write_bytes(ids.tobytes())
    (tmp_path / "part-00001-x.txt").write_bytes(b"")
    for block in (1, 2, 3, 100):
        got = token_counts.count_tokens(spark, str(tmp_path), 9, block_bytes=block).orderBy("document").collect()
        assert [(r["document"], r["n_tokens"], r["ended"]) for r in got] == [(0, 2, True), (1, 0, True), (2, 3, True), (3, 1, False)]


def test_packing_and_counts_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    packed = best_fit.pack(df, tokenizer_path())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("piece = 0").count() == len(ODD)
    assert token_counts.document_token_counts(df, tokenizer_path(), END_OF_TEXT).count() == len(ODD)
    empty = spark.createDataFrame([], SCHEMA)
    assert best_fit.pack(empty, tokenizer_path()).count() == 0
    assert token_counts.document_token_counts(empty, tokenizer_path(), END_OF_TEXT).count() == 0


# Learned operators -------------------------------------------------------------------------------------------------------------


def test_levenshtein_automata_against_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
            row = new
        return row[-1]

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 8)))
    for _ in range(40):
        lexicon = toxicity.Lexicon({word(): rnd.random() for _ in range(20)})
        for _ in range(60):
            x = word()
            near = [t for t in lexicon.weights if t == x] or [t for t in lexicon.weights if len(t) >= 5 and len(x) >= 4 and distance(t, x) <= 1]
            got = lexicon.near(x)
            assert (got and got[0]) == (max(near, key=lambda t: (lexicon.weights[t], t)) if near else None)


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader(toxicity.Lexicon({"scumbag": 2.0}))
    plain, quoted = reader.features("you are a scumbag indeed"), reader.features('they wrote "you are a scumbag" there')
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0
    misspelled = reader.features("what a scumbga, or scumbg!")
    assert misspelled[0] == 0 and misspelled[1] > 0
    assert reader.features("nothing here") is None and reader.features("") is None


def slow_features(text, weights):
    """Features by hand: each word is compared with all terms."""

    def close(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
            row = new
        return row[-1] <= 1

    found, quoted, place = [], 0, 0
    for raw in text.lower().split():
        quoted += raw[0] in toxicity._OPEN
        for w in toxicity.words_of(raw):
            w = w.decode()
            near = [w] if w in weights else [t for t in weights if len(t) >= 5 and len(w) >= 4 and close(t, w)]
            if near:
                term = max(near, key=lambda t: (weights[t], t))
                found.append((place, term, w in weights, quoted > 0))
            place += 1
        end = raw.rstrip(".,;:!?")[-1:]
        if end and end in toxicity._CLOSE or len(raw) > 1 and raw[-1] in toxicity._CLOSE:
            quoted = max(0, quoted - 1)
    if not found:
        return [0.0] * 7
    total = lambda keep: sum(weights[t] for _, t, exact, q in found if keep(exact, q))
    crowd = max(sum(abs(a - b) <= 8 for b, *_ in found) for a, *_ in found)
    return [
        np.log1p(total(lambda e, q: e and not q)), np.log1p(total(lambda e, q: not e and not q)), np.log1p(total(lambda e, q: q)),
        max([weights[t] for _, t, e, q in found if e and not q], default=0.0), np.log1p(len({t for _, t, e, _ in found if e})),
        np.log(crowd), len(found) / np.sqrt(place),
    ]


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MEMORY_BYTES", 4000)  # so that words are forgotten
    rnd = random.Random(7)
    weights = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 7))): rnd.random() * 5 for _ in range(25)}
    marks = ["{}", "{}", "{}", '"{}', '{}"', "({})", "{}.", "«{}", "{}!»"]
    word = lambda: rnd.choice([*weights, "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8)))])
    texts = [" ".join(rnd.choice(marks).format(word()) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    model = toxicity.Model(toxicity.Lexicon(weights), np.array([0.4, 0.2, -0.6, 0.1, 0.3, -0.2, 0.5, -1.1]))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(df, model).collect()}
    for k, t in enumerate(texts):
        want = 1 / (1 + np.exp(-(np.dot(slow_features(t, weights), model.coefficients[:-1]) + model.coefficients[-1])))
        assert abs(got[k][0] - want) < 1e-9 and got[k][1] == (want >= 0.5)


def test_scores_do_not_depend_on_spaces_or_neighbours(spark):
    """White space of any kind ends a word, and the other texts of a task change nothing."""
    rnd = random.Random(9)
    weights = {"vileword": 3.0, "nasty": 2.0, "abcd": 1.0}
    spaces = [" ", "\u00a0", "\u2003", "\x1c", "\x85", "\n", "\u3000", " \u00a0"]
    word = lambda: rnd.choice(["hello", "there", "vileword", "vilewrd", "nasty", "\"nasty", "nasty\"", "(abcd)", "\u00c9t\u00e9", "-"])
    texts = ["hello vileword\u00a0 there", "a vileword b", "\u00a0", "\u00a0vileword"]
    texts += ["".join(word() + rnd.choice(spaces) for _ in range(rnd.randint(0, 12))) for _ in range(80)]
    model = toxicity.Model(toxicity.Lexicon(weights), np.array([0.4, 0.2, -0.6, 0.1, 0.3, -0.2, 0.5, -1.1]))
    for parts in (1, 7, 40):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
        for k, t in enumerate(texts):
            want = 1 / (1 + np.exp(-(np.dot(slow_features(t, weights), model.coefficients[:-1]) + model.coefficients[-1])))
            assert abs(got[k] - want) < 1e-9, t
    odd = spark.sql("SELECT 1L AS doc_id, cast(unhex('FF20') AS string) || 'vileword' AS text")
    assert toxicity.score(odd, model).count() == 1


def test_toxicity_held_out(spark):
    found = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    right, toxic, said = (sum(f(r) for r in rows) for f in (lambda r: r["predicted"] * r["toxic"], lambda r: r["toxic"], lambda r: r["predicted"]))
    assert 0 < toxic < len(rows) / 2 and right >= 0.9 * toxic and right >= 0.9 * said
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_frequent_terms_in_set_phrases_are_learned_and_copies_once(spark):
    rnd = random.Random(3)
    filler = lambda: [f"w{rnd.randrange(400)}" for _ in range(30)]
    docs = [(k, filler(), 0) for k in range(300)]
    docs += [(1000 + k, [*filler(), "abc"[k % 3] * 3, "insultum", *filler()], 1) for k in range(200)]
    docs += [(2000 + k, ["copied", "words", "insultum", "only", "here"], 1) for k in range(300)]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t, _ in docs], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, toxic int")
    words, totals = toxicity._word_counts(toxicity._sample(df, labels, F.lit(True), 20_000))
    assert words["insultum"][[1, 3]].sum() == 201 and totals[[1, 3]].sum() == 201
    assert "insultum" in toxicity.learn(df, labels, F.lit(True)).lexicon.weights
    assert not {"copied", "words", "only", "here"} & set(words)


def test_toxicity_edges(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(7, 1), (7, None), (-3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(df, labels).count() == len(ODD)
    none = toxicity.toxicity(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.drop_toxic(df, labels.limit(0)).collect() == df.collect()
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_language_held_out(spark):
    found = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97


def test_languages_against_plain_compression(spark):
    """Sizes under each dictionary by calls of the library; the smallest wins, the first of equals, and the lead is its share."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    samples = language_id.dictionaries(docs, train)
    params = zstandard.ZstdCompressionParameters.from_level(7, write_content_size=False, write_dict_id=False)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in language_id.identify(docs, train, margin=0.02).collect()}
    for d, text in rows.items():
        words = {}
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            words.setdefault(w)
        if not words:
            assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0
            continue
        data = (" ".join(words) + " ").encode()
        sizes = []
        for _, _, raw in samples:
            book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=7)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=book, compression_params=params).compress(data)))
        first, second = sorted(sizes)[:2]
        lead = (second - first) / second
        assert got[d]["lang_pred"] == samples[sizes.index(first)][0]
        assert abs(got[d]["score"] - min(1, 0.5 + 2 * lead)) < 1e-12 and got[d]["rejected"] == (lead < 0.02)


def test_language_edges(spark):
    texts = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de"), (3, None, "en"), (4, "12 34 !?", "de"), (5, "", None),
             (None, "and the house", None), (6, "und das haus", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True)).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 6: "de"}
    assert {r["lang_pred"] for r in language_id.identify(df, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0
    assert language_id.identify(spark.createDataFrame(ODD, SCHEMA), F.lit(True)).count() == len(ODD)


def test_a_language_of_long_texts_only(spark):
    rows = [(1, "the house and the garden " * 400, "en"), (2, "das haus und der garten " * 400, "de"), (3, "und das haus", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, F.lit(True), sample_bytes=2000).collect()} == {1: "en", 2: "de", 3: "de"}
    with pytest.raises(ValueError, match="languages"):
        language_id.dictionaries(df, F.lit(True), max_languages=1)


# Sharding ----------------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = documents(9, 400) + [(5000, "y" * 3000, "en", "s", 0)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    load, slots = [0] * 4, [[] for _ in range(4)]
    text = {d: (t or "").encode() for d, t, *_ in rows}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(load) - min(load) <= 50
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sharding.shard_by_bytes(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_slot_maps():
    rnd = random.Random(4)
    sizes = [rnd.randint(0, 1000) for _ in range(512)]
    old = sharding.initial_map(512, 8)
    new = sharding.rebalanced(old, sizes, 8)
    load = [sum(s for s, k in zip(sizes, new) if k == shard) for shard in range(8)]
    assert max(load) - min(load) <= 2 and sum(a != b for a, b in zip(old, new)) < 300
    more = sharding.grown(new, 8)
    assert all(b in (a, 8) for a, b in zip(new, more)) and more.count(8) == 512 // 9


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k if k % 3 else None, lambda k: k])
def test_shards_against_brute_force(spark, ids):
    """Whatever the ids: sizes, checksums and places by hand, and shards of nearly equal bytes."""
    rnd = random.Random(5)
    texts = [rnd.choice([None, "", "é" * rnd.randint(1, 300), "x" * rnd.randint(1, 2000)]) for _ in range(1000)]
    rows = [(ids(k), t, k) for k, t in enumerate(texts)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(3), 16).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    load, places = [0] * 16, [[] for _ in range(16)]
    for r in got:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(load) - min(load) <= 2000 and all(sorted(p) == list(range(len(p))) for p in places)


def test_a_map_is_edited(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(900)], "doc_id long, text string")
    more = docs.union(spark.createDataFrame([(2000 + k, "y" * 40) for k in range(90)] + [(None, "z" * 3000)] * 30, "doc_id long, text string"))
    path = str(tmp_path / "map")
    sizes = {(s, 0): 1 for s in range(64)}
    sharding.map_table(spark, 0, sorted(sizes), sharding.initial_map(64, 4), [1] * 64).write.partitionBy("version").parquet(path)
    one = sharding.shard_by_bytes(docs, 4, n_slots=64, map_path=path).collect()
    again = sharding.shard_by_bytes(docs, 4, n_slots=64, map_path=path).collect()
    assert {(r["doc_id"], r["shard"]) for r in one} == {(r["doc_id"], r["shard"]) for r in again}  # nothing to move
    assert {r["map_version"] for r in again} == {2}
    five = sharding.shard_by_bytes(more, 5, n_slots=64, map_path=path).collect()
    load = [sum(r["size"] for r in five if r["shard"] == k) for k in range(5)]
    assert len(five) == 1020 and max(load) - min(load) <= 3200
    steps = {r["version"]: (r["moved_slots"], r["moved_bytes"]) for r in sharding.moved(spark, path).collect()}
    assert set(steps) == {1, 2, 3} and steps[2] == (0, 0) and steps[3][0] >= 64 // 5
    stay = {r["doc_id"]: r["shard"] for r in five}
    assert sum(stay[r["doc_id"]] == r["shard"] for r in one) > 300
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_by_bytes(docs, 5, n_slots=32, map_path=path)
    with pytest.raises(ValueError, match="shards"):
        sharding.shard_by_bytes(docs, 2, n_slots=64, map_path=path)


# Decontamination ---------------------------------------------------------------------------------------------------------------


def slow_alignment(a, b):
    best, table = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment_equals_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        a = np.array([rnd.randrange(4) for _ in range(rnd.randint(1, 12))])
        b = np.array([rnd.randrange(5) - 1 for _ in range(rnd.randint(1, 20))])
        score, low, high = decontaminate.align(a, b)
        assert score == slow_alignment(a, b)
        if score:
            assert slow_alignment(a, b[low:high]) == score


def test_leaks_are_found_and_clean_documents_stay(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(12)] + [(90, "three short words"), (91, None), (92, "")]
    filler = lambda: " ".join(word() for _ in range(60))
    docs, want = [], set()
    for k in range(60):
        body, item = filler(), items[k % 12]
        if k % 3 == 0:  # a copy, edited every ninth word, in capitals, with other punctuation
            words = [w if n % 9 else word() for n, w in enumerate(item[1].split(), 1)]
            body += " " + ", ".join(words).upper() + " " + filler()
            want.add((k, item[0]))
        docs.append((k, body))
    docs += [(900, "here: Three, short words!"), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 900):
        got = decontaminate.contaminated(df, bench, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(900, 90)}
        span = [r for r in got if r["doc_id"] == 0][0]
        assert 58 <= span["first_word"] <= 62 and 98 <= span["end_word"] <= 102
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.count() == len(docs) - len(want) - 1 and kept.columns == df.columns
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(ODD, SCHEMA), bench).count() == 0


def test_frequent_leak_is_still_a_leak(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(k, f"start {k} {passage} end") for k in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontaminate.contaminated(df, bench).count() == 50


def test_edited_half_and_parted_copies_are_leaks(spark):
    items = [[f"i{k}w{n}" for n in range(40)] for k in range(6)] + [[f"long{n}" for n in range(100)]]
    docs = [(k, [w if n % (5 + k) else "edit" for n, w in enumerate(items[k], 1)]) for k in range(3)]  # every 5th, 6th, 7th word
    docs += [(10 + k, items[3][:20]) for k in range(200)]  # the same half in many documents
    docs += [(300, items[4]), (301, items[4][:16]), (302, items[4][:15])]  # 0.375 is too little
    docs += [(400 + k, items[5]) for k in range(5)] + [(410, items[5][10:30])]  # a rarer, shorter copy
    docs += [(500, items[6][:42] + ["x"] * 60 + items[6][58:])]  # each part alone scores 0.42, both 0.54
    df = spark.createDataFrame([(d, " ".join(["a", *t, "z"])) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, bench).collect()}
    want = {(0, 0), (1, 1), (2, 2), (300, 4), (301, 4), (410, 5), (500, 6)}
    assert set(got) == want | {(10 + k, 3) for k in range(200)} | {(400 + k, 5) for k in range(5)}
    assert got[500, 6] == (2 * 84 - 60) / 200


def test_an_n_gram_that_many_items_share(spark):
    """Items with a common phrase: the result is that of all items aligned with all documents that share an n-gram."""
    rnd = random.Random(12)
    phrase = "answer the following question with yes or no".split()
    items = [[*phrase, *(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(4, 20)))] for _ in range(300)]
    docs = [[*phrase, *(f"w{rnd.randrange(60)}" for _ in range(25))] for _ in range(20)]
    docs += [[f"x{k}", *items[k][:3], "edit", *items[k][4:], *phrase] for k in range(20)]
    found = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(items)], 4, most_items=5)
    assert found.common_grams.any()
    gram = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    for d in docs:
        ids = found.numbers(" ".join(d))
        want = {k for k, w in enumerate(items) if gram(w) & gram(d) and decontaminate.align(found.words[k], ids)[0] >= 0.8 * len(w)}
        assert {m[0] for m in found.matches(" ".join(d))} == want and (d[0][0] != "x" or int(d[0][1:]) in want)


def test_decontamination_of_rows_without_or_with_equal_ids(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, item, 1), (None, "clean", 2), (9, f"a {item}", 3), (9, "clean", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long")
    bench = spark.createDataFrame([(1, item), (2, item + " more")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(df, bench)
    assert sorted(r["__id"] for r in kept.collect()) == [2, 4] and kept.columns == df.columns
    with pytest.raises(ValueError, match="not broadcast"):
        decontaminate.drop_contaminated(df, bench, block_bytes=10)


def test_remainder(spark):
    df = spark.createDataFrame([(k,) for k in range(50)], "doc_id long")
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in df.select("doc_id", id_remainder(5).alias("m")).collect())
