"""The registered queries ``opN_<name>`` of this subpackage, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.best_fit import pack
from locusframe.llm.decontaminate import contaminated
from locusframe.llm.exact_dedup import exact_duplicates
from locusframe.llm.filter_audit import filter_audit
from locusframe.llm.html_text import extract_text
from locusframe.llm.language_id import identify
from locusframe.llm.prefix_trie import prefix_trie
from locusframe.llm.sharding import shard_by_bytes
from locusframe.llm.simhash import near_duplicates
from locusframe.llm.suffix_dedup import remove_repeats
from locusframe.llm.token_counts import document_token_counts
from locusframe.llm.toxicity import toxicity
from locusframe.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(k: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % k


#: The rules that the contract fixes.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, with_text=False)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary file is on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


#: <|endoftext|> of the vocabulary.
END_OF_TEXT = 49407


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(5) == 0
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(4) == 2
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: On the given tables, whose pages have one article each, flat blocks in it, and few character references.
OP11_SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g') AS x FROM pages),
block AS (
  SELECT page_id, url, list_transform(string_split_regex(x, '<[^>]*>'), lambda b: trim(regexp_replace(
    regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM article)
SELECT page_id, url, t AS text, CAST(length(t) AS bigint) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), ' ') AS t FROM block)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Conversations borrow 0 to 3 turns from the one whose id is the multiple of 20 before theirs.
    base, borrowed = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4
    return prefix_trie(table(spark, sf_dir, "conversations"), base=base, borrowed=borrowed, most_borrowed=3)


#: CRC-32 of a decimal number modulo 4, four bits at a time; the 16 values are fixed by the polynomial.
_CRC_MOD_4 = """
  xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(CAST({c} AS varchar), ''), lambda x: [ascii(x) & 15, ascii(x) >> 4]))),
    lambda crc, x: xor(crc >> 4, ([
      0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::bigint[])[(xor(crc, x) & 15) + 1]))) % 4"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(digest ORDER BY turn NULLS FIRST, digest) AS ds, list(words ORDER BY turn NULLS FIRST, digest) AS ws FROM t GROUP BY c),
h AS (
  SELECT *, c - c % 20 AS base, CRC AS h FROM own),
seq AS (
  SELECT h.c, list_concat(coalesce(b.ds, [])[1:h], h.ds[h + 1:len(h.ds)]) AS ds, list_concat(coalesce(b.ws, [])[1:h], h.ws[h + 1:len(h.ws)]) AS ws
  FROM h LEFT JOIN own b ON b.c = h.base),
prefix AS (
  SELECT c, d, array_to_string(ds[1:d], '') AS p, d = len(ds) AS at_end, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM seq)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
         coalesce(string_agg(CAST(c AS varchar), ',' ORDER BY c) FILTER (at_end), '') AS ends
  FROM prefix GROUP BY p, d),
kids AS (
  SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(p, 64 * k) AS p, sum((n - 1) * words) AS saved, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT node.*, n_children, unnest(range(0, d + 1)) AS k FROM node LEFT JOIN kids USING (p)) GROUP BY 1)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(n_children, 0) AS n_children,
       CAST(leaves AS bigint) AS n_leaves, CAST(saved AS bigint) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node LEFT JOIN node up ON node.d > 0 AND up.p = left(node.p, 64 * (node.d - 1))
LEFT JOIN kids ON kids.p = node.p JOIN below ON below.p = node.p
""".replace("CRC", _CRC_MOD_4.format(c="c"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
known AS (
  SELECT doc_id, max(coalesce(CAST(quality = 1 AS int), 0)) AS good, max(coalesce(CAST(toxic = 1 AS int), 0)) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(words) < 200 AS a, 100 * list_unique(words) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > smallest, false) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM (
    SELECT concat(p.x, q.x, r.x, s.x, t.x) AS o
    FROM l p JOIN l q ON q.x <> p.x JOIN l r ON r.x NOT IN (p.x, q.x) JOIN l s ON s.x NOT IN (p.x, q.x, r.x)
    JOIN l t ON t.x NOT IN (p.x, q.x, r.x, s.x))),
judged AS (
  SELECT cells.*, o, step, contains(fails, o[step]) AS failed, fails = o[step] AS alone,
         len(list_filter(range(1, step), lambda k: contains(fails, o[k]))) > 0 AS gone
  FROM cells, steps),
counted AS (
  SELECT part, o AS filter_order, step,
         coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS int) AS step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed,
       CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost,
       CAST(toxic_lost AS bigint) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS bigint) AS shapley
FROM counted
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_html_text": op11_html_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op11_html_text": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
