"""The registered queries over the derived views, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import arrays, chrom, dna, packed, pos, rounding, variant
from locusframe.operators import batching, binning, pairing, pileup, records
from locusframe.operators._cut import new_path
from locusframe.plans import derive
from locusframe.plans.derive import table, with_views
from locusframe.sources import bam, fai, fastq, raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query, and its SQL over the named views."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = with_views(sql, *views, recursive=recursive) if views or recursive else sql
        return fn

    return add


# Pileups ------------------------------------------------------------------------------------------------------------------

_PILED = """
WITH t AS (SELECT DISTINCT contig, pos FROM targets),
piled AS (SELECT t.contig, t.pos, r.rid, t.pos - 1 - r.pos0 AS qpos,
                 CASE WHEN (r.rid + t.pos - 1 - r.pos0) % 17 <> 0 THEN (r.rid + t.pos - 1 - r.pos0) % 41 END AS bq
          FROM t JOIN reads r ON r.contig = t.contig AND t.pos - 1 >= r.pos0 AND t.pos - 1 < r.pos0 + r.len)
"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reads = derive.reads(spark, sf_dir).withColumn("end0", F.col("pos0") + F.col("len"))
    return reads, derive.targets(spark, sf_dir).select("contig", "pos")


def _piled(spark: SparkSession, sf_dir: str, mates: bool = False) -> DataFrame:
    """``mates``: with the names of templates, and whether a read meets another one of its name."""
    reads, targets = _spans(spark, sf_dir)
    if mates:
        reads = pileup.marked_mates(reads.withColumn("qname", F.floor(F.col("rid") / 20)))
    rows = pileup.pileup(reads, targets)
    at = F.col("rid") + F.col("qpos")
    return rows.withColumn("bq", F.when(at % 17 != 0, at % 41))


@query(_PILED + """SELECT contig, pos, count(*) AS depth, cast(coalesce(sum(bq), 0) AS bigint) AS sum_bq,
  cast(coalesce(sum(bq), 0) AS double) / count(*) AS mean_bq FROM piled GROUP BY ALL""", "reads", "targets")
def locus_mean_quality(spark, sf_dir):
    """Mean base quality per target; a base without a quality counts in the denominator only."""
    return pileup.mean_quality(_piled(spark, sf_dir), F.col("bq"))


@query(_PILED + "SELECT contig, pos, count(*) AS depth FROM piled GROUP BY ALL", "reads", "targets")
def locus_depth(spark, sf_dir):
    """From events, without pairs."""
    reads = derive.reads(spark, sf_dir).withColumn("end0", F.col("pos0") + F.col("len"))
    return pileup.depth_at(reads, derive.targets(spark, sf_dir))


@query("""WITH e AS (SELECT contig, x, sum(d) AS d FROM (
  SELECT contig, pos0 AS x, 1 AS d FROM reads UNION ALL SELECT contig, pos0 + len, -1 FROM reads) GROUP BY ALL HAVING sum(d) <> 0),
s AS (SELECT contig, x AS start, lead(x) OVER (PARTITION BY contig ORDER BY x) AS "end",
             cast(sum(d) OVER (PARTITION BY contig ORDER BY x) AS bigint) AS depth FROM e)
SELECT * FROM s WHERE depth > 0""", "reads")
def depth_runs(spark, sf_dir):
    """Stretches of equal depth along the contigs."""
    return pileup.depth_runs(derive.reads(spark, sf_dir).withColumn("end0", F.col("pos0") + F.col("len")))


@query(_PILED.replace("r.rid,", "r.rid, r.pos0,") + """,
b AS (SELECT *, rid // 20 AS qname, substring('ACGTN', cast((pos + CASE WHEN pos % 3 = 0 THEN rid ELSE 0 END) % 5 AS int) + 1, 1) AS base FROM piled),
k AS (SELECT *, row_number() OVER w AS k, lead(base) OVER w AS b2, lead(bq) OVER w AS q2, lag(base) OVER w AS b1, lag(bq) OVER w AS q1
      FROM b WHERE bq IS NOT NULL WINDOW w AS (PARTITION BY contig, pos, qname ORDER BY pos0, rid, qpos)),
told AS (SELECT contig, pos, CASE
    WHEN k = 1 AND q2 IS NOT NULL THEN CASE WHEN base = b2 THEN least(bq + q2, 200) WHEN bq >= q2 THEN bq * 8 // 10 ELSE 0 END
    WHEN k = 2 THEN CASE WHEN base <> b1 AND bq > q1 THEN bq * 8 // 10 ELSE 0 END ELSE bq END AS bq FROM k
  UNION ALL SELECT contig, pos, NULL FROM b WHERE bq IS NULL)
SELECT contig, pos, count(*) AS depth, cast(coalesce(sum(bq), 0) AS bigint) AS sum_bq,
  cast(coalesce(sum(bq), 0) AS double) / count(*) AS mean_bq FROM told GROUP BY ALL""", "reads", "targets")
def locus_mates_quality(spark, sf_dir):
    """Mean quality where the qualities of overlapping mates count once and both mates stay in the depth."""
    base = F.substring(F.lit("ACGTN"), ((F.col("pos") + F.when(F.col("pos") % 3 == 0, F.col("rid")).otherwise(0)) % 5 + 1).cast("int"), F.lit(1))
    return pileup.mean_quality(pileup.overlapping_mates(_piled(spark, sf_dir, True), base, F.col("bq"), "qname", ("pos0", "rid", "qpos"), "meets"), F.col("bq"))


@query(_PILED + """SELECT contig, pos, count(*) FILTER (b = 'A') AS n_a, count(*) FILTER (b = 'T') AS n_t,
  count(*) FILTER (b = 'C') AS n_c, count(*) FILTER (b = 'G') AS n_g, count(*) FILTER (b = 'N') AS n_n,
  count(*) FILTER (b = 'X') AS n_other
FROM (SELECT *, substring('atCGNX', cast((rid + qpos) % 6 AS int) + 1, 1) AS raw, upper(raw) AS b FROM piled) GROUP BY ALL""",
       "reads", "targets")
def locus_base_counts(spark, sf_dir):
    base = F.substring(F.lit("atCGNX"), ((F.col("rid") + F.col("qpos")) % 6 + 1).cast("int"), F.lit(1))
    return pileup.base_counts(_piled(spark, sf_dir), base, "contig", "pos")


def _cigar_reads(spark, sf_dir):
    """Reads of the form 2S aM 3D 1I bM, with flags."""
    part = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("long").alias("len"))
    a = F.floor(F.col("len") / 2)
    return derive.reads(spark, sf_dir).select(
        "contig", "pos0", "rid", (F.col("rid") % 7 * 256).cast("int").alias("flag"),
        F.array(part("S", F.lit(2)), part("M", a), part("D", F.lit(3)), part("I", F.lit(1)), part("M", F.col("len") - a)).alias("cigar"),
    )


@query("""
WITH t AS (SELECT DISTINCT contig, pos FROM targets),
r AS (SELECT *, len // 2 AS a FROM reads WHERE (rid % 7 * 256) & 1796 = 0),
piled AS (SELECT t.contig, t.pos, t.pos - 1 - r.pos0 AS o, r.a, r.rid FROM t JOIN r
          ON r.contig = t.contig AND t.pos - 1 >= r.pos0 AND t.pos - 1 < r.pos0 + r.len + 3)
SELECT contig, pos, rid, CASE WHEN o < a THEN o + 2 WHEN o < a + 3 THEN NULL ELSE o END AS qpos FROM piled
""", "reads", "targets")
def cigar_pileup(spark, sf_dir):
    """Offsets in the reads along their CIGARs; reads with certain flags are left out."""
    return pileup.pileup(_cigar_reads(spark, sf_dir), derive.targets(spark, sf_dir).select("contig", "pos")).select(
        "contig", "pos", "rid", "qpos"
    )


@query(_PILED.replace("r.rid,", "r.rid, r.rid // 20 AS qname,") + """SELECT contig, pos, qname, max(struct_pack(q := coalesce(bq, -1), rid := rid)).rid AS rid
FROM piled GROUP BY contig, pos, qname""", "reads", "targets")
def locus_one_of_mates(spark, sf_dir):
    """Of reads with one name at a target the one with the best quality, then the largest number."""
    best = pileup.one_of_overlapping(_piled(spark, sf_dir, True), "qname", F.coalesce("bq", F.lit(-1)), "rid", meets="meets")
    return best.select("contig", "pos", "qname", "rid")


@query("SELECT contig, pos, min(ord) AS ord FROM targets GROUP BY ALL", "targets")
def target_dedup_first(spark, sf_dir):
    return pileup.first_of_duplicates(derive.targets(spark, sf_dir), "ord")


@query("""
WITH sites AS (SELECT pos0, min(rid) AS rid FROM reads GROUP BY pos0),
t AS (SELECT pos, max(ord) AS ord FROM targets GROUP BY pos)
SELECT pos0, rid, ord FROM sites JOIN t ON pos0 = pos - 1
""", "reads", "targets")
def locus_hash_join(spark, sf_dir):
    """Sites that are targets: first site, last target, contigs not compared."""
    sites = derive.reads(spark, sf_dir).select("pos0", "rid", F.col("rid").alias("site_ord"))
    found = pileup.hash_lookup(sites, derive.targets(spark, sf_dir), "ord")
    return found.select("pos0", "rid", F.col("target.ord").alias("ord"))


@query("""SELECT contig, pos0, len, rid FROM reads WHERE contig = 'chr2' AND pos0 < 2000 AND pos0 + len > 1000""", "reads")
def region_fetch(spark, sf_dir):
    """Reads that overlap chr2:1000-2000 (0-based, half-open)."""
    f = pos.as_fetch(pos.region(F.lit("2"), F.lit(1000), F.lit(2000)))
    inside = (F.col("contig") == f["contig"]) & (F.col("pos0") < f["end"]) & (F.col("pos0") + F.col("len") > f["start"])
    return derive.reads(spark, sf_dir).where(inside)


def _summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"contig": [key[0]], "pos": [key[1]], "span": [int(pdf["len"].max() - pdf["len"].min())]})


@query("""WITH t AS (SELECT DISTINCT contig, pos FROM targets)
SELECT t.contig, t.pos, max(len) - min(len) AS span FROM t JOIN reads r
  ON r.contig = t.contig AND t.pos - 1 >= r.pos0 AND t.pos - 1 < r.pos0 + r.len GROUP BY ALL""", "reads", "targets")
def locus_user_function(spark, sf_dir):
    """A user's function once per locus."""
    return records.process_loci(*_spans(spark, sf_dir), _summary, "contig string, pos long, span long")


# Records ------------------------------------------------------------------------------------------------------------------


@query("SELECT contig, pos0, len, rid FROM reads WHERE (pos0 + 1) % 2 <> 0", "reads")
def records_odd_pos(spark, sf_dir):
    return records.keep(derive.reads(spark, sf_dir), records.odd_position(F.col("pos0")))


def _halved(pdf: pd.DataFrame) -> pd.DataFrame:
    kept = pdf[pdf["rid"] % 3 == 0]
    return kept.assign(pos0=kept["pos0"] // 2)


@query("SELECT contig, pos0 // 2 AS pos0, len, rid FROM reads WHERE rid % 3 = 0", "reads")
def records_user_function(spark, sf_dir):
    """A user's function that changes some records and drops others."""
    return records.modify_records(derive.reads(spark, sf_dir), _halved)


@query("""SELECT p_partkey, k, cast(split_part(k, '_', 2) AS bigint) AS pos FROM variants
WHERE regexp_full_match(split_part(k, '_', 2), '[+-]?[0-9]+')""", "variants")
def records_drop_errors(spark, sf_dir):
    """Records whose position can't be read are dropped."""
    number = F.get(F.split("k", "_", -1), F.lit(1))
    return records.drop_errors(derive.variants(spark, sf_dir), number.try_cast("long"), "pos")


@query("""SELECT count(*) OVER (ORDER BY rid) AS rank, rid, contig FROM reads WHERE pos0 % 2 = 0""", "reads")
def records_reordered(spark, sf_dir):
    """Changed records in the order of their ordinals, with their place."""
    kept = records.keep(derive.reads(spark, sf_dir), F.col("pos0") % 2 == 0).withColumn("rec_idx", F.col("rid"))
    return batching.running_total(kept, F.lit(1).cast("long"), "rank", "rec_idx").select("rank", "rid", "contig")


@query("SELECT contig, pos0, len, rid FROM reads ORDER BY rid LIMIT 10", "reads")
def first_ten(spark, sf_dir):
    return records.first_n(derive.reads(spark, sf_dir), 10, "rid")


@query("""SELECT contig, pos0, len, rid FROM reads
WHERE contig IN (SELECT contig FROM targets WHERE pos % 7 = 0) AND pos0 IN (SELECT pos - 1 FROM targets)""", "reads", "targets")
def membership_semi(spark, sf_dir):
    targets = derive.targets(spark, sf_dir)
    some = records.members(derive.reads(spark, sf_dir), "contig", targets.where("pos % 7 = 0"))
    return records.members(some, "pos0", targets.select((F.col("pos") - 1).alias("pos0")))


@query("SELECT doc_id, cast(strlen(text) AS bigint) AS n_bytes FROM documents")
def bytes_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT cast(sum(strlen(text)) AS bigint) AS n_bytes FROM documents")
def bytes_total(spark, sf_dir):
    return bytes_by_document(spark, sf_dir).agg(F.sum("n_bytes").alias("n_bytes"))


# Batches and bins -----------------------------------------------------------------------------------------------------------

_STEPS = """
runs AS (SELECT *, sum(new) OVER (ORDER BY ord) AS run FROM (
  SELECT *, cast(coalesce(contig <> lag(contig) OVER (ORDER BY ord), false) AS int) AS new FROM {rows})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) AS k FROM runs),
steps AS (
  SELECT run, ord, k, contig, {first} AS anchor, 0 AS local, {shown} FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.run, n.ord, n.k, n.contig, CASE WHEN n.{end} - s.anchor < {window} THEN s.anchor ELSE n.{first} END,
         CASE WHEN n.{end} - s.anchor < {window} THEN s.local ELSE s.local + 1 END, {shown_n}
  FROM steps s JOIN numbered n ON n.run = s.run AND n.k = s.k + 1)
SELECT ord, contig, {shown}, dense_rank() OVER (ORDER BY run, local) - 1 AS batch FROM steps
"""


def _sorted_targets(spark, sf_dir):
    """Targets by blocks of 200 of their order, in a block by contig and position: short sorted runs."""
    t = derive.targets(spark, sf_dir)
    number = F.floor(F.col("ord") / 200) * 3 + F.substring("contig", 4, 1).cast("long") - 1
    return t.select("contig", "pos", ((number * 20001 + F.col("pos")) * 1_000_000 + F.col("ord") % 1_000_000).alias("ord"))


@query("WITH sorted AS (SELECT contig, pos, (((ord // 200) * 3 + cast(substring(contig, 4, 1) AS bigint) - 1) * 20001 + pos) "
       "* 1000000 + ord % 1000000 AS ord FROM targets)," + _STEPS.format(
           rows="sorted", first="pos", end="pos", window=500, shown="pos", shown_n="n.pos"), "targets", recursive=True)
def batch_coordinates(spark, sf_dir):
    return batching.batch_coordinates(_sorted_targets(spark, sf_dir), 500)


@query("WITH " + _STEPS.format(rows="regions", first="start", end='"end"', window=300, shown='start, "end"',
                               shown_n='n.start, n."end"'), "regions", recursive=True)
def batch_regions(spark, sf_dir):
    return batching.batch_regions(derive.regions(spark, sf_dir), 300)


@query("""SELECT ord, contig, start, "end", cast(sum(new) OVER (ORDER BY ord) AS bigint) AS run FROM (
  SELECT *, cast(coalesce(contig <> lag(contig) OVER (ORDER BY ord), false) AS int) AS new FROM regions)""", "regions")
def contig_runs(spark, sf_dir):
    return batching.contig_runs(derive.regions(spark, sf_dir), blocks=15)


@query("""SELECT ord, x AS lo, least(x + 25, "end") AS hi FROM (
  SELECT ord, "end", unnest(range(start, "end", 25)) AS x FROM regions)""", "regions")
def bins_fixed(spark, sf_dir):
    made = binning.bins(F.col("start"), F.col("end"), F.lit(25).cast("long"))
    return derive.regions(spark, sf_dir).select("ord", F.explode(made).alias("b")).select("ord", "b.lo", "b.hi")


@query("""
WITH last AS (SELECT CASE WHEN starts_with(name, 'chr') THEN name ELSE 'chr' || name END AS chrom, arg_max(len, ord) AS len
              FROM contig_index GROUP BY 1)
SELECT chrom, x AS lo, least(x + 100, len) AS hi FROM (SELECT chrom, len, unnest(range(0, len, 100)) AS x FROM last)
""", "contig_index")
def bins_from_index(spark, sf_dir):
    made = binning.bins_of_index(derive.contig_index(spark, sf_dir), 100)
    return made.select("chrom", F.explode("bins").alias("b")).select("chrom", "b.lo", "b.hi")


# Names, positions, variants ----------------------------------------------------------------------------------------------------

_CHROM = "CASE WHEN starts_with(name, 'chr') THEN name ELSE 'chr' || name END"
_BARE = "CASE WHEN starts_with(name, 'chr') THEN substring(name, 4) ELSE name END"
_STANDARD = ", ".join(f"'{c}'" for c in chrom.STANDARD)
_TYPICAL = ", ".join(f"'{c}'" for c in chrom.TYPICAL)


@query(f"""SELECT ord, name, {_CHROM} AS chrom, {_CHROM} IN ({_STANDARD}) AS standard,
  cast(coalesce(list_position([{_STANDARD}], {_CHROM}), 26) AS int) AS rank FROM contig_index""", "contig_index")
def chrom_normalize(spark, sf_dir):
    name = F.col("name")
    return derive.contig_index(spark, sf_dir).select(
        "ord", "name", chrom.chrom(name).alias("chrom"), chrom.is_standard(name).alias("standard"),
        chrom.chrom_rank(chrom.chrom(name)).alias("rank"),
    )


@query(f"SELECT ord, {_CHROM} AS prefixed, {_BARE} AS unprefixed FROM contig_index", "contig_index")
def chrom_prefix_forms(spark, sf_dir):
    name = F.col("name")
    return derive.contig_index(spark, sf_dir).select(
        "ord", chrom.to_prefixed(name).alias("prefixed"), chrom.to_unprefixed(name).alias("unprefixed")
    )


@query(f"SELECT ord, {_CHROM} AS chrom FROM contig_index WHERE {_CHROM} IN ({_TYPICAL})", "contig_index")
def chrom_typical_filter(spark, sf_dir):
    rows = derive.contig_index(spark, sf_dir).select("ord", chrom.chrom(F.col("name")).alias("chrom"))
    return rows.where(chrom.is_typical(F.col("chrom")))


_POS0 = """CASE WHEN v < 0 THEN '0-based position must be >= 0, got ' || v
  WHEN v = 9223372036854775807 THEN 'cannot represent 1-based position for 0-based value ' || v END"""


@query(f"""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -o_custkey WHEN 1 THEN 9223372036854775807
           WHEN 2 THEN 0 WHEN 3 THEN 4294967290 + o_custkey % 11 ELSE o_custkey END AS v FROM orders),
e AS (SELECT *, {_POS0} AS error0, CASE WHEN v <= 0 THEN '1-based position must be > 0, got ' || v END AS error1 FROM x)
SELECT o_orderkey, CASE WHEN error0 IS NULL THEN v END AS pos_from_0, error0, CASE WHEN error1 IS NULL THEN cast(v - 1 AS varchar) END AS pos_from_1,
  error1, CASE WHEN v > 4294967295 OR v < 0 THEN 'position ' || v || ' cannot be represented as u32' END AS error_u32 FROM e
""")
def pos_convert(spark, sf_dir):
    v = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN -o_custkey WHEN 1 THEN 9223372036854775807L WHEN 2 THEN 0L
                  WHEN 3 THEN 4294967290L + o_custkey % 11 ELSE o_custkey END""")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    a, b, u = pos.try_from_0based(F.col("v")), pos.try_from_1based(F.col("v")), pos.try_zero_based_u32(F.col("v"))
    return rows.select(
        "o_orderkey", a["pos"].alias("pos_from_0"), a["error"].alias("error0"), b["pos"].cast("string").alias("pos_from_1"),
        b["error"].alias("error1"), u["error"].alias("error_u32"),
    )


@query("""
WITH x AS (SELECT o_orderkey, o_custkey AS p, CASE o_orderkey % 4 WHEN 0 THEN 9223372036854775807 WHEN 1 THEN 5
           WHEN 2 THEN -o_custkey - 3 ELSE 100000 END AS d FROM orders),
s AS (SELECT *, cast(p AS hugeint) + d AS up, cast(p AS hugeint) - d AS down FROM x)
SELECT o_orderkey,
  CASE WHEN up > 9223372036854775807 THEN 'cannot represent 1-based position for 0-based value ' || p
       WHEN up < 0 THEN '0-based position must be >= 0, got ' || up
       WHEN up = 9223372036854775807 THEN 'cannot represent 1-based position for 0-based value ' || up END AS add_error,
  CASE WHEN add_error IS NULL THEN cast(up AS bigint) END AS added,
  CASE WHEN down < 0 THEN '0-based position must be >= 0, got ' || down END AS sub_error,
  CASE WHEN down >= 0 THEN cast(down AS bigint) END AS subtracted FROM s
""")
def pos_checked_arith(spark, sf_dir):
    d = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN 9223372036854775807L WHEN 1 THEN 5L WHEN 2 THEN -o_custkey - 3
                  ELSE 100000L END""")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("p"), d.alias("d"))
    up, down = pos.try_checked_add(F.col("p"), F.col("d")), pos.try_checked_sub(F.col("p"), F.col("d"))
    return rows.select(
        "o_orderkey", up["error"].alias("add_error"), up["pos"].alias("added"), down["error"].alias("sub_error"),
        down["pos"].alias("subtracted"),
    )


@query("""WITH x AS (SELECT o_orderkey, cast(CASE o_orderkey % 5 WHEN 0 THEN -o_custkey WHEN 1 THEN 9223372036854775807
  WHEN 2 THEN 18446744073709551615 WHEN 3 THEN 0 ELSE o_custkey END AS hugeint) AS v FROM orders),
e AS (SELECT *, v < 0 OR v = 9223372036854775807 AS bad, v > 9223372036854775807 AS large FROM x)
SELECT o_orderkey, CASE WHEN NOT bad AND NOT large THEN cast(v AS bigint) END AS zero_based, CASE WHEN NOT bad AND NOT large THEN cast(v + 1 AS bigint) END AS one_based,
  CASE WHEN large THEN 'cannot convert u64 to Pos: value does not fit into i64 range' WHEN bad THEN 'cannot convert u64 to Pos: value violates Pos invariants' END AS error_u64,
  CASE WHEN bad AND NOT large THEN 'cannot convert i64 to Pos: value violates Pos invariants' END AS error_i64,
  CASE WHEN v < 0 THEN '0-based position must be >= 0, got ' || v WHEN bad THEN 'cannot represent 1-based position for 0-based value ' || v END AS error_isize
FROM e""")
def pos_integers(spark, sf_dir):
    """Positions from integers of several types, and as 0- and 1-based numbers."""
    v = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN -o_custkey WHEN 1 THEN 9223372036854775807BD
                  WHEN 2 THEN 18446744073709551615BD WHEN 3 THEN 0 ELSE o_custkey END""").cast("decimal(20,0)")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    u, i, reason = (pos.try_from_integer(F.col("v"), k) for k in ("u64", "i64", "isize"))
    return rows.select(
        "o_orderkey", pos.zero_based(u["pos"]).alias("zero_based"), pos.one_based(u["pos"]).alias("one_based"),
        u["error"].alias("error_u64"), i["error"].alias("error_i64"), reason["error"].alias("error_isize"),
    )


_VARIANT = """
WITH f AS (SELECT p_partkey, k, string_split(k, '_') AS e, try_cast(CASE WHEN regexp_full_match(e[2], '[+-]?[0-9]+') THEN e[2] END AS bigint) AS n
           FROM variants),
v AS (SELECT *, CASE WHEN n IS NULL THEN 'invalid position' WHEN len(e) < 4 THEN 'Failed to get next element of variant key.'
                WHEN len(e) > 4 THEN 'Invalid variant key, it has 5-th element: ' || k END AS err FROM f)
"""
_VARIANT_CHROM = "CASE WHEN err IS NULL THEN CASE WHEN starts_with(e[1], 'chr') THEN e[1] ELSE 'chr' || e[1] END END"


@query(_VARIANT + f"""SELECT p_partkey, {_VARIANT_CHROM} AS chrom, CASE WHEN err IS NULL THEN n END AS pos,
  CASE WHEN err IS NULL THEN e[3] END AS ref_b, CASE WHEN err IS NULL THEN e[4] END AS alt_b,
  err || ' Input variant key: ' || k AS error FROM v""", "variants")
def variant_parse(spark, sf_dir):
    return derive.variants(spark, sf_dir).select("p_partkey", variant.try_variant(F.col("k")).alias("v")).select("p_partkey", "v.*")


@query(_VARIANT + f'SELECT p_partkey, {_VARIANT_CHROM} AS contig, n AS start, n + 1 AS "end" FROM v WHERE err IS NULL', "variants")
def variant_regions(spark, sf_dir):
    rows = derive.variants(spark, sf_dir).select("p_partkey", variant.try_variant(F.col("k")).alias("v")).where("v.error is null")
    return rows.select("p_partkey", variant.region_1bp(F.col("v")).alias("r")).select("p_partkey", "r.*")


# DNA --------------------------------------------------------------------------------------------------------------------------

_COMPLEMENT = """translate(regexp_replace({0}, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTNacgtn', 'TGCANTGCAN')"""


@query(f"SELECT doc_id, {_COMPLEMENT.format('text')} AS seq FROM documents")
def dna_complement(spark, sf_dir):
    """Over whole raw texts."""
    return table(spark, sf_dir, "documents").select("doc_id", dna.complement(F.col("text")).alias("seq"))


@query("SELECT doc_id, reverse(" + _COMPLEMENT.format("text") + ") AS seq FROM documents")
def dna_reverse_complement(spark, sf_dir):
    """Over whole raw texts, so most letters are none of the bases."""
    return table(spark, sf_dir, "documents").select("doc_id", dna.reverse_complement(F.col("text")).alias("seq"))


_PACK = """list_transform(range(0, 8), lambda c: list_sum(list_transform(range(0, 21), lambda i:
  cast(instr('ATCGN', CASE WHEN c * 21 + i < length(seq) THEN substring(seq, cast(c * 21 + i + 1 AS int), 1) ELSE '-' END) AS bigint)
  * (1::bigint << cast(3 * i AS int)))))"""


@query(f"SELECT doc_id, piece, list_transform({_PACK}, lambda x: cast(x AS bigint)) AS packed FROM dna_pieces", "dna_pieces")
def bases_pack(spark, sf_dir):
    return derive.dna_pieces(spark, sf_dir).select("doc_id", "piece", packed.pack(F.col("seq")).alias("packed"))


_WRONG = "CASE doc_id % 4 WHEN 0 THEN seq WHEN 1 THEN seq || 'x' WHEN 2 THEN 'A-' || seq ELSE lower(seq) END"


@query(f"""WITH x AS (SELECT doc_id, piece, {_WRONG} AS s FROM dna_pieces),
w AS (SELECT *, length(s) AS n, length(regexp_extract(s, '^[ATCGN]*', 0)) AS good FROM x),
e AS (SELECT *, 'Invalid base ' || chr(39) || substring(s, cast(good AS int) + 1, 1) || chr(39) || ' at position ' || good AS wrong FROM w)
SELECT doc_id, piece, CASE WHEN n > 168 THEN 'Input slice is too long: ' || n || ' bases, max is 168' WHEN good < n THEN wrong END AS of_slice,
  CASE WHEN good < least(n, 168) THEN wrong WHEN n > 168 THEN 'Input iterator is too long, max is 168' END AS of_iter,
  n <= 168 AND good = n AS packed, CASE WHEN regexp_full_match(substring(s, 1, 1), '[ATCGN]') THEN substring(s, 1, 1) END AS first_base FROM e
""", "dna_pieces")
def bases_checked(spark, sf_dir):
    """Sequences with letters that are no bases or too many of them: the errors in either order of checks, and the first base."""
    rows = derive.dna_pieces(spark, sf_dir).select("doc_id", "piece", F.expr(_WRONG).alias("s"))
    first, iterated = F.substring("s", 1, 1), packed.try_pack(F.col("s"), from_iter=True)
    return rows.select(
        "doc_id", "piece", packed.pack_error(F.col("s")).alias("of_slice"), packed.pack_error(F.col("s"), from_iter=True).alias("of_iter"),
        iterated.isNotNull().alias("packed"), F.when(packed.code(first) > 0, packed.base(first)).alias("first_base"),
    )


def _packed(spark, sf_dir):
    return derive.dna_pieces(spark, sf_dir).select("doc_id", "piece", packed.pack(F.col("seq")).alias("p"))


@query("SELECT doc_id, piece, seq FROM dna_pieces", "dna_pieces")
def bases_unpack(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "piece", packed.bases(F.col("p")).alias("seq"))


@query("""SELECT doc_id, piece, nullif(substring(seq, cast(doc_id % 170 AS int) + 1, 1), '') AS base FROM dna_pieces""", "dna_pieces")
def bases_get(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", "piece", packed.get(F.col("p"), F.col("doc_id") % 170).alias("base"))


@query("""SELECT doc_id, piece, substring(seq, cast(doc_id % 50 AS int) + 1, 40) AS seq FROM dna_pieces""", "dna_pieces")
def bases_slice(spark, sf_dir):
    at = (F.col("doc_id") % 50).cast("int")
    return _packed(spark, sf_dir).select("doc_id", "piece", packed.bases(F.col("p"), at, at + 40).alias("seq"))


@query("""SELECT doc_id, piece, CASE WHEN i < length(seq) THEN substring(seq, 1, i) || 'G' || substring(seq, i + 2)
  WHEN i = length(seq) THEN seq || 'G' ELSE seq END AS seq
FROM (SELECT *, cast(doc_id % 160 AS int) AS i FROM dna_pieces)""", "dna_pieces")
def bases_set(spark, sf_dir):
    """One base replaced; beyond the end it leaves a hole, so the text stays as it was."""
    changed = packed.set_base(F.col("p"), (F.col("doc_id") % 160).cast("int"), F.lit("G"))
    return _packed(spark, sf_dir).select("doc_id", "piece", packed.bases(changed).alias("seq"))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, 150), lambda i: substring('ACGTN', cast(cast('0x' || substring(
  md5(doc_id || ':' || (i // 8)), cast(i % 8 * 4 + 1 AS int), 4) AS bigint) % 5 AS int) + 1, 1)), '') AS seq FROM documents""")
def dna_generated(spark, sf_dir):
    """Sequences from a seed, one per document."""
    return table(spark, sf_dir, "documents").select("doc_id", dna.generated(F.col("doc_id"), 150).alias("seq"))


@query("""SELECT ord, contig, unnest(range(start, "end", 50)) AS pos FROM regions""", "regions")
def stepped_targets(spark, sf_dir):
    """Every 50th position of all regions."""
    return binning.stepped(derive.regions(spark, sf_dir), 50, "ord").select("ord", "contig", "pos")


# Rounding, arrays, maps ---------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, cast(printf('%.1f', v) AS double) AS r1, cast(printf('%.2f', v) AS double) AS r2
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 20000) / 40.0::double AS v FROM lineitem)""")
def py_round_pos(spark, sf_dir):
    v = (F.col("l_partkey") % 20000) / F.lit(40.0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rounding.py_round(v, 1).alias("r1"), rounding.py_round(v, 2).alias("r2")
    )


@query("SELECT l_orderkey, l_linenumber, round_even(l_partkey / 8.0::double, 0) AS r FROM lineitem")
def py_round_zero(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounding.py_round0(F.col("l_partkey") / F.lit(8.0)).alias("r"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_orderkey / 100.0::double, 0) * 100 AS r FROM lineitem")
def py_round_neg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounding.py_round(F.col("l_orderkey"), -2).alias("r"))


_SLICE = """WITH x AS (SELECT o_orderkey, [10, 20, 30, 40, 50] AS a, cast(o_orderkey % 13 AS int) - 6 AS s,
  cast(o_custkey % 13 AS int) - 6 AS e FROM orders),
y AS (SELECT *, CASE WHEN s < 0 THEN 5 + s ELSE s END AS lo, CASE WHEN e < 0 THEN 5 + e ELSE e END AS hi FROM x)
"""


@query(_SLICE + """SELECT o_orderkey, CASE WHEN lo >= 0 AND hi <= 5 AND lo <= hi THEN coalesce(array_to_string(a[lo + 1:hi], ','), '') END AS part,
  CASE WHEN lo >= 0 AND lo <= 5 THEN coalesce(array_to_string(a[lo + 1:], ','), '') END AS rest FROM y""")
def array_slice_signed(spark, sf_dir):
    a = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50)])
    s, e = ((F.col(c) % 13).cast("int") - 6 for c in ("o_orderkey", "o_custkey"))
    text = lambda x: F.array_join(x, ",")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text(arrays.try_signed_slice(a, s, e)).alias("part"), text(arrays.try_signed_slice(a, s)).alias("rest")
    )


@query("SELECT o_orderkey, [10, 20, 30][cast(o_orderkey % 3 AS int) + 1] AS item, [10, 20, 30][cast(o_orderkey % 5 AS int) + 1] AS maybe FROM orders")
def array_get_checked(spark, sf_dir):
    a = F.array(*[F.lit(x) for x in (10, 20, 30)])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", arrays.item(a, F.col("o_orderkey") % 3).alias("item"), arrays.try_item(a, F.col("o_orderkey") % 5).alias("maybe")
    )


@query("SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN 100 WHEN '2' THEN 200 ELSE 300 END AS value FROM orders")
def map_get_checked(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for k, v in (("1", 100), ("2", 200), ("3", 300), ("4", 300), ("5", 300)) for x in (k, v)])
    return table(spark, sf_dir, "orders").select("o_orderkey", arrays.value_of(m, F.substring("o_orderpriority", 1, 1)).alias("value"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def utf8_check(spark, sf_dir):
    """Bytes that are text, and bytes that were cut within a letter."""
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", arrays.try_utf8(data).isNotNull().alias("valid"))


@query("""SELECT o_orderkey, coalesce(array_to_string([10, 20, 30, 40, 50][s + 1:e], ','), '') AS part, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS present,
  o_orderkey AS index, o_custkey AS data, 'Order' AS kind
FROM (SELECT *, cast(o_orderkey % 3 AS int) AS s, 2 + cast(o_custkey % 3 AS int) AS e FROM orders)""")
def checked_access(spark, sf_dir):
    """Slices, values that must be there, values with their index, and values with the name of their case."""
    a = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50)])
    s, e = (F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int") - 3
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("none")).otherwise(F.col("o_orderpriority"))
    indexed, named = arrays.with_index(F.col("o_custkey"), F.col("o_orderkey")), arrays.tagged("Order", F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(arrays.signed_slice(a, s, e), ",").alias("part"), arrays.present(urgent, "a priority is missing").alias("present"),
        indexed["index"].alias("index"), indexed["data"].alias("data"), named["kind"].alias("kind"),
    )


# Files -------------------------------------------------------------------------------------------------------------------------
# Written into the shared folder in the formats that the sources read, and read from there.


@query("SELECT header, sequence, plus, quality FROM fastq_r1", "fastq_r1")
def fastq_files(spark, sf_dir):
    """All records of the first mate through compressed FASTQ files."""
    path = new_path(spark, "fastq") + ".gz"
    fastq.write_fastq(derive.fastq(spark, sf_dir, 1), path)
    return fastq.read_fastq(spark, path, strict=True).select("header", "sequence", "plus", "quality")


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS k FROM fastq_r1),
b AS (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS k FROM fastq_r2)
SELECT coalesce(a.k, b.k) AS rec, a.header AS h1, b.header AS h2 FROM a FULL JOIN b ON a.k = b.k""", "fastq_r1", "fastq_r2")
def fastq_file_pairs(spark, sf_dir):
    """The n-th records of the FASTQ files of either mate, which are cut at other places."""
    paths = [new_path(spark, "mate"), new_path(spark, "mate")]
    for mate, path in enumerate(paths, 1):
        fastq.write_fastq(derive.fastq(spark, sf_dir, mate), path)
    return fastq.read_pairs(spark, *paths).select("rec", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"))


@query("""SELECT cast(sum(strlen(header) + 2 * strlen(sequence) + 5) AS bigint) AS n_bytes FROM fastq_r1""", "fastq_r1")
def file_bytes_total(spark, sf_dir):
    """Bytes of plain FASTQ files: four line ends and a plus sign besides header, bases and qualities."""
    path = new_path(spark, "fastq")
    fastq.write_fastq(derive.fastq(spark, sf_dir, 1), path)
    return raw.total_bytes(spark, f"{path}/part-*")


_BAM_REFS = [("chr1", 30_000), ("chr2", 30_000), ("chr3", 30_000)]
_BAM_TEXT = "@HD\tVN:1.6\tSO:unsorted\n"


def _bam_records(spark, sf_dir):
    text = lambda x: F.lit(x).cast("string")
    return _cigar_reads(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("rid").cast("string")).alias("qname"), "flag", F.col("contig").alias("rname"), "pos0",
        F.lit(60).alias("mapq"), "cigar", text(None).alias("rnext"), F.lit(-1).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.lit("ACGTN").alias("seq"), F.lit("IIII#").alias("qual"), F.lit(None).cast("binary").alias("tags"),
    )


@query("""SELECT 'r' || rid AS qname, cast(rid % 7 * 256 AS int) AS flag, contig, pos0, '2S' || (len // 2) || 'M3D1I' || (len - len // 2) || 'M' AS cigar,
  'ACGTN' AS seq, 'IIII#' AS qual FROM reads""", "reads")
def bam_files(spark, sf_dir):
    """All reads through BAM files."""
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    path = new_path(spark, "bam")
    bam.write_bam(_bam_records(spark, sf_dir), path, _BAM_TEXT, _BAM_REFS)
    found = bam.read_bam(spark, path)
    return found.select("qname", "flag", F.col("rname").alias("contig"), "pos0", cigar.alias("cigar"), "seq", "qual")


@query("""SELECT CASE WHEN starts_with(name, 'chr') THEN name ELSE 'chr' || name END AS name, arg_max(len, ord) + 1 AS len
FROM contig_index GROUP BY 1""", "contig_index")
def bam_header_refs(spark, sf_dir):
    """The reference sequences of an index table, through the headers of BAM files."""
    named = derive.contig_index(spark, sf_dir).groupBy(chrom.chrom(F.col("name")).alias("name")).agg(F.max_by("len", "ord").alias("len"))
    refs = [(r["name"], r["len"] + 1) for r in named.orderBy("name").collect()]  # as many as spellings
    path = new_path(spark, "bam")
    bam.write_bam(_bam_records(spark, sf_dir), path, _BAM_TEXT, refs)
    return bam.read_header(spark, path).select(F.explode("refs").alias("r")).select("r.name", "r.len").distinct()


_SORTED = """SELECT row_number() OVER (ORDER BY contig, pos0, 'r' || rid, len) - 1 AS rec_idx, 'r' || rid AS qname, contig, pos0,
  pos0 + len + 3 AS end0 FROM reads"""


def _sorted_bam(spark, sf_dir):
    path = new_path(spark, "bam")
    bam.write_bam(_bam_records(spark, sf_dir).orderBy("rname", "pos0", "qname", "cigar"), path, _BAM_TEXT, _BAM_REFS)
    return path


@query(_SORTED, "reads")
def bam_one_file_in_splits(spark, sf_dir):
    """One file, joined from what the tasks wrote, and read by many tasks; the ordinal is the place in it."""
    pieces = _sorted_bam(spark, sf_dir)
    bam.join_files(spark, pieces, f"{pieces}-joined.bam")
    found = bam.read_bam(spark, f"{pieces}-joined.bam", split_bytes=1 << 14)
    return found.select("rec_idx", "qname", F.col("rname").alias("contig"), "pos0", "end0")


_REGIONS = [("chr1", 0, 40), ("chr1", 1800, 1900), ("chr1", 5000, 5300), ("chr2", 5200, 5301), ("chr3", 3000, 3100), ("chr3", 19_990, 40_000), ("chr4", 0, 9)]


@query("WITH g(name, lo, hi) AS (VALUES " + ", ".join(map(str, _REGIONS)) + """)
SELECT 'r' || rid AS qname, contig, pos0 FROM reads r
WHERE EXISTS (SELECT 1 FROM g WHERE g.name = r.contig AND r.pos0 < g.hi AND r.pos0 + r.len + 3 > g.lo)""", "reads")
def bam_regions_by_index(spark, sf_dir):
    """Reads that overlap any of some regions; the files are read where their indexes say."""
    found = bam.read_regions(spark, _sorted_bam(spark, sf_dir), _REGIONS)
    return found.select("qname", F.col("rname").alias("contig"), "pos0")


@query("""SELECT 'r' || rid AS qname, pos0 FROM reads WHERE contig = 'chr2' AND pos0 < 2000 AND pos0 + len + 3 > 1000""", "reads")
def bam_filter_pushed_down(spark, sf_dir):
    """The same by a plain filter on the data source."""
    bam.register(spark)
    found = spark.read.format("bam").load(_sorted_bam(spark, sf_dir))
    return found.where("rname = 'chr2' AND pos0 < 2000 AND end0 > 1000").select("qname", "pos0")


@query("""
WITH last AS (SELECT CASE WHEN starts_with(name, 'chr') THEN name ELSE 'chr' || name END AS chrom, arg_max(len, ord) AS len
              FROM contig_index GROUP BY 1)
SELECT chrom, x AS lo, least(x + 100, len) AS hi FROM (SELECT chrom, len, unnest(range(0, len, 100)) AS x FROM last)
""", "contig_index")
def bins_from_fai(spark, sf_dir):
    """Bins of the sequences of a FASTA index file, which is small and one file by its nature."""
    path = new_path(spark, "genome.fa")
    index = derive.contig_index(spark, sf_dir).orderBy("ord").coalesce(1)
    index.select("name", "len", F.lit(0).alias("off"), F.lit(60).alias("bases"), F.lit(61).alias("width")).write.option("sep", "\t").csv(f"{path}.fai")
    made = fai.bins_from_fasta(spark, path, 100)
    return made.select("chrom", F.explode("bins").alias("b")).select("chrom", "b.lo", "b.hi")


@query("SELECT contig, count(*) AS n, cast(sum(len) AS bigint) AS bases FROM reads GROUP BY contig", "reads")
def cached_reads(spark, sf_dir):
    """Over a copy in memory."""
    copy = raw.in_memory(derive.reads(spark, sf_dir))
    return copy.groupBy("contig").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))


@query("SELECT count(*) AS records, count(*) FILTER (NOT regexp_full_match(split_part(k, '_', 2), '[+-]?[0-9]+')) AS dropped FROM variants",
       "variants")
def records_counted(spark, sf_dir):
    """How many records a pass over them read and dropped."""
    counter = Observation("variants")
    number = F.get(F.split("k", "_", -1), F.lit(1))
    records.drop_errors(derive.variants(spark, sf_dir), number.try_cast("long"), "pos", counter).write.format("noop").mode("overwrite").save()
    seen = counter.get
    return spark.range(1).select(F.lit(seen["records"]).alias("records"), F.lit(seen["dropped"]).alias("dropped"))


def _started() -> dict:
    return {"n": 0, "least": None, "most": None}


def _processed(state: dict, pdf: pd.DataFrame) -> dict:
    return _merged(state, {"n": len(pdf), "least": int(pdf["len"].min()), "most": int(pdf["len"].max())})


def _merged(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    return {"n": a["n"] + b["n"], "least": min(a["least"], b["least"]), "most": max(a["most"], b["most"])}


def _finished(state: dict) -> tuple:
    return state["n"], state["most"] - state["least"]


@query("SELECT contig, pos0 // 100 AS hundred, count(*) AS n, max(len) - min(len) AS spread FROM reads GROUP BY ALL", "reads")
def accumulated_lengths(spark, sf_dir):
    """A user's accumulator of read lengths, merged across tasks."""
    rows = derive.reads(spark, sf_dir).select("contig", F.floor(F.col("pos0") / 100).alias("hundred"), "len")
    return records.accumulate(rows, ["contig", "hundred"], _started, _processed, _merged, _finished, "n long, spread long")


@query("""WITH t AS (SELECT DISTINCT contig, pos FROM targets)
SELECT t.contig, t.pos, count(*) AS n, max(len) - min(len) AS spread FROM t JOIN reads r
  ON r.contig = t.contig AND t.pos - 1 >= r.pos0 AND t.pos - 1 < r.pos0 + r.len GROUP BY ALL""", "reads", "targets")
def locus_user_fold(spark, sf_dir):
    """A user's accumulator per locus; where a locus is deep no task sees it whole."""
    return records.fold_reads(*_spans(spark, sf_dir), _started, _processed, _merged, _finished, "n long, spread long")


# FASTQ --------------------------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    return pairing.zip_mates(derive.fastq(spark, sf_dir, 1), derive.fastq(spark, sf_dir, 2))


@query("""SELECT coalesce(a.rec, b.rec) AS rec, a.header AS h1, b.header AS h2, length(a.sequence) AS n1, length(b.sequence) AS n2
FROM fastq_r1 a FULL JOIN fastq_r2 b ON a.rec = b.rec""", "fastq_r1", "fastq_r2")
def fastq_zip(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "rec", F.col("r1.header").alias("h1"), F.col("r2.header").alias("h2"),
        F.length("r1.sequence").cast("long").alias("n1"), F.length("r2.sequence").cast("long").alias("n2"),
    )


@query("""SELECT (SELECT count(*) FROM fastq_r1) AS r1_records, (SELECT count(*) FROM fastq_r2) AS r2_records,
  (SELECT cast(sum(length(sequence)) AS bigint) FROM fastq_r1) AS r1_bases,
  (SELECT cast(sum(length(sequence)) AS bigint) FROM fastq_r2) AS r2_bases""", "fastq_r1", "fastq_r2")
def fastq_totals(spark, sf_dir):
    return pairing.mate_totals(_pairs(spark, sf_dir))


@query("SELECT rec, regexp_extract(header, '^[^ \\t]*', 0) AS id FROM fastq_r1", "fastq_r1")
def fastq_ids(spark, sf_dir):
    from locusframe.sources.fastq import header_id

    return derive.fastq(spark, sf_dir, 1).select("rec", header_id(F.col("header")).alias("id"))
