"""Genomics views over general tables, by integer and text arithmetic that SQL engines agree on.

``VIEWS`` has the same views as SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, AS_BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTN" * 5 + "A"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig, pos0, len, rid``: one read per line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(l_suppkey % 3 + 1 as string)) AS contig",
        "(l_partkey * 7 + l_linenumber * 131 + l_orderkey) % 20000 AS pos0",
        "20 + cast(l_quantity AS bigint) % 30 AS len",
        "l_orderkey * 8 + l_linenumber AS rid",
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig, pos, ord``: 1-based positions, some more than once."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('chr', cast(o_custkey % 3 + 1 as string)) AS contig", "o_orderkey % 20000 + 1 AS pos", "o_orderkey AS ord"
    )


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, seq``: the ASCII letters of a whole text as bases."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(letters, LETTERS, AS_BASES).alias("seq"))


def dna_pieces(spark: SparkSession, sf_dir: str, size: int = 168) -> DataFrame:
    """``doc_id, piece, seq``: the same in pieces that can be packed."""
    pieces = F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0))
    return dna(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("piece", "seq"))


def fastq(spark: SparkSession, sf_dir: str, mate: int) -> DataFrame:
    """``rec, header, sequence, plus, quality`` of one mate; the second has fewer records."""
    mine = dna(spark, sf_dir).where(F.pmod("doc_id", F.lit(2)) == mate - 1)
    if mate == 2:
        mine = mine.where(F.pmod("doc_id", F.lit(10)) != 9)
        rec = F.floor(F.col("doc_id") / 10) * 4 + F.floor(F.pmod("doc_id", F.lit(10)) / 2)
    else:
        rec = F.floor(F.col("doc_id") / 2)
    return mine.select(
        rec.alias("rec"),
        F.concat(F.lit("@read"), F.col("doc_id").cast("string"), F.lit(f" {mate}:N:0")).alias("header"),
        F.col("seq").alias("sequence"),
        F.lit("+").alias("plus"),
        F.repeat(F.lit("I"), F.length("seq")).alias("quality"),
    )


#: Spellings of sequence names in a reference index.
SPELLINGS = ["1", "chr1", "X", "chrX", "MT", "M", "chrM", "EBV", "chrEBV", "ChrEBV", "GL000218.1", "chr", "chr0", "22", "Y"]


def contig_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, len, ord``: a reference index whose names repeat in several spellings."""
    names = F.array(*[F.lit(s) for s in SPELLINGS])
    return table(spark, sf_dir, "supplier").select(
        F.element_at(names, (F.pmod("s_suppkey", F.lit(len(SPELLINGS))) + 1).cast("int")).alias("name"),
        (F.col("s_suppkey") * 37 % 1000).alias("len"),
        F.col("s_suppkey").alias("ord"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, k``: variant keys, some malformed."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """concat(CASE p_partkey % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN '7' WHEN 2 THEN 'EBV' ELSE 'chrM' END, '_',
             CASE WHEN p_partkey % 10 = 3 THEN 'x1' WHEN p_partkey % 50 = 7 THEN '' ELSE cast(p_partkey * 11 AS string) END,
             CASE WHEN p_partkey % 10 = 4 THEN '_A' WHEN p_partkey % 10 = 5 THEN '_A_C_G' WHEN p_partkey % 10 = 6 THEN '_A_'
                  ELSE concat('_', repeat('AC', cast(p_partkey % 3 AS int)), '_GG') END) AS k""",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig, start, end, ord``."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('chr', cast(floor(event_id / 500) % 3 + 1 AS string)) AS contig",
        "event_id * 37 % 50000 AS start",
        "event_id * 37 % 50000 + user_id % 200 + 1 AS `end`",
        "event_id AS ord",
    )


_DNA = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_BASES}')"
_NAMES = ", ".join(f"'{s}'" for s in SPELLINGS)
_FASTQ = """SELECT {rec} AS rec, '@read' || doc_id || ' {mate}:N:0' AS header, seq AS sequence, '+' AS plus,
  repeat('I', length(seq)) AS quality FROM dna WHERE {where}"""
VIEWS = {
    "reads": """SELECT 'chr' || (l_suppkey % 3 + 1) AS contig, (l_partkey * 7 + l_linenumber * 131 + l_orderkey) % 20000 AS pos0,
  20 + cast(l_quantity AS bigint) % 30 AS len, l_orderkey * 8 + l_linenumber AS rid FROM lineitem""",
    "targets": "SELECT 'chr' || (o_custkey % 3 + 1) AS contig, o_orderkey % 20000 + 1 AS pos, o_orderkey AS ord FROM orders",
    "dna": f"SELECT doc_id, {_DNA} AS seq FROM documents",
    "dna_pieces": """SELECT doc_id, cast(off // 168 AS int) AS piece, substring(seq, cast(off AS int) + 1, 168) AS seq
  FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 168)) AS off FROM dna)""",
    "fastq_r1": _FASTQ.format(rec="doc_id // 2", mate=1, where="doc_id % 2 = 0"),
    "fastq_r2": _FASTQ.format(
        rec="(doc_id // 10) * 4 + (doc_id % 10) // 2", mate=2, where="doc_id % 2 = 1 AND doc_id % 10 <> 9"
    ),
    "contig_index": f"""SELECT [{_NAMES}][cast(s_suppkey % {len(SPELLINGS)} AS int) + 1] AS name, s_suppkey * 37 % 1000 AS len,
  s_suppkey AS ord FROM supplier""",
    "variants": """SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN '7' WHEN 2 THEN 'EBV' ELSE 'chrM' END,
  '_', CASE WHEN p_partkey % 10 = 3 THEN 'x1' WHEN p_partkey % 50 = 7 THEN '' ELSE cast(p_partkey * 11 AS varchar) END,
  CASE WHEN p_partkey % 10 = 4 THEN '_A' WHEN p_partkey % 10 = 5 THEN '_A_C_G' WHEN p_partkey % 10 = 6 THEN '_A_'
       ELSE '_' || repeat('AC', p_partkey % 3) || '_GG' END) AS k FROM part""",
    "regions": """SELECT 'chr' || (event_id // 500 % 3 + 1) AS contig, event_id * 37 % 50000 AS start,
  event_id * 37 % 50000 + user_id % 200 + 1 AS "end", event_id AS ord FROM events""",
}


def with_views(query: str, *names: str, recursive: bool = False) -> str:
    """SQL of a query over derived views."""
    needs = {"dna_pieces": ["dna"], "fastq_r1": ["dna"], "fastq_r2": ["dna"]}
    all_ = list(dict.fromkeys(x for n in names for x in (*needs.get(n, ()), n)))
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in all_)
    more = query.strip()
    head = f"WITH {'RECURSIVE ' if recursive else ''}{views}"
    return f"{head},\n{more[5:].strip()}" if more.upper().startswith("WITH ") else f"{head}\n{more}"
