"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last keep the columns of ``documents``, whatever further ones there are.

In every stage a row is judged by its own text and place in the files, so null ids and ids that repeat do no harm; null text
counts as empty, which no stage but the dedups drops; a text of any length is read as a whole; no documents give no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm._common import scratch, stored
from locusframe.llm.best_fit import pack
from locusframe.llm.decontaminate import drop_contaminated
from locusframe.llm.exact_dedup import drop_exact_duplicates
from locusframe.llm.simhash_copies import keep_one_of_each
from locusframe.llm.queries import id_remainder, table, tokenizer_path
from locusframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go.  Learned as in the query op5, on the documents of this stage."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), id_remainder(5) != 0)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space apart, the row with the smallest id stays; one of several with that id."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; one of several with that id.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles, which is verified.  Candidates are found by SimHash, an
    index of its positional bytes and a count filter, as in op6; its 1024 bits reach these pairs, op6's 64 reach few of them.
    """
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, and where each stands in which sequence."""
    # Half the words that a task remembers alone: four stages have filled the executors by now.
    return pack(docs, tokenizer_path(), capacity=2048, end_id=0, memory_bytes=32 << 20, text_bytes=1 << 20)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A learned score, alignments and a packing have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:  # what a stage wrote for itself goes when its documents are written
            docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
            made[:], written = [*made[:-1], *before], made[-1]
        before = [written]
    return STAGES[-1][1](spark, docs, sf_dir)
