"""A folder to which FASTQ files are added, as a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fastq_records(texts: DataFrame) -> DataFrame:
    """``file, rec, header, sequence, plus, quality`` of whole files (``file, value``); raises where one ends within a record."""
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)
    n = F.when(F.col("value") == "", F.lit(0)).otherwise(F.size(lines))
    whole = F.when(n % 4 != 0, F.raise_error(F.lit("Unexpected EOF in fastq.")).cast("int")).otherwise((n / 4).cast("int"))
    rows = texts.select("file", lines.alias("lines"), whole.alias("n")).where("n > 0")
    numbered = rows.select("file", "lines", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("rec"))
    line = lambda k: F.get("lines", F.col("rec") * 4 + k)
    return numbered.select(
        "file", F.col("rec").cast("long").alias("rec"), line(0).alias("header"), line(1).alias("sequence"), line(2).alias("plus"),
        line(3).alias("quality"),
    )


def read_fastq_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Records of the files in a folder and of those added to it; each file is read once, as a whole."""
    texts = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return fastq_records(texts.select(F.input_file_name().alias("file"), "value"))


def process_stream(
    records: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, format: str = "parquet"
) -> StreamingQuery:
    """Change records as they come and append them to ``path``, each exactly once; ends when the folder is read."""
    return (
        change(records).writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
