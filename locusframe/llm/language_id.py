"""Language identification by compression.

For every language a Zstandard raw-content dictionary is made of training texts.  A text is encoded once with each dictionary;
the language whose dictionary makes it smallest is the prediction.  The margin to the runner-up is the score's basis: where it
is narrow the row is marked ``rejected``, and callers may treat that as unknown.  ``lang_pred`` still names the best language,
since only texts that are null or have no letter are ``und``.

What is encoded is the sequence of the distinct words of the whole text, lower-cased and freed of all but letters, so that
neither capitals, junk characters nor a word said a thousand times count.  A dictionary holds the words of its language's
sample in the same form, the most frequent last, where references are cheapest, up to ``dictionary_bytes``.

The words come from a bounded sample: ``sample_bytes`` of text per language, of the documents with the smallest hash of
their text, each text once, so that the sample neither depends on the order of rows nor grows with the input.  Of a text of more
than a quarter of that the sample has as many characters.  More than ``max_languages`` languages are an error, since counts and
dictionaries of each reach the driver and all tasks.

Special cases: a text of any length is judged as a whole; null text and text without a letter: ``und`` with score 0; texts of equal size under two dictionaries go to
the language with more training documents, then the smaller name; no training rows at all: ``und`` for every text; rows that
repeat are judged row by row; null ids are allowed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import decoded

SAMPLE_BYTES = 4_000_000
DICTIONARY_BYTES = 32_768
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def distinct_words(text: str) -> list[str]:
    """Distinct words in the order of their first place: lower case, letters only."""
    rough = " ".join(dict.fromkeys(text.split()))
    return list(dict.fromkeys(_OTHER.sub(" ", rough.lower()).split()))


def dictionaries(
    docs: DataFrame, train: Column, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES,
    text_col: str = "text", lang_col: str = "lang", max_languages: int = 200,
) -> list[tuple[str, int, bytes]]:
    """``(language, training documents, sample)``, the language with most documents first."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length(text_col)).cast("double").alias("bytes")
    ).limit(max_languages + 1).collect()  # one row per language
    if not counts:
        return []
    if len(counts) > max_languages:
        raise ValueError(f"{len(counts)} languages; more than {max_languages} dictionaries are not broadcast")
    # A share of each language's documents that holds about twice the bytes asked for, at least some 64 documents.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * sample_bytes / max(r["bytes"], 1) + 64 / r["n"]))])
    rank = F.xxhash64(F.lit("sample"), F.col(text_col))
    sample = (
        rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), rank.alias("rank"))
        .where(F.pmod("rank", F.lit(1_000_003)) / 1_000_003.0 <= share[F.col("lang")])
        .dropDuplicates(["lang", "rank"])  # copies count once, so no group of them can fill the sample
        .withColumn("text", F.substring("text", 1, sample_bytes // 4))
        .collect()  # about twice sample_bytes per language
    )
    words: dict[str, Counter] = {r["lang"]: Counter() for r in counts}
    room = dict.fromkeys(words, sample_bytes)
    for r in sorted(sample, key=lambda r: (r["rank"], r["text"])):
        if room[r["lang"]] > 0:
            room[r["lang"]] -= len(r["text"].encode())
            words[r["lang"]].update(distinct_words(r["text"]))
    by_size = sorted(counts, key=lambda r: (-r["n"], r["lang"]))
    return [(r["lang"], r["n"], _dictionary(words[r["lang"]], dictionary_bytes)) for r in by_size]


def _dictionary(words: Counter, most_bytes: int) -> bytes:
    chosen, room = [], most_bytes
    for word, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        room -= len(word.encode()) + 1
        if room < 0:
            break
        chosen.append(word)
    return (" ".join(reversed(chosen)) + " ").encode() if chosen else b""


class Encoder:
    """Sizes of a text under each dictionary; made once per task."""

    def __init__(self, samples: list[tuple[str, int, bytes]], level: int = 7):
        self.languages = [s[0] for s in samples]
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_dict_id=False)
        self.encoders = []
        for _, _, data in samples:
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params) if data else None)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = " ".join(distinct_words(text)).encode() + b" "
        sizes = [len(e.compress(data)) if e else len(data) + 16 for e in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        other = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best] + 1)
        lead = (other - sizes[best]) / other
        return self.languages[best], min(1.0, 0.5 + 2 * lead), lead < margin


def identify(
    docs: DataFrame, train: Column, margin: float = 0.01, sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, rejected``; ``train`` says which rows may be learned from."""
    samples = dictionaries(docs, train, sample_bytes, dictionary_bytes, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [encoder.predict(x, margin) for x in decoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
