"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The words of the benchmark items are numbered; every document becomes the sequence of those numbers, and its n-grams are
looked up among the items' n-grams.  An n-gram that few items have (``MOST_ITEMS`` at most) is a seed: it joins a document to
these items.  One that many items share, such as a common instruction, would join each of them to every document that holds it;
it joins only items of which the document has a rare word, too.  These are the rarest words of an item that are so many that the
others alone cannot reach ``min_score``, so nothing is lost.  How frequent an n-gram is among the documents does not matter:
passages that are copied often are frequent themselves.

Hits of an item on nearby diagonals are one passage, with as many words around it as the gaps of an alignment that reaches
``min_score`` can take.  A passage is aligned with its item unless the words that both have in common cannot reach ``min_score``
even if all match; the score is the share of the best possible score, so an edited or shortened copy scores by how much of the
item it repeats.  A copy without a single whole n-gram has no seed and is not found.

The items are broadcast in blocks of ``block_bytes`` of text at most, which is checked; one scan of the documents per block.

Special cases: null or empty texts have no words and match nothing; a text of any length is searched as a whole; items shorter
than an n-gram are one n-gram as a whole; items that repeat are judged each for itself; of alignments with equal scores the one
that ends first in item and document counts, of passages with equal scores the first; rows that repeat a ``doc_id`` count as one
document, which has the best score of them; null ids are kept as a document without id; an empty table on either side gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import decoded, id_and_text

SEED_WORDS, MIN_SCORE, BLOCK_BYTES, MOST_ITEMS = 4, 0.4, 4 << 20, 64
MATCH, MISMATCH, GAP = 2, -1, -1
_PLAIN = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: str) -> list[bytes]:
    """Words without ASCII punctuation, in lower case."""
    return text.lower().encode().translate(_PLAIN).split()


def _listed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where the values of each begin (and the last end), and the values by key."""
    order = np.argsort(keys, kind="stable")
    distinct, starts = np.unique(keys[order], return_index=True)
    return distinct, np.append(starts, len(keys)), [v[order] for v in values]


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of the keys ``which``, and for each place the position in ``which``."""
    sizes = starts[which + 1] - starts[which]
    of = np.repeat(np.arange(len(which)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which][of], of


class Items:
    """A block of benchmark items: numbered words, n-grams by key, and the rare words of each item."""

    def __init__(self, rows: list[tuple[int, str]], n: int, min_score: float = MIN_SCORE, most_items: int = MOST_ITEMS):
        self.n, self.min_score, self.ids, self.words, self.vocabulary = n, min_score, [], [], {}
        for item_id, text in rows:
            words = words_of(text or "")
            if words:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                self.ids.append(item_id)
                self.words.append(np.array(numbers, np.int32))
        self.bags = [np.unique(ids, return_counts=True) for ids in self.words]
        self.widths = {min(n, len(ids)) for ids in self.words}
        found = [self.keys(ids, min(n, len(ids)))[0] for ids in self.words]
        none = np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int32)
        offset = np.concatenate([none, *(np.arange(len(f)) for f in found)]).astype(np.int32)
        self.grams, self.starts, (self.owner, self.offset) = _listed(np.concatenate([none, *found]), owner, offset)
        self.common_grams = np.diff(self.starts) > most_items
        # Of each item the rarest words; what is left of it is less than min_score.
        held = np.bincount(np.concatenate([none, *(b[0] for b in self.bags)]).astype(np.int64), minlength=len(self.vocabulary))
        rare, owners = [none], [none]
        for k, (words, counts) in enumerate(self.bags if self.common_grams.any() else ()):
            order = np.argsort(held[words], kind="stable")
            left = counts.sum() - np.concatenate(([0], np.cumsum(counts[order])[:-1]))
            rare.append(words[order][left >= min_score * counts.sum()].astype(np.int64))
            owners.append(np.full(len(rare[-1]), k))
        self.rare, self.rare_starts, (self.rare_owner,) = _listed(np.concatenate(rare), np.concatenate(owners))

    @staticmethod
    def keys(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams without an unknown word, and their places."""
        m = len(ids) - width + 1
        if m < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, known = np.full(m, width, np.uint64), np.ones(m, bool)
        for k in range(width):
            part = ids[k : k + m].astype(np.int64)
            key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            known &= part >= 0
        at = np.flatnonzero(known)
        return key[at].view(np.int64), at

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def with_rare_words(self, ids: np.ndarray) -> np.ndarray:
        """Of which items a document has a rare word."""
        found = np.zeros(len(self.words), bool)
        which = np.flatnonzero(np.isin(self.rare, ids))
        found[self.rare_owner[_spread(self.rare_starts, which)[0]]] = True
        return found

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and diagonal of the n-grams that a document shares with items, in that order."""
        items, diagonals, likely = [], [], None
        for width in self.widths:
            keys, at = self.keys(ids, width)
            if not len(keys):
                continue
            near = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
            seen = np.flatnonzero(self.grams[near] == keys)
            which, place = near[seen], at[seen]
            if likely is None and self.common_grams[which].any():
                likely = self.with_rare_words(ids)
            for common in (False, True):
                mine = self.common_grams[which] == common
                if not mine.any():
                    continue
                for low in range(0, int(mine.sum()), 64 if common else 1 << 30):  # a few of the long lists at once
                    some = np.flatnonzero(mine)[low : low + (64 if common else 1 << 30)]
                    rows, of = _spread(self.starts, which[some])
                    if common:
                        stay = likely[self.owner[rows]]
                        rows, of = rows[stay], of[stay]
                    items.append(self.owner[rows])
                    diagonals.append(place[some][of] - self.offset[rows])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        item, diagonal = np.concatenate(items).astype(np.int64), np.concatenate(diagonals).astype(np.int64)
        order = np.lexsort((diagonal, item))
        return item[order], diagonal[order]

    def passages(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item, from, to)`` of the places of a document that share n-grams with an item."""
        item, diagonal = self.hits(ids)
        if not len(item):
            return
        sizes = np.array([len(self.words[k]) for k in item.tolist()])
        # What all words of the item score beyond min_score may be spent on gaps, which leave the diagonal.
        slack = (MATCH * sizes * (1 - self.min_score)).astype(np.int64) // -GAP + self.n
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        low, high = diagonal[first] - slack[first], diagonal[last] + sizes[first] + slack[first]
        yield from zip(item[first].tolist(), np.maximum(low, 0).tolist(), np.minimum(high, len(ids)).tolist())

    def matches(self, text: str | None) -> Iterator[tuple[int, float, int, int]]:
        """``(item id, score, first word, end word)`` of the passages of a text that repeat an item."""
        ids = self.numbers(text or "")
        for item, low, high in self.passages(ids):
            mine, passage = self.words[item], ids[low:high]
            if self.common(item, passage) / len(mine) < self.min_score:
                continue
            points, a, b = align(mine, passage)
            share = points / (MATCH * len(mine))
            if share >= self.min_score:
                yield self.ids[item], share, low + a, low + b

    def common(self, item: int, passage: np.ndarray) -> int:
        """How many words of the item the passage has, in any order: no alignment matches more."""
        words, counts = self.bags[item]
        near = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        return int(np.minimum(np.bincount(near[words[near] == passage], minlength=len(words)), counts).sum())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with a linear gap cost: ``(score, from, to)``, the aligned words of the passage."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        slope = -GAP * np.arange(1, len(b) + 1)
        row, top = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(a):
            new = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
            new = np.maximum(new, 0)
            new = np.maximum.accumulate(new + slope) - slope  # gaps along the passage
            j = int(new.argmax())
            if new[j] > top[0]:
                top = (int(new[j]), i, j)
            row = np.concatenate(([0], new))
        return top

    score, i, j = best(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[: i + 1][::-1], passage[: j + 1][::-1])
    return score, j - back, j + 1


def _matches(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(d, *m) for d, text in zip(ids, decoded(batch.column("text"))) for m in known.matches(text)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "first_word", "end_word"]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def item_blocks(
    benchmark: DataFrame, seed_words: int, min_score: float, block_bytes: int, item_col: str, item_text_col: str
) -> Iterator[Items]:
    """The items in blocks of ``block_bytes`` of text at most; raises for an item that is larger by itself."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text")
    ).distinct()
    size = F.octet_length("text")
    total, largest = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if largest > block_bytes:
        raise ValueError(f"an item of {largest} bytes is not broadcast; blocks have {block_bytes}")
    blocks, block = 1, F.lit(0)
    while total > block_bytes:
        blocks = max(blocks * 2, -(-2 * total // block_bytes))  # half full on average, as items fall into blocks by hash
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        total = items.groupBy(block).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0]
    for k in range(blocks):
        found = Items([(r["item_id"], r["text"]) for r in items.where(block == k).collect()], seed_words, min_score)
        if found.words:
            yield found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE,
    block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item that it repeats: ``doc_id, item_id, score, first_word, end_word``.

    The span counts the document's words without punctuation.
    """
    texts = id_and_text(docs, id_col, text_col)
    found = None
    for items in item_blocks(benchmark, seed_words, min_score, block_bytes, item_col, item_text_col):
        part = _matches(texts, items)
        found = part if found is None else found.union(part)
    if found is None:
        found = texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"),
                             F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("end_word")).where("false")
    best = F.max(F.struct("score", -F.col("first_word"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), "best.end_word"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE,
    block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents that repeat no item, with all their columns.

    Each row is judged by its own text, whatever its id; nothing is shuffled.
    """
    position = docs.columns.index(text_col)
    for items in item_blocks(benchmark, seed_words, min_score, block_bytes, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(shared.value.matches(t), None) is None for t in decoded(batch.column(position))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
