"""Toxicity of texts from a learned lexicon, misspellings included.

The lexicon is learned from labelled documents: words that are far more frequent in toxic documents than in others.  Its terms
form tries, one from the front and one from the back.  A word of a text matches a term if the Levenshtein automaton of the word,
walked along a trie, accepts.  A word within one edit of a term has half of it undamaged, so the walk starts where that half
ends.  A word that a task remembers is not walked again; what it remembers is bounded in bytes.

Every match is looked at in a window of words around it: whether it stands between quotation marks, how many other matches are
near.  Counts of exact, misspelled, quoted and crowded matches and the terms' weights are the features of a logistic
regression, whose coefficients are learned too.  To keep that honest each half of the training sample is described with the
lexicon of the other half; texts are then scored with the lexicon of both.

Only the learning uses a sample: ``train_rows`` labelled documents (20,000), those with the smallest hash of their id, and about
as many of their texts where ids repeat.  All documents and whole texts are scored.

Special cases: null and empty texts have no match and get the score of a text without any; a text of any length is scored as a
whole, and quotation marks are followed through all of it; of terms that are equally near to a word the heaviest counts, then the
last in the alphabet; without labelled rows of both kinds every score is 0; labels that are null are not learned from; equal
texts are learned once per label; rows that repeat are scored row by row, whatever texts the same task has; bytes that are no UTF-8 are replaced; null ids are allowed; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import decoded, id_and_text, slices, stored

TRAIN_ROWS, MOST_TERMS, WINDOW = 20_000, 4000, 8
#: Bytes of words that a reader remembers, in two generations, and what a word costs besides its letters.
MEMORY_BYTES, WORD_BYTES = 24 << 20, 90
MIN_DOCUMENTS, MIN_CONTEXTS, MIN_RATIO, FUZZY_LENGTH = 3, 3, 8.0, 5
_PLAIN = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_OPEN, _CLOSE = "\"'«“„‘(", "\"'»”’)"


def words_of(text: str) -> list[bytes]:
    """Words between white space of any kind and ASCII punctuation: those of the text are those of its parts, one after the other."""
    return " ".join(text.lower().split()).encode("utf-8", "replace").translate(_PLAIN).split()


@dataclass
class Lexicon:
    """Terms with weights, in a trie from the front and one from the back.

    A word within one edit of a term has the term's first or second half undamaged.  The walk starts where that half ends, in
    the one trie or the other, so most words end before a first step.
    """

    weights: dict[str, float]
    heads: dict[str, dict] = field(default_factory=dict)
    tails: dict[str, dict] = field(default_factory=dict)
    sizes: tuple = ()

    def __post_init__(self) -> None:
        front: dict = {}
        back: dict = {}
        for term in self.weights:
            if len(term) < FUZZY_LENGTH:
                continue
            half = len(term) // 2
            for root, letters, size, halves in ((front, term, half, self.heads), (back, term[::-1], len(term) - half, self.tails)):
                node = root
                for k, c in enumerate(letters, 1):
                    node = node.setdefault(c, {})
                    if k == size:
                        halves[letters[:k]] = node
                node[""] = term
        self.sizes = (tuple(sorted({len(h) for h in self.heads})), tuple(sorted({len(t) for t in self.tails})))

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance (0 or 1; the heaviest of equals)."""
        if word in self.weights:
            return word, 0
        if len(word) < FUZZY_LENGTH - 1:
            return None
        found: set[str] = set()
        reverse = word[::-1]
        for letters, halves, sizes in ((word, self.heads, self.sizes[0]), (reverse, self.tails, self.sizes[1])):
            for k in sizes:
                node = halves.get(letters[:k])
                if node is not None and len(letters) >= k:
                    found.update(accepted(node, letters[k:]))
        return (max(found, key=lambda t: (self.weights[t], t)), 1) if found else None


def accepted(node: dict, word: str, edits: int = 1) -> list[str]:
    """Terms below a node of a trie whose remaining letters the Levenshtein automaton of ``word`` accepts.

    A state is the row of edit counts to each prefix of the word; a branch ends when no count is small enough.
    """
    n, found = len(word), []
    stack = [(node, tuple(range(n + 1)))]
    while stack:
        node, row = stack.pop()
        term = node.get("")
        if term is not None and row[n] <= edits:
            found.append(term)
        for c, below in node.items():
            if c:
                new = [row[0] + 1]
                for k in range(n):
                    new.append(min(row[k] + (word[k] != c), row[k + 1] + 1, new[k] + 1))
                if min(new) <= edits:
                    stack.append((below, tuple(new)))
    return found


class Reader:
    """Features of texts under a lexicon; remembers the words it has walked."""

    FEATURES = 7

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.matched: dict[bytes, tuple[str, int]] = {}
        self.seen: set[bytes] = set()
        self.before: set[bytes] = set()
        self.used = 0

    def features(self, text: str) -> list[float] | None:
        """None for a text without a match."""
        words = words_of(text)
        distinct = set(words)
        new = distinct - self.seen
        if new:
            walk = new - self.before if self.before else new
            for w in walk:
                if (hit := self.lexicon.near(w.decode())) is not None:
                    self.matched[w] = hit
            self.seen |= new
            self.used += sum(map(len, new)) + WORD_BYTES * len(new)
            if self.used > MEMORY_BYTES // 2:  # the generation before goes, but for this text's words
                self.before, self.seen, self.used = self.seen, set(distinct), 0
                self.matched = {w: hit for w, hit in self.matched.items() if w in self.before}
        if not self.matched or distinct.isdisjoint(self.matched):
            return None
        # ``matched`` may hold words of other texts too, but whether a word is in it follows from the word alone.
        hits, quoted_words, depth = [], [], 0
        place = 0
        for raw in text.lower().split():
            depth = max(0, depth + (raw[0] in _OPEN) * 1)
            for w in words_of(raw):
                if w in self.matched:
                    hits.append((place, *self.matched[w]))
                    quoted_words.append(depth > 0)
                place += 1
            if raw.rstrip(".,;:!?")[-1:] in _CLOSE or len(raw) > 1 and raw[-1] in _CLOSE:
                depth = max(0, depth - 1)
        weight = self.lexicon.weights
        places = np.array([h[0] for h in hits])
        crowd = np.searchsorted(places, places + WINDOW, "right") - np.searchsorted(places, places - WINDOW)
        exact = [weight[t] for (_, t, d), q in zip(hits, quoted_words) if d == 0 and not q]
        fuzzy = [weight[t] for (_, t, d), q in zip(hits, quoted_words) if d and not q]
        quoted = [weight[t] for (_, t, _), q in zip(hits, quoted_words) if q]
        return [
            math.log1p(sum(exact)),
            math.log1p(sum(fuzzy)),
            math.log1p(sum(quoted)),
            max(exact, default=0.0),
            math.log1p(len({t for _, t, d in hits if not d})),
            math.log(int(crowd.max())),
            len(hits) / math.sqrt(len(words)),
        ]


def _share(hashed: Column, rows: int, of: int) -> Column:
    """Whether a row is among a share of about ``rows`` of ``of`` rows."""
    return F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, rows / max(of, 1)) * (1 << 30))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, rows: int) -> DataFrame:
    """``text, toxic, half`` of the distinct texts of ``rows`` labelled documents; stored."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(train).select("doc_id", "toxic").distinct()
    rank = F.xxhash64(F.lit("toxicity"), "doc_id")
    # The broadcast side has ``rows`` rows at most.
    chosen = labelled.where(_share(rank, 2 * rows, labelled.count())).orderBy(F.pmod(rank, F.lit(1 << 30)), "doc_id", "toxic").limit(rows)
    found = docs.join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    )
    # Copies count once, and never in both halves.
    found = stored(found.groupBy("text", "toxic").agg(F.min("half").alias("half")), "labelled")
    n = found.count()
    return found if n <= rows else found.where(_share(F.xxhash64(F.lit("texts"), "text"), rows, n))


def _word_counts(sample: DataFrame) -> tuple[dict, np.ndarray]:
    """Documents by half and label, and of each word that may be a term in any of the lexicons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            words, before, kinds = [], [], []
            for text, toxic, half in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                mine = words_of(text)
                # Of each word the last place counts: the word before it there.
                last = {w: p for w, p in zip(mine, [b"", *mine]) if len(w) > 2}
                words += [w.decode() for w in last]
                before += [zlib.crc32(p) for p in last.values()]
                kinds += [2 * half + toxic] * len(last)
            columns = [pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(kinds, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "before", "kind"])

    totals = np.zeros(4)
    for r in sample.groupBy("half", "toxic").count().collect():
        totals[2 * r["half"] + r["toxic"]] = r["count"]
    by_kind = [F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in range(4)]
    toxic, clean = F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]
    ratio = F.lit(MIN_RATIO / 4 * (totals[1] + totals[3] + 1) / (totals[0] + totals[2] + 1))
    found = (
        sample.mapInArrow(run, "word string, before long, kind int")
        .groupBy("word", "before")
        .agg(*by_kind)
        .groupBy("word")
        .agg(*sums, F.count_if(toxic > 0).alias("contexts"))
        .where((toxic >= MIN_DOCUMENTS) & ((toxic + 0.5) / (clean + 0.5) > ratio))
        # What stands in one copied passage only is not a term.  No share of the documents: neighbours grow more slowly.
        .where(F.col("contexts") >= MIN_CONTEXTS)
        .orderBy(F.desc(toxic * F.log((toxic + 0.5) / (clean + 0.5) / ratio)), "word")
        .limit(2 * MOST_TERMS)
        .collect()
    )
    return {r["word"]: np.array([r[f"n{k}"] for k in range(4)], float) for r in found}, totals


def lexicon(words: dict, totals: np.ndarray, halves: tuple[int, ...]) -> Lexicon:
    clean, toxic = sum(totals[2 * h] for h in halves), sum(totals[2 * h + 1] for h in halves)
    least = max(MIN_DOCUMENTS if len(halves) > 1 else 2, toxic / 400)
    weights = {}
    for w, n in words.items():
        a, b = sum(n[2 * h + 1] for h in halves), sum(n[2 * h] for h in halves)
        ratio = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))
        if a >= least and ratio >= MIN_RATIO:
            weights[w] = (a * math.log(ratio), math.log(ratio))
    best = sorted(weights, key=lambda w: (-weights[w][0], w))[:MOST_TERMS]
    return Lexicon({w: weights[w][1] for w in best})


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray | None


class Scorer:
    """Scores of texts; made once per task."""

    def __init__(self, model: Model):
        self.reader, self.w = Reader(model.lexicon), model.coefficients

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.w is None or not len(texts):
            return np.zeros(len(texts))
        x = np.array([(t and self.reader.features(t)) or [0.0] * Reader.FEATURES for t in decoded(texts)])
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, train: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic; ``train``: which rows may be learned from."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, train, train_rows)
    words, totals = _word_counts(sample)
    if not (totals[0] + totals[2]) or not (totals[1] + totals[3]):
        return Model(Lexicon({}), None)
    halves = spark.sparkContext.broadcast([lexicon(words, totals, (1,)), lexicon(words, totals, (0,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in halves.value]
        for part in (p for batch in batches for p in slices(batch, "text")):
            rows = zip(*(part.column(c).to_pylist() for c in ("text", "half")))
            x = [readers[half].features(text) or [0.0] * Reader.FEATURES for text, half in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, toxic int").collect()  # about train_rows at most
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    return Model(lexicon(words, totals, (0, 1)), fit(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p = scorer.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, score, predicted``; the labels of rows where ``train`` (of ``doc_id``) holds are learned."""
    texts = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic"))
    return score(texts, learn(texts, known, F.lit(True) if train is None else train, train_rows))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, threshold: float = 0.5,
) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns; the texts are not shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic"))
    model = learn(id_and_text(docs, id_col, text_col), known, F.lit(True) if train is None else train, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p = scorer.scores(batch.column(position))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
