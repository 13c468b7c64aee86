"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (with word edges); each n-gram hashes to a learned vector. The vectors of a
window of ``WINDOW`` words are averaged and go through a linear softmax. A text's score is that of its most toxic window,
over every window of the whole text: a toxic word is found in a text of any length, and misspellings and unseen endings
of it share its n-grams. Words beside a toxic one dilute it, so a window is one word: windows of two find fewer toxic texts.

Vectors and softmax are trained jointly in numpy, by Adam; each round sums over all training texts, some at a time. A toxic text is taken to have at
least one toxic window, any other none: with window odds p, the chance of a toxic text is 1 - prod(1 - p), so each window
of a toxic text learns in proportion to how far it explains the label, and no first guess locks in. In each round only
``KEEP`` of a toxic text's windows, drawn anew, are asked, so that words which always stand beside others that explain
the label learn too; in every ``MISSPELT``-th round each word has one letter inserted, deleted or replaced. N-grams met in
the words of one text only have no vector, and vectors decay, so that the model doesn't learn texts by heart.

Training reads at most ``PER_CLASS`` labelled texts of each class (those of smallest hash of their id; of several texts
of one id that of smallest hash) and of these, in that order, ``CLASS_BYTES`` bytes a class, without texts above
``TEXT_BYTES``; in one task, and the model has a fixed size. Everything else covers all rows.

Defined results: null and empty texts get the score of an empty bag; null ids are scored; labels that are null do not
count, and of several for one id the highest counts; rows that repeat are scored alike, each for itself; without
labelled rows of both classes every score is that of the untrained model, near 0; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longspan.llm.common import lean, table, trim

PER_CLASS = 3000
CLASS_BYTES = 8 << 20
TEXT_BYTES = 1 << 20
WINDOW = 1
DIM = 8
BITS = 18
GRAMS = (3, 4, 5, 6)
ROUNDS = 80
RATE = 0.1  # of the first half of the rounds; then it falls to 0
DECAY = 1e-4
KEEP = 0.3  # of a toxic text's windows, others in every round
MISSPELT = 3  # every so many rounds all words are misspelt
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PRIOR = -4.0  # log odds of a window before anything is learned
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
WORDS_KEPT = 400_000
PART = 20_000
TOKENS = 1 << 17  # of training texts that are worked on at once, but for a longer text
SLICE = 256  # texts whose words are held at once


def words(text: str | None) -> list[str]:
    return [w.strip(EDGES) or w for w in (text or "").lower().split()]


def grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram bucket, number of its word) of all n-grams of all names."""
    size = np.array([len(w) + 2 for w in names])
    code = np.frombuffer(("<" + "><".join(names) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(names)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    buckets, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = left[: len(h)] >= n
        buckets.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(word[: len(h)][whole].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(owners)


def gram_parts(names: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of names, and their grams, of parts of names that are small enough to be worked on at once."""
    return ((len(some), *grams(some)) for some in (names[k : k + PART] for k in range(0, len(names), PART)))


class Model:
    """Vectors of n-grams (zero where nothing was learned), softmax and bias."""

    def __init__(self):
        self.vectors = np.zeros((1 << BITS, DIM), np.float32)
        self.softmax, self.bias = np.zeros((DIM, 2)), np.array([0.0, PRIOR])
        self.trained = False

    @cached_property
    def slope(self) -> np.ndarray:
        """Each n-gram's share in a window's log odds: under the softmax an average of vectors is an average of numbers."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    def numbers(self, names: list[str]) -> np.ndarray:
        """Each word's share in a window's log odds."""
        return np.concatenate([np.bincount(word, self.slope[bucket], n) / np.bincount(word, minlength=n) for n, bucket, word in gram_parts(names)])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every window of texts of these numbers of words, laid end to end; a shorter text is one window."""
    n = np.where(size > 0, np.maximum(1, size - WINDOW + 1), 0)
    text = np.repeat(np.arange(len(size)), n)
    start = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)
    return text, start, start + np.minimum(WINDOW, size)[text]


def shared_buckets(parts: list[tuple[int, np.ndarray, np.ndarray]], docs: list[np.ndarray], n: int) -> np.ndarray:
    """The buckets of n-grams that words of more than one text hold, in order."""
    first, last = np.full(n, len(docs)), np.full(n, -1)
    for i, d in enumerate(docs):
        last[d] = i
    for i in range(len(docs) - 1, -1, -1):
        first[docs[i]] = i
    low, high, at = np.full(1 << BITS, len(docs)), np.full(1 << BITS, -1), 0
    for size, bucket, word in parts:
        np.minimum.at(low, bucket, first[at + word])
        np.maximum.at(high, bucket, last[at + word])
        at += size
    return np.flatnonzero(high > low)


def misspelt(word: str, rng: np.random.Generator) -> str:
    """word with one letter inserted, deleted or replaced."""
    k, way, c = int(rng.integers(len(word))), int(rng.integers(3)), LETTERS[int(rng.integers(len(LETTERS)))]
    return (word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :])[way] or word


def spans(size: np.ndarray, tokens: int) -> list[tuple[int, int]]:
    """(first text, text after the last) of runs of whole texts of these numbers of words: at most so many words, or one text."""
    out, lo, ends = [], 0, np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + tokens, "right")))
        out.append((lo, hi))
        lo = hi
    return out


class Words:
    """The windows of training texts, whose words are numbers laid end to end. Sums of them take a run of texts at a time."""

    def __init__(self, docs: list[np.ndarray], label: np.ndarray):
        self.size, self.tokens, self.label = np.array([len(d) for d in docs]), np.concatenate(docs), label
        self.weight = np.where(label, 0.25 / label.sum(), 0.5 / (~label).sum())
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.err = np.empty(len(windows(self.size)[0]))

    def slopes(self, z: np.ndarray, bias: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """Of the loss: that by each word's number and that by the bias, when words have numbers z."""
        out, so_far, back_so_far, left, at = np.zeros(len(z)), 0.0, 0.0, 0.0, 0
        for lo, hi in spans(self.size, TOKENS):
            tokens = self.tokens[self.begin[lo] : self.begin[hi]]
            text, start, end = windows(self.size[lo:hi])
            length, toxic = end - start, self.label[lo:hi][text]
            total = np.cumsum(np.concatenate([[so_far], z[tokens]]))
            so_far = total[-1]
            odds = (total[end] - total[start]) / length + bias[1] - bias[0]
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            p *= ~toxic | (rng.random(len(text)) < KEEP)
            clean = np.exp(np.bincount(text, np.log1p(-p), hi - lo))[text]  # chance that no window of its text is toxic
            err = self.err[at : at + len(text)]
            err[:] = self.weight[lo:hi][text] * p * np.where(toxic, -clean / np.maximum(1 - clean, 1e-9), 1)
            at += len(text)
            each = err / length
            ended = np.bincount(end, each, len(tokens) + 1)
            ended[0] = left
            left = ended[-1]
            back = (np.bincount(start, each, len(tokens) + 1) - ended)[:-1]
            if len(back):
                back[0] += back_so_far
                back = np.cumsum(back)
                back_so_far = back[-1]
            np.add.at(out, tokens, back)
        return out, self.err.sum()


def train(texts: Iterable[str | None], labels: list[int], seed: int = 7) -> Model:
    model, rng = Model(), np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.int32) for t in texts]
    label = np.array(labels, bool)
    if not index or label.all() or not label.any():
        return model
    names = list(index)
    del index
    parts = list(gram_parts(names))
    used = shared_buckets(parts, docs, len(names))
    held = Words(docs, label)
    del docs
    place = np.full(1 << BITS, len(used), np.int32)  # of a bucket among used ones; all others have no vector
    place[used] = np.arange(len(used))

    def placed(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
        """Number of names, places and names of the used grams, and numbers of all grams of each name."""
        out = []
        for n, bucket, word in parts:
            some = place[bucket] < len(used)
            out.append((n, place[bucket][some], word[some].astype(np.uint16), np.bincount(word, minlength=n)))
        return out

    spelt = placed(parts.pop(0) for _ in range(len(parts)))
    odd = [misspelt(w, rng) for w in names]
    del names
    odd = placed(gram_parts(odd))
    trim()
    state = [rng.normal(0, 0.1, (len(used) + 1, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.array([0.0, PRIOR])]
    state[0][-1] = 0  # a last place that stays 0
    mean, square = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for t in range(1, ROUNDS + 1):
        vectors, softmax, bias = state
        parts = odd if t % MISSPELT == 0 else spelt
        way = softmax[:, 1] - softmax[:, 0]
        slope = vectors @ way
        z = np.concatenate([np.bincount(word, slope[at], n) / count for n, at, word, count in parts])
        back, err = held.slopes(z, bias, rng)
        by_gram, at_name = np.zeros(len(used) + 1), 0
        for n, at, word, count in parts:
            by_gram += np.bincount(at, (back[at_name : at_name + n] / count)[word], len(used) + 1)
            at_name += n
        turn = by_gram @ vectors
        other = np.stack([-turn, turn], 1) + DECAY * softmax, np.array([-err, err])

        def step(x: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray) -> None:
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= RATE * min(1, 2 - 2 * t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

        for k in (slice(lo, lo + PART) for lo in range(0, len(used) + 1, PART)):
            step(vectors[k], by_gram[k, None] * way + DECAY * vectors[k], mean[0][k], square[0][k])
        for x, g, m, s in zip(state[1:], other, mean[1:], square[1:]):
            step(x, g, m, s)
    model.vectors[used] = state[0][:-1]
    model.softmax, model.bias, model.trained = state[1], state[2], True
    return model


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["label"], r["doc_id"], r["text"] or ""))
    labels = [r["label"] for r in rows]
    model = train((r.pop("text") for r in rows), labels)  # each text goes when it is read
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, training, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, text_bytes: int = TEXT_BYTES) -> bytes:
    """A model from labelled rows for whose id the condition training holds: per_class rows and class_bytes bytes of each class at most."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(training)
    chosen = None
    for y in (0, 1):
        some = marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("x")).select("doc_id", "x.*")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    so_far = F.sum(size).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))  # per_class rows a label
    sample = sample.where(size <= text_bytes).withColumn("so_far", so_far).where(F.col("so_far") <= class_bytes).select("doc_id", "text", "label")
    found = sample.repartition(1).mapInArrow(lean(_train), "model binary").collect()
    return found[0][0] if found else pickle.dumps(Model())


def top_window(z: np.ndarray) -> float:
    """The highest mean of WINDOW numbers in a row; of fewer numbers their mean, of none 0."""
    if len(z) <= WINDOW:
        return float(z.mean()) if len(z) else 0.0
    c = np.concatenate([[0.0], np.cumsum(z)]) if WINDOW > 1 else None
    return float(z.max() if c is None else (c[WINDOW:] - c[:-WINDOW]).max() / WINDOW)


class Scorer:
    """Scores texts and remembers the numbers of words."""

    def __init__(self, model: bytes):
        self.model: Model = pickle.loads(model)
        self.numbers: dict[str, float] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [words(t) for t in texts]
        if new := list({w for t in bags for w in t if w not in self.numbers}):
            if len(self.numbers) + len(new) > WORDS_KEPT:
                self.numbers = {}
                new = list({w for t in bags for w in t})
            self.numbers.update(zip(new, self.model.numbers(new).tolist()))
        odds = [top_window(np.fromiter(map(self.numbers.__getitem__, t), float, len(t))) for t in bags]
        return 1 / (1 + np.exp(-np.clip(np.array(odds) + self.model.offset, -50, 50)))

    def slices(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], np.ndarray]]:
        """Slices of a batch, their texts (column at) and scores."""
        for lo in range(0, batch.num_rows, SLICE):
            some = batch.slice(lo, SLICE)
            texts = some.column(at).to_pylist()
            yield some, texts, self(texts)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for some, _, scores in scorer.slices(b, 1):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(lean(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold or that have no word; all if the model saw no two classes."""
    if not pickle.loads(model).trained:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            for some, texts, scores in scorer.slices(b, at):
                bare = np.array([not (t or "").strip() for t in texts], bool)
                yield some.filter(pa.array((scores < threshold) | bare))

    return docs.mapInArrow(lean(run), docs.schema)


def bucket5():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), bucket5() != 0))
    held_out = F.coalesce(bucket5() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
