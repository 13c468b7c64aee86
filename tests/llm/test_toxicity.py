import collections
import os
import pickle
import random
import tracemalloc

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from longspan.llm import toxicity

GIVEN = "/root/testdata/sf0.1"
BAD = ["blorgful", "snakritch", "wumpold", "grizzentop"]


def texts(lexicon, n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = words(rng, rng.choice([8, 60, 300]), lexicon).split()
        if k % 3 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_held_out_and_misspelled(spark, make, lexicon):
    rows = texts(lexicon, 600, 1)
    docs, labels = make([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 450)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in rows if i >= 450]
    assert sum(held) >= 0.97 * len(held)
    odd_spellings = toxicity.Scorer(model)(["ababa blorgfull " + rows[1][1], "snakritsch " + rows[2][1]])
    assert (odd_spellings > toxicity.Scorer(model)([rows[1][1], rows[2][1]])).all()
    kept = {r["doc_id"] for r in toxicity.accepted(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert toxicity.accepted(docs, model).columns == docs.columns


def test_odd_rows(spark, odd, none, lexicon):
    labels = spark.createDataFrame([(4, None, 1), (5, None, 0), (5, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    untrained = toxicity.fit(odd, labels.limit(0), F.lit(True))
    assert len(toxicity.score(odd, untrained).collect()) == odd.count()
    assert toxicity.score(none, model).collect() == [] and toxicity.accepted(none, model).collect() == []


def test_windows(monkeypatch):
    z = np.zeros(100)
    z[70] = 8
    assert toxicity.top_window(z) == 8 and toxicity.top_window(z[:0]) == 0
    assert [x.tolist() for x in toxicity.windows(np.array([2, 0, 1]))] == [[0, 0, 2], [0, 1, 2], [1, 2, 3]]
    monkeypatch.setattr(toxicity, "WINDOW", 4)
    assert toxicity.top_window(z) == 2 and toxicity.top_window(np.array([2.0, 4.0])) == 3
    assert [x.tolist() for x in toxicity.windows(np.array([5, 0, 3]))] == [[0, 0, 2], [0, 1, 5], [4, 5, 8]]


def plain_score(model, text):
    """Every window's vectors averaged n-gram by n-gram, through the softmax; the highest chance of class 1."""

    def vector(word):
        word, found = f"<{word}>", []
        for n in toxicity.GRAMS:
            for k in range(len(word) - n + 1):
                h = n
                for c in word[k : k + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                found.append(model.vectors[h >> (64 - toxicity.BITS)].astype(float))
        return np.mean(found, 0)

    names = toxicity.words(text)
    best = []
    for k in range(max(1, len(names) - toxicity.WINDOW + 1)):
        bag = np.mean([vector(w) for w in names[k : k + toxicity.WINDOW]], 0) if names else np.zeros(toxicity.DIM)
        e = np.exp(bag @ model.softmax + model.bias)
        best.append(e[1] / e.sum())
    return max(best)


@pytest.mark.parametrize("window", [1, 3])
def test_independent_scorer(lexicon, monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    monkeypatch.setattr(toxicity, "ROUNDS", 10)
    rows = texts(lexicon, 60, 2)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    some = [t for _, t, _ in rows] + ["", None, "a", "é \U0001f600 ...", BAD[0]]
    assert np.allclose(toxicity.Scorer(pickle.dumps(model))(some), [plain_score(model, t) for t in some], atol=1e-6)


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given tables are not here")
def test_training_holds_a_run_of_texts_at_a_time(lexicon, monkeypatch):
    """The model is the same to the last bit however many words are worked on at once, and few are."""
    rows = texts(lexicon, 400, 6)
    both = [t for _, t, _ in rows] + [None, "", "  ", "alone"], [y for _, _, y in rows] + [0, 1, 0, 1]
    monkeypatch.setattr(toxicity, "ROUNDS", 4)
    for window in (1, 3):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        models = []
        for tokens in (1 << 30, 1 << 17, 100, 1):
            monkeypatch.setattr(toxicity, "TOKENS", tokens, raising=False)
            models.append(toxicity.train(*both))
        for m in models[1:]:
            assert (m.vectors == models[0].vectors).all() and (m.softmax == models[0].softmax).all() and (m.bias == models[0].bias).all()
        assert models[0].trained
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    rng = random.Random(7)
    many = [words(rng, 2000, lexicon) for _ in range(500)]
    tracemalloc.start()
    toxicity.train(many, [k % 2 for k in range(500)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # of a million words; was 127 MB


def test_held_out_rows_of_the_given_tables(spark):
    """A better F1 than a list of the words met mostly in toxic training texts; precision and recall were 0.93 and 0.94 (list: 0.94, 0.90)."""
    docs, labels = spark.read.parquet(f"{GIVEN}/documents.parquet"), spark.read.parquet(f"{GIVEN}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.bucket5() != 0)
    got = toxicity.score(docs.where(toxicity.bucket5() == 0), model).join(labels, "doc_id").select("score", "toxic").collect()
    rows = docs.join(labels, "doc_id").select("text", "toxic", (toxicity.bucket5() == 0).alias("held")).collect()
    met = [collections.Counter(w for t, y, held in rows if not held and y == label for w in set(toxicity.words(t))) for label in (0, 1)]
    listed = {w for w, n in met[1].items() if n >= 8 and n > 0.6 * (n + met[0][w])}

    def rates(pairs):
        hits, said, true = sum(p and y for p, y in pairs), sum(p for p, _ in pairs), sum(y for _, y in pairs)
        return hits / said, hits / true, 2 * hits / (said + true)

    precision, recall, f1 = rates([(s >= 0.5, y) for s, y in got])
    assert precision >= 0.9 and recall >= 0.9
    assert f1 > rates([(bool(listed & set(toxicity.words(t))), y) for t, y, held in rows if held])[2]
    alone = ["trash", "pathetic", "worthless", "idiot", "loser", "disgusting", "scum", "moron", "clown", "stupid"]
    scorer = toxicity.Scorer(model)
    assert (scorer([f"the thing {w}, was" for w in alone]) >= 0.5).all()
    clean = scorer(["", "the thing was there", "und das ist", "les choses sont"]).max()
    assert clean < 0.2 and scorer(["les réeuxette sont", "das achlichhaft ist"]).min() > clean  # stems with endings that no text has; below 0.5


def test_sample_is_bounded_in_rows(spark, make, lexicon, monkeypatch):
    """One labelled id on very many rows brings one text, that of smallest hash."""
    rows = [(1, f"{lexicon[k % 700]} {k}") for k in range(5000)] + [(2, "plain words"), (3, "other words"), (3, "other words")]
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    def seen(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array([repr(sorted((r["doc_id"], r["label"]) for r in rows)).encode()])], ["model"])

    monkeypatch.setattr(toxicity, "_train", seen)
    assert toxicity.fit(make(rows), labels, F.lit(True)) == repr([(1, 1), (2, 0), (3, 0)]).encode()


def test_sample_is_bounded_in_bytes(spark, make, monkeypatch):
    """Texts above text_bytes do not train; of each class no more bytes than class_bytes, in order of the ids' hash."""
    docs = make([(k, "x" * (10 + k)) for k in range(40)] + [(40, "y" * 500), (41, None)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(42)], "doc_id long, quality int, toxic int")

    def seen(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array([pickle.dumps([(r["doc_id"], r["label"], len(r["text"] or "")) for r in rows])])], ["model"])

    monkeypatch.setattr(toxicity, "_train", seen)
    rows = pickle.loads(toxicity.fit(docs, labels, F.lit(True), class_bytes=200, text_bytes=100))
    for y in (0, 1):
        assert 0 < sum(n for _, label, n in rows if label == y) <= 200
    assert 40 not in {i for i, _, _ in rows} and len(pickle.loads(toxicity.fit(docs, labels, F.lit(True)))) == 42
