import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import words
from pyspark.sql import functions as F

from longspan.llm import suffix_tree as st


def scored(docs, **sizes):
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.coalesce(fold != 2, F.lit(False)).alias("learned"))
    training = docs.where("learned")
    counts = st.written(st.word_counts(training))
    tree = st.fit(training, counts, **sizes)
    return tree, st.score(docs, tree, counts)


@pytest.fixture(scope="module")
def corpus(lexicon):
    rng = random.Random(8)
    texts = []
    for k in range(400):
        topic = lexicon[(k % 4) * 40 : (k % 4) * 40 + 40]
        text = " ".join(x for _ in range(60) for x in ("The" if rng.random() < 0.5 else "of", rng.choice(topic)))
        texts.append((k, text + (" unseen%d" % k if k % 9 == 0 else "")))
    return texts


def test_base_is_exact_and_tree_is_better(make, corpus):
    tree, df = scored(make(corpus))
    rows = {r["doc_id"]: r for r in df.collect()}
    count = Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*t.encode().lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    held = [i for i, _ in corpus if rows[i]["held_out"]]
    assert held and all((zlib.crc32(str(i).encode()) % 7 == 2) == rows[i]["held_out"] for i, _ in corpus)
    for i, t in corpus:
        tokens = [*t.encode().lower().split(), b" "]
        assert rows[i]["n_tokens"] == len(tokens) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(count[x] > 0 for x in tokens)
        assert math.isclose(rows[i]["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)
    assert tree.levels[0][1].count()


def test_odd_rows(odd, none):
    _, df = scored(odd)
    rows = df.collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(math.isfinite(r["score"]) for r in rows)
    assert scored(none)[1].collect() == []


def test_hashes_are_those_of_spark(spark):
    df = spark.range(-50, 50).selectExpr("id", "id * 7919 AS b", "id - 3 AS c").selectExpr("*", "xxhash64(id, b) AS two", "xxhash64(id, b, c) AS three").toPandas()
    two = st.joined(df["b"].to_numpy(), st.joined(df["id"].to_numpy()))
    assert (two == df["two"].to_numpy()).all() and (st.joined(df["c"].to_numpy(), two) == df["three"].to_numpy()).all()


def test_tokens_are_words_and_ends(spark, monkeypatch):
    """Cut and hashed like split() and xxhash64, whatever the lengths of words, at any size of runs."""
    rng = random.Random(1)
    texts = ["", None, "One", " \t two  Words\n", "é Ünïcode \u00a0x ÄB", "a" * 31 + " " + "b" * 32 + " " + "C" * 200, *(" ".join("x" * rng.randint(1, 40) for _ in range(rng.randint(0, 30))) for _ in range(40))]
    want = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    known = {r["w"]: r["h"] for r in spark.createDataFrame([(w.decode(),) for w in {w for x in want for w in x}], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    for size in (1, 100, st.BYTES):
        monkeypatch.setattr(st, "BYTES", size)
        column = st.pa.array(["skipped", *texts])[1:]
        got = []
        for _, lengths, ids in st.token_runs(column):
            at = 0
            for n in lengths.tolist():
                got.append(ids[at : at + n].tolist())
                at += n
        assert got == [[known[w.decode()] for w in x] for x in want]
    assert list(st.token_runs(st.pa.array([], st.pa.string()))) == []


def reference(texts, learned, depth, context, least):
    """log10 of each text's probability, by a tree of plain dictionaries; and its states."""
    seqs = [[" ", *t.lower().split(), " "] for t in texts]
    uni = Counter(x for s, l in zip(seqs, learned) if l for x in s[1:])
    n, v = sum(uni.values()), len(uni)
    states = {}

    def p(before, x):
        if not before:
            return (uni[x] + 1) / (n + v + 1)
        back = p(before[1:], x)
        if before not in states:
            return back
        seen, total, low = states[before]
        return (seen[x] - st.DISCOUNT) / total + low * back if x in seen else low * back

    above = {(x,): c for x, c in uni.items()}
    for d in range(1, depth + 1):
        grams = Counter(tuple(s[k - d : k + 1]) for s, l in zip(seqs, learned) if l for k in range(d, len(s)))
        by, found = {}, {}
        for key, c in grams.items():
            pairs = all((a,) in states and b in states[(a,)][0] for a, b in zip(key[:-1], key[1:-1]))
            if c >= least and above.get(key[:-1], 0) >= context and pairs:
                by.setdefault(key[:-1], {})[key[-1]] = c
        for before, seen in by.items():
            total = above[before]
            seen = {x: c for x, c in seen.items() if c * math.log(c / total / p(before[1:], x)) > math.log(v) + 0.5 * math.log(total)}
            if not seen:
                continue
            parents = {x: p(before[1:], x) for x in seen}
            other, others = 1 - sum(seen.values()) / total, max(1e-12, 1 - sum(parents.values()))
            gain = sum(c * math.log(c / total / parents[x]) for x, c in seen.items()) + (total * other * math.log(other / others) if other > 1e-15 else 0)
            if gain > len(seen) * (math.log(v) + 0.5 * math.log(total)):
                found[before] = seen, total, max(1e-12, 1 - sum(c - st.DISCOUNT for c in seen.values()) / total)
        states.update(found)
        above = grams
    return [sum(math.log10(p(tuple(s[max(0, k - depth) : k]), s[k])) for k in range(1, len(s))) for s in seqs], states, p, set(uni)


@pytest.mark.parametrize("depth,context,least", [(4, 16, 4), (3, 2, 2), (5, 3, 2)])
def test_scores_are_those_of_a_plain_tree(make, lexicon, monkeypatch, depth, context, least):
    """Every text's score, with states of every length, however much is broadcast, named shortly or packed at once; states are distributions."""
    rng = random.Random(3)
    phrases = ["quill midst vexed onto umber", "sable midst vexed onto amber", "ocean grove hills fjord delta north", "woods grove hills fjord delta south", "quill midst umber"]
    docs = [(k, words(rng, 50, lexicon[:100]) + (f" {phrases[k // 2 % 5]}" if k % 2 == 0 else "") + " tail" * (k % 7)) for k in range(300)]
    docs += [(300, phrases[0]), (301, ""), (302, "quill"), (303, "never seen words")]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    want, states, p, symbols = reference([t for _, t in docs], learned, depth, context, least)
    assert {len(s) for s in states} == set(range(1, depth + 1))
    for before in sorted(states)[::7]:
        assert math.isclose(sum(p(before, x) for x in symbols) + p(before, "of no text"), 1, rel_tol=1e-9)
    for hot, short, chunk in ((st.HOT, st.SHORT, st.CHUNK), (64, 20, 2000), (0, 0, 100)):
        for name, value in (("HOT", hot), ("SHORT", short), ("CHUNK", chunk)):
            monkeypatch.setattr(st, name, value)
        tree, df = scored(make(docs), depth=depth, context=context, least=least)
        rows = {r["doc_id"]: r for r in df.collect()}
        for (i, _), w in zip(docs, want):
            assert math.isclose(rows[i]["score"], w, rel_tol=1e-9)
        assert sum(s.count() for _, s in tree.levels) == len(states)
    assert rows[300]["score"] > rows[300]["base_score"] + 4


def test_more_text_makes_a_larger_and_better_tree(spark):
    """From sf0.01 to sf0.1 entries grow and the perplexity of held-out texts falls."""
    found = []
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        tree, df = scored(docs)
        held = df.where("held_out").agg(F.sum("n_tokens"), F.sum("score"), F.sum("base_score")).first()
        found.append((sum(e.count() for e, _ in tree.levels), held[1] / held[0], (held[1] - held[2]) / held[0]))
    assert found[1][0] > 5 * found[0][0] and found[1][1] > found[0][1] and found[1][2] > found[0][2] > 0


def test_a_chunk_is_packed_column_by_column():
    """Counts are right, and a chunk of 25 bytes a token takes at most 75 while it is packed (116 to 123 when all columns were held)."""
    rng = np.random.default_rng(3)
    context, word = rng.integers(-(2**62), 2**62, 300)[rng.integers(0, 300, 400_000)], rng.integers(-(2**62), 2**62, 500)[rng.integers(0, 500, 400_000)]
    code = st.joined(word, st.joined(context))
    tracemalloc.start()
    held = [[c[:150_000].copy(), c[150_000:].copy()] for c in (code, context, word, np.zeros(len(code), bool))]
    packed = st._pack(1, held, 64, np.empty(0, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and peak < 75 * len(code)
    want = Counter(zip(context.tolist(), word.tolist()))
    rows = pa.Table.from_batches([packed])
    got = {}
    for b in set(rows["bucket"].to_pylist()):
        out = st._unpacked(rows.filter(pc.equal(rows["bucket"], b)), 1, np.empty(0, np.int64)).to_pydict()
        got |= dict(zip(zip(out["ctx"], out["word"]), out["n"]))
    assert got == dict(want)


def test_bitmap_is_made_of_fixed_parts(spark):
    """It has all its hashes and hardly any other; what tasks pass on is of fixed size however many hashes there are."""
    rows = spark.range(0, 300_000, 1, 3).select(F.xxhash64("id").alias("code"))
    codes = rows.toPandas()["code"].to_numpy()
    bits = st.Bitmap(rows, F.col("code"))
    assert bits.has(codes).all() and bits.has(~codes).sum() < 100
    assert np.unpackbits(bits.bits).sum() <= 2 * len(codes)
    assert not st.Bitmap(rows.limit(0), F.col("code")).bits.any()
    made = []
    frame = type(rows)
    kept = frame.mapInArrow
    try:
        frame.mapInArrow = lambda self, f, schema, *a, **k: made.append(kept(self, f, schema, *a, **k)) or made[-1]
        st.Bitmap(rows, F.col("code"))
    finally:
        frame.mapInArrow = kept
    assert made[0].count() <= 3 * (1 << st.BITS - 15)


def test_batches_are_small_within_a_block_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with st.small_batches(spark):
        rows = spark.range(5000).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
        assert max(r["n"] for r in rows) <= 512 and sum(r["n"] for r in rows) == 5000
    assert spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), st.small_batches(spark):
        1 / 0
    assert spark.conf.get(key) == before
