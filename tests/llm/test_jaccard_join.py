import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import words

from longspan.llm import jaccard_join as jj
from longspan.llm.common import SLICE


def brute(rows, percent, width):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_copies(lexicon, seed, base=12, copies=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(base):
        w = words(rng, rng.choice([1, 2, 4, 9, 30, 80, 200, 600]), lexicon).split()
        for _ in range(copies):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(v))
                v[at : at + rng.choice([0, 1])] = [rng.choice(lexicon)]
            rows.append((len(rows), " ".join(v)))
    return rows


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5), (60, 2)])
def test_against_all_pairs(make, lexicon, percent, width):
    rows = near_copies(lexicon, percent)
    got = Counter(tuple(r) for r in jj.similar_classes(make(rows), percent, width).collect())
    assert got == brute(rows, percent, width)


def test_many_near_copies(make, lexicon):
    rng = random.Random(2)
    w = words(rng, 120, lexicon).split()
    rows = []
    for k in range(300):
        v = list(w)
        v[rng.randrange(len(v))] = rng.choice(lexicon)
        rows.append((k, " ".join(v)))
    got = jj.similar_classes(make(rows), 90, 3).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 90, 3)


def test_allocation_follows_cost():
    """Few sets take equal segments, many take segments that allow a deletion."""
    few, many = (jj.Bands(80, dict.fromkeys(range(1, 400), n)).bands for n in (10, 10_000_000))
    assert not any(b.double for b in few) and any(b.double for b in many)
    assert all(b.single + 2 * b.double == b.tolerance + 1 + b.extra for b in few + many)


def test_unrelated_sets_hardly_meet():
    """Segments of which nothing is left don't make unrelated sets meet, whatever their size."""
    rng = np.random.default_rng(3)
    bands = jj.Bands(80, dict.fromkeys(range(1, 6000, 10), 100_000))
    for size in (30, 100, 400, 1500, 5000):
        held = Counter()
        for _ in range(100):
            x = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            held.update({int(v) for k in bands.of(len(x)) for v in bands.signatures(x, k)})
        assert sum(c * (c - 1) // 2 for c in held.values()) < 0.03 * 100 * 99 / 2


def test_sets_that_share_a_node(make, lexicon, monkeypatch):
    """Nodes of few bits clash; the sets that share one are told apart by others."""
    whole = jj.node_of
    monkeypatch.setattr(jj, "node_of", lambda key, shared=frozenset(): x if (x := whole(key) & 63) not in shared else whole(key[8:] + key[:8]))
    monkeypatch.setattr(jj, "set_key", lambda hashes: jj.hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
    rows = near_copies(lexicon, 4)
    assert Counter(tuple(r) for r in jj.similar_classes(make(rows), 80, 5).collect()) == brute(rows, 80, 5)


def test_repeated_rows_make_one_node(make, lexicon):
    base = words(random.Random(8), 100, lexicon)
    join = jj.Join(make([(1, base)] * 40 + [(2, base + " x")] * 40 + [(None, base + " y")] * 40), 80, 5)
    assert join.sets(join.rows.select("node").distinct()).count() == 3
    assert {r["component_id"] for r in join.classes().collect()} == {1}


@pytest.mark.parametrize("kind", ["single", "double", "mixed"])
@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_a_signature(percent, kind):
    """All kinds of allocation: random pairs just above the similarity meet in some band."""
    rng = np.random.default_rng(percent)
    bands = jj.Bands(percent, {})
    for b in bands.bands:
        b.double = {"single": 0, "double": (b.tolerance + 1) // 2, "mixed": (b.tolerance + 1) // 3}[kind]
        b.single = b.tolerance + 1 - 2 * b.double
    for _ in range(300):
        n = int(rng.integers(10, 300))
        x = rng.integers(1, 1 << 62, n).astype(np.uint64)
        least = -(-percent * n // 100)
        c = int(rng.integers(least, n + 1))
        extra = int(rng.integers(0, max(1, 100 * c // percent - n + 1)))
        y = np.unique(np.concatenate([rng.permutation(x)[:c], rng.integers(1, 1 << 62, extra).astype(np.uint64)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common) or np.array_equal(x, y):
            continue
        sig = lambda s: {int(v) for k in bands.of(len(s)) for v in bands.signatures(s, k)}
        assert sig(x) & sig(y)


def test_long_texts(make, lexicon):
    """Sets whose sketches have different sizes."""
    rng = random.Random(12)
    base = words(rng, 2300, lexicon).split()
    rows = []
    for k, n in enumerate((2300, 2100, 2050, 2040, 1030, 1020, 1000, 930)):
        v = base[:n]
        for _ in range(4 * (k % 3)):
            v[rng.randrange(n)] = rng.choice(lexicon)
        rows.append((k, " ".join(v)))
        rows.append((k + 100, words(rng, n, lexicon)))
    got = Counter(tuple(r) for r in jj.similar_classes(make(rows), 80, 5).collect())
    assert got == brute(rows, 80, 5) and len({c for _, _, c in got}) < len(rows) - 3


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in jj.similar_classes(odd, 90, 3).collect()) == brute(rows, 90, 3)
    assert jj.similar_classes(none, 90, 3).collect() == []


def test_full_sketches_leave_pairs_that_may_be_similar():
    """Of random pairs of large sets, those of sizes beyond the largest sketch too: similar ones stay, unlike ones that a fold can't tell apart go."""
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    rows, stay = [], []
    for n in (700, 1500, 3000, 5000, 9000, 30_000):
        x = np.unique(some(n))
        for y in (np.concatenate([x[n // 20 :], some(n // 20)]), np.concatenate([x, some(n // 8)]), some(n), some(n * 7 // 8)):
            y = np.unique(y)
            common = len(np.intersect1d(x, y))
            full = [jj.folded(jj.sketch(z)) for z in (x, y)]
            assert all((f[:16] == jj.folded(f[16:])[:16]).all() for f in full if len(f) > 16)
            rows.append((len(rows), len(rows), len(x) + len(y), *(f[16:].tolist() or None for f in full)))
            stay.append(100 * common >= 80 * (len(x) + len(y) - common) or None in rows[-1])
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["a", "b", "both", "full1", "full2"])
    got = [a for b in jj._near(80)([batch, batch.slice(5)]) for a in b.column(0).to_pylist()]
    want = [k for k, s in enumerate(stay) if s]
    assert got == want + [k for k in want if k >= 5]


def test_middle_folds_tell_large_sets_apart_in_the_join(spark):
    """Unlike sets of a few thousand shingles, whose folds of SKETCH bits are full, went on to be written as pairs; similar ones stay."""
    rng, rows = np.random.default_rng(5), []
    for n in (2100, 3000, 5000, 8000, 9000, 17_000):
        x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        near = np.concatenate([x[: int(0.9 * n)], y[: n - int(0.9 * n)]])
        for like, z in ((True, near), (False, y)):
            full = [jj.sketch(s).tolist() for s in (x, z)]
            folds = [jj.folded(jj.sketch(s))[: len(jj.WORDS)].tolist() for s in (x, z)]
            rows.append((n, like, n, n, *full, *folds))
    df = spark.createDataFrame(rows, "size int, like boolean, n1 long, n2 long, full1 array<long>, full2 array<long>, s1 array<long>, s2 array<long>")
    df = df.withColumns({f"middle{k}": jj.middle(F.col(f"full{k}")) for k in (1, 2)} | {f"{w}{k}": F.get(f"s{k}", i) for k in (1, 2) for i, w in enumerate(jj.WORDS)})
    for r in df.select("full1", "middle1").collect():
        assert r["middle1"] == np.bitwise_xor.reduce(np.array(r["full1"]).reshape(-1, jj.MIDDLE), axis=0).tolist() if len(r["full1"]) >= jj.MIDDLE else r["middle1"] is None
    kept = {(r["size"], r["like"]) for r in df.where(jj.Join.possible(SimpleNamespace(percent=80), "1", "2")).collect()}
    assert {(r[0], True) for r in rows} <= kept
    assert not {(n, False) for n in (2100, 3000, 5000)} & kept


def test_signatures_are_made_of_slices_of_a_batch(lexicon):
    """What is held of a batch doesn't grow with it: its rows leave in slices, and signatures with each."""
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 12), lexicon) for _ in range(2 * SLICE + 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([b"k"] * len(texts))], ["doc_id", "text", "text_key"])
    bands = jj.Bands(80, {8: len(texts)})
    out = list(jj._parts(3, bands, frozenset())(iter([batch])))
    rows = [b for b in out if b.column("sig").null_count]
    assert [b.num_rows for b in rows] == [SLICE, SLICE, 7]
    assert [x for b in rows for x in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    whole = [jj.set_key(jj.shingles(t, 3)) for t in texts]
    assert [x for b in rows for x in b.column("set_key").to_pylist()] == whole
    signed = sum(len(bands.signatures(x, k)) for t in texts if len(x := jj.shingles(t, 3)) for k in bands.of(len(x)))
    assert sum(b.num_rows for b in out if not b.column("sig").null_count) == signed > 0
