import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from longspan.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(rows, texts, library, window=2048):
    """Pieces cover each document once, sequences have no gaps, ids are the library's."""
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
    crcs = defaultdict(int)
    for r in rows:
        crcs[(r["doc_id"], r["start"], r["length"], r["ids_crc32"])] += 1
    for i, ids in want:
        starts = sorted({(r["start"], r["length"]) for r in by_doc[(i, len(ids))]})
        assert starts
        for s, n in starts:
            assert any((i, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) in crcs for j, x in want if j == i)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return {k: sum(r["length"] for r in v) for k, v in by_sequence.items()}


def test_ids_are_the_librarys(library, lexicon):
    own = packing.Tokenizer.of("byte_bpe_50k.tiktoken")
    rng = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n<|endoftext", "it's 12 éè ñ 漢字   z", *(words(rng, 50, lexicon).capitalize() + ".\n" for _ in range(50))]
    for t in texts:
        assert own.ids(t, 1).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_packs_everything(make, library, lexicon):
    rng = random.Random(2)
    texts = [(k, words(rng, rng.choice([3, 40, 400, 3000]), lexicon)) for k in range(80)]
    rows = packing.digests(packing.pack(make(texts), shard_docs=40)).collect()
    size = check(rows, texts, library)
    padded = sum(2048 - n for n in size.values() if n & (n - 1))
    assert padded <= 2 * 64
    assert sum(n == 2048 for n in size.values()) > 0.8 * len(size)


def test_neighbours_share_words():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * k, 100 * k + 100, (6, 500)) for k in range(4)]
    docs = [topics[k % 4][k // 4].astype(np.uint32) for k in range(24)]
    pieces = packing.fill(docs)
    by = defaultdict(list)
    for d, _, n, s, _ in pieces:
        by[s].append((d % 4, n))
    alike = sum(n for v in by.values() for t, n in v if t == v[0][0])
    assert alike > 0.7 * sum(len(d) for d in docs)


def test_neighbours_are_those_of_bm25(lexicon):
    """All unused documents with a term of the seed, in order of BM25 scores counted one by one."""
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.5, int(rng.integers(1, 120))).clip(0, 400).astype(np.uint32) for _ in range(60)]
    index, n = packing.Index(docs, 1.2, 0.75), len(docs)
    mean = sum(len(d) for d in docs) / n
    df = {t: sum(t in d for d in docs) for t in range(401)}
    for seed in range(0, 60, 7):
        unused = rng.random(n) < 0.7
        unused[seed] = False
        score = {}
        for k in np.flatnonzero(unused).tolist():
            for t in set(docs[seed].tolist()) & set(docs[k].tolist()):
                tf = int((docs[k] == t).sum())
                score[k] = score.get(k, 0) + np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(docs[k]) / mean))
        found = index.neighbours(seed, unused).tolist()
        assert set(found) == set(score)
        assert np.allclose([score[k] for k in found], sorted(score.values(), reverse=True))


def test_repeated_rows_are_spread(spark, make):
    """Equal rows do not meet in one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = packing.pack(make([(None, "the same text")] * 6000), shard_docs=100).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in df.groupBy("part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 4000


def test_odd_rows(odd, none, library):
    rows = packing.digests(packing.pack(odd)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], library)
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.digests(packing.pack(none)).collect() == []
