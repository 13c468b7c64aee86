import random
import re
import zlib
from collections import Counter

import pytest

from longspan.llm import spelling


def within_one(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = sorted(((-m, v) for v, m in words.items() if within_one(w, v)))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = (form, n, len(near), -near[0][0] if form else None)
    rows = set()
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, count, form_n))
    return rows


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def counted(rows, least=6, count=5, drop=None):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


@pytest.mark.parametrize("limit", [0, 3, 1024])
def test_against_all_pairs(spark, limit):
    """Small alphabets, so that blocks are crowded; at limit 0 every block is subdivided down to one open place."""
    rng = random.Random(limit)
    words = {}
    for _ in range(250):
        words["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 5, 6, 7])))] = 5 ** rng.randint(0, 5) + rng.randint(0, 3)
    words |= {"a": 7, "b": 1, "x" * 300: 4, "x" * 301: 40, "x" * 150 + "y" + "x" * 149: 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df, limit=limit)) == brute(words)
    pairs = [(r["u"], r["v"]) for r in spelling.near_pairs(df, limit).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) == sum(within_one(a, b) for a in words for b in words if a < b)


def test_skewed_block(spark):
    """A third of all words share their first half: the block is subdivided and nothing is lost."""
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)): rng.randint(1, 60) for _ in range(600)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(12)): 5 for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df, limit=50)) == brute(words)


def test_chains_of_forms(spark):
    """Each word's form is five times as frequent, over more steps than one doubling."""
    chain = {"abcdefgh"[:k] + "z" * (8 - k): 5**k for k in range(9)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert {r["root"] for r in spelling.variants(df).collect()} == {"abcdefgh"}


@pytest.mark.parametrize("drop", [None, 3, 199])
def test_words_of_a_corpus(make, lexicon, drop):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["", "É", "Z", "ß×"]) + rng.choice(lexicon[:60]) + rng.choice(["", ",", "7", "-İ"]) for _ in range(90))) for k in range(40)]
    words = counted(rows, 4, 5, drop)
    assert {r["word"]: r["n"] for r in spelling.corpus_words(make(rows), 4, 5, drop).collect()} == words
    assert got(spelling.variants(spelling.corpus_words(make(rows), 4, 5, drop))) == brute(words)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    words = counted(rows, 3, 2, 5)
    assert got(spelling.variants(spelling.corpus_words(odd, 3, 2, 5))) == brute(words)
    assert spelling.variants(spelling.corpus_words(none)).collect() == []
