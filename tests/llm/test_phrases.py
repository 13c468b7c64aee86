import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words

from longspan.llm import phrases


def brute(rows, least=10, most=3, inside=50):
    """(lang, phrase) -> (a, l, r, n, score) of what stays, by counting every run of words."""
    f, totals, out = Counter(), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, most + 1):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    many = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    for (lang, *w), a in many.items():
        if any(x[0] == lang and len(x) > len(w) + 1 and 100 * m >= inside * a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x))) for x, m in many.items()):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[(lang, " ".join(w))] = (a, f[(lang, *w[:k])], f[(lang, *w[k:])], totals[lang], score)
    return out


def ranks(found, top=2000):
    by = defaultdict(list)
    for (lang, phrase), (a, left, right, n, score) in found.items():
        by[lang].append((-score, -a, phrase.encode(), phrase, left, right, n))
    return {(lang, k, p, -a, left, right, n, -s) for lang, rows in by.items() for k, (s, a, _, p, left, right, n) in enumerate(sorted(rows)[:top], 1)}


def got(df, least=10, most=3, top=2000, **k):
    found, totals = phrases.frequent(df, least, most, **k)
    rows = phrases.ranked(phrases.scored(found), totals, top).collect()
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows}


def corpus(seed, lexicon, n=120):
    rng = random.Random(seed)
    some, out = lexicon[:25] + ["É", "é", "漢字", "x\xa0y", "A\x1cb"], []
    fixed = [words(rng, 3, some) for _ in range(5)]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else words(rng, rng.randint(0, 9), some) for _ in range(8)]
        text = "".join(p.upper() * (rng.random() < 0.1) or p + rng.choice([".", ", ", "\n", " \t", "!?", " ", "\x0b;"]) for p in parts)
        out.append((rng.choice(["en", "de", None, ""]), text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "n", "w") for lang, text in rows], "lang string, text string, n int, phrase string, part string")


@pytest.mark.parametrize("bits, chunk", [(None, phrases.CHUNK), (6, 300), (20, 5000)])
def test_against_counting_everything(spark, lexicon, bits, chunk):
    """Few buckets fill up and prune nothing; results stay the same."""
    rows = corpus(1, lexicon)
    assert got(frame(spark, rows), bits=bits, chunk=chunk) == ranks(brute(rows))


@pytest.mark.parametrize("least, most", [(2, 5), (3, 2), (400, 3)])
def test_lengths_and_thresholds(spark, lexicon, least, most):
    rows = corpus(2, lexicon, 60)
    assert got(frame(spark, rows), least, most, top=40) == ranks(brute(rows, least, most), 40)


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(odd, 2) == ranks(brute(rows, 2))
    assert got(none) == set()
    same = [(None, "a b c"), ("und", "a b c")] * 5 + [(None, None), ("x", "")]
    assert got(frame(spark, same)) == {("und", 1, "a b c", 10, 10, 10, 30, 1000000)}


def test_codes_that_clash(spark, lexicon, monkeypatch):
    """Phrases of one code are still told apart by their words."""
    rows = corpus(3, lexicon, 40)
    real = {b: phrases._code("en", b) % 3 for b in {w.lower().encode() for w in lexicon}}
    monkeypatch.setattr(phrases, "_code", lambda lang, word: real.get(word, 1))
    texts = [t.encode() for lang, t in rows if lang == "en"]
    found = Counter()
    for b in phrases._counted("en", texts, 2, True, 20, 2, None):
        for r in b.to_pylist():
            assert r["phrase"] not in found
            found[r["phrase"]] = r["n"]
    want = Counter()
    for t in texts:
        for piece in t.translate(phrases.STEP).split(phrases.BREAK):
            w = piece.decode().replace("\t", " ").split(" ")
            w = [x for x in w if x]
            want.update(" ".join(x) for x in zip(w, w[1:]))
    assert found == want


def test_bitmaps(spark):
    """Sums over many rows of one bucket, none of which is enough alone."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 18, 3000) for _ in range(20)]
    rows = [tuple(r[c] for c in ("part", "offsets", "counts")) for p in parts for b in phrases._ranges(p, 7) for r in b.to_pylist()]
    bits = phrases.bitmap(spark.createDataFrame(rows, "part int, offsets binary, counts binary"), 18, 7)
    met = np.bincount(np.concatenate([np.repeat(v, np.minimum(n, 7)) for v, n in (np.unique(p, return_counts=True) for p in parts)]), minlength=1 << 18) >= 7
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == met).all()


def test_exact_scores(spark):
    """Products beyond 64 bits, and ties of cuts after flooring to the first."""
    big = 10**12
    rows = [("en", "a", 1, 3 * big), ("en", "b", 1, 3 * big + 1), ("en", "a b", 2, big), ("en", "c", 1, big), ("en", "b c", 2, big), ("en", "a b c", 3, big - big // 2 - 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long")
    have = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in phrases.scored(df).collect()}
    a = big - big // 2 - 1
    assert have["a b"] == (3 * big, 3 * big + 1, 1000000 * big * big // (3 * big * (3 * big + 1)))
    assert have["a b c"] == (3 * big, big, 1000000 * a * a // (3 * big * big))
