import random

import numpy as np
from conftest import words

from longspan.llm import licenses


def test_finds_whole_and_edited_templates(make, lexicon):
    rng = random.Random(3)
    mit = licenses.TEMPLATES["MIT"].split()
    edited = [*mit[:30], "brand", "new", *mit[30:60], *mit[62:]]
    texts = [(1, words(rng, 90, lexicon) + " " + licenses.TEMPLATES["MIT"]), (2, " ".join(edited)), (3, words(rng, 300, lexicon)), (4, "Released under the MIT License. Released under the MIT License.")]
    rows = licenses.license_matches(make(texts)).collect()
    by = {(r["doc_id"], r["license"], r["first_word"]): r for r in rows}
    whole = by[(1, "MIT", 90)]
    assert whole["coverage"] == 1 and texts[0][1][whole["first_char"] :].startswith("Permission is hereby")
    assert 0.95 < by[(2, "MIT", 0)]["coverage"] < 1
    assert not [r for r in rows if r["doc_id"] == 3]
    assert len([r for r in rows if r["doc_id"] == 4 and r["license"] == "MIT-line"]) == 2


def test_candidates_are_those_of_whole_alignment(lexicon):
    """The index against an alignment of every template over every diagonal."""
    rng = random.Random(4)
    index = licenses.Index(licenses.TEMPLATES)
    for _ in range(12):
        parts = [words(rng, rng.randint(0, 60), lexicon)]
        for name in rng.sample(sorted(licenses.TEMPLATES), 2):
            t = licenses.TEMPLATES[name].split()
            for _ in range(len(t) // 25):
                t[rng.randrange(len(t))] = rng.choice(lexicon)
            parts += [" ".join(t), words(rng, rng.randint(0, 60), lexicon)]
        text = " ".join(parts)
        ids = np.array([index.number.get(w, -1) for w in licenses.words(text)])
        cover = {n: (len(t), licenses.align(t, ids, -len(t), len(ids))[0] / len(t)) for n, t in zip(index.names, index.texts)}
        found = {m[0] for m in licenses.scan(index, text)}
        assert found <= {n for n, (_, c) in cover.items() if c >= 0.8}
        assert found >= {n for n, (_, c) in cover.items() if c >= 0.8}


def test_odd_rows(odd, none):
    assert licenses.license_matches(odd).collect() == []
    assert licenses.license_matches(none).collect() == []


def test_alignment_is_the_best_of_all(lexicon):
    """The score of a plain Smith-Waterman table over all diagonals; the path's words match one by one."""
    rng = random.Random(3)
    for _ in range(30):
        template = np.array([rng.randrange(12) for _ in range(rng.randint(5, 30))])
        doc = np.array([rng.randrange(12) for _ in range(rng.randint(5, 40))])
        table = np.zeros((len(template) + 1, len(doc) + 1), int)
        for i in range(1, len(template) + 1):
            for j in range(1, len(doc) + 1):
                step = table[i - 1, j - 1] + (licenses.MATCH if template[i - 1] == doc[j - 1] else licenses.MISMATCH)
                table[i, j] = max(0, step, table[i - 1, j] + licenses.GAP, table[i, j - 1] + licenses.GAP)
        n, first, last, begin, end = licenses.align(template, doc, -len(template), len(doc))
        assert 0 < n <= min(last - first, end - begin) and table[end, last] == table.max()


def test_an_inserted_clause(lexicon):
    """A template with 40 words put into its middle is one match of its whole coverage; half of one is reported at a lower cut."""
    rng = random.Random(4)
    index = licenses.Index(licenses.TEMPLATES)
    w = licenses.TEMPLATES["MIT"].split()
    text = f"{words(rng, 30, lexicon)} {' '.join(w[:80])} {words(rng, 40, lexicon)} {' '.join(w[80:])} {words(rng, 30, lexicon)}"
    name, _, coverage, first, last, *_ = next(m for m in licenses.scan(index, text) if m[0] == "MIT")
    assert coverage > 0.97 and last - first >= len(w) + 35
    half = words(rng, 30, lexicon) + " " + " ".join(w[: len(w) // 2])
    assert not [m for m in licenses.scan(index, half) if m[0] == "MIT"]
    assert 0.4 < next(m for m in licenses.scan(index, half, 0.4) if m[0] == "MIT")[2] < 0.6


def test_copies_in_one_text(spark, make):
    """Each of many copies in a text is a match, and a repetitive text costs no more than its length; rows that repeat and null ids are reported."""
    text = " ".join([licenses.TEMPLATES["ISC"]] * 200)
    assert sum(m[0] == "ISC" for m in licenses.scan(licenses.Index(licenses.TEMPLATES), text)) == 200
    licenses.scan(licenses.Index(licenses.TEMPLATES), "of the software and the copyright notice " * 3000)
    rows = licenses.license_matches(make([(None, licenses.TEMPLATES["ISC"]), (1, licenses.TEMPLATES["ISC"]), (1, licenses.TEMPLATES["ISC"])])).where("license = 'ISC'").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]


def test_every_template_with_any_word_changed(lexicon):
    """All places of all templates, lines of five words included: those of which 0.8 is left are all found."""
    index = licenses.Index(licenses.TEMPLATES)
    missed, seen = [], 0
    for name, t in licenses.TEMPLATES.items():
        w = licenses.words(t)
        for k in range(len(w)):
            if (len(w) - 1) / len(w) >= 0.8:
                seen += 1
                text = " ".join([*lexicon[:20], *w[:k], "zzz", *w[k + 1 :], *lexicon[20:40]])
                if name not in {m[0] for m in licenses.scan(index, text)}:
                    missed.append((name, k))
    assert seen > 700 and not missed


def test_a_long_part_far_back_still_chains():
    """Of three parts in order the longest stands first; shorter ones between don't hide it."""
    parts = [(100, 0, 100, 0, 100), (3, 102, 105, 0, 3), (20, 110, 130, 100, 120)]
    assert licenses.chain(parts, 30)[0] == (120, 0, 130)
