import random

import pytest
from conftest import words

from longspan.llm import line_dedup as ld


def brute(rows, least):
    """All runs of lines, by comparing every pair of places: (id, text) -> deleted line numbers."""
    docs = sorted({(i if i is not None else -1, t or "") for i, t in rows})
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    gone = [set() for _ in docs]
    for b, second in enumerate(seqs):
        for a in range(b + 1):
            first = seqs[a]
            for i in range(len(first)):
                for j in range(len(second)):
                    if (a, i) >= (b, j):
                        continue
                    n = 0
                    while i + n < len(first) and j + n < len(second) and first[i + n][1] == second[j + n][1]:
                        n += 1
                    if sum(len(second[j + k][1].split()) for k in range(n)) >= least:
                        gone[b].update(second[j + k][0] for k in range(n))
    return {d: sorted(g) for d, g in zip(docs, gone)}


def got(df, least):
    out = {}
    for r in ld.delete_repeats(df.selectExpr("*", "text AS before"), least).collect():
        out[(r["doc_id"] if r["doc_id"] is not None else -1, r["before"] or "")] = (list(r["removed_lines"]), r["text"])
    return out


@pytest.mark.parametrize("least", [1, 7, 20, 50])
def test_against_all_pairs_of_places(make, lexicon, least):
    rng = random.Random(least)
    pool = [words(rng, rng.choice([1, 3, 5, 9, 30]), lexicon) for _ in range(14)]
    rows = []
    for k in range(30):
        lines = [rng.choice(pool) if rng.random() < 0.7 else words(rng, 6, lexicon) for _ in range(rng.randint(1, 12))]
        if k % 4 == 3:
            at = rng.randrange(k)
            lines[1:1] = rows[at][1].split("\n")
        if k % 5 == 0:
            lines.insert(1, " ")
        rows.append((k, "\n".join(lines)))
    want = brute(rows, least)
    have = got(make(rows), least)
    assert {k: v[0] for k, v in have.items()} == want
    for (i, text), (removed, left) in have.items():
        assert left == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in removed)


def test_odd_rows(make, odd, none):
    have = got(odd, 50)
    assert len(have) == 9
    assert have[(1, "")] == ([], None) and have[(2, "")] == ([], "")
    # Of one id with two texts, one id and a null id only whole lines that are equal count, and repeated rows are one document.
    assert all(not removed for removed, _ in have.values())
    rows = ld.delete_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert ld.delete_repeats(none).collect() == []
    again = ld.delete_repeats(make([(9, None), (3, "w " * 60), (2, "w " * 60), (2, "w " * 60)]))
    assert sorted((r["doc_id"], r["text"]) for r in again.collect() if r["text"] is not None) == [(2, "w " * 60), (2, "w " * 60), (3, "")]


def test_maximal_runs(make, lexicon):
    """A run longer than any window, found once with the place of its first copy."""
    rng = random.Random(5)
    lines = [words(rng, 9, lexicon) for _ in range(120)]
    other = [words(rng, 4, lexicon) for _ in range(6)]
    docs = [(1, lines), (2, other[:2] + lines[10:90] + other[2:4]), (3, other[4:] + lines[3:12])]
    runs, _ = ld.repeated_runs(make([(i, "\n".join(x)) for i, x in docs]), 50)
    assert sorted((r["d"], r["i"], r["size"], r["first_d"], r["first_i"]) for r in runs.collect()) == [(2, 2, 80, 1, 10), (3, 2, 9, 1, 3)]


def test_a_run_that_many_share(make, lexicon):
    """A third of all rows hold one passage; the first keeps it."""
    rng = random.Random(6)
    passage = "\n".join(words(rng, 20, lexicon) for _ in range(4))
    rows = [(k, words(rng, 30, lexicon) + ("\n" + passage if k % 3 == 0 else "")) for k in range(600)]
    have = {r["doc_id"]: (r["n_lines"], list(r["removed_lines"])) for r in ld.delete_repeats(make(rows)).collect()}
    assert all(have[k] == ((5, [] if k == 0 else [1, 2, 3, 4]) if k % 3 == 0 else (1, [])) for k in have)


def test_own_columns_stay(make):
    """Columns named like the result's own are kept under other names for those; names used inside are free."""
    df = make([(1, "w " * 60), (2, "w " * 60)]).selectExpr("*", "5 AS removed_lines", "6 AS __d0", "7 AS __k0", "8 AS __lines0")
    rows = {r["doc_id"]: r for r in ld.delete_repeats(df, lines_col="a", removed_col="b").collect()}
    assert [rows[1][c] for c in ("n_lines", "removed_lines", "__d0", "__k0", "__lines0", "k", "d", "a", "b")] == [1, 5, 6, 7, 8, "x", 7, 1, []]
    assert rows[2]["text"] == "" and rows[2]["b"] == [0]


def test_very_many_lines(make, lexicon):
    """100,000 repeated lines of one text, deleted in time that grows with them."""
    text = "\n".join(f"{lexicon[k % 800]} {k}" for k in range(100_000))
    rows = {r["doc_id"]: r for r in ld.delete_repeats(make([(1, text), (2, text + "\nmore")])).collect()}
    assert rows[1]["text"] == text and rows[2]["text"] == "more" and len(rows[2]["removed_lines"]) == 100_000
