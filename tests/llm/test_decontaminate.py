import random
from collections import Counter

import pytest
from conftest import words

from longspan.llm import decontaminate as dc


def split(t):
    import re

    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, width=5, percent=80):
    """Every window where an item's shingle falls, exactly."""
    out = {}
    for i, t in docs:
        w = split(t)
        for j, s in items:
            q = split(s)
            if not q:
                continue
            u = min(width, len(q))
            item = Counter(tuple(q[k : k + u]) for k in range(len(q) - u + 1))
            where = {}
            for k in range(len(w) - u + 1):
                where.setdefault(tuple(w[k : k + u]), []).append(k)
            starts = {p - k for k in range(len(q) - u + 1) for p in where.get(tuple(q[k : k + u]), [])}
            for start in starts:
                lo, hi = max(0, start), min(len(w), start + len(q))
                window = Counter(tuple(w[k : k + u]) for k in range(lo, hi - u + 1))
                a, b = sum((window & item).values()), sum((window | item).values())
                if 100 * a >= percent * b:
                    out[(i, j)] = max(out.get((i, j), 0), a / b)
    return {k: round(v, 9) for k, v in out.items()}


@pytest.fixture(scope="module")
def items(lexicon):
    rng = random.Random(9)
    return [(k, words(rng, rng.choice([2, 4, 5, 12, 30, 60]), lexicon)) for k in range(25)] + [(90, None), (91, "")]


def test_against_brute_force(spark, make, lexicon, items):
    rng = random.Random(10)
    docs = []
    for k in range(120):
        w = words(rng, rng.choice([5, 50, 200]), lexicon).split()
        for _ in range(rng.choice([0, 1, 2])):
            leak = split(rng.choice(items[:25])[1])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = rng.choice(lexicon)
            at = rng.randrange(len(w))
            w[at:at] = leak[: rng.choice([len(leak), len(leak), max(1, len(leak) - 2)])]
        docs.append((k, ", ".join(w).title()))
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n", "2 AS w", "3 AS item")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dc.contaminated(make(docs), frame).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_without_broadcasts(spark, make, items, monkeypatch):
    docs = [(k, "some words before it " + (items[k][1] or "") + " and after it") for k in range(25)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in dc.contaminated(make(docs), frame).collect()}
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in dc.contaminated(make(docs), frame).collect()} == whole and len(whole) >= 25


def test_plan_is_native(spark, make, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    plan = dc.contaminated(make([(1, items[3][1])]), frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd, none, items):
    frame = spark.createDataFrame([*items, (50, odd.where("doc_id = 4").first()["text"])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(odd, frame).collect() if r["item_id"] == 50}
    assert got == {(None, 50), (4, 50), (7, 50)}
    assert dc.contaminated(none, frame).collect() == []
    assert dc.contaminated(odd, frame.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 7, 19, 25])
def test_all_fingerprints_within_the_radius_meet(spark, radius):
    """Whichever bits differ, as many as the radius: some block of one is among the turned blocks of the other; few unrelated ones are."""
    rng = random.Random(radius)
    rows = []
    for k in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), radius):
            y ^= 1 << b
        rows.append((k, x - (1 << 63), y - (1 << 63), rng.getrandbits(64) - (1 << 63)))
    df = spark.createDataFrame(rows, "k long, x long, y long, z long")
    ours = df.withColumn("fp", dc.F.col("x")).select("k", dc.F.inline(dc.blocks(radius)))
    met = lambda other: df.withColumn("fp", dc.F.col(other)).select("k", dc.F.inline(dc.neighbours(radius))).join(ours, ["k", "block", "bits"]).select("k").distinct().count()
    assert met("y") == 200 and met("z") < 0.5 * 200 * (1 if radius < 25 else 2)
