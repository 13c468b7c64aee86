import random
import shutil

import pytest
from conftest import words

import corpus_pipeline
from longspan.llm import packing

BAD = ["blorgful", "snakritch", "wumpold"]


@pytest.fixture(scope="module")
def sf_dir(spark, make, lexicon, tmp_path_factory):
    rng = random.Random(11)
    texts = {k: words(rng, 120, lexicon) for k in range(300)}
    toxic = {k for k in texts if k % 5 == 0}
    for k in toxic:
        w = texts[k].split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        texts[k] = " ".join(w)
    passage = words(rng, 60, lexicon)
    item = words(rng, 40, lexicon)
    texts[301] = texts[1]
    texts[302] = texts[2] + " tail"
    texts[303] = words(rng, 30, lexicon) + "\n" + passage
    texts[304] = words(rng, 30, lexicon) + "\n" + passage
    texts[306] = words(rng, 30, lexicon) + " " + item + " " + words(rng, 30, lexicon)
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    yield path, texts, toxic, passage
    shutil.rmtree(path)


def test_stages_take_effect(spark, sf_dir):
    path, texts, toxic, passage = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path))
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(300)) - toxic
    assert len(toxic & set(kept["toxicity"])) <= 2 and len(clean - set(kept["toxicity"])) <= 3
    assert 301 not in kept["line_dedup"] and passage in kept["line_dedup"][303] and passage not in kept["line_dedup"][304]
    assert 2 in kept["near_copies"] and 302 not in kept["near_copies"]
    assert 306 in kept["near_copies"] and 306 not in kept["decontamination"]
    assert set(kept["near_copies"]) - {306} == set(kept["decontamination"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    tokenizer = packing.Tokenizer.of("byte_bpe_50k.tiktoken")
    assert sum(r["length"] for r in pieces) == sum(len(tokenizer.ids(t, 1)) for t in kept["decontamination"].values())


def test_run_returns_pieces_of_what_stays(spark, sf_dir):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir[0]).select("doc_id").distinct().collect()}
    assert 1 in got and not got & {301, 302, 306}


def test_rows_of_one_id_stand_for_themselves(spark, odd, lexicon, tmp_path):
    """Rows without an id, or with an id that others have, go for their own text only."""
    rng = random.Random(12)
    a, b, c, d, e, f = (words(rng, 120, lexicon) for _ in range(6))
    item = words(rng, 40, lexicon)
    held = f"{words(rng, 30, lexicon)} {item} {words(rng, 30, lexicon)}"
    rows = [(20, a), (None, a + " tail"), (None, b), (None, c), (None, c + " tail"), (21, d), (22, d + " tail"), (22, e), (None, held), (23, held[:60] + f), (23, item + " " + f[:90])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str)
    left = corpus_pipeline.written(corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)))
    got = pairs(left)
    assert sum(x in got for x in ((None, c), (None, c + " tail"))) == 1
    assert [x for x in got if not (x[1] or "").startswith(c)] == sorted((x for x in rows if x[1] not in (a + " tail", d + " tail", c, c + " tail")), key=str)
    got = pairs(corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)))
    assert got == sorted((x for x in rows if item not in x[1]), key=str)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for stage in (corpus_pipeline.without_repeated_lines, corpus_pipeline.without_near_copies, corpus_pipeline.without_benchmark):
        kept = pairs(stage(spark, odd.select(columns), str(tmp_path)))
        assert {1, 2, 3, 5, 6} <= {i for i, _ in kept}


EXTRA = ["'a' AS __k", "1 AS n_lines", "array(2) AS removed_lines", "'b' AS __gone", "3 AS __key0", "4 AS node", "5 AS score", "'c' AS w"]


@pytest.fixture(scope="module")
def side_tables(spark, lexicon, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("side"))
    rng = random.Random(14)
    spark.createDataFrame([(1, words(rng, 40, lexicon)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (4, None, None), (None, 1, 1), (100, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/none/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, odd, side_tables, name):
    """Null and empty texts, null ids, repeated rows, a very long text, columns with the names of helpers; and empty tables."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *EXTRA)
    none = docs.limit(0)
    assert stage(spark, none, side_tables).collect() == [] and stage(spark, none, f"{side_tables}/none").collect() == []
    before = sorted(map(str, docs.collect()))
    for path in (side_tables, f"{side_tables}/none"):
        out = stage(spark, docs, path)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
            continue
        assert out.schema.simpleString() == docs.schema.simpleString()
        after = sorted(map(str, rows))
        if name == "near_copies":  # 4, its repeated row, its longer form, the one without an id and 7 differ in a word or two
            assert {1, 2, 3, 4, 5, 6, 7} - {7} <= {r["doc_id"] for r in rows} and len(set(after)) == len(after) and set(after) <= set(before)
        else:
            assert after == before
