"""Groups of spelling variants: words within one edit of one another, by forward and reversed sorted dictionaries.

Let m be the length of the shorter of two words that differ by one inserted, deleted or replaced code point, and p the
number of code points they share from the start. Then for any segment [lo, hi) of 0..m that holds p, both begin with the
same lo code points and end with the same m - hi: one edit leaves one half of a word intact, and of the other half one
half again. So each word stands, for its own length and for that below it, in a block of the forward dictionary (words
that share the first half: the edit is in the second) and in one of the dictionary of reversed words (words that share
the second half). Both are sorted by Spark and scanned range by range: a sort-merge join on the shared part verifies the
pairs of a range as it meets them, and only near ones leave it. Blocks of more than ``LIMIT`` comparisons are subdivided:
their members go to the two halves of the segment, with more of the word shared, until a block is small or only one
place is left open (at most one word for each letter there, and two letters in longer words). A pair is reported only in
the segment that holds its p, so once.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent; forms are followed to the last by
doubling steps, which end as frequencies rise by that ratio each time. Words are counted in the tasks before they are
shuffled, and what is shuffled afterwards grows with the dictionary, not with the corpus.

Defined results: null and empty texts have no words; a null id counts as an empty one where ids take part (``drop_one_in``);
rows that repeat count each; an empty table has no words; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import lower_ascii, table, written

#: Letters of a word, as a character class.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Comparisons of a block beyond which it is subdivided.
LIMIT = 1024
BLOCK = ["m", "lo", "hi", "head", "tail"]


def without_one(word: Column, at: Column) -> Column:
    """word without its code point at, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased, of at least min_length letters and min_count occurrences.

    drop_one_in: the occurrences in a document of the runs whose crc32 of ``<id>:<run>`` it divides lose a letter, which
    plants misspellings of known origin.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("d"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("d", lower_ascii(F.col("run")).alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat(F.coalesce("d", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.length("word")).cast("int")
        runs = runs.select(F.when(F.col("h") % drop_one_in == 0, without_one(F.col("word"), at)).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _block(lo: Column, hi: Column) -> list[Column]:
    """The columns of BLOCK for the segment [lo, hi) of class m, and those that stay."""
    tail = F.col("m") - hi
    return [F.col("m"), lo.alias("lo"), hi.alias("hi"), F.substring("word", F.lit(1), lo).alias("head"), F.reverse(F.substring("word", F.length("word") - tail + 1, tail)).alias("tail"), F.col("word"), F.col("n"), F.col("short")]


def _halves(rows: DataFrame) -> DataFrame:
    """rows of segments [lo, hi), each in the blocks of both halves of its segment."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = F.array(F.struct(mid.alias("from"), F.col("hi").alias("to")), F.struct(F.col("lo").alias("from"), mid.alias("to")))
    return rows.withColumn("s", F.explode(cut)).select(*_block(F.col("s.from"), F.col("s.to")))


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """u, n_u, v, n_v: each unordered pair of words (word, n; word distinct) within one edit, once; u is the shorter or smaller one."""
    classes = F.array(F.struct(F.length("word").alias("m"), F.lit(True).alias("short")), F.struct((F.length("word") - 1).alias("m"), F.lit(False).alias("short")))
    rows = words.withColumn("c", F.explode(classes)).select("word", "n", "c.m", "c.short", F.lit(0).alias("lo"), F.col("c.m").alias("hi")).where("m > 0")
    single = rows.where("hi = 1").select(*_block(F.col("lo"), F.col("hi")))
    level, done = written(_halves(rows.where("hi > 1")).unionByName(single)), []
    while True:
        n = {x: F.count(F.when(F.col("short") == y, 1)) for x, y in (("a", True), ("b", False))}
        sizes = level.groupBy(*BLOCK).agg(n["a"].alias("a"), n["b"].alias("b"))
        large = written(sizes.where(F.col("a") * (F.col("a") - 1) / 2 + F.col("a") * F.col("b") > limit).where("hi - lo > 1").select(*BLOCK))
        if large.isEmpty():
            done.append(level)
            break
        done.append(level.join(large, BLOCK, "left_anti"))
        level = written(_halves(level.join(large, BLOCK)))
    blocks = reduce(DataFrame.unionByName, done)
    u = blocks.where("short").drop("short").withColumnsRenamed({"word": "u", "n": "n_u"})
    v = blocks.withColumnsRenamed({"word": "v", "n": "n_v"})
    here = "hi = m OR substring(u, 1, hi) <> substring(v, 1, hi)"
    met = u.hint("merge").join(v, BLOCK).where("NOT short OR u < v").where(here).where("levenshtein(u, v, 1) = 1")
    return met.select("u", "n_u", "v", "n_v")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of rows word, form: the last form that following forms leads to. Forms lead to no cycle."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("next"))
        doubled = written(steps.join(further, steps["root"] == further["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if doubled.where("moved").isEmpty():
            return doubled.select("word", "root")
        steps = doubled.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = written(near_pairs(words, limit))
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("n_v").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("n_u").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    known = written(known)
    roots = last_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(corpus_words(docs, drop_one_in=199))


QUERIES = {"op13_spelling": op13_spelling}
ORACLE_SQL = {
    "op13_spelling": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT range AS i FROM range(256)))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS k FROM runs GROUP BY ALL
), keyed AS (
  SELECT word, k, flatten(list_transform(string_split(concat(doc_id, ':', word), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes FROM lowered
), hashed AS (
  SELECT word, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM keyed, crc
), planted AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(word, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) AS INT) + 2) ELSE word END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM planted WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), less AS (
  SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS x FROM cut
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.x = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS reached, 0 AS step FROM known UNION ALL SELECT walk.word, k.form, step + 1 FROM walk JOIN known k ON k.word = walk.reached WHERE k.form IS NOT NULL
), roots AS (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN roots USING (word)"""
}
