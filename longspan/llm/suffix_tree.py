"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words and one end per text. The root is the add-one word distribution. Below it stand contexts of one to
``DEPTH`` words: those that occur ``CONTEXT`` times or more and whose next-symbol distribution diverges from their
parent's by more than its own description costs. A context has an explicit entry for a next word seen with it at least
``LEAST`` times if the entry alone gains more than it costs: the logarithm of the number of words, to name one, and half
that of the context's occurrences, to give its number. The discounted rest goes to the parent's distribution, so every
state is a proper distribution. Contexts of two words and more are those of which every two words in a row are an entry.
A token is scored in the state of the longest kept suffix.

Thresholds are numbers of occurrences, not shares, so the tree grows with the input. One pass counts words, one (context,
word) for contexts of one word, one those for longer contexts, where all pairs of words in them are frequent enough.
Tasks count first and shuffle what they counted packed by ranges of contexts' hashes (contexts of more than a range's
share are dealt by word); reducers add up and keep what is frequent. The divergence test, totals and parents are joins
by hash, from the root on.

The tree is a table: what a word, or a word after a context, adds to the score of the text it stands in. A word adds the
root's log probability and what its state as a context leaves to the root; an entry adds what it has beyond its parent,
and what its own state leaves to the shorter one. Occurrences are joined to that table, summed by text before.

Memory is of fixed size and never decides a result: bitmaps of hashes (frequent words, contexts and entries) only spare
rows that can't meet anything, two-byte names of the ``SHORT`` most frequent words only shorten what is shuffled, and the
most frequent rows of the table are broadcast (at most ``HOT``, of 25 bytes) so that they need no join. Words and
contexts count as their 64-bit hashes.

Defined results: null and empty texts are one end; null ids are scored, learned from by nobody and not held out;
repeated rows count and are scored each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import discard, lean, sliced, small_batches, table, trim, written

END = " "
DEPTH = 4
CONTEXT = 16
LEAST = 4
HOT = 1 << 20
SHORT = 1 << 16
DISCOUNT = 0.75
BITS = 27
CHUNK = 1_000_000
#: Bytes of text that are cut into words at once.
BYTES = 1 << 21
ROWS = 128
#: Texts that are scored at once: each of their tokens has a row for its word and for each length of context.
SCORED = 128
#: Occurrences in a range of contexts, which one reducer holds.
RANGE = 1 << 20


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of xxHash
SEED = 42


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _last(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def joined(value: np.ndarray, seed: np.ndarray | int = SEED) -> np.ndarray:
    """What xxhash64 of Spark makes of a long after the columns whose hash is seed."""
    h = (seed.view(np.uint64) if isinstance(seed, np.ndarray) else np.full(len(value), seed, np.uint64)) + P5 + np.uint64(8)
    return _last(_turn(h ^ _turn(value.view(np.uint64) * P2, 31) * P1, 27) * P1 + P4)


def hashed(strings: np.ndarray) -> np.ndarray:
    """What xxhash64 of Spark makes of strings of equal length, as rows of less than 32 bytes."""
    n, size = strings.shape
    h, at = np.full(n, SEED, np.uint64) + P5 + np.uint64(size), 0
    while size - at >= 8:
        k = np.ascontiguousarray(strings[:, at : at + 8]).view(np.uint64)[:, 0]
        h, at = _turn(h ^ _turn(k * P2, 31) * P1, 27) * P1 + P4, at + 8
    if size - at >= 4:
        k = np.ascontiguousarray(strings[:, at : at + 4]).view(np.uint32)[:, 0].astype(np.uint64)
        h, at = _turn(h ^ k * P1, 23) * P2 + P3, at + 4
    for k in range(at, size):
        h = _turn(h ^ strings[:, k].astype(np.uint64) * P5, 11) * P1
    return _last(h)


END_CODE = int(hashed(np.frombuffer(END.encode(), np.uint8).reshape(1, -1))[0])


def token_runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, numbers of tokens and hashes of tokens (A-Z lower-cased words and an end) of runs of texts; null is empty."""
    if len(texts) > ROWS:
        for at in range(0, len(texts), ROWS):
            yield from ((at + lo, lengths, ids) for lo, lengths, ids in token_runs(texts.slice(at, ROWS)))
        return
    filled = texts.fill_null("").cast(pa.large_string())
    edges = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(filled):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BYTES, "right")) - 1)
        bounds = edges[lo : hi + 1] - edges[lo]
        text = data[edges[lo] : edges[hi]].copy()
        text[(text >= 65) & (text <= 90)] += 32
        word = ~((text == 32) | ((text >= 9) & (text <= 13)))
        begins, ends = word.copy(), word.copy()
        cut = np.zeros(len(text) + 1, bool)  # between two texts
        cut[bounds] = True
        begins[1:] &= ~word[:-1] | cut[1:-1]
        ends[:-1] &= ~word[1:] | cut[1:-1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = end - begin
        code = np.empty(len(begin), np.int64)
        order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
        steps = np.searchsorted(size[order], np.arange(1, 33))
        for k in range(1, 32):
            some = order[steps[k - 1] : steps[k]]
            if len(some):
                code[some] = hashed(text[begin[some][:, None] + np.arange(k)])
        for k in order[steps[31] :].tolist():
            code[k] = np.uint64(xxhash.xxh64_intdigest(text[begin[k] : end[k]].tobytes(), SEED)).view(np.int64)
        lengths = np.diff(np.searchsorted(begin, bounds)) + 1
        out = np.full(int(lengths.sum()), END_CODE, np.int64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = code
        yield lo, lengths, out
        lo = hi


def word_counts(docs: DataFrame) -> DataFrame:
    """code, c of all tokens of docs, by hash; summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            code, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(c.astype(np.int64))], ["code", "c"])

        for b in batches:
            for _, _, ids in token_runs(b.column(0)):
                held.append(ids)
                size += len(ids)
                if size > CHUNK:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return docs.select("text").mapInArrow(lean(run), "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _places(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return code & ((1 << BITS) - 1), (code >> (64 - BITS)) & ((1 << BITS) - 1)


class Bitmap:
    """A set of hashes by two bits of each: what is in the set is found, a little else is too."""

    def __init__(self, rows: DataFrame, code: Column):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros((1 << BITS - 15, 4096), np.uint8)
            for b in batches:
                for at in _places(b.column(0).to_numpy()):
                    np.bitwise_or.at(bits.reshape(-1), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            some = np.flatnonzero(bits.any(axis=1))
            for part in (some[k : k + 256] for k in range(0, len(some), 256)):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([bits[k].tobytes() for k in part], pa.binary())], ["b", "bits"])

        parts = rows.select(code.alias("code")).mapInArrow(lean(run), "b long, bits binary").groupBy("b").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.bits = np.zeros(1 << BITS - 3, np.uint8)
        for r in parts.coalesce(8).toLocalIterator():  # at most 2^(BITS - 15) rows of 4 KB, an eighth at a time
            self.bits[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    def has(self, code: np.ndarray) -> np.ndarray:
        out = np.ones(len(code), bool)
        for at in _places(code):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _shifted(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _levels(ids: np.ndarray, lengths: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, ... symbols, at each token: the context, the token after it, and whether there are so many before.

    Both by hash. A text begins after an end.
    """
    at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = ids
    for d in range(1, depth + 1):
        context = _shifted(code)
        if d == 1:
            context[at == 0] = END_CODE
        code = joined(ids, joined(context))
        yield context, code, at >= d - 1


PACKED = "depth int, bucket long, short boolean, ctx binary, size binary, word binary, n binary"


def _pack(depth: int, held: list[list[np.ndarray]], buckets: int, short: np.ndarray) -> pa.RecordBatch:
    """The (context, word) of a chunk, counted: a row per range of contexts' hashes, one for words with short names and one for others.

    held has the parts of four columns: the hash of both, context, word and whether it is hot. Each goes when it is read.
    """

    def column() -> np.ndarray:
        return np.concatenate(held.pop(0))

    code = column()
    order = np.argsort(code).astype(np.uint32)  # a chunk and a run of texts are far below 2^32
    code = code[order]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(begin, len(code))).astype(np.uint32)
    order = order[begin]
    del code, begin
    context = column()[order]
    word = column()[order]
    hot = column()[order]
    order = np.argsort(context.view(np.uint64))
    context, word, hot, n = context[order], word[order], hot[order], n[order]
    del order
    by = np.where(hot, word, context).view(np.uint64)
    bucket = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    del by, hot
    name = np.minimum(np.searchsorted(short, word), max(0, len(short) - 1))
    named = short[name] == word if len(short) else np.zeros(len(word), bool)
    kind = bucket * 2 + ~named
    if buckets < 1 << 15:
        kind = kind.astype(np.uint16)
    order = np.argsort(kind, kind="stable")  # contexts stay in order
    kind = kind[order]
    edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    rows: list[tuple] = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        some = order[lo:hi]
        c = context[some]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        is_short = bool(named[some[0]])
        names = name[some].astype(np.uint16) if is_short else word[some]
        rows.append((depth, int(bucket[some[0]]), is_short, c[first].tobytes(), np.diff(np.append(first, len(c))).astype(np.uint32).tobytes(), names.tobytes(), n[some].tobytes()))
    types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in PACKED.split(", ")])


def _unpacked(rows: pa.Table, least: int, short: np.ndarray) -> pa.Table:
    """depth, ctx, word, n of what a range's packed rows hold least times or more."""
    parts = []
    for is_short, c, size, word, n in zip(*(rows.column(x).to_pylist() for x in ("short", "ctx", "size", "word", "n"))):
        names = short[np.frombuffer(word, np.uint16)] if is_short else np.frombuffer(word, np.int64)
        parts.append((np.repeat(np.frombuffer(c, np.int64), np.frombuffer(size, np.uint32)), names, np.frombuffer(n, np.uint32)))
    context, word, n = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order].astype(np.int64)
    del order
    begin = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    n = np.add.reduceat(n, begin)
    kept = n >= least
    return pa.table({"depth": np.full(int(kept.sum()), rows.column("depth")[0].as_py(), np.int32), "ctx": context[begin][kept], "word": word[begin][kept], "n": n[kept]})


def entries(docs: DataFrame, depths: list[int], contexts: Broadcast, seen: Broadcast, least: int, buckets: int, hot: list[int], short: np.ndarray) -> DataFrame:
    """depth, ctx, word, n of the words seen least times or more after contexts of depths symbols: 1, or some that are more.

    contexts and seen are bitmaps: of the words that may be contexts and of frequent words; for more than 1, of pairs of words.
    hot are the words, or pairs, of more than a range's share.
    """
    hot_array = np.array(sorted(hot), np.int64)

    def found(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        before = None
        for d, (context, code, deep) in enumerate(_levels(ids, lengths, depths[-1]), 1):
            if d == 1:
                last, may = (context, contexts.value.has(context)) if depths == [1] else (_shifted(code), _shifted(contexts.value.has(code)))
                frequent = seen.value.has(ids if depths == [1] else code)
                before = np.ones(len(ids), bool) if depths == [1] else may
                if depths != [1]:
                    continue
            elif d > 2:  # all pairs of the context
                before = before & _shifted(may)
                may = _shifted(may)
            at = np.flatnonzero(deep & frequent & (may if depths == [1] else before))
            some = last[at]
            near = np.minimum(np.searchsorted(hot_array, some), max(0, len(hot_array) - 1))
            yield d, code[at], context[at], ids[at], hot_array[near] == some if len(hot_array) else np.zeros(len(at), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {d: [] for d in depths}
        size = dict.fromkeys(depths, 0)

        def flush(d: int) -> pa.RecordBatch:
            some = [list(x) for x in zip(*held[d])]
            held[d], size[d] = [], 0
            return _pack(d, some, buckets, short)

        for b in batches:
            for _, lengths, ids in token_runs(b.column(0)):
                for d, *some in found(ids, lengths):
                    held[d].append(some)
                    size[d] += len(some[0])
                    if size[d] > CHUNK // len(depths):
                        yield flush(d)
        for d in depths:
            if size[d]:
                yield flush(d)

    def frequent_ones(rows: pa.Table) -> pa.Table:
        out = _unpacked(rows, least, short)
        trim()
        return out

    packed = docs.select("text").mapInArrow(lean(run), PACKED)
    return packed.groupBy("depth", "bucket").applyInArrow(frequent_ones, "depth int, ctx long, word long, n long")


def _states(entries: DataFrame, v: int) -> DataFrame:
    """ctx of the contexts that pass the test against their parents, and rest: the log10 of the share that goes to the parent.

    entries has ctx, n, total (the context's own number), parent (log10 of the word's probability in the parent) and pays.
    """
    p = F.pow(F.lit(10.0), "parent")
    sums = entries.where("pays").groupBy("ctx").agg(
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(p).alias("p"),
        F.sum(_gain()).alias("gain"),
    )
    left = F.col("total") - F.col("n")
    beyond = F.when(left > 0, left * F.log(left / F.col("total") / F.greatest(F.lit(1e-12), 1 - F.col("p")))).otherwise(0.0)
    low = F.greatest(F.lit(1e-12), 1 - (F.col("n") - F.col("k") * DISCOUNT) / F.col("total"))
    return sums.where(F.col("gain") + beyond > F.col("k") * _cost(v)).select("ctx", F.log10(low).alias("rest"))


def _cost(v: int) -> Column:
    """What an entry costs: its word's name among v and its number."""
    return F.lit(float(np.log(max(1, v)))) + 0.5 * F.log("total")


def _gain() -> Column:
    """What an entry adds to the log probability of the text, in place of its parent."""
    return F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("parent") * F.lit(float(np.log(10))))


def _added() -> Column:
    """log10 of an entry's probability less that of its parent and the rest that it does not need."""
    return F.when(F.col("rest").isNull() | ~F.col("pays"), 0.0).otherwise(F.log10((F.col("n") - DISCOUNT) / F.col("total") + F.pow(F.lit(10.0), F.col("rest") + F.col("parent"))) - F.col("parent") - F.col("rest"))


class Tree:
    """The model: n tokens of v distinct words; words (code, n, root) and for each depth its entries and states.

    Entries have code (the hash of context and word), n, par (code of the entry in the parent), added, log (log10 of the
    probability there) and whole (made of pairs that are entries); states have ctx and rest.
    """

    def __init__(self, n: int, v: int, words: DataFrame, levels: list[tuple[DataFrame, DataFrame]]):
        self.n, self.v, self.words, self.levels = n, v, words, levels

    def table(self) -> DataFrame:
        """code, n, base, value, known: what each word and entry adds to the scores of a text."""

        def with_rest(rows: DataFrame, depth: int) -> DataFrame:
            if depth == len(self.levels):
                return rows.withColumn("rest", F.lit(0.0))
            rest = self.levels[depth][1].select(F.col("ctx").alias("code"), "rest")
            return rows.join(rest, "code", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))

        out = with_rest(self.words, 0).select("code", "n", F.col("root").alias("base"), (F.col("root") + F.col("rest")).alias("value"), F.lit(1).alias("known"))
        for d, (found, _) in enumerate(self.levels, 1):
            rows = with_rest(found.select("code", "n", "added"), d)
            out = out.unionByName(rows.select("code", "n", F.lit(None).cast("double").alias("base"), (F.col("added") + F.col("rest")).alias("value"), F.lit(0).alias("known")).where("value <> 0"))
        return out


def fit(docs: DataFrame, counts: DataFrame, depth: int = DEPTH, context: int = CONTEXT, least: int = LEAST) -> Tree:
    """The tree of docs, whose word_counts are counts."""
    spark = docs.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.select("code", F.col("c").alias("n"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("root"))
    short = np.array(sorted(r["code"] for r in words.orderBy(F.desc("n"), "code").limit(SHORT).select("code").collect()), np.int64)
    buckets = max(64, n // RANGE)

    def counted(rows: DataFrame, depths: list[int]) -> DataFrame:
        """entries after the frequent ones of rows, the words or pairs."""
        hot = [r["code"] for r in rows.where(F.col("n") * buckets > n).select("code").collect()]  # fewer than buckets
        maps = [spark.sparkContext.broadcast(Bitmap(x, F.col("code"))) for x in (rows.where("whole").where(F.col("n") >= context), rows)]
        with small_batches(spark):
            out = written(entries(docs, depths, *maps, least, buckets, hot, short))
        for x in maps:
            x.destroy()
        return out

    before = words.where(F.col("n") >= least).select("code", "n", F.lit(None).cast("long").alias("par"), F.col("root").alias("log"), F.lit(True).alias("whole"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    tables: list[DataFrame] = []
    for d in range(1, depth + 1):
        if d < 3:
            tables.append(counted(before, [1] if d == 1 else list(range(2, depth + 1))))
        asked = before.where("whole").where(F.col("n") >= context)
        asked = asked.select(F.col("code").alias("ctx"), F.col("n").alias("total"), F.col("par").alias("shorter"))
        found = tables[-1].where(F.col("depth") == d).drop("depth").join(asked, "ctx")
        found = found.withColumn("par", F.col("word") if d == 1 else F.xxhash64("shorter", "word"))
        found = written(found.join(before.select(F.col("code").alias("par"), F.col("log").alias("parent"), "whole"), "par").drop("shorter").withColumn("pays", _gain() > _cost(v)))
        states = written(_states(found, v))
        log = F.col("parent") + F.coalesce("rest", F.lit(0.0)) + _added()
        before = written(found.join(states, "ctx", "left").select(F.xxhash64("ctx", "word").alias("code"), "n", "par", _added().alias("added"), log.alias("log"), (_added() != 0 if d == 1 else F.col("whole")).alias("whole")))
        discard(found)
        levels.append((before, states))
    discard(*tables)
    return Tree(n, v, words, levels)


def _hot_from(rows: DataFrame) -> float:
    """The least n from which on there are at most HOT rows, to a sixteenth of an octave."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    counts = {r["step"]: r["count"] for r in rows.groupBy(step).count().collect()}  # a row per sixteenth of an octave
    total, least = 0, max(counts, default=0) + 1
    for s in sorted(counts, reverse=True):
        total += counts[s]
        if total > HOT:
            break
        least = s
    return 2.0 ** (least / 16)


def _sorted(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """code, base, value, known of rows, at most HOT, in order of code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(0).to_numpy(zero_copy_only=False), *(b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (1, 2)), b.column(3).to_numpy(zero_copy_only=False).astype(bool)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["code", "base", "value", "known"])

    packed = rows.select("code", "base", "value", "known").mapInArrow(lean(run), "code binary, base binary, value binary, known binary").collect()
    columns = [np.frombuffer(b"".join(r[k] for r in packed), kind) for k, kind in enumerate((np.int64, float, float, bool))]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


PARTS = "key long, code long, tf int, doc_id long, held_out boolean, n_tokens long, n_frequent long, n_joined long, base_part double, score_part double"


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; docs has doc_id, text, held_out."""
    spark = docs.sparkSession
    n, v, depth = tree.n, tree.v, len(tree.levels)
    full = written(tree.table())
    least = _hot_from(full)
    hot = _sorted(full.where(F.col("n") >= least))
    held = spark.sparkContext.broadcast((hot, Bitmap(full.where("known = 0"), F.col("code"))))
    schema = pa.schema([("key", pa.int64()), ("code", pa.int64()), ("tf", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("n_joined", pa.int64()), ("base_part", pa.float64()), ("score_part", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, base, value, known), bits = held.value

        def find(of):
            at = np.minimum(np.searchsorted(codes, of), max(0, len(codes) - 1))
            return at, (codes[at] == of) if len(codes) else np.zeros(len(of), bool)

        for b in sliced(batches, SCORED):
            for lo, lengths, ids in token_runs(b.column(3)):
                size = len(lengths)
                row = np.repeat(np.arange(size), lengths)
                at, frequent = find(ids)
                frequent &= known[at] if len(codes) else False
                total = lambda a, x: np.bincount(row[a], x, size)
                base_part, score_part = (total(frequent, x[at[frequent]]) if len(codes) else np.zeros(size) for x in (base, value))
                rest = [(row[~frequent], ids[~frequent])]
                for _, code, deep in _levels(ids, lengths, depth):
                    a = np.flatnonzero(deep & bits.has(code))
                    where, of = row[a], code[a]
                    at2, found = find(of)
                    if found.any():
                        score_part = score_part + np.bincount(where[found], value[at2[found]], size)
                    rest.append((where[~found], of[~found]))
                where, of = (np.concatenate(x) for x in zip(*rest))
                order = np.lexsort((of, where))
                where, of = where[order], of[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (where[1:] != where[:-1])
                begin = np.flatnonzero(new)
                tf = np.diff(np.append(begin, len(of))).astype(np.int32)
                some = b.slice(lo, size)
                keys = np.asarray(some.column(0))
                rows = len(begin)
                none = [pa.nulls(rows, f.type) for f in schema][3:]
                yield pa.RecordBatch.from_arrays([pa.array(keys[where[begin]]), pa.array(of[begin]), pa.array(tf), *none], schema=schema)
                n_frequent = np.bincount(row[frequent], minlength=size)
                columns = [pa.array(x) for x in (lengths.astype(np.int64), n_frequent.astype(np.int64), (lengths - n_frequent).astype(np.int64), base_part.astype(float), score_part.astype(float))]
                # A text's own row meets nothing: its code is spread by the key, its tf null.
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(joined(keys.astype(np.int64))), pa.nulls(size, pa.int32()), some.column(1), some.column(2), *columns], schema=schema)

    parts = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", "text").mapInArrow(lean(run), PARTS)
    met = parts.join(full.where(F.col("n") < least).select("code", "base", "value", "known"), "code", "left")
    firsts = [F.max(c).alias(c) for c in PARTS.replace(",", "").split()[6::2]]
    sums = met.groupBy("key").agg(
        *firsts,
        F.coalesce(F.sum(F.col("tf") * F.col("base")), F.lit(0.0)).alias("base"),
        F.coalesce(F.sum(F.col("tf") * F.col("value")), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum(F.col("tf") * F.col("known")), F.lit(0)).alias("known"),
    )
    unseen = (F.col("n_joined") - F.col("known")) * F.lit(-float(np.log10(n + v + 1)))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.col("known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.col("base") + unseen).alias("base_score"),
        (F.col("score_part") + F.col("value") + unseen).alias("score"),
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.coalesce(fold != 2, F.lit(False)).alias("learned"))
    training = docs.where("learned")
    with small_batches(spark):
        counts = written(word_counts(training))
    return score(docs, fit(training, counts), counts)


QUERIES = {"op3_suffix_tree": op3_suffix_tree}
ORACLE_SQL: dict[str, str] = {}
