"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt to shards of at most ``SHARD`` rows. A shard keeps, for each dimension, its rows in order of their
component. For a query the lists are read from their better end, in steps; how much of a list is read in a step follows
how much it can still add. A row's lower bound adds the worst component of each list in which it has not been seen, its
upper bound the one last read there. Rows whose upper bound is below the k-th best lower bound can't qualify and leave;
lists are then read on for the others alone. Reading stops when no outsider can qualify, and the rows left get their
final scores from what is left of the lists.

Shards stay where they are: queries come to them in rounds of ``QUERY_BYTES`` at most, broadcast, and of each round only
a shard's k best rows per query leave a task. So what is shuffled grows with the rows, and memory is one shard and one
round.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; a query's own row is
the one with its vec_id; ties go to the smaller vec_id; rows that repeat an id stand each for itself (queries are their
distinct vectors); vectors of different lengths are not compared; null ids take no part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longspan.llm.common import table, written

SHARD = 4096
QUERY_BYTES = 16 << 20
SCALE = 1024


class Lists:
    """A shard's rows and its sorted lists: of each dimension its row numbers and values, from the highest and from the lowest value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        rising = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        values = np.take_along_axis(vectors.T, rising, 1)
        self.rows = [np.ascontiguousarray(rising[:, ::-1]), rising]
        self.places = [x + np.arange(len(x))[:, None] * x.shape[1] for x in self.rows]  # of a list's row among all lists'
        self.largest = int(np.abs(values).max(initial=0))
        values = values.astype(np.float64) if self.largest < 1 << 51 else values
        self.values = [np.ascontiguousarray(values[:, ::-1]), values]
        self.share = 0.0  # of the lists, read for the last query before no outsider could qualify

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows but those of id own, and of all that tie with the k-th."""
        dims, n = self.rows[0].shape
        lists, up = range(dims), query < 0
        side = up.astype(int).tolist()
        rows, values = [self.rows[side[d]][d] for d in lists], [self.values[side[d]][d] for d in lists]  # each list from its better end
        q, alive = query.astype(np.float64), self.ids != own
        gain, seen, at = np.zeros(n), np.zeros(dims * n, np.float32), np.zeros(dims, np.int64)
        worst = q * np.array([v[-1] for v in values], np.float64)
        adds = np.empty((dims, n))  # what each entry adds over the worst of its list
        for k_side, some in enumerate((~up, up)):
            adds[some] = self.values[k_side][some] * q[some, None] - worst[some, None]

        def read(sizes: np.ndarray) -> None:
            """Reads on, so far in each list, for the rows that are alive."""
            spans = [slice(a, a + m) for a, m in zip(at.tolist(), sizes.tolist())]
            found, value, place = (np.concatenate([x[d][spans[d]] for d in lists]) for x in (rows, adds, [self.places[side[d]][d] for d in lists]))
            if 2 * left < n:
                keep = np.flatnonzero(alive[found])
                found, value, place = found[keep], value[keep], place[keep]
            gain[:] += np.bincount(found, value, n)
            seen[place] = 1
            at[:] += sizes

        while (left := int(alive.sum())) > k:
            slack = np.where(at < n, adds[np.arange(dims), np.minimum(at, n - 1)], 0.0)  # what an unseen component adds at most
            lower = gain[alive]
            kth = np.partition(lower, left - k)[left - k]
            upper = gain + slack.sum() - slack.astype(np.float32) @ seen.reshape(dims, n)
            alive &= upper + 1e-5 * slack.sum() + 1 >= kth
            left = int(alive.sum())
            if left <= k or not slack.any():
                break  # no outsider can qualify, or all is read and the rest ties
            budget = max((n * dims - int(at.sum())) * 0.75, n * dims // 8)  # most of what is left, dealt by what lists can add
            read(np.minimum(np.ceil(budget * slack / slack.sum()).astype(np.int64), n - at))
        self.share = float(at.sum()) / max(1, n * dims)
        best = np.flatnonzero(alive)
        if self.largest * int(np.abs(query).max(initial=0)) * dims < 1 << 51:  # sums of whole numbers so far are exact
            read(n - at)
            score = (gain[best] + worst.sum()).astype(np.int64)
        else:
            place = np.zeros(n, np.int64)
            place[best] = np.arange(len(best))
            whole = np.zeros((len(best), dims), np.int64)
            for d in lists:
                keep = alive[rows[d]]
                whole[place[rows[d][keep]], d] = values[d][keep]
            score = whole @ query
        if len(best) > k:
            kth = np.partition(score, len(best) - k)[len(best) - k]
            best, score = best[score >= kth], score[score >= kth]
        return best, score


def scaled(c):
    """floor(SCALE * x) of each component, or null if one is null or not finite."""
    x = F.transform(c, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(c) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


PACKED = "dims int, ids binary, vectors binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """vec_id and v of at most size rows of a partition together, by length of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def row(dims: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dims)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.stack(vectors).tobytes()])], ["dims", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy(zero_copy_only=False)
                ids, vectors = held.setdefault(len(x), ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == size:
                    yield row(len(x))
        for dims in list(held):
            yield row(dims)

    return rows.select("vec_id", "v").mapInArrow(run, PACKED)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dims, ids, vectors, asked, queries = (b.column(c)[r].as_py() for c in range(5))
                lists = Lists(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dims))
                out: list[list[np.ndarray]] = [[], [], []]
                for own, query in zip(np.frombuffer(asked, np.int64), np.frombuffer(queries, np.int64).reshape(-1, dims)):
                    rows, score = lists.top(query, own, k)
                    best = np.lexsort((lists.ids[rows], -score))[:k]
                    out[0].append(np.full(len(best), own))
                    out[1].append(lists.ids[rows[best]])
                    out[2].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, shard: int = SHARD, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row of vectors for which is_query holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    per_block = max(1, query_bytes // (8 * (longest or 1) + 8))
    asked = written(_packed(rows.where(is_query).distinct(), per_block))
    shards = written(_packed(rows.repartition(max(1, -(-n // shard))), shard))
    blocks = asked.select(F.octet_length("ids").alias("bytes"), F.monotonically_increasing_id().alias("block")).collect()  # one or two numbers a block
    rounds: list[list[int]] = [[]]
    size = 0
    for r in blocks:
        size += r["bytes"] * ((longest or 1) + 1)
        if size > query_bytes and rounds[-1]:
            rounds.append([])
            size = r["bytes"] * ((longest or 1) + 1)
        rounds[-1].append(r["block"])
    found = None
    for some in rounds:
        queries = asked.withColumn("block", F.monotonically_increasing_id()).where(F.col("block").isin(some)).select("dims", F.col("ids").alias("asked"), F.col("vectors").alias("queries"))
        work = shards.join(F.broadcast(queries), "dims").select("dims", "ids", "vectors", "asked", "queries")  # query_bytes at most
        part = work.mapInArrow(_search(k), "query_id long, vec_id long, score long")
        part = written(part) if len(rounds) > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op5_topk": op5_topk}
ORACLE_SQL = {
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
