"""Bootstrap of ranking metrics: Poisson weights of all replicates as one vector, summed by score.

A row's weights come from a hash of its keys, so a lost task repeats them. A task sums the weight vectors of its rows
by group and score, so rows are neither repeated nor multiplied by replicates and a score that many rows share is a row
of each task. Vectors are cut into ranges of scores (``ranges``); the vector of what stands above a range, one for each
range and group, is added to the running sums within it, and each range gives its part of all replicates' metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.operators.ranges import ranged

#: Scores times replicates of one range, 16 bytes each.
RANGE_CELLS = 1 << 22
TWO_32 = 2**32


def poisson_thresholds() -> list[int]:
    """Numbers up to 2^32 that a uniform one below it passes k times with the Poisson(1) probability of k or more."""
    total, out = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out.append(min(TWO_32, round(total * TWO_32)))
    return out


def weights(base: np.ndarray, reps: int) -> np.ndarray:
    """rows x reps: Poisson weights from 32-bit bases; only products below 2^63, so that SQL can say the same."""
    x = base.astype(np.int64)[:, None] ^ (np.arange(1, reps + 1, dtype=np.int64) * 2654435761 % TWO_32)
    for _ in range(2):
        x = (x ^ (x >> 16)) * 73244475 % TWO_32
    return np.searchsorted(np.array(poisson_thresholds()), x ^ (x >> 16), side="right")


def _sums(group: list[str], reps: int):
    """By group and score: the vectors of weights (n) and of positives' weights (pos)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            code = b.groupby([*group, "score"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
            w = weights(b["base"].to_numpy(), reps)[order]
            hit = w * b["y"].to_numpy()[order, None]
            out = b.iloc[order[first]][[*group, "score"]].copy()
            for name, x in (("n", w), ("pos", hit)):
                out[name] = [v.tobytes() for v in np.add.reduceat(x, first, axis=0).astype(np.int64)]
            yield out

    return run


def _matrix(values: pd.Series, reps: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(-1, reps)


def bootstrap(df: DataFrame, group: list[str], metric: str = "auprc", reps: int = 100, seed: int = 0, keys: list[str] = ("cell_id", "date"), y: str = "y", p: str = "p", range_cells: int = RANGE_CELLS) -> DataFrame:
    """group, mean and sample deviation of a metric (auprc, roc_auc) over Poisson resamples, and the number of resamples that have it.

    Rows without a score or a label take no part; rows of equal keys have equal weights.
    """
    if metric not in ("auprc", "roc_auc"):
        raise ValueError(metric)
    word = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    base = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    rows = df.select(*group, F.col(p).cast("double").alias("score"), F.col(y).cast("long").alias("y"), base.alias("base")).where("score IS NOT NULL AND y IS NOT NULL")
    fields = [rows.schema[g] for g in group]
    named = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    vectors = rows.mapInPandas(_sums(list(group), reps), f"{named}score double, n binary, pos binary")
    # One write: sums of tasks, dealt into ranges of as many scores as their vectors allow.
    held = ranged(vectors, list(group), [F.desc("score")], max(1, rows.count() * reps // range_cells))

    def total(x: pd.DataFrame) -> pd.DataFrame:
        out = x.iloc[:1][[*group, "__part"]].copy()
        for c in ("n", "pos"):
            out[c] = [_matrix(x[c], reps).sum(0).tobytes()]
        return out

    totals = held.groupBy(*group, "__part").applyInPandas(total, f"{named}__part int, n binary, pos binary")

    def above(x: pd.DataFrame) -> pd.DataFrame:
        """Of one group's ranges, a vector each: sums before it, and over all."""
        x = x.sort_values("__part")
        out = x[[*group, "__part"]].copy()
        for c in ("n", "pos"):
            m = _matrix(x[c], reps)
            up = np.cumsum(m, 0)
            out[f"{c}_before"] = [v.tobytes() for v in up - m]
            out[f"{c}_all"] = [up[-1].tobytes()] * len(x)
        return out

    offsets = totals.groupBy(*group).applyInPandas(above, f"{named}__part int, n_before binary, n_all binary, pos_before binary, pos_all binary")

    def parts(x: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        """A range's part of each replicate's metric."""
        x = x.sort_values("score", ascending=False, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(x["score"].to_numpy()) != 0]))
        n, pos = (np.add.reduceat(_matrix(x[c], reps), first, axis=0) for c in ("n", "pos"))
        before, all_n, tp_before, all_pos = (_matrix(o[c], reps)[0] for c in ("n_before", "n_all", "pos_before", "pos_all"))
        seen, tp = np.cumsum(n, 0) + before, np.cumsum(pos, 0) + tp_before
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == "auprc":
                v = np.where(pos > 0, pos / all_pos * tp / seen, 0.0).sum(0)
                v[all_pos == 0] = np.nan
            else:
                v = (pos * (all_n - all_pos - (seen - tp) + (n - pos) / 2)).sum(0) / (all_pos * (all_n - all_pos))
                v[all_pos * (all_n - all_pos) == 0] = np.nan
        out = x.iloc[:1][[*group]].copy()
        out["v"] = [v.tobytes()]
        return out

    values = held.groupBy(*group, "__part").cogroup(offsets.groupBy(*group, "__part")).applyInPandas(parts, f"{named}v binary")

    def summary(x: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(x["v"]), np.float64).reshape(-1, reps).sum(0)
        v = v[~np.isnan(v)]
        out = x.iloc[:1][[*group]].copy()
        out["mean"], out["std"], out["reps"] = [v.mean() if len(v) else None], [v.std(ddof=1) if len(v) > 1 else None], [len(v)]
        return out

    found = values.groupBy(*group).applyInPandas(summary, f"{named}mean double, std double, reps long")
    return found.select(*group, F.col("mean").alias(f"{metric}_mean"), F.col("std").alias(f"{metric}_std"), "reps")
