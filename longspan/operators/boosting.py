"""Gradient boosting of trees that grow leaf by leaf, with a limit of leaves, patience, and columns and rows sampled per tree.

Features are cut into bins at exact quantiles of the training rows; bin 0 is a missing value. The binned rows are written
once, and again with their margins after every ``SNAPSHOT`` trees; tasks add the few trees since then, so nothing is
cached and a lost executor repeats one job. A job sums gradients by (node, feature, bin), in the tasks first, runs over
the bins of each (node, feature) for its best split, with missing values on either side, and sends one row for each
(node, feature) to the driver, which picks the split of most gain, as in best-first growth. The children of all nodes
that may still be split are summed in one job, so a tree takes a job a level and not one a leaf; splits that best-first
growth doesn't reach are dropped again, and the tree is the one that growing leaf by leaf gives.

Training rows with a null label or no weight above 0 are an error; ties of gain (to 9 digits) go to the earlier feature,
then the lower bin, then missing values to the left.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.operators.quality import ContractError, required
from longspan.operators.ranks import cut_points
from longspan.sources.scratch import discard, written
from longspan.sources.sinks import write_text

SNAPSHOT = 10


@dataclass
class Settings:
    """trees, rate, leaves, depth, bins; least rows and hessian of a leaf; l2 on leaf values; shares of rows and columns per tree; rounds without a better validation metric (loss or auprc) that end it."""

    trees: int = 500
    rate: float = 0.03
    leaves: int = 31
    depth: int = 5
    bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    min_gain: float = 0.0
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 30
    stop_on: str = "auprc"
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, 0 the root: feature (-1: a leaf), bin (values of it and below go left), whether missing ones go left, children, value, and rows of training (cover)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        for column, leaf in ((self.feature, -1), (self.bin, 0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0)):
            column.extend([leaf, leaf])
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node], self.gain[node] = feature, at, missing_left, a, a + 1, gain
        return a, a + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x features)."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        rows = np.arange(len(bins))
        for _ in range(len(self.feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            i = rows[inner]
            node = at[i]
            b = bins[i, feature[node]]
            go = np.where(b == 0, missing[node], b <= cut[node])
            at[i] = np.where(go, left[node], right[node])
        return at

    def pruned(self, kept: set[int]) -> Tree:
        """The tree with only the splits of kept nodes, numbered anew."""
        out = Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            out.value[new], out.cover[new] = self.value[old], self.cover[old]
            if old in kept:
                a, b = out.split(new, self.feature[old], self.bin[old], self.missing_left[old], self.gain[old])
                todo += [(self.left[old], a), (self.right[old], b)]
        return out


@dataclass
class Boosted:
    """A fitted model: the margin is base plus each tree's leaf value."""

    features: list[str]
    cuts: dict[str, list[float]]
    base: float
    trees: list[Tree]
    name: str = "p_boosted"
    history: list[float] = field(default_factory=list)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of values by feature: 0 for missing, else one more than the cut points below the value."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (f, x) in enumerate(zip(self.features, columns)):
            out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(self.cuts[f], x, side="left") + 1)
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.nodes(bins)]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """df with a column of probabilities; values are binned and walked in Arrow batches."""
        held = df.sparkSession.sparkContext.broadcast(self)  # trees of a limited number of leaves

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-held.value.margins(held.value.binned(x)))))

        return df.select("*", score(self.values()).alias(self.name))

    def values(self) -> Column:
        """The features' values as one column for Arrow."""
        return F.struct(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.features)))

    def binned(self, x: pd.DataFrame) -> np.ndarray:
        return self.bins([x.iloc[:, k].to_numpy(dtype=float, na_value=np.nan) for k in range(len(self.features))])


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    write_text(spark, json.dumps(asdict(model)), path)


def load(spark: SparkSession, path: str) -> Boosted:
    held = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    return Boosted(**held | {"trees": [Tree(**t) for t in held["trees"]]})


ROWS = "id long, y double, w double, val boolean, margin double, bins binary"


def _binned(model: Boosted):
    """Rows of ROWS from id, y, w, val and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(4 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(model.features))]
            bins = model.bins(columns)
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(np.full(len(bins), model.base)), packed], [x.split()[0] for x in ROWS.split(", ")])

    return run


def _state(b: pa.RecordBatch, trees: list[Tree], width: int) -> tuple[np.ndarray, ...]:
    """id, y, w, val, margin with the trees' values added, bins (rows x features)."""
    i, y, w, val, margin = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
    held = b.column(5)  # values of one width stand together
    bins = np.frombuffer(held.buffers()[2], np.uint8, len(held) * width, held.offset * width).reshape(-1, width)
    margin = margin.copy()
    for t in trees:
        margin += np.array(t.value)[t.nodes(bins)]
    return i, y, w, val.astype(bool), margin, bins


def uniform(i: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) by row number and salt, the same in each run."""
    x = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xBF58476D1CE4E5B9) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


SUMS = "node int, feature int, bin int, n double, g double, h double"


def _histogram(trees: list[Tree], tree: Tree, wanted: list[int], used: list[int], width: int, share: float, salt: int):
    """Sums of a task by (node, feature, bin), of training rows in the sample; node -1 has the weighted loss of the validation rows (g) and their weight (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: k for k, n in enumerate(wanted)}
        total = np.zeros((len(wanted), len(used), 256, 3))
        loss = np.zeros(2)
        for b in batches:
            i, y, w, val, margin, bins = _state(b, trees, width)
            loss += [float((w[val] * np.logaddexp(0, np.where(y[val] == 1, -margin[val], margin[val]))).sum()), float(w[val].sum())]
            on = ~val & (uniform(i, salt) < share)
            y, w, margin, bins = y[on], w[on], margin[on], bins[on]
            p = 1 / (1 + np.exp(-margin))
            at = np.array([place.get(n, -1) for n in range(len(tree.feature))])[tree.nodes(bins)]
            here = at >= 0
            at, g, h = at[here], (w * (p - y))[here], (w * p * (1 - p))[here]
            for k, f in enumerate(used):
                cell = at * 256 + bins[here, f]
                for s, x in enumerate((None, g, h)):
                    total[:, k, :, s] += np.bincount(cell, x, len(wanted) * 256).reshape(len(wanted), 256)
        node, k, b = np.nonzero(total[..., 0])
        sums = total[node, k, b]
        rows = [np.concatenate([x, [e]]) for x, e in zip((np.array(wanted, np.int32)[node], np.array(used, np.int32)[k], b), (-1, -1, 0))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in rows), *(pa.array(np.append(sums[:, s], e)) for s, e in zip(range(3), (0.0, *loss)))], [x.split()[0] for x in SUMS.split(", ")])

    return run


BEST = "node int, feature int, bin int, missing_left boolean, gain double, n double, g double, h double"


def _best(s: Settings):
    """The best split of each (node, feature) of a task, from all their rows by bin: at most nodes * features * 256 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        node, feature, b, *sums = (rows.column(k).to_numpy() for k in range(6))
        keys, at = np.unique(np.stack([node, feature]), axis=1, return_inverse=True)
        own = np.zeros((keys.shape[1], 256, 3))
        own[at.ravel(), b] = np.stack(sums, 1)
        there = np.zeros(own.shape[:2], bool)
        there[at.ravel(), b] = True
        up = own.copy()
        up[:, 0] = 0
        up, whole, lost = up.cumsum(1), own.sum(1)[:, None, None], own[:, :1]
        left = np.stack([up + lost, up], 2)  # by key and bin, with missing values on the left and on the right
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.round(sum(side[..., 1] ** 2 / (side[..., 2] + s.l2) for side in (left, right)) - whole[..., 1] ** 2 / (whole[..., 2] + s.l2), 9)
        fair = there[:, :, None] & (np.minimum(left[..., 0], right[..., 0]) >= s.min_rows) & (np.minimum(left[..., 2], right[..., 2]) >= s.min_hessian) & (gain > s.min_gain)
        gain = np.where(fair, gain, -np.inf).reshape(len(own), -1)
        k, found = gain.argmax(1), fair.any((1, 2))  # the first: the lower bin, then missing values on the left
        split = [pa.array(x, mask=~found) for x in ((k // 2).astype(np.int32), k % 2 == 0, gain[np.arange(len(k)), k])]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int32)), pa.array(keys[1].astype(np.int32)), *split, *(pa.array(whole[:, 0, 0, c]) for c in range(3))], [c.split()[0] for c in BEST.split(", ")])

    return run


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """node, feature, bin, missing_left, gain (null without a split), n, g, h: the best split of each (node, feature) from its bins' sums (SUMS)."""
    # Dealt by (node, feature) once, for the sums by bin and for the split. Few steps: the plan is made anew for each level of each tree.
    bins = sums.repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    return bins.mapInArrow(_best(s), BEST)


class Grower:
    """One tree in best-first order from rows (node, feature, bin, missing_left, gain, n, g, h), a batch of nodes at a time."""

    def __init__(self, s: Settings):
        self.s, self.tree, self.depth = s, Tree(), {0: 0}
        self.best: dict[int, tuple] = {}
        self.asked, self.loss = [0], None

    def take(self, rows: list) -> None:
        """The sums of the nodes that were asked for."""
        t, found = self.tree, {}
        for r in rows:
            if r["node"] < 0:
                self.loss = r["g"] / r["h"] if r["h"] else None
                continue
            t.cover[r["node"]] = r["n"]
            t.value[r["node"]] = -self.s.rate * r["g"] / (r["h"] + self.s.l2) if r["h"] + self.s.l2 > 0 else 0.0
            if r["gain"] is not None and (r["node"] not in found or (r["gain"], -r["feature"]) > (found[r["node"]][0], -found[r["node"]][1])):
                found[r["node"]] = (r["gain"], r["feature"], r["bin"], r["missing_left"])
        for n in self.asked:
            if n in found and self.depth[n] < self.s.depth:
                self.best[n] = found[n]
        self.asked = []

    def reached(self) -> tuple[set[int], bool]:
        """Nodes that best-first growth splits, as far as sums are known, and whether that is all."""
        split: set[int] = set()
        queue = [(-self.best[0][0], 0)] if 0 in self.best else []
        while queue and len(split) + 1 < self.s.leaves:
            _, node = heapq.heappop(queue)
            split.add(node)
            if self.tree.feature[node] < 0:
                return split - {node}, False
            for child in (self.tree.left[node], self.tree.right[node]):
                if child in self.best:
                    heapq.heappush(queue, (-self.best[child][0], child))
        return split, True

    def ask(self) -> list[int]:
        """Splits the nodes that may still be reached; their children, whose sums come next. Empty when the tree is done."""
        split, done = self.reached()
        if done:
            return []
        open_nodes = sorted((n for n in self.best if self.tree.feature[n] < 0), key=lambda n: (-self.best[n][0], n))
        for n in open_nodes[: self.s.leaves - 1 - len(split)]:
            gain, feature, at, missing = self.best[n]
            a, b = self.tree.split(n, feature, at, missing, gain)
            self.depth[a] = self.depth[b] = self.depth[n] + 1
            self.asked += [a, b]
        return self.asked

    def finished(self) -> Tree:
        return self.tree.pruned(self.reached()[0])


def _advanced(state: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """state with the trees' values in its margins, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = _state(b, trees, width)[4]
            yield b.set_column(4, "margin", pa.array(margin))

    return written(state.mapInArrow(run, ROWS))


def _validation_auprc(state: DataFrame, trees: list[Tree], width: int, n: int) -> float:
    """Average precision over the margins of the n validation rows."""
    from longspan.operators.metrics import average_precision

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, y, _, _, margin, _ = _state(b, trees, width)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(margin)], ["y", "p"])

    r = average_precision(state.where("val").mapInArrow(run, "y int, p double"), [], "y", "p", n).first()
    return (r["auprc"] if r else None) or 0.0


def prepared(train: DataFrame, features: list[str], val: DataFrame | None = None, bins: int = 255, weight: str | None = "weight", y: str = "y", name: str = "p_boosted") -> tuple[Boosted, DataFrame]:
    """A model without trees, and the written rows (ROWS) of training and validation with its margin."""
    if not 2 <= bins <= 255:
        raise ValueError("2 to 255 bins")
    required(train, [*features, y], "train")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pick = [F.col(y).cast("double").alias("y"), w.alias("w")]
    values = [F.col(f).cast("double").alias(f"__x{k}") for k, f in enumerate(features)]
    rows = train.select(*pick, F.lit(False).alias("val"), *values)
    if val is not None:
        rows = rows.unionByName(val.select(F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(True).alias("val"), *values))
    rows = written(rows)  # read for the checks, the bins and the state
    n, bad, positive, total = rows.agg(F.count_if(~F.col("val")), F.count_if(F.expr("y IS NULL OR NOT y IN (0, 1) OR w IS NULL OR NOT w > 0")), F.sum(F.when(~F.col("val"), F.col("y") * F.col("w"))), F.sum(F.when(~F.col("val"), F.col("w")))).first()
    if bad or not n or not 0 < positive < total:
        raise ContractError(f"{n} training rows, {bad} of all without a label of 0 or 1 or a weight above 0; both classes are needed")
    cuts = cut_points(rows.where("NOT val").select(*(F.col(f"__x{k}").alias(f) for k, f in enumerate(features))), features, bins)
    model = Boosted(list(features), cuts, math.log(positive / (total - positive)), [], name)
    ids = F.monotonically_increasing_id().alias("id")
    state = written(rows.select(ids, "y", "w", "val", *(f"__x{k}" for k in range(len(features)))).mapInArrow(_binned(model), ROWS))
    discard(rows)
    return model, state


def histogram(state: DataFrame, model: Boosted, s: Settings, grower: Grower, trees: list[Tree], used: list[int], number: int) -> DataFrame:
    """Sums (SUMS) for the nodes that grower asks for."""
    return state.mapInArrow(_histogram(trees, grower.tree, list(grower.asked), used, len(model.features), s.rows, s.seed * 1_000_003 + number), SUMS)


def sampled_columns(s: Settings, n: int, number: int) -> list[int]:
    """The features of one tree."""
    order = np.argsort(uniform(np.arange(n), s.seed * 7_919 + number + 1), kind="stable")
    return sorted(order[: max(1, math.ceil(n * s.columns - 1e-9))].tolist())


def fit(train: DataFrame, features: list[str], val: DataFrame | None = None, settings: Settings | None = None, weight: str | None = "weight", y: str = "y", name: str = "p_boosted") -> Boosted:
    """Boosted trees; with val, growth ends after ``patience`` trees without a better metric on it, and trees after the best are dropped, but never the first. history holds the metric after each tree."""
    s = settings or Settings()
    if s.stop_on not in ("auprc", "loss"):
        raise ValueError(s.stop_on)
    model, state = prepared(train, features, val, s.bins, weight, y, name)
    n_val = state.where("val").count() if val is not None else 0
    recent: list[Tree] = []
    best, best_at = -math.inf, 0
    for number in range(s.trees + 1):
        grower, used = Grower(s), sampled_columns(s, len(features), number)
        rows = best_splits(histogram(state, model, s, grower, recent, used, number), s).collect()  # a row for each (node, feature)
        grower.take(rows)
        if val is not None and number:
            score = _validation_auprc(state, recent, len(features), n_val) if s.stop_on == "auprc" else -(grower.loss or 0.0)
            model.history.append(score)
            if score > best + 1e-12:
                best, best_at = score, number
            elif number - best_at >= s.patience:
                break
        if number == s.trees:
            break
        while grower.ask():
            grower.take(best_splits(histogram(state, model, s, grower, recent, used, number), s).collect())
        tree = grower.finished()
        if len(tree.feature) == 1 and s.rows == 1 and s.columns == 1:
            break
        model.trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == SNAPSHOT:
            new = _advanced(state, recent, len(features))
            discard(state)
            state, recent = new, []
    if val is not None:
        model.trees = model.trees[:best_at]
    discard(state)
    return model
