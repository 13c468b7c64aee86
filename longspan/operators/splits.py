"""Split protocols: each row's role in each fold of a protocol.

Folds come from a reproducible pseudo-random order of keys, dealt round, so their sizes differ by one at most. The fold
map is small (a row per block or cell) and joined; folds multiply rows only where a role is given, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.functions import order_key
from longspan.operators.assemble import between_dates, with_replicates
from longspan.operators.quality import ContractError, multi_role_rows, shared_blocks
from longspan.operators.ranges import RANGE_ROWS, numbered

# Block columns in order of preference, and the windows of DEFAULT below.
BLOCK_PREFERENCE = ("grid100km_id", "grid50km_id", "grid10km_id", "spatial_block_id", "tile_id")


@dataclass(frozen=True)
class Windows:
    """First and last month of training, validation and test."""

    train: tuple[str, str]
    val: tuple[str, str]
    test: tuple[str, str]

    def of(self, date: Column) -> tuple[Column, Column, Column]:
        return tuple(between_dates(date, *w) for w in (self.train, self.val, self.test))


DEFAULT = Windows(("2015-01-01", "2021-12-01"), ("2022-01-01", "2022-12-01"), ("2023-01-01", "2024-12-01"))


def choose_block(columns: list[str]) -> str | None:
    return next((c for c in BLOCK_PREFERENCE if c in columns), None)


def fold_map(df: DataFrame, key: str, k: int, seed: int, name: str = "fold", range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, fold for each key of df that isn't null. Keys are numbered in the order of a hash, by as many ranges as they need."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__o", order_key(seed, F.col(key)))
    dealt = numbered(keys, [], [F.col("__o"), F.col(key)], "__n", range_rows)
    return dealt.select(key, F.pmod(F.col("__n") - 1, F.lit(k)).cast("int").alias(name))


def p1(df: DataFrame, windows: Windows = DEFAULT, date: str = "date") -> DataFrame:
    """By time: test, then validation, then training window claims a row; other rows go."""
    train, val, test = windows.of(F.col(date))
    role = F.when(test, "test").when(val, "val").when(train, "train")
    return _named(df, "P1", F.lit(0), role)


def _named(df: DataFrame, protocol: str, fold: Column, role: Column) -> DataFrame:
    return df.withColumns({"protocol": F.lit(protocol), "fold_id": fold.cast("int"), "split_role": role}).where("split_role is not null")


def _with_folds(df: DataFrame, block: str, k: int, seed: int, of: DataFrame | None = None) -> DataFrame:
    folds = fold_map(df if of is None else of, block, k, seed, "__fold")
    return with_replicates(df.join(folds, block, "left"), k, "__k")


def p2(df: DataFrame, block: str, k: int = 5, seed: int = 0, windows: Windows = DEFAULT, date: str = "date") -> DataFrame:
    """Blocks of the training window in k folds: a fold's own blocks validate, the others train; all test rows test in each fold."""
    train, _, test = windows.of(F.col(date))
    rows = _with_folds(df, block, k, seed, df.where(train))
    own = F.col("__fold") == F.col("__k")
    role = F.when(test, "test").when(train & own, "val").when(train & F.col("__fold").isNotNull(), "train")
    return _named(rows, "P2", F.col("__k"), role).drop("__k", "__fold")


def p2_nested(df: DataFrame, block: str, k: int = 5, seed: int = 0, windows: Windows = DEFAULT, date: str = "date") -> DataFrame:
    """Like P2 inside training (inner_train, inner_val), with the whole validation and test windows in each fold."""
    train, val, test = windows.of(F.col(date))
    rows = _with_folds(df, block, k, seed, df.where(train))
    own = F.col("__fold") == F.col("__k")
    role = F.when(test, "test").when(val, "val").when(train & own, "inner_val").when(train & F.col("__fold").isNotNull(), "inner_train")
    return _named(rows, "P2_nested", F.col("__k"), role).drop("__k", "__fold")


def p3(df: DataFrame, block: str, k: int = 5, seed: int = 0, windows: Windows = DEFAULT, date: str = "date", name: str = "P3") -> DataFrame:
    """By time and block: a fold tests its own blocks in the test window, and trains and validates on the others before it."""
    train, val, test = windows.of(F.col(date))
    rows = _with_folds(df.where(train | val | test), block, k, seed)
    own = F.col("__fold") == F.col("__k")
    role = F.when(test & own, "test").when(val & ~own, "val").when(train & ~own, "train")
    return _named(rows, name, F.col("__k"), role).drop("__k", "__fold")


def p4_rows(df: DataFrame, keys: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Rows in k folds at random; a fold's own rows test. Dealt in a hash's order."""
    named = df.withColumn("__key", F.concat_ws("|", *(F.col(c).cast("string") for c in keys)))
    rows = with_replicates(named.join(fold_map(named, "__key", k, seed, "__fold"), "__key"), k, "__k")
    return _named(rows, "P4_row", F.col("__k"), F.when(F.col("__fold") == F.col("__k"), "test").otherwise("train")).drop("__k", "__fold", "__key")


def p4_cells(df: DataFrame, cell: str = "cell_id", k: int = 5, seed: int = 0) -> DataFrame:
    """Cells in k folds at random; a fold's own cells test."""
    rows = _with_folds(df, cell, k, seed)
    return _named(rows, "P4_cell", F.col("__k"), F.when(F.col("__fold") == F.col("__k"), "test").otherwise("train")).drop("__k", "__fold")


def p3_scales(df: DataFrame, blocks: dict[str, str], k: int = 5, seed: int = 42, windows: Windows = DEFAULT, check: bool = True) -> DataFrame:
    """P3 at several scales, as protocols p3_<scale>; raises if a fold trains on a block that it tests."""
    out = None
    for scale, block in blocks.items():
        one = p3(df, block, k, seed, windows, name=f"p3_{scale}").withColumn("block", F.col(block).cast("string"))
        if check:
            audit(one, ["protocol", "fold_id", "cell_id", "date"], "block")
        out = one if out is None else out.unionByName(one)
    return out


def by_year(df: DataFrame, train: tuple[int, int], test: tuple[int, int], date: str = "date") -> DataFrame:
    y = F.year(date)
    return _named(df, "P1_year", F.lit(0), F.when(y.between(*test), "test").when(y.between(*train), "train"))


def audit(splits: DataFrame, keys: list[str], block: str | None = None) -> None:
    """Raises if a row has two roles in a fold, or a block both trains and tests in one."""
    if not multi_role_rows(splits, keys).isEmpty():
        raise ContractError("a row has several roles in a fold")
    if block and not shared_blocks(splits, block).isEmpty():
        raise ContractError("a block both trains and tests in a fold")
