"""What columns are: roles, admission to feature sets, audits of names, and the data dictionary.

All of it works on schemas in the driver; only constant columns need a pass over the data.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from longspan.operators.quality import ContractError
from longspan.operators.summary import constant_columns

# Names of the panel's columns.
KEYS = ["cell_id", "date", "year", "month"]
LABELS = ["y", "burned_flag", "burned_area_m2"]
SEASON = ["month_sin", "month_cos"]
STRATA = ["BIOME", "HUMAN_bin", "STRATUM", "VPD_bin", "VPD_mean_bin", "Nh", "nh"]
WEIGHTS = ["pi", "d_weight", "pi_clip", "d_weight_clip", "weight", "valid_core_pass", "valid_core_raw"]
BLOCKS = ["grid10km_id", "grid50km_id", "grid100km_id", "spatial_block_id", "tile_id"]
STATIC = ["BUILT_mean", "LC_mode", "NTL_mean", "POP_mean", "aspect_mean", "dist_built_m", "dist_water_m", "elev_mean", "frac_crop", "frac_forest", "frac_grass", "slope_mean", "treecover_2015"]
DYNAMIC = ["EVI_mean_mon", "LST_day_mon", "LST_night_mon", "NDVI_mean_mon", "PET_sum_mon", "P_sum_mon", "RH_mean_mon", "RH_min_mon", "SM1_mean_mon", "SM2_mean_mon", "TP_sum_mon", "Tmax_mon", "Tmean_mon", "VPD_max_mon", "VPD_mean_mon", "WD_R_mon", "WD_u_mon", "WD_v_mon", "WS_max_mon", "WS_mean_mon", "WS_strong_frac"]
QC_ONLY = ["pix_count", "pix_count_lag1", "pi_clip"]
# Names, prefixes and patterns that are barred, and names of memory features that are not.
FORBIDDEN = {
    "exact": ["burned_area_m2", "burned_flag", "burned_frac", "ever_burned", "system:index", ".geo", "__source_file__", "lon", "lat"],
    "prefix": ["label_aux_", "burned_", "valid_weight"],
    "regex": ["BurnDate", "burndate", "MCD64A1", "future", r"lead\+", "lead_", r"t\+1", r"t\+2", "next_month", "forward", "_lead1", "lead1_", "target_", "label_"],
}
MEMORY = ["months_since_last_fire", "fire_count_(12m|24m|36m)", "burned_area_(12m|24m|36m)", r"y_lag\d+", r"y_roll\d+m_(sum|mean|max|min)", "fire_(tslf|tslb)"]
# Words of names that look like the future, whatever their case.
SUSPICIOUS = [r"\blead\b", r"\bfuture\b", r"\bt\+", r"\blead\d+", r"\blag-", r"\bnext\b"]
#: This library's own memory features.
OWN_MEMORY = ["months_since_event", r"event_count_\d+m", "ever_before"]
ROLL = re.compile(r".+_roll\d+m_(sum|mean|max|min)")
LOOKS_AHEAD = ["has_fire_history"]


def unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def is_quality(name: str) -> bool:
    base = name.removesuffix("_lag1")
    return base == "pix_count" or base.endswith(("_cov", "_missing", "_n"))


def is_dynamic(name: str) -> bool:
    """Changes by month: a monthly value, the strong-wind share, or the quality of one."""
    return "_mon" in name or bool(re.search(r"strong_frac|WS_strong", name, re.I)) or is_quality(name)


def is_memory(name: str) -> bool:
    return any(re.fullmatch(p, name) for p in MEMORY + OWN_MEMORY)


def role(name: str, static: list[str] = STATIC) -> str:
    """key, label, weight, stratum, block, derived, memory, quality, static, dynamic, forbidden or other; the first that fits."""
    tests: list[tuple[str, Callable[[str], bool]]] = [
        ("key", KEYS.__contains__),
        ("label", LABELS.__contains__),
        ("weight", WEIGHTS.__contains__),
        ("stratum", STRATA.__contains__),
        ("block", BLOCKS.__contains__),
        ("derived", SEASON.__contains__),
        ("memory", lambda c: is_memory(c) or bool(ROLL.fullmatch(c))),
        ("forbidden", lambda c: bool(forbidden([c]))),
        ("quality", is_quality),
        ("static", static.__contains__),
        ("dynamic", is_dynamic),
    ]
    return next((r for r, test in tests if test(name)), "other")


def forbidden(names: list[str], rules: dict[str, list[str]] = FORBIDDEN) -> list[str]:
    """Names that leak the label or the future, but for the memory features that are allowed."""
    hit = lambda c: c in rules["exact"] or not is_memory(c) and (c.startswith(tuple(rules["prefix"])) or any(re.search(p, c) for p in rules["regex"]))
    return sorted({c for c in names if hit(c)} | set(LOOKS_AHEAD) & set(names))


def assert_allowed(names: list[str], where: str) -> None:
    if bad := forbidden(names):
        raise ContractError(f"{where}: forbidden columns {bad}")


def suspicious(names: list[str]) -> list[str]:
    """Names that look like the future by a word of theirs: a light guard against a wrong input."""
    return [c for c in names if any(re.search(p, c, re.IGNORECASE) for p in SUSPICIOUS)]


def assert_not_suspicious(names: list[str], where: str) -> None:
    if bad := suspicious(names):
        raise ContractError(f"{where}: names that look like the future: {bad}")


def without_forbidden(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df without its forbidden columns, and their names."""
    bad = forbidden(df.columns)
    return df.drop(*bad), bad


def blacklisted(names: list[str], exact: list[str], patterns: list[str] = ()) -> list[str]:
    return [c for c in names if c in set(exact) or any(re.search(p, c) for p in patterns)]


def temporal_audit(names: list[str], scenario: str) -> dict[str, list[str]]:
    """Predictors that aren't known in time: lag 0 anywhere, monthly values without a lag in lead1."""
    return {"lag0": sorted({c for c in names if "_lag0" in c}), "same_month": sorted({c for c in names if scenario == "lead1" and is_dynamic(c) and "_lag" not in c and not is_memory(c)})}


def enforce_temporal_audit(names: list[str], scenario: str) -> None:
    if any(hits := temporal_audit(names, scenario).values()):
        raise ContractError(f"{scenario}: not known in time: {sorted(x for h in hits for x in h)}")


def check_roll_columns(names: list[str]) -> None:
    if bad := [c for c in names if not c.endswith("_lag1")]:
        raise ContractError(f"rolling columns must be lagged: {bad}")


def expected(scenario: str) -> dict[str, list[str]]:
    """Names of dynamic, quality and count columns that a scenario's panel should have."""
    lag = "_lag1" if scenario == "lead1" else ""
    return {
        "dynamic": [f"{c}{lag}" for c in DYNAMIC],
        "quality": [f"{c}_{s}{lag}" for c in DYNAMIC for s in ("cov", "missing")] + [f"pix_count{lag}"],
        "counts": [f"{c}_n{lag}" for c in DYNAMIC],
    }


def normalise(predictors: list[str], columns: list[str], scenario: str, modes: dict[str, str] | None = None, strict: bool = False) -> tuple[list[str], dict[str, list[str]]]:
    """Predictors without repeats and without QC-only, block and id columns, which fail or are dropped by modes; and what was hit."""
    modes = {"qc": "fail", "block": "fail", "id": "fail"} | (modes or {})
    names = unique(predictors)
    hits = {"qc": [c for c in names if c in QC_ONLY], "block": [c for c in names if c in BLOCKS or re.fullmatch(r"grid\d+km_id", c)], "id": [c for c in names if c in KEYS or c in LABELS]}
    for kind, found in hits.items():
        if found and modes[kind] == "fail":
            raise ContractError(f"{scenario}: {kind} columns among predictors: {found}")
    gone = {c for kind, found in hits.items() for c in found if modes[kind] == "drop"}
    missing = [c for c in names if c not in columns]
    if missing and strict:
        raise ContractError(f"{scenario}: predictors that the panel lacks: {missing}")
    return [c for c in names if c not in gone and c in columns], hits | {"missing": missing}


@dataclass
class Admission:
    """Nested predictor sets of a panel and how they came about."""

    scenario: str
    predictors: dict[str, list[str]]
    kept: list[str]
    missing: dict[str, list[str]]
    added: dict[str, list[str]] = field(default_factory=dict)
    dropped_constant: list[str] = field(default_factory=list)

    def columns(self, name: str) -> list[str]:
        """A set's columns in the data: kept ones, then predictors."""
        return unique(self.kept + self.predictors[name])

    def record(self) -> dict:
        return asdict(self)


def admit(df: DataFrame, scenario: str, strict: bool = False, dynamic: list[str] | None = None, static: list[str] = STATIC, drop_constants: bool = True) -> Admission:
    """F0 (season, static, dynamic, quality), F1 (and memory) and F2 (and counts), from names that df has, constant columns dropped."""
    if scenario not in ("lead1", "nowcast"):
        raise ValueError(scenario)
    columns = df.columns
    assert_allowed(columns, scenario)
    if lacking := [c for c in [*KEYS, "y", *SEASON] if c not in columns]:
        raise ContractError(f"{scenario}: missing columns {lacking}")
    lag = "_lag1" if scenario == "lead1" else ""
    want = expected(scenario) if dynamic is None else {"dynamic": [f"{c}{lag}" for c in dynamic], "quality": [c for c in columns if is_quality(c) and not c.removesuffix("_lag1").endswith("_n")], "counts": [c for c in columns if c.removesuffix("_lag1").endswith("_n")]}
    if scenario == "lead1" and (late := [c for c in columns if is_dynamic(c) and "_lag" not in c and not is_memory(c)]):
        raise ContractError(f"lead1: columns without a lag: {late}")
    missing = {k: [c for c in v if c not in columns] for k, v in want.items()}
    if strict and (missing["dynamic"] or missing["quality"]):
        raise ContractError(f"{scenario}: missing {missing}")
    memory = [c for c in columns if is_memory(c) or ROLL.fullmatch(c)]
    steps = {"F0": SEASON + [c for c in static if c in columns] + want["dynamic"] + [c for c in want["quality"] if c not in QC_ONLY], "F1": memory, "F2": want["counts"]}
    constants = set(constant_columns(df, [c for c in unique(sum(steps.values(), [])) if c in columns], null_is_value=True)) if drop_constants else set()
    sets: dict[str, list[str]] = {}
    so_far: list[str] = []
    for name, more in steps.items():
        so_far = unique(so_far + [c for c in more if c in columns])
        sets[name] = [c for c in so_far if c not in constants]
        normalise(sets[name], columns, scenario)
    kept = [c for c in [*KEYS, "y", *STRATA, *BLOCKS, *WEIGHTS, *QC_ONLY] if c in columns]
    added = {"F1": [c for c in sets["F1"] if c not in sets["F0"]], "F2": [c for c in sets["F2"] if c not in sets["F1"]]}
    got = Admission(scenario, sets, unique(kept), missing, added, sorted(constants))
    check_admission(got)
    return got


def with_extras(predictors: list[str], columns: list[str], extras: list[str], policy: str = "auto") -> list[str]:
    """Predictors with extras: none (off), those that exist (auto), or all or an error (require)."""
    if policy == "off":
        return predictors
    if policy == "require" and (missing := [c for c in extras if c not in columns]):
        raise ContractError(f"missing extras {missing}")
    return unique(predictors + [c for c in extras if c in columns])


def build(df: DataFrame, predictors: list[str], scenario: str, keep: list[str] = (), extras: list[str] = (), policy: str = "auto", exclude: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict]:
    """A versioned feature table and its record: extras, names normalised, blacklist, constants (nulls aside), temporal audit, in this order."""
    names, hits = normalise(with_extras(predictors, df.columns, list(extras), policy), df.columns, scenario, {"qc": "drop", "block": "drop", "id": "drop"})
    barred = blacklisted(names, (exclude or {}).get("exact", []), (exclude or {}).get("regex", []))
    names = [c for c in names if c not in barred]
    constant = constant_columns(df, names, null_is_value=False)
    names = [c for c in names if c not in constant]
    enforce_temporal_audit(names, scenario)
    columns = unique([c for c in [*KEYS, "y", *keep] if c in df.columns] + names)
    return df.select(*columns), {"scenario": scenario, "predictors": names, "constant": constant, "blacklisted": barred, "hits": hits}


def set_differences(sets: dict[str, list[str]]) -> dict[str, list[str]]:
    return {f"{b}-{a}": sorted(set(sets[b]) - set(sets[a])) for a, b in zip(list(sets), list(sets)[1:])}


@dataclass(frozen=True)
class Source:
    """Unit and origin of columns that begin with a prefix."""

    prefix: str
    unit: str
    source: str


def dictionary(spark: SparkSession, columns: list[str], sources: list[Source] = (), static: list[str] = STATIC) -> DataFrame:
    """A row per column: name, role, unit, source, availability, leakage_risk. The longest prefix of the name names unit and source."""
    rows = []
    for c in columns:
        base = re.sub(r"(_lag\d+|_cov|_missing|_n|_roll\d+m_\w+)+$", "", c)
        best = max((s for s in sources if base.startswith(s.prefix)), key=lambda s: len(s.prefix), default=Source("", "", ""))
        kind = role(c, static)
        when = "month before" if "_lag" in c or kind == "memory" else "fixed" if kind in ("static", "stratum", "weight", "block", "key") else "same month"
        risk = "high" if kind in ("label", "forbidden") or c in LOOKS_AHEAD else "timing" if when == "same month" and kind in ("dynamic", "quality") else "none"
        rows.append((c, kind, best.unit if kind != "quality" else "", best.source, when, risk))
    return spark.createDataFrame(rows, "column string, role string, unit string, source string, availability string, leakage_risk string")


def group_map(features: list[str], groups: dict[str, list[str]]) -> dict[str, list[int]]:
    """Positions of each group's features; an empty group is an error."""
    out = {g: [k for k, c in enumerate(features) if c in set(names)] for g, names in groups.items()}
    if empty := [g for g, at in out.items() if not at]:
        raise ContractError(f"groups without a feature: {empty}")
    return out


def adaptive_call(f: Callable, **options):
    """f with those options that it takes."""
    taken = inspect.signature(f).parameters
    whole = any(p.kind is p.VAR_KEYWORD for p in taken.values())
    return f(**{k: v for k, v in options.items() if whole or k in taken})


# Columns that identify a row and that weight it, and the pattern of columns kept for splits only.
ID_COLUMNS = ["cell_id", "date", "y", "year", "month"]
WEIGHT_COLUMNS = ["pi", "d_weight", "pi_clip", "d_weight_clip", "weight", "valid_core_pass", "valid_core"]
SPLIT_ONLY = r"^(grid10km_id|grid50km_id|grid100km_id|spatial_block_id|tile_id)$"


def inferred_roles(columns: list[str], qc_only: str, split_only: str = "") -> dict[str, list[str]]:
    """Columns that are there as id, weight, qc and split; qc_only and split_only are patterns, of which an empty one is the default."""
    qc, split = option_pattern(qc_only, r"^$"), option_pattern(split_only, SPLIT_ONLY)
    return {
        "id": [c for c in ID_COLUMNS if c in columns],
        "weight": [c for c in WEIGHT_COLUMNS if c in columns],
        "qc": [c for c in columns if qc.search(c)],
        "split": [c for c in columns if split.search(c)],
    }


def option_pattern(text: str | None, default: str) -> re.Pattern:
    """The pattern of an option, or the default for a blank one; one that can't be read is an error that names it."""
    pattern = (text or "").strip() or default
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ValueError(f"pattern {pattern!r}: {e}") from e


def check_admission(got: Admission) -> None:
    """Raises unless sets are nested, their steps are the recorded ones in order, and no dropped constant stayed."""
    names = list(got.predictors)
    for a, b in zip(names, names[1:]):
        step = [c for c in got.predictors[b] if c not in set(got.predictors[a])]
        if not set(got.predictors[a]) <= set(got.predictors[b]) or step != got.added[b]:
            raise ContractError(f"{b} is not {a} and its recorded step: {step} against {got.added[b]}")
    for name, columns in got.predictors.items():
        if kept := sorted(set(columns) & set(got.dropped_constant)):
            raise ContractError(f"{name} keeps constants {kept}")
        if len(set(columns)) < len(columns):
            raise ContractError(f"{name} repeats columns")


def options_list(text: str | None) -> list[str]:
    """Names in a comma-separated option."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]
