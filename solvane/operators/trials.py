"""Trial tables: parameter sampling by hash, state counts, best trial and resume counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.hashing import HASH_RANGE

# States of a trial, and how many failures end a study.
STATES = ["RUNNING", "COMPLETE", "PRUNED", "FAIL"]
MAX_FAILED = 50


def _draw(seed: int, name: str, trial: str, index: Column | None = None) -> Column:
    """Uniform [0, 1) per (seed, parameter, trial), and per list position if there is one."""
    parts = [F.lit(f"{seed}:{name}")] + ([F.lit("_"), index.cast("string")] if index is not None else [])
    text = F.concat(*parts, F.lit(":"), F.col(trial).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(HASH_RANGE))


def sampled_value(spec: dict, u: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Turn a uniform draw into a value of the given kind; ``low`` and ``high`` override the bounds."""
    kind = spec["type"]
    if kind == "categorical":
        choices = F.array(*[F.lit(c) for c in spec["choices"]])
        return F.element_at(choices, (F.floor(u * len(spec["choices"])) + 1).cast("int"))
    low = F.lit(spec["low"]) if low is None else low
    high = F.lit(spec["high"]) if high is None else high
    if kind == "int":
        if spec.get("log"):
            bottom, top = F.ln(low - 0.5), F.ln(high + 0.5)
            return F.least(F.greatest(F.floor(F.exp(bottom + u * (top - bottom)) + 0.5), low), high).cast("bigint")
        step = spec.get("step", 1)
        return (low + step * F.floor(u * (F.floor((high - low) / step) + 1))).cast("bigint")
    if kind == "loguniform" or (kind == "float" and spec.get("log")):
        return F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low)))
    step = spec["q"] if kind == "discrete_uniform" else spec.get("step")
    if step:
        return low + step * F.floor(u * (F.floor((high - low) / step) + 1))
    if kind in ("uniform", "float"):
        return low + u * (high - low)
    raise ValueError(f"unknown parameter type {kind!r}")


def _sampled_list(spec: dict, seed: int, name: str, trial: str, length: Column, head: Column | None) -> Column:
    """Draw values one after the other; with a direction each bounds the next."""
    kind = "string" if spec["type"] == "categorical" and isinstance(spec["choices"][0], str) else ("bigint" if spec["type"] == "int" else "double")
    array = f"array<{kind}>"
    direction = spec.get("direction")

    def step(values: Column, index: Column) -> Column:
        last = F.try_element_at(values, F.lit(-1))
        low = high = None
        if direction == "increasing":
            low = F.coalesce(last, F.lit(spec["low"]))
            high = F.greatest(F.lit(spec["high"]), low)
        elif direction == "decreasing":
            high = F.coalesce(last, F.lit(spec["high"]))
            low = F.least(F.lit(spec["low"]), high)
        value = sampled_value(spec, _draw(seed, name, trial, index), low, high)
        if direction == "constant":
            value = F.coalesce(last, value)
        return F.when(F.size(values) > index, values).otherwise(F.concat(values, F.array(value).cast(array)))

    start = F.array().cast(array) if head is None else head.cast(array)
    return F.slice(F.aggregate(F.sequence(F.lit(0), length - 1), start, step), 1, length)


def _fixed_list(values: Column, length: Column) -> Column:
    """The first ``length`` values, the last one repeated where they run out."""
    filled = F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(length - F.size(values), F.lit(0)).cast("int")))
    return F.slice(filled, 1, length.cast("int"))


def _referred(text: str, kinds: dict[str, str]) -> tuple[Column, str] | None:
    """The earlier parameter that ``name`` or ``name[i]`` stands for, with its kind."""
    match = re.fullmatch(r"([^\[\]]+)(?:\[(\d+)\])?", text)
    if not match or match[1] not in kinds:
        return None
    if match[2] is None:
        return F.col(match[1]), kinds[match[1]]
    return F.get(F.col(match[1]), F.lit(int(match[2]))), "scalar"


def _literal(value) -> tuple[Column, str]:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]), "list"
    return F.lit(value), "scalar"


def _parameter(name: str, spec, seed: int, trial: str, kinds: dict[str, str]) -> tuple[Column, str]:
    if not isinstance(spec, dict):
        return _literal(spec)
    start = spec.get("starting_value")
    if start is not None:
        start = (isinstance(start, str) and _referred(start, kinds)) or _literal(start)
    length = spec.get("length")
    if isinstance(length, str):
        column, kind = _referred(length, kinds)
        length = F.size(column) if kind == "list" else column
    elif length is not None:
        length = F.lit(length)
    head = None if start is None else (start[0] if start[1] == "list" else F.array(start[0]))
    if "values" in spec:
        values = _literal(spec["values"])[0]
        return _fixed_list(values, F.size(values) if length is None else length), "list"
    if "type" in spec and length is not None:
        return _sampled_list(spec, seed, name, trial, length.cast("int"), head), "list"
    if start is not None:
        return (_fixed_list(head, length), "list") if length is not None else start
    return sampled_value(spec, _draw(seed, name, trial)), "scalar"


def sample_parameters(trials: DataFrame, trial: str, space: dict, seed: int = 0) -> DataFrame:
    """One column per parameter of ``space`` for every row of ``trials``.

    A specification is a fixed value or list, ``{"type": ...}`` with bounds or
    choices, ``{"values": ..., "length": n}``, or has a ``starting_value``.
    Lengths and starting values may name an earlier parameter, or ``name[i]``.
    """
    kinds: dict[str, str] = {}
    for name, spec in space.items():
        column, kinds[name] = _parameter(name, spec, seed, trial, kinds)
        trials = trials.withColumn(name, column)
    return trials


def state_counts(state: str = "state") -> list[Column]:
    """Aggregates all, running, completed, pruned, failed."""
    names = ["running", "completed", "pruned", "failed"]
    return [F.count("*").alias("all")] + [F.count_if(F.col(state) == s).alias(n) for n, s in zip(names, STATES)]


def best_trial(trials: DataFrame, direction: str = "minimize", groups: tuple[str, ...] = (), number: str = "number", value: str = "value", state: str = "state") -> DataFrame:
    """The complete trial with the best value (lowest number on ties), all columns kept."""
    sign = 1.0 if direction.startswith("min") else -1.0
    rest = F.struct(*[c for c in trials.columns if c not in groups])
    done = trials.filter((F.col(state) == "COMPLETE") & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    best = F.min_by(rest, F.struct((F.col(value) * sign).alias("v"), F.col(number).alias("n"))).alias("_best")
    return done.groupBy(*groups).agg(best).filter(F.col("_best").isNotNull()).select(*groups, "_best.*")


def previous_trials(trials: DataFrame, study: str, name: str = "study") -> int:
    """Number of trials already recorded for a study."""
    return trials.filter(F.col(name) == study).count()


def total_trials(requested: int, previous: int) -> int:
    """Trials to report on resume: one of the earlier ones is continued."""
    return requested + previous - 1 if previous > 0 else requested


def study_summaries(trials: DataFrame, direction: str = "minimize", study: str = "study") -> DataFrame:
    """Trials and best value so far per study."""
    done = (F.col("state") == "COMPLETE") & ~F.isnan("value")
    pick = F.min if direction.startswith("min") else F.max
    return trials.groupBy(study).agg(F.count("*").alias("trials"), pick(F.when(done, F.col("value"))).alias("best_value"))
