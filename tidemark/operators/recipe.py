"""A raw table plus a replayable list of fitted cleaning steps.

The raw plan never changes. The working table is the recipe applied to it, so
replaying is deterministic, and taking a step back reads the raw value of the
same row inside the same scan; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cleaning as cl
from tidemark.operators.profile import drop_missing_rows, remove_duplicate_rows
from tidemark.plans.roles import c, field_type

_RAW = "_raw"
_REVERTS = ("revert_imputation", "revert_cast", "revert_transform")


@dataclass(frozen=True)
class Step:
    """One fitted step: its name, its columns and the values it was fitted to."""

    action: str
    columns: tuple[str, ...] = ()
    values: Mapping[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {"action": self.action, "columns": list(self.columns), "values": dict(self.values)}

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> "Step":
        return Step(d["action"], tuple(d["columns"]), dict(d["values"]))


def _revert(df: DataFrame, step: Step) -> DataFrame:
    made = {}
    for n in step.columns:
        old, was, now = F.col(_RAW)[n], df.schema[_RAW].dataType[n].dataType, field_type(df, n)
        if step.action == "revert_imputation":
            made[n] = F.when(old.isNotNull(), c(n))
        elif step.action == "revert_cast":
            made[n] = F.coalesce(old, cl.try_convert(c(n), now.simpleString(), was.simpleString()))
        else:
            narrower = now.simpleString() == "bigint" and was.simpleString() == "double"
            made[n] = F.coalesce(old, c(n).cast(was)) if narrower else F.coalesce(old.cast(now), c(n))
    return df.withColumns(made)


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    visible = [n for n in df.columns if n != _RAW]
    if step.action == "impute":
        return cl.apply_fill(df, step.values)
    if step.action in ("standardize", "normalize"):
        return cl.apply_scale(df, {n: tuple(v) for n, v in step.values.items()})
    if step.action == "cast":
        for n in step.columns:
            x, source = c(n), field_type(df, n).simpleString()
            fraction = step.values.get("fraction", "abort")
            if fraction in ("ceil", "floor"):
                made = (F.ceil(x) if fraction == "ceil" else F.floor(x)).cast("bigint")
            else:
                made = cl.try_convert(x, source, step.values["type"])
            df = df.withColumn(n, made)
        return df
    if step.action == "drop_columns":
        return df.drop(*step.columns)
    if step.action == "drop_missing":
        return drop_missing_rows(df, [n for n in visible if n not in step.values.get("ignore", ())])
    if step.action == "drop_duplicates":
        names = [n for n in visible if n not in step.values.get("ignore", ())]
        return remove_duplicate_rows(df, names, step.values.get("keep", "none"), step.values.get("order_by", ()))
    if step.action in _REVERTS:
        return _revert(df, step)
    raise ValueError(f"Unknown step: {step.action}")


@dataclass(frozen=True)
class Dataset:
    """Raw table, row id column and the recipe that makes the working table."""

    raw: DataFrame
    row_id: str
    steps: tuple[Step, ...] = ()

    def working(self) -> DataFrame:
        df = self.raw
        reverted = list(dict.fromkeys(n for s in self.steps if s.action in _REVERTS for n in s.columns))
        if reverted:
            df = df.withColumn(_RAW, F.struct(*[c(n) for n in reverted]))
        for step in self.steps:
            df = apply_step(df, step)
        return df.drop(_RAW)

    def active(self, use_raw: bool = False) -> DataFrame:
        return self.raw if use_raw else self.working()

    def _with(self, step: Step | None) -> "Dataset":
        return self if step is None else replace(self, steps=(*self.steps, step))

    def impute(self, columns: Sequence[str], method: str = "mean", custom: Mapping[str, str] | None = None) -> "Dataset":
        """Only columns that really change are recorded."""
        fills, _ = cl.fit_impute(self.working(), columns, method, custom)
        return self._with(Step("impute", tuple(fills), fills) if fills else None)

    def standardize(self, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> "Dataset":
        fitted = cl.fit_standardize(self.working(), columns, with_mean, with_std)
        fitted = {n: v for n, v in fitted.items() if v != (0.0, 1.0)}
        return self._with(Step("standardize", tuple(fitted), fitted) if fitted else None)

    def normalize(self, columns: Sequence[str]) -> "Dataset":
        fitted = cl.fit_normalize(self.working(), columns)
        fitted = {n: v for n, v in fitted.items() if v != (0.0, 1.0)}
        return self._with(Step("normalize", tuple(fitted), fitted) if fitted else None)

    def cast(self, column: str, target: str, coerce: bool = False, fraction: str = "abort") -> "Dataset":
        now = self.working()
        if field_type(now, column).simpleString() == cl.canonical_type(target):
            return self
        rounding = fraction in ("ceil", "floor") and cl.canonical_type(target) == "bigint"
        if not coerce and not rounding and not cl.can_convert(now, column, target):
            raise ValueError(f"Column '{column}' cannot be converted to {target}.")
        values = {"type": cl.canonical_type(target), "fraction": fraction if rounding else "abort"}
        return self._with(Step("cast", (column,), values))

    def drop_columns(self, columns: Sequence[str]) -> "Dataset":
        known = tuple(n for n in columns if n in self.working().columns and n != self.row_id)
        return self._with(Step("drop_columns", known) if known else None)

    def drop_missing(self) -> "Dataset":
        return self._with(Step("drop_missing", (), {"ignore": [self.row_id]}))

    def drop_duplicates(self, keep: str = "none") -> "Dataset":
        return self._with(Step("drop_duplicates", (), {"ignore": [self.row_id], "keep": keep, "order_by": [self.row_id]}))

    def revert(self, kind: str, columns: Sequence[str]) -> "Dataset":
        """``kind`` is imputation, cast or transform."""
        now = self.working().columns
        known = tuple(n for n in columns if n in self.raw.columns and n in now)
        return self._with(Step(f"revert_{kind}", known) if known else None)

    def recipe(self) -> list[dict[str, Any]]:
        return [s.to_dict() for s in self.steps]

    def replay(self, recipe: Sequence[Mapping[str, Any]]) -> "Dataset":
        return replace(self, steps=tuple(Step.from_dict(d) for d in recipe))
