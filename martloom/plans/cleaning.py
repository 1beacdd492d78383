"""The configured cleaning job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from martloom.functions.values import is_numeric
from martloom.operators.encoding import OneHotBoolean, ReduceBooleans
from martloom.operators.filters import DropWhere, remove_rows, replace_values
from martloom.operators.narrowing import Narrow, model_cast
from martloom.operators.profile import ColumnStats, profile, table_bytes
from martloom.operators.scaling import Scale, ScalePlan


@dataclass(frozen=True)
class RowRule:
    """Rows go where the condition holds for any of the columns."""

    columns: tuple[str, ...]
    condition: Callable[[Column], Column]


@dataclass(frozen=True)
class ColumnRule:
    """Columns go where the condition holds for their statistics."""

    condition: Callable[[ColumnStats], bool]
    ignore: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValueRule:
    """Values of the columns become `value` where the condition holds."""

    columns: tuple[str, ...]
    condition: Callable[[Column], Column]
    value: object


@dataclass(frozen=True)
class CleaningConfig:
    remove_rows: tuple[RowRule, ...] = ()
    remove_columns: tuple[ColumnRule, ...] = ()
    replace: tuple[ValueRule, ...] = ()
    encode: bool = True
    rename: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Cleaned:
    table: DataFrame
    scaler: ScalePlan
    bytes_before: int
    bytes_after: int

    @property
    def saved_percent(self) -> int:
        return round(100 * (self.bytes_before - self.bytes_after) / self.bytes_before) if self.bytes_before else 0


def tidy(df: DataFrame, config: CleaningConfig) -> DataFrame:
    """Narrow the types and apply the row, column and value rules."""
    df = Narrow(flavour="pandas").fit(df).apply(df)
    for rule in config.remove_rows:
        df = remove_rows(df, list(rule.columns), rule.condition)
    for rule in config.remove_columns:
        df = DropWhere(rule.condition, rule.ignore).fit(df).apply(df)
    for rule in config.replace:
        df = replace_values(df, list(rule.columns), rule.condition, rule.value)
    return df


def clean(df: DataFrame, config: CleaningConfig) -> Cleaned:
    """Tidy, encode, rename, reduce the boolean columns, scale, cast; with the size saved."""
    before = profile(df, want=("bytes",))
    out = tidy(df, config)
    if config.encode:
        out = OneHotBoolean().fit(out).apply(out)
    out = out.withColumnsRenamed(config.rename)
    out = ReduceBooleans().fit(out).apply(out)
    scaler = Scale().fit(out)
    out = scaler.apply(out)
    out = model_cast(out, [f.name for f in out.schema.fields if is_numeric(f.dataType)])
    after = profile(out, want=("bytes",))
    return Cleaned(out, scaler, table_bytes(before), table_bytes(after))
