"""What every data-dependent operator returns from `fit`."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from martloom.functions.values import quoted


class Plan(Protocol):
    """Learned once on one table, applied lazily to any table with the same columns."""

    def apply(self, df: DataFrame) -> DataFrame: ...


class Stage(Protocol):
    def fit(self, df: DataFrame) -> Plan: ...


@dataclass(frozen=True)
class Identity:
    """The plan learned from a table without rows."""

    def apply(self, df: DataFrame) -> DataFrame:
        return df


@dataclass(frozen=True)
class DropColumns:
    """Drop the named columns; names that are not there are skipped."""

    names: tuple[str, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[quoted(c) for c in df.columns if c not in self.names])
