"""Chains of stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from martloom.functions.values import col
from martloom.operators.narrowing import fit_new_columns
from martloom.operators.plan import Identity, Plan, Stage
from martloom.session import cut

TableFunction = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Call:
    """A plain table -> table function as a plan."""

    function: TableFunction

    def apply(self, df: DataFrame) -> DataFrame:
        return self.function(df)


@dataclass(frozen=True)
class ChainPlan:
    """The plans of a fitted chain, applied in order."""

    plans: tuple[Plan, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        for plan in self.plans:
            df = plan.apply(df)
        return df


@dataclass(frozen=True)
class Chain:
    """Stages or table functions in order; a table without rows passes unchanged.

    The result of the first fitted stage is written once, and the statistics of the stages
    after it, as well as the result, start from there: neither the input (a join, say) nor
    the parsing of texts runs again for every stage.
    """

    steps: tuple[Stage | TableFunction, ...]

    def fit_apply(self, df: DataFrame) -> tuple[ChainPlan, DataFrame]:
        """The fitted plans and the transformed table."""
        if df.isEmpty():
            return ChainPlan((Identity(),)), df
        plans: list[Plan] = []
        fitted = [i for i, step in enumerate(self.steps) if hasattr(step, "fit_apply") or hasattr(step, "fit")]
        for i, step in enumerate(self.steps):
            if fitted[1:2] == [i]:
                df = cut(df, "chain")
            if hasattr(step, "fit_apply"):
                plan, df = step.fit_apply(df)
            else:
                plan = step.fit(df) if hasattr(step, "fit") else Call(step)
                df = plan.apply(df)
            plans.append(plan)
        return ChainPlan(tuple(plans)), df

    def fit(self, df: DataFrame) -> ChainPlan:
        return self.fit_apply(df)[0]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.fit_apply(df)[1]


def narrowing_new(function: TableFunction) -> TableFunction:
    """Wrap a table function: the columns it adds come last, in their narrowest types."""

    def run(df: DataFrame) -> DataFrame:
        out = function(df)
        kept = [c for c in out.columns if c in df.columns]
        new = [c for c in out.columns if c not in df.columns]
        out = out.select(*[col(c) for c in kept + new])
        return fit_new_columns(out, df.columns).apply(out)

    return run
