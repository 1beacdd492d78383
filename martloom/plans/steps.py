"""The standard step chains of the feature mart."""

from __future__ import annotations

from martloom.operators.aggregation import Aggregate
from martloom.operators.correlation import DropCorrelated
from martloom.operators.encoding import EncodeNarrow
from martloom.operators.filters import DropConstant, DropNullHeavy
from martloom.operators.narrowing import Narrow
from martloom.operators.scaling import Scale
from martloom.plans.chain import Chain

# Key and bookkeeping columns that are neither filtered, scaled nor aggregated.
KEY = "case_id"
IGNORE = ("case_id", "date_decision", "MONTH", "WEEK_NUM", "target", "num_group1", "num_group2")


def step1(key: str = KEY, ignore: tuple[str, ...] = IGNORE, date_features: tuple[str, ...] = ("unix",)) -> Chain:
    """Per source table: narrow, drop wide categories, encode, aggregate by key."""
    return Chain(
        (
            Narrow(),
            EncodeNarrow(threshold=11, ignore=ignore, features=date_features),
            Aggregate(key, ignore, stats=("mean", "std")),
        )
    )


def step2(ignore: tuple[str, ...] = IGNORE) -> Chain:
    """On the merged table: drop constant, null-heavy and correlated columns."""
    return Chain(
        (
            DropConstant(ignore=ignore),
            DropNullHeavy(threshold=0.8, ignore=ignore),
            DropCorrelated(threshold=0.9, ignore=ignore),
        )
    )


def step3(ignore: tuple[str, ...] = IGNORE) -> Chain:
    """Standard scaling."""
    return Chain((Scale(ignore=ignore),))
