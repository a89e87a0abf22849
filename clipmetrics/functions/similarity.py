"""Text similarity: exact ratio in Arrow batches, edit-distance form inside the JVM."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clipmetrics.functions import text

_HIDDEN = re.compile(r"\s+|[\u200b-\u200f\ufeff]")
_OTHER = re.compile(r"[^\w\u3400-\u9fff]")


def squeezed(value: str | None) -> str:
    """Without white space and zero-width characters."""
    return _HIDDEN.sub("", value or "")


def comparable(value: str | None) -> str:
    """What the exact ratio compares."""
    return _OTHER.sub("", squeezed(value))


def ratio(a: str, b: str) -> float:
    """Matching-blocks ratio of two comparable texts; empty texts resemble nothing."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def ratio_from(a: str, b: str, floor: float) -> float:
    """ratio(a, b) where it is at least floor, else 0. Pairs whose lengths or letters cannot reach it are not aligned."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < floor:
        return 0.0
    matcher = difflib.SequenceMatcher(None, a, b)
    found = matcher.ratio() if matcher.quick_ratio() >= floor else 0.0
    return found if found >= floor else 0.0


def floored(own: Callable[[str, str], float]) -> Callable[[str, str, float], float]:
    """A ratio as a function that may answer 0 below a floor; the standard one spares the work there."""
    return ratio_from if own is ratio else lambda a, b, floor: own(a, b)


@F.pandas_udf(DoubleType())
def _exact(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = zip(left.map(comparable), right.map(comparable))
    return pd.Series([ratio(a, b) for a, b in pairs], dtype="float64")


def similarity(left: Column, right: Column, mode: str = "native") -> Column:
    """mode exact = matching blocks (Python, Arrow batches); native = 1 - edit distance / longer length."""
    if mode == "exact":
        return _exact(left, right)
    a, b = text.comparable(left), text.comparable(right)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer.cast("double"))
