"""User-defined rolling aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.series import SYMBOL_DAY, Series


def rolling_apply(df: DataFrame, col: str, span: int, fn: Callable[[pd.Series], float], name: str, s: Series = SYMBOL_DAY) -> DataFrame:
    """Any Series-to-number function over the last ``span`` rows, as an Arrow window aggregate.

    Built-in aggregates are far faster; this is for functions Spark does not have.
    """

    def call(x: pd.Series) -> float:
        return float(fn(x.dropna())) if x.notna().any() else None

    call.__annotations__ = {"x": pd.Series, "return": float}
    udaf = F.pandas_udf(call, "double")
    frame = s.last(span)
    return df.withColumn(name, F.when(F.count(col).over(frame) >= span, udaf(F.col(col)).over(frame)))
